"""Sinks: JSON, CSV, text, HTML and DOT of a chronology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADERS = ("Date", "Precision", "Event", "Status", "Sources", "Quotes", "Disputed values", "Confidence")


def export_rows(events: DataFrame) -> DataFrame:
    """Eight columns; quotes joined by |, disputed values as 'value (docs)', confidence to two places.

    events: date, precision, label, status, sources array of struct(doc_id, fact_id, quote), disputed_values, confidence.
    """
    disputed = F.transform(F.coalesce("disputed_values", F.array().cast("array<struct<date:date,docs:array<string>>>")), lambda d: F.concat(F.date_format(d["date"], "yyyy-MM-dd"), F.lit(" ("), F.array_join(d["docs"], ", "), F.lit(")")))
    columns = (
        F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")), F.col("precision"), F.col("label"), F.col("status"), F.array_join(F.array_distinct(F.transform("sources", lambda s: s["doc_id"])), "; "),
        F.array_join(F.filter(F.transform("sources", lambda s: s["quote"]), lambda q: q != ""), " | "), F.array_join(disputed, "; "), F.format_string("%.2f", "confidence"),
    )
    return events.select(*[c.alias(n) for c, n in zip(columns, HEADERS)])


def footer(version: str, extractor: str, built_at: str, counts: dict[str, int]) -> list[str]:
    """X21."""
    return [f"version {version}", f"extractor {extractor}", f"built {built_at}", ", ".join(f"{n} {k}" for k, n in counts.items()), "Dates are as the documents state them; check each against its source."]


def write_csv(events: DataFrame, path: str) -> None:
    """One file with a header. A chronology is the small end of a run."""
    export_rows(events).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(events: DataFrame, path: str) -> None:
    """S20."""
    events.coalesce(1).write.mode("overwrite").json(path)


def write_parquet(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").parquet(path)


#: S25. Spreadsheet and word-processor files need libraries that are not here.
EXPORTERS = {"csv": write_csv, "json": write_json, "parquet": write_parquet}


def escaped(text: Column) -> Column:
    """HTML-escaped text."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def render_line(results: DataFrame) -> DataFrame:
    """One line for each checked rule."""
    days = F.when(F.col("days_over") > 0, F.format_string(", %d days late", "days_over")).otherwise("")
    text = F.when(F.col("verdict") == "INDETERMINATE", F.concat(F.lit("INDETERMINATE: needs "), F.coalesce("request", F.lit("more facts"))))
    return results.select("doc_id", "dep_pos", text.otherwise(F.concat("verdict", F.lit(": due "), F.date_format("deadline", "yyyy-MM-dd"), F.lit(", done "), F.date_format("action_date", "yyyy-MM-dd"), days)).alias("line"))


def render_html(results: DataFrame) -> DataFrame:
    """A table row for each checked rule."""
    cells = [escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("verdict", "anchor_date", "deadline", "action_date", "days_over")]
    return results.select("doc_id", "dep_pos", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")).alias("html"))


def dot_edges(claims: DataFrame, derived: DataFrame) -> DataFrame:
    """DOT lines from documents to events, derived edges dashed."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit("'")), F.lit('"'))
    plain = claims.select(F.concat_ws(" -> ", quoted("doc_id"), quoted("event_id")).alias("line"))
    return plain.union(derived.select(F.concat(F.concat_ws(" -> ", quoted("src"), quoted("dst")), F.lit(" [style=dashed]")).alias("line")))


def context_block(events: DataFrame) -> DataFrame:
    """One text for each event of a selected context."""
    when = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("undated"))
    mark = F.when(F.col("status") == "disputed", " [DISPUTED]").when(F.col("status") == "derived", " [derived]").otherwise("")
    return events.select("date", "label", F.concat(F.lit("- "), when, F.lit(": "), "label", mark).alias("line")).orderBy(F.col("date").asc_nulls_last(), "label")
