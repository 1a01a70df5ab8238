"""Context selection, passages, answers and exploration."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.functions.calendar import active_on
from factloom.functions.text import NO_WORD, SENTENCE_END, flat, mentions_date, token_set, tokens


def select_events(events: DataFrame, about: str = "", since: str | None = None, until: str | None = None, on: str | None = None, limit: int | None = None) -> DataFrame:
    """Events on or between dates whose words meet the question's; null dates fail date tests."""
    out = events
    if on:
        out = out.where(F.col("date") == F.lit(on).cast("date"))
    if since:
        out = out.where(F.col("date") >= F.lit(since).cast("date"))
    if until:
        out = out.where(F.col("date") <= F.lit(until).cast("date"))
    if about:
        words = F.concat_ws(" ", "label", "quotes") if "quotes" in events.columns else F.col("label")
        out = out.where(F.arrays_overlap(token_set(words), token_set(F.lit(about))))
    return out.orderBy("date", "label").limit(limit) if limit else out


def passages(documents: DataFrame, question: str, limit: int = 8) -> DataFrame:
    """Sentences that share words with the question, by their weight."""
    asked = F.array(*map(F.lit, sorted(set(documents.sparkSession.range(1).select(token_set(F.lit(question))).first()[0]))))
    n = documents.select(F.count("*").alias("docs"))
    met = lambda t: F.array_intersect(F.split(F.lower(t), NO_WORD), asked)
    df = documents.select(F.explode(met(F.col("source_text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    weights = df.join(F.broadcast(n), F.lit(True)).agg(F.map_from_entries(F.collect_list(F.struct("token", scores.idf(F.col("df"), F.col("docs"))))).alias("weights"))  # one row, an entry for each word of the question
    # Scores and the best of a document need no exchange; places in the text are summed for these only.
    scored = lambda p, i: F.struct(p.alias("p"), i.alias("i"), met(p).alias("hit"))
    total = lambda x: F.aggregate(x["hit"], F.lit(0.0), lambda a, w: a + F.col("weights")[w])
    size = lambda x: F.size(token_set(flat(x["p"])))
    judged = lambda x: F.struct((-scores.passage_score(total(x), size(x))).alias("s"), x["i"].alias("i"), x["p"].alias("p"))
    hits = F.transform(F.filter(F.transform("parts", scored), lambda x: F.size(x["hit"]) > 0), judged)
    own = documents.select("doc_id", F.split("source_text", SENTENCE_END).alias("parts")).join(F.broadcast(weights), F.lit(True))
    best = own.select("doc_id", F.transform("parts", F.length).alias("lengths"), F.slice(F.array_sort(hits), 1, limit).alias("best")).select("doc_id", "lengths", F.explode("best").alias("x"))
    start = F.aggregate(F.slice("lengths", F.lit(1), F.col("x.i")), F.lit(0), lambda a, v: a + v) + F.length("x.p") - F.length(F.ltrim("x.p"))
    return best.select("doc_id", start.alias("start"), flat(F.col("x.p")).alias("sentence"), (-F.col("x.s")).alias("score")).orderBy(F.desc("score"), "doc_id", "start").limit(limit)


def unsupported_dates(answer_dates: DataFrame, established: DataFrame) -> DataFrame:
    """Dates of an answer that no established event has."""
    return answer_dates.select("date").distinct().join(established.select("date").distinct(), "date", "left_anti")


def missed_dates(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Date expressions of the raw text that no fact accounts for, first of each value."""
    known = facts.select("doc_id", F.explode(F.array_compact(F.array(F.col("value"), F.date_format("date_parsed", "yyyy-MM-dd")))).alias("value")).distinct()
    open_ = found.where((F.col("timex_type") != "DURATION") & F.col("value").isNotNull()).join(known, ["doc_id", "value"], "left_anti")
    w = Window.partitionBy("doc_id", "value").orderBy("start")
    return open_.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def entity_interval(facts: DataFrame, query: str | Column) -> DataFrame:
    """Each document's interval of the entities whose name holds the query."""
    q = F.lit(query) if isinstance(query, str) else query
    own = facts.where(F.col("date_parsed").isNotNull() & F.contains(F.lower("entity"), F.lower(q)))
    return own.groupBy("doc_id").agg(F.min(F.when(F.col("role") == "START", F.col("date_parsed"))).alias("start"), F.max(F.when(F.col("role") == "END", F.col("date_parsed"))).alias("end"))


def holds_on(facts: DataFrame, query: str, on: str) -> DataFrame:
    """D15."""
    return entity_interval(facts, query).withColumn("holds", active_on(F.col("start"), F.col("end"), F.lit(on).cast("date")))


def compare_documents(claims: DataFrame, doc_a: str, doc_b: str) -> DataFrame:
    """event_id, date_a, date_b, verdict. claims: event_id, doc_id, date."""
    side = lambda d, n: claims.where(F.col("doc_id") == d).groupBy("event_id").agg(F.min("date").alias(n))
    joined = side(doc_a, "date_a").join(side(doc_b, "date_b"), "event_id", "full_outer")
    verdict = F.when(F.col("date_b").isNull(), "only in A").when(F.col("date_a").isNull(), "only in B").when(F.col("date_a") == F.col("date_b"), "same").otherwise("different")
    return joined.withColumn("verdict", verdict)


def contradiction_report(links: DataFrame) -> DataFrame:
    """A12."""
    return links.where(F.col("link_type") == "contradiction").groupBy("from_doc", "to_doc").agg(F.count("*").alias("contradictions"))


def claims(events_with_sources: DataFrame) -> DataFrame:
    """A row for each event and source; a source without a date takes the event's."""
    rows = events_with_sources.select("event_id", "status", F.col("date").alias("event_date"), F.explode("sources").alias("s"))
    return rows.select("event_id", "status", "s.doc_id", "s.fact_id", F.coalesce("s.date", "event_date").alias("date")).where(F.col("date").isNotNull())


def states_date(text: Column, date: Column) -> Column:
    """Whether an answer states a date in any usual form."""
    return mentions_date(text, date)


def question_words(question: Column) -> Column:
    return F.array_distinct(tokens(question))


def missed_totals(missed: DataFrame) -> DataFrame:
    """Missed dates of each document."""
    return missed.groupBy("doc_id").agg(F.count("*").alias("missed"))


def verdict_counts(compared: DataFrame) -> DataFrame:
    """A18."""
    return compared.groupBy("verdict").agg(F.count("*").alias("n"))


def filter_events(events: DataFrame, text: str = "", statuses: tuple[str, ...] = (), since: str | None = None, until: str | None = None) -> DataFrame:
    """rows of which some column holds the text, of these statuses, between dates; rows without a date stay."""
    out = events
    if text:
        held = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in events.columns]
        out = out.where(reduce(or_, held))
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    for bound, inside in ((since, lambda d: F.col("date") >= d), (until, lambda d: F.col("date") <= d)):
        if bound:
            out = out.where(F.col("date").isNull() | inside(F.lit(bound).cast("date")))
    return out


def chart_spans(claimed: DataFrame) -> DataFrame:
    """First and last date of each event and status where they differ, in order of the event's first date."""
    spans = claimed.groupBy("event_id", "status").agg(F.min("date").alias("first"), F.max("date").alias("last")).where(F.col("first") < F.col("last"))
    return spans.orderBy("first", "event_id")


def resolve_texts(documents: DataFrame, files: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, text, found_in: the graph's own text if it is over ``least`` characters, else the file of that stem, else the only file of which one name begins with the other; never a guess.

    files: stem, text. Names meet at their prefixes, so no document is tried with every file.
    """
    own = documents.select("doc_id", F.trim("source_text").alias("own"))
    exact = own.join(files.select(F.col("stem").alias("doc_id"), F.col("text").alias("exact")), "doc_id", "left")
    # Only prefixes as long as some name of the other side can meet it; one row of lengths each.
    lengths = lambda df, c: F.broadcast(df.agg(F.collect_set(F.length(c)).alias("_lengths")))
    prefixes = lambda c: F.explode(F.transform(F.filter("_lengths", lambda n: (n > 0) & (n <= F.length(c))), lambda n: F.substring(c, F.lit(1), n)))
    longer = files.join(lengths(own, "doc_id"), F.lit(True)).select("stem", prefixes(F.col("stem")).alias("doc_id")).where(F.length("stem") > F.length("doc_id"))
    named = own.where(F.col("doc_id") != "").select("doc_id").join(lengths(files, "stem"), F.lit(True)).select("doc_id", prefixes(F.col("doc_id")).alias("stem"))
    shorter = named.join(files.select("stem"), "stem").select("stem", "doc_id")
    # A document with one such file has the same first and last.
    loose = longer.union(shorter).groupBy("doc_id").agg(F.min("stem").alias("stem"), F.max("stem").alias("_last")).where(F.col("stem") == F.col("_last")).drop("_last")
    loose = loose.join(files.select("stem", F.col("text").alias("loose")), "stem").select("doc_id", F.col("stem").alias("loose_stem"), "loose")
    out = exact.join(loose, "doc_id", "left")
    has = F.coalesce(F.length("own") > least, F.lit(False))
    found = F.when(has, "graph").when(F.col("exact").isNotNull(), "exact file").when(F.col("loose").isNotNull(), "only similar file")
    return out.select("doc_id", F.when(has, F.col("own")).otherwise(F.coalesce("exact", "loose")).alias("text"), found.alias("found_in"))


def prompt(question: str, context: DataFrame, found: DataFrame) -> DataFrame:
    """Q04: one row, text: the established lines first, then the passages with their documents, then the question.

    context: line, in its order (date, label); found: doc_id, sentence, score of the best passages, which a limit bounds.
    """
    lines = context.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("date", F.lit("9999-12-31").cast("date")).alias("d"), "label", "line"))).alias("l"))
    quoted = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit('] "'), "sentence", F.lit('"'))
    said = found.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "start", quoted.alias("q")))).alias("p"))
    body = F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["q"]), "\n")).otherwise("(no passage matches the question)")
    text = F.concat_ws("\n", F.lit("Established dates:"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(""), F.lit("Passages:"), body, F.lit(""), F.lit(f"Question: {question}"))
    return lines.join(F.broadcast(said), F.lit(True)).select(text.alias("text"))  # one row each
