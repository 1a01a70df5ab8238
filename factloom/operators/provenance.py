"""Provenance: are quotes and stated periods in the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.calendar import let, offset_from_text
from factloom.functions.text import clauses, flat, quote_supported, stated_offsets, tokens
from factloom.sources.bundles import source_hash


def check_facts(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with ``verified``; null where the document has no usable text."""
    source = documents.select("doc_id", "source_text")
    usable = F.length(flat(F.col("source_text"))) >= 12
    return facts.join(source, "doc_id", "left").withColumn("verified", F.when(usable, quote_supported(F.col("source_text"), F.col("sentence"), F.col("raw_text")))).drop("source_text")


def document_report(checked: DataFrame) -> DataFrame:
    """Supported and unsupported facts of each document."""
    return checked.groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if("verified").alias("supported"), F.sort_array(F.collect_set(F.when(~F.col("verified"), F.col("fact_id")))).alias("unsupported"))


def check_relations(deps: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Deps with relation_verdict: supported, offset-not-in-source, anchor-not-in-clause.

    Null where an additive edge states no period or the document has no usable text. The period
    is that of the edge's text, else delta_days as days; its clause must share a word with the anchor.
    """
    # A document's clauses are read once, not at each of its edges: words and periods of those that state one.
    weeks = lambda p: F.struct(F.when(p["unit"] == "week", p["n"] * 7).otherwise(p["n"]).alias("n"), F.when(p["unit"] == "week", "day").otherwise(p["unit"]).alias("unit"))
    stated = F.transform(clauses(F.col("source_text")), lambda c: F.struct(c.alias("c"), F.transform(stated_offsets(c), weeks).alias("p")))
    read = F.transform(F.filter(stated, lambda x: F.size(x["p"]) > 0), lambda x: F.struct(tokens(x["c"]).alias("w"), x["p"].alias("p")))
    usable = F.length(flat(F.col("source_text"))) >= 12
    own = documents.select("doc_id", F.when(usable, read).alias("_read"))
    anchor = facts.select("doc_id", F.col("fact_id").alias("from_id"), tokens(F.col("entity")).alias("_anchor"))
    o = F.col("_o")
    unit = F.when(o["years"] > 0, "year").when(o["months"] > 0, "month").otherwise("day")
    n = F.coalesce(F.when(unit == "year", o["years"]).when(unit == "month", o["months"]).otherwise(o["days"]), F.abs("delta_days"))
    # One period for each edge; edges of other types need none.
    periods = deps.withColumn("_o", F.when(F.col("constraint_type") == "additive", offset_from_text(F.col("constraint_expr"))))
    periods = periods.withColumns({"_n": F.when(F.col("constraint_type") == "additive", n), "_unit": unit}).drop("_o")
    joined = periods.join(own, "doc_id", "left").join(anchor, ["doc_id", "from_id"], "left")
    same = lambda p: (p["n"] == F.col("_n")) & (p["unit"] == F.col("_unit"))
    near = lambda stating: F.exists(stating, lambda x: F.arrays_overlap(x["w"], F.col("_anchor")))
    verdict = lambda stating: F.when(F.size(stating) == 0, "offset-not-in-source").when(~near(stating), "anchor-not-in-clause").otherwise("supported")
    judged = let(F.filter("_read", lambda x: F.exists(x["p"], same)), verdict)
    checkable = F.col("_n").isNotNull() & F.col("_read").isNotNull()
    return joined.withColumn("relation_verdict", F.when(checkable, judged)).drop("_read", "_anchor", "_n", "_unit")


def trusted(checked: DataFrame) -> DataFrame:
    """edges without a checkable period, or with a supported one."""
    return checked.where(F.col("relation_verdict").isNull() | (F.col("relation_verdict") == "supported"))


def hash_verdict(text: Column, stated: Column) -> Column:
    """P04."""
    has = F.coalesce(F.length(text) > 0, F.lit(False))
    return F.when(has & stated.isNotNull(), F.when(source_hash(text) == F.lower(stated), "match").otherwise("mismatch")).when(stated.isNotNull(), "hash-only").when(has, "text-only").otherwise("neither")


def matter_report(documents: DataFrame) -> DataFrame:
    """P07, A15."""
    return documents.agg(F.count_if(F.col("matter").isNotNull()).alias("declared"), F.count_if(F.size("parties") > 0).alias("named"), F.count("*").alias("total"), F.count_distinct("matter").alias("matters"))


def relation_report(checked: DataFrame) -> DataFrame:
    """The checked edges in order of document and start."""
    return checked.where(F.col("relation_verdict").isNotNull()).select("doc_id", "from_id", "to_id", "relation_verdict").orderBy("doc_id", "from_id", "to_id")


def relation_counts(checked: DataFrame) -> DataFrame:
    """Edges of each document by verdict."""
    verdict = F.col("relation_verdict")
    return checked.groupBy("doc_id").agg(F.count_if(verdict.isNotNull()).alias("checked"), F.count_if(verdict == "supported").alias("supported"), F.count_if((verdict == "offset-not-in-source") | (verdict == "anchor-not-in-clause")).alias("unsupported"))
