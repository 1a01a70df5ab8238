"""Corrections: an append-only log applied to facts; the last of each kind wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.schemas import CORRECTION_OPS

CLASS_OF = {"accept": "state", "reject": "state", "edit_date": "date", "edit_label": "label"}


def last_of_each(log: DataFrame) -> DataFrame:
    """The last correction of each fact and class."""
    kind = F.create_map(*[F.lit(x) for p in CLASS_OF.items() for x in p])[F.col("op")]
    w = Window.partitionBy("doc_id", "fact_id", "class").orderBy(F.desc("pos"))
    return log.withColumn("class", kind).where(F.col("class").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Rejected facts go, dates and labels change, accepted facts are marked; inputs stay as they are."""
    last = last_of_each(log).groupBy("doc_id", "fact_id").agg(
        F.max(F.when(F.col("class") == "state", F.col("op"))).alias("_state"), F.max(F.when(F.col("class") == "date", F.col("new_date"))).alias("_date"), F.max(F.when(F.col("class") == "label", F.col("new_label"))).alias("_label"),
    )
    joined = facts.join(last, ["doc_id", "fact_id"], "left").where(F.coalesce("_state", F.lit("")) != "reject")
    new = F.try_to_timestamp("_date", F.lit("yyyy-MM-dd")).cast("date")
    return joined.withColumns({
        "date_parsed": F.coalesce(new, "date_parsed"), "value": F.coalesce("_date", "value"), "entity": F.coalesce("_label", "entity"),
        "accepted": F.coalesce(F.col("_state") == "accept", F.lit(False)), "confidence": F.when(F.col("_state") == "accept", 1.0).otherwise(F.col("confidence")),
    }).drop("_state", "_date", "_label")


def merges_and_splits(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forced merges as pairs a, b of 'doc:fact' keys, and split keys."""
    keys = F.transform("keys", lambda k: F.array_join(k, ":"))
    merges = log.where("op = 'merge'").select(F.element_at(keys, 1).alias("a"), F.explode(F.slice(keys, 2, 1 << 20)).alias("b"))
    return merges, log.where("op = 'split'").select(F.explode(keys).alias("key"))


def export_gold(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """the log's known corrections as JSON lines without empty fields; ``keep`` names columns to return beside them."""
    return log.where(F.col("op").isin(*CORRECTION_OPS)).select(*keep, F.to_json(F.struct(*[c for c in log.columns if c != "pos"]), {"ignoreNullFields": "true"}).alias("value"))
