"""Events: clusters of facts, their status and the chronology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.calendar import precision, value_interval
from factloom.lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Key, label (the smallest key it reaches) for all ends of the edges.

    Labels spread to neighbours and then jump to their own label's label, so long
    chains take a logarithmic number of rounds.
    """
    both = cut(edges.select(F.col(a).alias("key"), F.col(b).alias("other")).union(edges.select(b, a)).distinct())
    labels = cut(both.groupBy("key").agg(F.min("other").alias("o")).select("key", F.least("key", "o").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("label").alias("near"))
        moved = labels.join(near, "key").select("key", "label", F.least("label", "near").alias("next"))
        far = labels.select(F.col("key").alias("next"), F.col("label").alias("far"))
        after = cut(moved.join(far, "next", "left").select("key", "label", F.least("next", F.coalesce("far", "next")).alias("new")))
        changed = after.where(F.col("new") != F.col("label")).limit(1).count()
        labels = after.select("key", F.col("new").alias("label"))
        if not changed:
            return labels


def cluster_facts(facts: DataFrame, links: DataFrame, force: DataFrame | None = None, split: DataFrame | None = None) -> DataFrame:
    """Facts with ``cluster``: duplicates, links and forced merges join; split keys stand alone.

    facts: key, duplicate_key (of the fact that it repeats, or null). links, force: a, b. split: key.
    """
    edges = links.select("a", "b").union(facts.where(F.col("duplicate_key").isNotNull()).select("key", "duplicate_key"))
    edges = edges.union(force.select("a", "b")) if force is not None else edges
    if split is not None:
        for side in ("a", "b"):
            edges = edges.join(split.select(F.col("key").alias(side)), side, "left_anti").select("a", "b")
    return facts.join(components(edges), "key", "left").withColumn("cluster", F.coalesce("label", "key")).drop("label")


def classify(facts: DataFrame, contradicted: DataFrame | None = None) -> DataFrame:
    """One row for each cluster.

    facts: cluster, doc_id, pos, entity, role, date_parsed, value, duration_days, confidence,
    temporal_content, verified (its quote is in its source), derivation. contradicted: clusters
    that hold a contradiction link. In order: no temporal content, several dates, values that
    exclude each other, one date derived, agreed by several verified documents, or from a
    single source, a month or year (agreed by several sources), no date.
    """
    span = value_interval(F.col("value"))
    prepared = facts.withColumns({"lo": span["lo"], "hi": span["hi"], "grain": precision(F.col("date_parsed"), F.col("value"), F.col("duration_days"))})
    ranked = F.struct(F.col("confidence"), F.length("entity"), (-F.col("pos")).alias("p"))
    coarse = F.col("grain").isin("month", "year")
    # Rows are shuffled once, by cluster; a cluster's dates and then the cluster are made of them where they are, and no row is multiplied.
    dated = prepared.repartition("cluster").groupBy("cluster", "date_parsed").agg(
        F.sort_array(F.collect_set("doc_id")).alias("docs"), F.collect_set(F.when(F.col("verified"), F.col("doc_id"))).alias("ok_docs"), F.count("*").alias("n_sources"),
        F.every(~F.col("temporal_content")).alias("without_time"), F.every(F.col("derivation").isNotNull()).alias("all_derived"), F.bool_or(F.col("grain") == "relative").alias("relative"),
        F.max("derivation").alias("derivation"), F.min("confidence").alias("confidence"), F.max(F.struct(ranked.alias("by"), "entity", "role")).alias("best"), F.max("lo").alias("latest_start"), F.min("hi").alias("earliest_end"),
        F.min(F.when(coarse, F.col("lo"))).alias("coarse_date"), F.min(F.when(coarse, F.col("grain"))).alias("coarse_grain"), F.min("duration_days").alias("least"), F.max("duration_days").alias("most"), F.min("pos").alias("pos"),
    )
    values = F.when(F.col("date_parsed").isNotNull(), F.struct(F.col("date_parsed").alias("date"), "docs"))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    grouped = dated.groupBy("cluster").agg(
        F.min("date_parsed").alias("first_date"), F.count("date_parsed").alias("n_dates"), distinct("docs").cast("long").alias("n_docs"), distinct("ok_docs").alias("n_verified"), F.sum("n_sources").alias("n_sources"),
        F.every("without_time").alias("without_time"), F.every("all_derived").alias("all_derived"), F.bool_or("relative").alias("relative"), F.max("derivation").alias("derivation"), F.min("confidence").alias("confidence"),
        F.max("best").alias("best"), F.max("latest_start").alias("latest_start"), F.min("earliest_end").alias("earliest_end"), F.min("coarse_date").alias("coarse_date"), F.min("coarse_grain").alias("coarse_grain"),
        F.when(F.min("least") < F.max("most"), 2).otherwise(1).alias("n_durations"), F.min("pos").alias("pos"), F.sort_array(F.collect_list(values)).alias("dates"),
    ).withColumns({"entity": F.col("best.entity"), "role": F.col("best.role"), "dates": F.when(F.col("n_dates") > 0, F.col("dates"))})
    if contradicted is not None:
        grouped = grouped.join(contradicted.select("cluster", F.lit(True).alias("_c")).distinct(), "cluster", "left")
    else:
        grouped = grouped.withColumn("_c", F.lit(None).cast("boolean"))
    conflict = (F.col("n_dates") > 1) | (F.coalesce("_c", F.lit(False)) & (F.col("n_dates") > 0))
    apart = (F.col("n_dates") < 2) & ((F.col("latest_start") > F.col("earliest_end")) | ((F.col("n_durations") > 1) & F.col("latest_start").isNull()))
    status = (
        F.when(F.col("without_time"), "unplaced").when(conflict | apart, "disputed").when((F.col("n_dates") == 1) & F.col("all_derived"), "derived")
        .when((F.col("n_dates") == 1) & (F.col("n_sources") > 1) & (F.col("n_verified") > 1), "agreed").when(F.col("n_dates") == 1, "single_source")
        .when(F.col("coarse_date").isNotNull() & (F.col("n_sources") > 1), "agreed").when(F.col("coarse_date").isNotNull(), "single_source").otherwise("unplaced")
    )
    reason = F.when(status != "unplaced", None).when(F.col("without_time"), "no temporal content").when(F.col("relative"), "relative expression not yet resolved").otherwise("no date found")
    grain = F.when(F.col("n_dates") > 0, "day").otherwise(F.coalesce("coarse_grain", F.when(F.col("relative"), "relative").otherwise("none")))
    label = F.concat("entity", F.when(F.col("role").isin("START", "END"), F.concat(F.lit(" ("), F.lower("role"), F.lit(")"))).otherwise(""))
    return grouped.select(
        "cluster", F.coalesce("first_date", "coarse_date").alias("date"), grain.alias("precision"), label.alias("label"), status.alias("status"), reason.alias("reason"), "confidence",
        F.when(status == "derived", F.col("derivation")).alias("derivation"), "n_docs", "n_sources", F.when(status == "disputed", F.col("dates")).alias("disputed_values"), "pos",
    )


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 1 in this order, without one task for all: a sort by ranges, a count for each, its start."""
    ranged = cut(rows.orderBy(*order)).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")  # one row for each partition


def chronology(events: DataFrame) -> DataFrame:
    """Ids in order of first appearance, then rows in order of date and label."""
    placed = numbered(events, ["pos", "cluster"], "_place").withColumn("event_id", F.format_string("ev%03d", "_place")).drop("_place")
    return placed.orderBy(F.col("date").asc_nulls_last(), "label", "event_id")


def run_counts(events: DataFrame) -> DataFrame:
    """A10."""
    placed = F.col("status") != "unplaced"
    return events.agg(F.count_if(placed).alias("events"), F.count_if(F.col("status") == "disputed").alias("disputed"), F.count_if(~placed).alias("unplaced"))
