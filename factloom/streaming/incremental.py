"""Incremental mode: an extension beyond batch runs, by matter group.

Groups are independent, so a micro-batch of new facts recomputes only the events of
the groups it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and time window, for a stream or a table; a stream drops what comes later than ``late``."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def follow_facts(spark: SparkSession, folder: str, schema: str, state: str, recompute: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Appends new facts to ``state``/facts and replaces the events of touched groups in ``state``/events.

    ``state`` is partitioned by grp; only touched partitions are read and overwritten, so a batch
    that runs again after a failure gives the same tables.
    """

    def batch(new: DataFrame, number: int) -> None:
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(f"{state}/facts")
        touched = new.select("grp").distinct()
        facts = spark.read.schema(f"{schema}, batch int").parquet(f"{state}/facts").drop("batch").join(touched, "grp", "left_semi")
        recompute(facts).write.mode("overwrite").partitionBy("grp").option("partitionOverwriteMode", "dynamic").parquet(f"{state}/events")

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
