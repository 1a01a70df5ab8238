"""Cutting lineage in loops with reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their history; the folder is the session's spark.checkpoint.dir."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="factloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def gather(parts: list[tuple[int, DataFrame]], new: DataFrame, width: int = 8) -> list[tuple[int, DataFrame]]:
    """The parts (level, rows) of a growing union with new added; ``width`` parts of a level become one cut part of the next.

    After n rounds there are at most width * log(n) parts, and each row was written log(n) times.
    """
    parts = [*parts, (0, new)]
    while len(parts) >= width and parts[-1][0] == parts[-width][0]:
        merged = cut(union(parts[-width:]))
        parts = [*parts[:-width], (parts[-1][0] + 1, merged)]
    return parts


def union(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows for _, rows in parts])
