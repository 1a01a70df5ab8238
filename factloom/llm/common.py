"""What the operators of this subpackage share: reading tables and mapping record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns never reach an operator."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, record batches hold at most ``rows`` rows, where a row is long; for plans that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of about ``most_bytes``, a row at least, so that Python objects are made of few rows at a time."""
    for batch in batches:
        rows = max(1, min(most_rows, most_bytes * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    # What a batch took goes back to the system; the worker lives on.
    pa.default_memory_pool().release_unused()


def map_rows(df: DataFrame, schema: str, per_batch: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow with a function from a record batch to columns by name.

    Batches come in slices, none without rows. The function is called on executors;
    what it caches at module level lives as long as the Python worker.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = per_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in target],
                schema=target,
            )

    return df.mapInArrow(run, schema)


def most_counted(counted: DataFrame, most: int, least: int) -> DataFrame:
    """The rows of the highest counts (column c): ``most`` at most, all of those above some count from ``least`` on.

    The bar comes from a histogram of eight steps to each doubling (some hundred rows), so
    that no task sends more than what is kept, however many tasks there are.
    """
    kept = cut(counted.where(F.col("c") >= least).withColumn("_step", F.floor(F.log2("c") * 8)).hint("rebalance"))
    bar, total = None, 0
    for row in kept.groupBy("_step").agg(F.count("*").alias("n")).sort(F.desc("_step")).collect():
        total += row["n"]
        if total > most:
            break
        bar = row["_step"]
    return kept.where(F.lit(False) if bar is None else F.col("_step") >= bar).drop("_step")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null becomes the empty string."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]
