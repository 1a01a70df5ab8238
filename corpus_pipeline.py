"""The corpus pipeline: toxic documents go, one of each group of near-duplicates
stays, sources are mixed to their target weights, and the mix is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` cuts the lineage between stages with
a checkpoint, as a runner that writes and rereads Parquet does.

Defined cases, as in the operators: null or empty text is not toxic by itself and has no
words, so it stays through the first two stages (once for each id and text) and the mix takes
nothing of it. Repeated rows leave one row. A null id or source is an id or source like any
other. An empty table passes through all stages. Columns beyond those of ``documents`` stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe_lexicon, mixing, near_dup, toxicity
from factloom.lineage import cut
from factloom.llm.common import table


def few_rows(spark: SparkSession, rows: int = 1024) -> None:
    """This application's session hands whole texts to Python in small batches, so that a worker and the JVM hold few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity operator predicts as toxic."""
    few_rows(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    few_rows(spark)
    return near_dup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each source gives to the mix, a row for each document and pass."""
    few_rows(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each row, by their hashes."""
    few_rows(spark)
    return bpe_lexicon.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
