"""Mixing sources to target weights, with DataFrame and SQL functions only.

A document's size is its number of words. The words of a source stand in one
stream (documents in a fixed pseudorandom order), packed into blocks of
``block_words``; the source's last block may be shorter. A source takes as many
words as its rounded target: whole passes over its blocks, then blocks of one
more pass, the last of them cut to the word. In each pass the slots map to blocks
through a pseudorandom permutation of the source's full blocks (the swap-or-not
shuffle, a bijection on any range); the short block comes last.

Each slot draws its output shard by itself, all shards alike, by a hash of seed,
source and slot. The numbers of slots that a source has in the shards are thereby
multinomial, without a loop over shards, state or collecting. Slots meet blocks by
(source, index).

Scale. The text is read once; sizes go to a checkpoint. A document's place in its
source's stream is a prefix sum in two steps, over hash buckets and within one
bucket of about ``bucket_rows`` documents, so a source with a third of all rows is
spread over all buckets. Only the
table of sources (one row a source) passes through a single task. It is broadcast
up to ``broadcast_sources`` rows; beyond that, joins with it are salted.

Defined cases: null text has size 0 and takes nothing; null is a source, the
last; repeated rows are documents of their own; a source of size 0 has target 0;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.llm.common import table

WORD = "[^\\x20\\x09-\\x0D]+"
# Weights of the sources in order, repeating; share and cap as parts of the sizes.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2


@dataclass(frozen=True)
class Mix:
    """documents: a row for each, with its place; sources: targets; slots: what is drawn."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    n_sources: int
    block_words: int
    broadcast_sources: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _with_sources(df: DataFrame, sources: DataFrame, n_sources: int, most: int, on: str, spread: Column) -> DataFrame:
    """df joined with the table of sources, null-safe, and without a hot key."""
    names = [c for c in sources.columns if c != on]
    right = sources.withColumnRenamed(on, "_on")
    if n_sources <= most:
        return df.join(F.broadcast(right), df[on].eqNullSafe(F.col("_on"))).select(*df.columns, *names)
    salts = 64
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn("_spread", F.pmod(spread, F.lit(salts)).cast("int"))
    return left.join(right, left[on].eqNullSafe(right["_on"]) & (left["_spread"] == right["_salt"])).select(*df.columns, *names)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_no, source_size, target from source and source_size.

    Sources are filled in order of cap over weight: one is capped as long as its
    part of what the sources before it left over is at least its cap.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    capped = F.col("cap") <= F.col("left") / F.col("weights_left") * F.col("weight")
    return (
        sizes.withColumn("source_no", F.row_number().over(by_name).cast("long") - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * cap)
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("is_capped", capped)
        .withColumn("rest", F.col("all") - F.sum(F.when(F.col("is_capped"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("is_capped"), 0.0).otherwise(F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("is_capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("rest") * F.col("weight") / F.col("open"))))
        .select("source", "source_no", "source_size", "target")
    )


def permuted(place: Column, size: Column, *keys: Column, rounds: int = 24) -> Column:
    """A pseudorandom permutation of 0 .. size - 1 applied to place.

    Each round pairs x with key - x (mod size) and swaps the pair or not by a
    hash of its larger member, so each round is a bijection.
    """

    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *keys), size) - x, size)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), r, *keys), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("long"), one)


def _drawn_slots(plan: DataFrame, levels: int, seed: int, together: int = 1 << 14) -> DataFrame:
    """shard, source_no, slot from source_no and n_slots; shards are 0 .. 2**levels - 1.

    Runs of ``together`` slots are dealt to tasks before they unfold.
    """
    run, first = F.lit(together).cast("long"), F.col("run") * together
    runs = plan.where("n_slots > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / run))))
    # The number is given, since rows are few before they unfold to slots and would be put together.
    dealt = runs.repartition(max(1, min((1 << levels) // 16, 20_000)), "source_no", "run")
    slots = dealt.select(*plan.columns, F.explode(F.sequence(first, F.least(first + run, "n_slots") - 1)).alias("slot"))
    return slots.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "source_no", "slot"), F.lit(1 << levels)))


def mix(docs: DataFrame, block_words: int = 512, shard_slots: int = 1024, seed: int = 20, bucket_rows: int = 1024, broadcast_sources: int = 100_000) -> Mix:
    """What each source gives to the mix. docs needs doc_id, text and source."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    buckets = max(1, -(-sized.count() // bucket_rows))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "size"), F.lit(buckets)).cast("int"))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = cut(targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))))
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()

    # Places in the stream: first over buckets, then within a bucket.
    named = sources.select("source", "source_no")
    by_bucket = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = _with_sources(per_bucket, named, n_sources, broadcast_sources, "source", F.col("bucket")).select(
        "source_no", "bucket", F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0)).alias("bucket_start")
    )
    in_bucket = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_hash", "size")
    placed = (
        _with_sources(sized, named, n_sources, broadcast_sources, "source", F.col("bucket"))
        .join(starts, ["source_no", "bucket"])
        .withColumn("row", F.row_number().over(in_bucket))
        .withColumn("start", F.col("bucket_start") + F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .select("doc_id", "source_no", "bucket", "row", "size", "text_hash", "start")
    )

    size, b = F.col("source_size"), F.lit(block_words).cast("long")
    plan = (
        sources.where("source_size > 0")
        .withColumn("taken", F.round("target").cast("long"))
        .withColumn("n_full", F.floor(size / b))
        .withColumn("n_blocks", F.ceil(size / b))
        .withColumn("whole", F.floor(F.col("taken") / size))
        .withColumn("over", F.col("taken") % size)
        .withColumn("n_slots", F.col("whole") * F.col("n_blocks") + F.ceil(F.col("over") / b))
        .select("source_no", "source_size", "n_full", "n_blocks", "whole", "over", "n_slots")
    )
    levels = max(0, math.ceil(math.log2(max(1, total * SHARE / block_words / shard_slots))))
    turn, place = F.floor(F.col("slot") / F.col("n_blocks")), F.col("slot") % F.col("n_blocks")
    slots = (
        _drawn_slots(plan, levels, seed)
        .withColumn("turn", turn)
        .withColumn("place", place)
        .withColumn("block", F.when(F.col("place") >= F.col("n_full"), F.col("n_full")).otherwise(permuted(F.col("place"), F.col("n_full"), F.lit(seed), F.col("source_no"), F.col("turn"))))
        .withColumn("words", F.least(b, size - F.col("block") * b, F.when(F.col("turn") < F.col("whole"), b).otherwise(F.col("over") - F.col("place") * b)))
        .select("shard", "source_no", "slot", "turn", "block", "words")
    )
    return Mix(placed, sources, slots, n_sources, block_words, broadcast_sources)


def pieces(mixed: Mix) -> DataFrame:
    """The part of each document that each drawn block takes.

    A row for each document, block and slot; a document of which nothing is taken
    has rows with null ``turn`` and 0 ``words``. ``first`` counts the document's
    words from 0.
    """
    b = mixed.block_words
    start, end = F.col("start"), F.col("start") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(start / b), F.floor((end - 1) / b))).otherwise(F.array(F.lit(None).cast("long")))
    cutted = mixed.documents.withColumn("block", F.explode(blocks)).withColumns(
        {"low": F.greatest(start - F.col("block") * b, F.lit(0).cast("long")), "high": F.least(end - F.col("block") * b, F.lit(b).cast("long"))}
    )
    joined = cutted.join(mixed.slots, ["source_no", "block"], "left")
    words = F.when(F.col("words").isNotNull(), F.greatest(F.least("high", "words") - F.col("low"), F.lit(0)))  # least() skips nulls
    return joined.withColumn("first", F.col("block") * b + F.col("low") - start).withColumn("words", F.coalesce(words, F.lit(0))).drop("low", "high", "start")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for each document."""
    mixed = mix(docs, **options)
    found = pieces(mixed).groupBy("source_no", "bucket", "row", "doc_id", "size").agg(F.sum("words").alias("taken"))
    named = mixed.sources.select("source_no", "source_size", "target")
    return _with_sources(found, named, mixed.n_sources, mixed.broadcast_sources, "source_no", F.col("bucket")).select("doc_id", "size", "source_size", "target", "taken")


def _identity(text_hash: Column) -> Column:
    """doc_id (also null) and the hash of its text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_hash.cast("string"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes of it.

    ``text`` holds the taken words with the white space after them, in order;
    a document taken whole keeps its text as it is. Other columns stay, n_chars
    is counted again where it exists. Rows of equal doc_id and text give their
    parts together.
    """
    names = docs.columns
    found = (
        pieces(mix(docs, **options)).where("words > 0")
        .groupBy("source_no", "bucket", "row", "doc_id", "text_hash", "size", "turn")
        .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"))
        .select("source_no", _identity(F.col("text_hash")).alias("_pair"), F.col("size").alias("_size"), "parts")
    )
    # One key column, so that the window and the join share one exchange of the texts.
    docs = docs.withColumn("_pair", _identity(F.xxhash64("text")))
    once = Window.partitionBy("_pair").orderBy("source")
    docs = docs.withColumn("_row", F.row_number().over(once)).where("_row = 1")
    joined = docs.join(found, docs["_pair"] == found["_pair"])
    runs = F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    part = F.array_join(F.transform("parts", lambda p: F.array_join(F.slice(runs, (p["first"] + 1).cast("int"), p["words"].cast("int")), "")), "")
    is_whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("_size")
    text = F.when(is_whole, F.col("text")).otherwise(part)
    out = joined.select(*[text.alias("text") if c == "text" else docs[c] for c in names])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
