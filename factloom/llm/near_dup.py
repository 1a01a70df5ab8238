"""Near-duplicate documents by bottom-k sketches, verified on full sets.

A document's set holds its distinct shingles, each under one 64-bit hash. Documents
of equal sets are one node, so copies never meet as pairs. A node's sketch holds
the ``k`` smallest hashes of its set, and a number stands for the node.

Lists. Retained values make inverted lists of nodes. Two sets of similarity 0.8
share at least ``m`` of their retained values: ceil(0.8 n) if the sketches hold the
whole sets, else what a binomial draw of ``k`` values exceeds but for a chance below
1e-9 (30 of 64). If values are put in any one order, such nodes share at least
``shared`` of the first len - m + ``shared`` values of both; only those are listed.
The order is rare values first, by the number of nodes that retain a value, so what
many documents share seldom makes a list. These counts cover all nodes; the most
frequent ``frequent`` values are told apart (12 bytes each), which changes lists,
never results. A ``k`` above the longest set's size makes everything exact.

Short lists (``small`` nodes at most) give their pairs; a pair is a candidate if it
shares ``shared`` of them. A linked pair that shares fewer shares a long list.

Long lists. Each node is first paired with the leader of its lists, the node whose
sketch is most widely shared. Candidates are verified and their links contracted.
Lists whose leaders fell into one component make a bucket. In a bucket, the nodes
outside the leaders' component are compared with those of other components, block
by block: first the overlaps of sketches, which tell the nodes that may have a
partner at all, then their whole sets. A pair of blocks is a task's group of
bounded size, and gives links that span what it joined, never all its pairs.

Verification of a candidate: the bottom-k sketch of the union estimates the
similarity (five standard deviations below 0.8 is rejected, a chance below 1e-6),
then 100 * intersection >= 80 * union is tested on the whole sets.

Defined cases: null or empty text, or one without words, has 0 shingles and is its
own component; fewer words than a shingle has are one shingle. Repeated rows share a
component. A null doc_id never names a component unless all its members' ids are
null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.llm.common import arrow_rows, map_rows, most_counted, table
from factloom.operators.events import components

_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: The chance that a linked pair shares fewer retained values than expected, and the width of the estimate's filter.
MISSED, LIKELY_SIGMAS = 1e-9, 5
#: A posting's info: the size of its set, above it how many lists a pair needs (four bits), above it how widely its sketch is shared.
SIZE_BITS = 44
#: Joins take the smaller side as a broadcast up to so many rows of a few dozen bytes; a shuffle beyond.
BROADCAST_ROWS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the shingles; bytes.split() splits at 0x20 and 0x09-0x0D."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    places = len(hashes) - size + 1
    value = hashes[:places] if size == words else _mixed(hashes[:1] + _A)
    for j in range(1, size):
        value = _mixed(value * _A + _mixed(hashes[j : j + places]))
    return np.unique(value)


def set_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def binomial_floor(k: int, share: float = 0.8, missed: float = MISSED) -> int:
    """The largest m so that fewer than m of k draws of this share have a chance below ``missed``."""
    below = 0.0
    for i in range(k + 1):
        below += math.exp(math.lgamma(k + 1) - math.lgamma(i + 1) - math.lgamma(k - i + 1) + i * math.log(share) + (k - i) * math.log(1 - share))
        if below > missed:
            return i
    return k


def least_shared(n: np.ndarray, k: int) -> np.ndarray:
    """How many retained values nodes of n shingles share with any linked node."""
    n = np.asarray(n, np.int64)
    whole = -(-4 * n // 5)
    return np.where(5 * n <= 4 * k, whole, np.minimum(whole, binomial_floor(min(k, 1 << 16))))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, k: int, words: int = 2) -> DataFrame:
    """doc_id, text_hash, n, key, sketch for each document; key is null without words."""

    def sketch(batch: pa.RecordBatch) -> dict:
        n, keys, kept = [], [], []
        for text in batch.column("text"):
            values = shingle_set(text.as_py(), words)
            n.append(len(values))
            keys.append(set_key(values) if len(values) else None)
            kept.append(values[:k])
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "text_hash": batch.column("text_hash"), "n": n, "key": pa.array(keys, pa.binary()), "sketch": _lists(kept)}

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_rows(rows, "doc_id long, text_hash long, n long, key binary, sketch array<bigint>", sketch)


def nodes_of(sketched: DataFrame) -> DataFrame:
    """node, key, doc_id (the smallest), n, sketch for each distinct set."""
    first = [F.first(c).alias(c) for c in ("n", "sketch")]
    return sketched.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"), *first).withColumn("node", F.monotonically_increasing_id())


def frequent_values(nodes: DataFrame, most: int, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The values that most nodes retain, sorted, and how many do; ``most`` rows at most."""
    counted = nodes.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("c"))
    rows = most_counted(counted, most, least).select("value", "c").toArrow()
    values, counts = rows.column("value").to_numpy(), rows.column("c").to_numpy()
    order = np.argsort(values)
    return values[order], np.minimum(counts[order], np.iinfo(np.int32).max).astype(np.int32)


def postings(nodes: DataFrame, k: int, shared: int, frequent: tuple[np.ndarray, np.ndarray], part_rows: int) -> DataFrame:
    """value, part, node, info: what is listed of each node.

    ``part`` is 0, or for a value of over ``part_rows`` nodes one of its parts from 1 on.
    """
    if not 0 < shared < 16:
        raise ValueError("shared is kept in four bits: 1 to 15")
    values, counts = frequent

    def post(batch: pa.RecordBatch) -> dict:
        lists, n, node = batch.column("sketch"), batch.column("n").to_numpy(), batch.column("node").to_numpy()
        value, lens = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lens)), lens)
        count = np.zeros(len(value), np.int64)
        if len(values):
            at = np.minimum(np.searchsorted(values, value), len(values) - 1)
            count = np.where(values[at] == value, counts[at], 0)
        order = np.lexsort((value, count, row))
        place = np.arange(len(value)) - np.repeat(np.cumsum(lens) - lens, lens)
        m = least_shared(n, k)
        need = np.minimum(shared, m)
        order = order[place < np.repeat(lens - m + need, lens)]
        widely = np.minimum(np.bincount(row, np.log2(1.0 + count), len(lens)), 32000).astype(np.int64)
        info = widely << (SIZE_BITS + 4) | need << SIZE_BITS | n
        row, count = row[order], count[order]
        parts = np.where(count > part_rows, -(-count // part_rows), 0)
        dealt = (_mixed(node[row].view(np.uint64) + _A) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int32)
        return {"value": value[order], "part": np.where(parts > 0, dealt + 1, 0).astype(np.int32), "node": node[row], "info": info[row]}

    return map_rows(nodes.select("node", "n", "sketch"), "value long, part int, node long, info long", post)


def list_rows(posted: DataFrame, small: int, held: int = 1 << 16) -> DataFrame:
    """Pairs of short lists (pair true: a, b, need) and postings of long ones (value, a: node, b: info).

    One sort by value serves both. At most a batch and ``held`` postings of a list are in memory;
    a list that is dealt in parts counts as long.
    """
    schema = pa.schema([("pair", pa.bool_()), ("value", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32())])

    def rows(pair: bool, value: np.ndarray, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), pair)), pa.array(value), pa.array(a), pa.array(b), pa.array(need.astype(np.int32))], schema=schema)

    def whole(value: np.ndarray, part: np.ndarray, node: np.ndarray, info: np.ndarray, open_: int | None) -> Iterator[pa.RecordBatch]:
        """The rows of complete lists; that of the value ``open_`` is known to be long."""
        _, run, c = np.unique(value, return_inverse=True, return_counts=True)
        is_long = (c[run] > small) | (part > 0) | (np.zeros(len(value), bool) if open_ is None else value == open_)
        if is_long.any():
            yield rows(False, value[is_long], node[is_long], info[is_long], np.zeros(is_long.sum()))
        short = ~is_long & (c[run] > 1)
        value, node, info = value[short], node[short], info[short]
        n, need = info & ((1 << SIZE_BITS) - 1), info >> SIZE_BITS & 15
        for j in range(1, min(small, len(value))):
            x = np.flatnonzero(value[:-j] == value[j:])
            if not len(x):
                return
            y = x + j
            # Sets of similarity 0.8 are of sizes within 4 : 5; other pairs never become rows.
            alike = (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x])
            x, y = x[alike], y[alike]
            yield rows(True, value[x], np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.minimum(need[x], need[y]))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, open_ = None, None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("value", "part", "node", "info")]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            cut_at = int(np.searchsorted(now[0], now[0][-1]))
            if cut_at:
                yield from whole(*(x[:cut_at] for x in now), open_)
                open_ = open_ if open_ == now[0][-1] else None
            rest = [x[cut_at:] for x in now]
            if len(rest[0]) > held or open_ is not None:
                open_ = int(rest[0][-1])
                yield from whole(*rest, open_)
                rest = None
        if rest is not None:
            yield from whole(*rest, open_)
        pa.default_memory_pool().release_unused()

    dealt = posted.repartition("value", "part").sortWithinPartitions("value")
    return dealt.mapInArrow(lists, "pair boolean, value long, a long, b long, need int")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def small_side(df: DataFrame) -> DataFrame:
    """As a broadcast if its rows, counted first, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def whole_sets(used: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, values: the sets of the nodes, made again from the texts of just their documents. used: node, doc_id, key."""
    used = cut(used.select("node", F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
    wanted = docs.select("doc_id", "text").join(small_side(used), docs["doc_id"].eqNullSafe(used["_id"])).select("node", "_key", "text")

    def sets(batch: pa.RecordBatch) -> dict:
        node, values = [], []
        for x, key, text in zip(batch.column("node"), batch.column("_key"), batch.column("text")):
            # An id may stand for several texts; only that of the node counts.
            found = shingle_set(text.as_py(), words)
            if len(found) and set_key(found) == key.as_py():
                node.append(x.as_py())
                values.append(found)
        return {"node": pa.array(node, pa.int64()), "values": _lists(values)}

    return map_rows(wanted, "node long, values array<bigint>", sets).groupBy("node").agg(F.first("values").alias("values"))


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, words: int) -> DataFrame:
    """The pairs a, b that are linked: estimated on sketches, then tested on whole sets."""

    def passing(pairs: DataFrame, have: DataFrame, test: Callable) -> DataFrame:
        def check(batch: pa.RecordBatch) -> dict:
            rows = zip(batch.column("va"), batch.column("vb"))
            mask = pa.array([bool(test(*(v.values.to_numpy().view(np.uint64) for v in row))) for row in rows], pa.bool_())
            return {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

        for side in ("a", "b"):
            pairs = pairs.join(have.select(F.col("node").alias(side), F.col("values").alias(f"v{side}")), side)
        return map_rows(pairs.select("a", "b", "va", "vb"), "a long, b long", check)

    def used(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return nodes.join(ends, "node", "left_semi")

    retained = used(pairs).select("node", F.col("sketch").alias("values"))
    with arrow_rows(docs.sparkSession, 256):  # a row holds two whole sets
        # What passes is far less than what is tested, so it comes in few files.
        likely = cut(passing(pairs, retained, lambda x, y: likely_linked(x, y, k)).hint("rebalance"))
        return cut(passing(likely, whole_sets(used(likely), docs, words), linked).hint("rebalance"))


def estimate(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Jaccard similarity from the bottom-k sketch of the union."""
    union = np.union1d(x, y)[:k]
    both = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean()) if len(union) else 0.0


def likely_linked(x: np.ndarray, y: np.ndarray, k: int) -> bool:
    """From two sketches; the answer is exact if both hold their whole sets."""
    if max(len(x), len(y)) < k:
        return linked(x, y)
    return estimate(x, y, k) >= 0.8 - LIKELY_SIGMAS * 0.4 / math.sqrt(k)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both) and both > 0


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each left array shares with each right one; arrays hold no value twice."""
    shared = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return shared
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def table_of(side: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(side), len(part)), np.float32)
        for i, own in enumerate(side):
            at = np.minimum(np.searchsorted(part, own), len(part) - 1)
            out[i, at[part[at] == own]] = 1
        return out

    for start in range(0, len(values), columns):
        part = values[start : start + columns]
        shared += table_of(left, part) @ table_of(right, part).T
    return shared


def _block_pairs(members: DataFrame, compare: Callable, schema: str, rows: int, size: int) -> DataFrame:
    """What ``compare`` gives for each block of outliers of a bucket with each block of its members.

    members: bucket, node, label, n, values. Outliers are those whose label isn't the bucket.
    A block has about ``rows`` members at most, and about ``size`` values.
    """
    outlier = F.col("label") != F.col("bucket")

    def blocks(which: Column, name: str) -> Column:
        count, total = F.count_if(which), F.sum(F.when(which, F.size("values")).otherwise(0))
        return F.greatest(F.ceil(count / rows), F.ceil(total / size)).cast("int").alias(name)

    counts = members.groupBy("bucket").agg(blocks(outlier, "left_blocks"), blocks(F.lit(True), "right_blocks")).where("left_blocks > 0")
    members = members.join(small_side(cut(counts)), "bucket")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "node", "label", "n", "values"]
    left = members.where(outlier).select(*columns, own("left_blocks").alias("i"), every("right_blocks").alias("j"), F.lit(True).alias("is_left"))
    right = members.select(*columns, own("right_blocks").alias("j"), every("left_blocks").alias("i"), F.lit(False).alias("is_left"))

    def both(group: pa.Table) -> pa.Table:
        is_left = group.column("is_left")
        return compare(group.filter(is_left), group.filter(pa.compute.invert(is_left)))

    return left.unionByName(right).groupBy("bucket", "i", "j").applyInArrow(both, schema)


def _arrays(side: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    values = [x.values.to_numpy() for x in side.column("values").combine_chunks()] if side.num_rows else []
    return values, *(side.column(c).to_numpy() for c in ("n", "label", "node"))


def _may_have_partners(members: DataFrame, k: int) -> DataFrame:
    """bucket, node: those whose sketch overlaps enough with one of another label in their bucket."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, n, label, node), (y, other_n, other_label, other) = _arrays(left), _arrays(right)
        enough = overlaps(x, y) >= np.maximum.outer(least_shared(n, k), least_shared(other_n, k))
        enough &= (5 * n[:, None] >= 4 * other_n) & (5 * other_n >= 4 * n[:, None]) & (label[:, None] != other_label)
        found = np.unique(np.concatenate((node[enough.any(axis=1)], other[enough.any(axis=0)])))
        bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
        return pa.table({"bucket": pa.array(np.full(len(found), bucket, np.int64)), "node": pa.array(found.astype(np.int64))})

    return _block_pairs(members, compare, "bucket long, node long", 512, 1 << 17).distinct()


def _spanning_links(members: DataFrame) -> DataFrame:
    """a, b: labels joined by a link of whole sets; of each two blocks, links that span what they join."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, _, label, _), (y, _, other_label, _) = _arrays(left), _arrays(right)
        both = overlaps(x, y)
        union = np.add.outer([len(v) for v in x], [len(v) for v in y]) - both
        rows, columns = np.nonzero((100 * both >= 80 * union) & (label[:, None] != other_label))
        joined = np.unique(np.stack((label[rows], other_label[columns])), axis=1).T.tolist()
        root: dict[int, int] = {}

        def top(z: int) -> int:
            while root.setdefault(z, z) != z:
                root[z] = z = root[root[z]]
            return z

        found = []
        for a, b in joined:
            if (p := top(a)) != (q := top(b)):
                root[p] = q
                found.append((a, b))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _block_pairs(members, compare, "a long, b long", 512, 1 << 19)


def links_in_long_lists(members: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, words: int) -> DataFrame:
    """a, b: links between components that share a long list, by their labels. members: value, node, leader."""
    placed = members.select("node", "leader").distinct().join(labels.select(F.col("key").alias("node"), "label"), "node", "left")
    placed = placed.join(labels.select(F.col("key").alias("leader"), F.col("label").alias("lead_label")), "leader", "left")
    placed = cut(placed.select(F.coalesce("lead_label", "leader").alias("bucket"), "node", F.coalesce("label", "node").alias("label")).distinct())
    mixed = placed.where("label <> bucket").select("bucket").distinct()
    placed = placed.join(mixed, "bucket", "left_semi")
    with arrow_rows(docs.sparkSession, 256):
        near = cut(_may_have_partners(placed.join(nodes.select("node", "n", F.col("sketch").alias("values")), "node"), k))
        sets = whole_sets(nodes.join(near.select("node").distinct(), "node", "left_semi"), docs, words)
        return cut(_spanning_links(placed.join(near, ["bucket", "node"]).join(sets, "node").withColumn("n", F.size("values"))).distinct())


def near_duplicates(docs: DataFrame, k: int = 64, shared: int = 4, small: int = 16, frequent: int = 1 << 18, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    return grouped(docs, k, shared, small, frequent, words).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, k: int = 64, shared: int = 4, small: int = 16, frequent: int = 1 << 18, words: int = 2, part_rows: int = 1024) -> DataFrame:
    """What near_duplicates gives, with text_hash, the key of the document's set and the component; null without words."""
    docs = docs.select("doc_id", "text")
    with arrow_rows(docs.sparkSession, 2048):
        sketched = cut(sketches(docs, k, words))
    nodes = cut(nodes_of(sketched))
    found = cut(list_rows(postings(nodes, k, shared, frequent_values(nodes, frequent), part_rows), small))
    pairs = found.where("pair").groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need").select("a", "b")
    in_long = found.where(~F.col("pair")).select("value", F.col("a").alias("node"), F.col("b").alias("info"))
    widely = F.struct(F.shiftright("info", SIZE_BITS + 4).alias("widely"), "node")
    heads = in_long.groupBy("value").agg(F.count("*").alias("c"), F.max(widely).alias("head")).where("c > 1").select("value", F.col("head.node").alias("leader"))
    members = cut(in_long.join(heads, "value").groupBy("node", "leader").agg(F.count("*").alias("c")))
    led = members.where(F.col("node") != F.col("leader")).where(F.col("c") >= shared).select(*_ordered("node", "leader"))
    links = confirmed(cut(pairs.union(led).distinct()), docs, nodes, k, words)
    labels = components(links)
    between = links_in_long_lists(members, labels, docs, nodes, k, words)
    # Labels of the first round meet by the links between them.
    wider = components(between).select(F.col("key").alias("label"), F.col("label").alias("wider"))
    ends = labels.select("key", "label").union(between.select(F.col("a").alias("key"), "a")).union(between.select("b", "b")).distinct()
    named = ends.join(wider, "label", "left").select(F.col("key").alias("node"), F.coalesce("wider", "label").alias("component"))
    named = cut(nodes.select("node", "key", "doc_id").join(named, "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = nodes.select("node", "key", "doc_id").join(named.join(smallest, "component").select("node", "component", "component_id"), "node", "left")
    placed = placed.select("key", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    rows = sketched.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "key")
    with_words = rows.where(F.col("key").isNotNull()).join(placed, "key").select(*rows.columns, "component", "component_id")
    without = rows.where(F.col("key").isNull()).select("*", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one of each component.

    It is the one of the smallest id (a null id last), then of the smallest set key and
    text hash; where that row repeats, one of the rows. Documents without words stay,
    one for each id and text.
    """
    place = ["doc_id", "text_hash"]
    rows = cut(grouped(docs).groupBy(*place, "key", "component").agg(F.count("*").alias("c")))
    best = rows.where(F.col("key").isNotNull()).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "text_hash")).alias("m"))
    best = best.select("component", F.col("m.doc_id").alias("best_id"), F.col("m.text_hash").alias("best_hash"))
    is_best = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash")))
    # Only what goes or repeats is joined with the documents.
    judged = cut(rows.join(best, "component", "left").withColumn("stays", is_best).where(~F.col("stays") | (F.col("c") > 1)).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays"))
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(judged["_id"]) & (hashed["_text_hash"] == judged["_hash"])
    once = hashed.join(small_side(judged), same, "left_anti")
    repeated = hashed.join(small_side(judged.where("stays")), same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return once.unionByName(repeated).drop("_text_hash")


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS c, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT c, n, unnest(s) AS x FROM classes),
common AS (SELECT a.c AS p, b.c AS q, a.n AS np, b.n AS nq, count(*) AS k
  FROM items a JOIN items b ON a.x = b.x AND a.c < b.c AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL),
edges AS (SELECT p, q FROM common WHERE 100 * k >= 80 * (np + nq - k)),
both_ways AS (SELECT p, q FROM edges UNION ALL SELECT q, p FROM edges),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, both_ways.q FROM reach JOIN both_ways ON reach.r = both_ways.p),
labels AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
       coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes k ON list_sort(d.s) = k.s LEFT JOIN labels l ON l.c = k.c
"""
