"""Exact top-k search by inner product with one KD-tree for each shard.

Components become the integers floor(1024 * x). Rows are hashed into shards of
about ``shard_rows`` rows of one dimension; each shard builds a KD-tree by median
splits of the widest side, with the tight bounding box of every node, and is
stored as one row. A query visits a tree's nodes best first, by the largest inner
product that its box allows, and stops below its kth best score so far. That score
propagates: shards are searched in rounds, each about as large as all before it,
and a query enters a round with its kth score of the rounds before. Of a shard only
what reaches that score leaves it.

Exactness. Scores are whole numbers; they are computed in float64 where every sum
stays below 2**53, in 64-bit integers below 2**63, and in Python integers beyond.
A node is left out only if its bound is below the kth score, so ties are kept and
go to the smaller vec_id.

Scale. The queries go to the trees: a group is one shard and a batch of up to
``query_rows`` queries, so there are as many tasks as shards times batches, and the
index moves once for each batch (1.6 million rows give one batch). Every query meets
every shard, which is what an exact search asks for.

Defined cases: vectors that are null or hold null, NaN or infinite components take
no part. Vectors of another length than the query's are no candidates. Rows that
repeat a vec_id are rows of their own; a query is compared with all rows but
itself. A null vec_id is never a query and ranks after all ids among ties. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.llm.common import table

LEAF = 64
SCHEMA = "query_id long, rank int, vec_id long, score long"


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as file:
        return {k: file[k] for k in file.files}


def build_tree(vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """order, and for each node its span of order, its box and its children (-1: leaf).

    Median splits along the widest side of the box; a node of equal vectors is a leaf.
    """
    order = np.arange(len(vectors))
    spans, low, high, children = [(0, len(vectors))], [], [], []
    for start, end in spans:  # spans grows while it is walked
        own = vectors[order[start:end]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        widths = high[-1] - low[-1]
        if end - start <= leaf or not widths.size or not widths.max():
            children.append((-1, -1))
            continue
        middle = (end - start) // 2
        order[start:end] = order[start:end][np.argpartition(own[:, widths.argmax()], middle)]
        children.append((len(spans), len(spans) + 1))
        spans += [(start, start + middle), (start + middle, end)]
    return {"order": order, "spans": np.array(spans), "low": np.array(low), "high": np.array(high), "children": np.array(children)}


def _exact(vectors: np.ndarray, queries: np.ndarray) -> np.dtype:
    """The type in which sums of products are exact."""
    most = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    return np.dtype(np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object)


class Shard:
    """A tree with its vectors, as they are searched."""

    def __init__(self, data: bytes):
        parts = _unpacked(data)
        self.vectors, self.ids, self.nulls, self.occurrences = parts["vectors"], parts["ids"], parts["nulls"], parts["occurrences"]
        self.spans, self.children = parts["spans"].tolist(), parts["children"].tolist()
        self.low, self.high = parts["low"], parts["high"]

    def search(self, queries: np.ndarray, own: list[tuple[int, int]], best: list[list], k: int, least: list[int | None]) -> None:
        """Puts each query's candidates that reach its least score (if any) into its heap of the k best, whose least is first."""
        kind = _exact(np.concatenate((self.low, self.high)), queries)
        q, vectors = queries.astype(kind), self.vectors.astype(kind)
        low, high = self.low.astype(kind), self.high.astype(kind)
        # The most that a box allows: each side at the end that suits the query.
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        ids, nulls, occurrences = self.ids.tolist(), self.nulls.tolist(), self.occurrences.tolist()
        for i, heap in enumerate(best):
            bound = bounds[i].tolist()
            waiting = [(-bound[0], 0)]
            while waiting:
                negative, node = heapq.heappop(waiting)
                bar = heap[0][0] if len(heap) == k else least[i]
                if bar is not None and -negative < bar:
                    break
                left, right = self.children[node]
                if left >= 0:
                    for child in (left, right):
                        if bar is None or bound[child] >= bar:
                            heapq.heappush(waiting, (-bound[child], child))
                    continue
                start, end = self.spans[node]
                scores = vectors[start:end] @ q[i]
                likely = range(end - start) if bar is None else np.flatnonzero(scores >= bar)
                for j in likely:
                    at = start + int(j)
                    if not nulls[at] and (ids[at], occurrences[at]) == own[i]:
                        continue
                    item = (int(scores[j]), not nulls[at], -ids[at], -occurrences[at])
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)


def _whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v and occurrence of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.select("vec_id", "embedding").where(usable).select("vec_id", F.transform(x, lambda c: F.floor(c * 1024)).alias("v"))
    same = Window.partitionBy("vec_id", F.xxhash64("v")).orderBy("v")
    # Rows of one id are told apart by their vector's hash and their number among equals.
    return whole.withColumn("occurrence", F.xxhash64("v").bitwiseXOR(F.row_number().over(same).cast("long")))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, shard_rows: int = 8192, query_rows: int = 1 << 14, first_shards: int = 32) -> DataFrame:
    """Each query's k highest scores: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``. The first round searches ``first_shards``.
    """
    rows = cut(_whole_vectors(vectors).withColumn("dim", F.size("v")))
    is_query = F.col("vec_id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    n_shards, n_batches = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))

    def values(side: pa.Table) -> np.ndarray:
        flat = side.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat.reshape(side.num_rows, -1) if side.num_rows else flat.reshape(0, 0)

    def plant(key: tuple, shard: pa.Table) -> pa.Table:
        dim, number = (x.as_py() for x in key)
        vectors = values(shard).reshape(shard.num_rows, dim)
        tree = build_tree(vectors)
        order = tree.pop("order")
        nulls = np.array(shard.column("vec_id").is_null())
        ids = shard.column("vec_id").fill_null(0).to_numpy()
        packed = _packed(vectors=vectors[order], ids=ids[order], nulls=nulls[order], occurrences=shard.column("occurrence").to_numpy()[order], **tree)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([number], pa.int32()), "tree": pa.array([packed], pa.binary())})

    place = lambda m: F.pmod(F.xxhash64("vec_id", "occurrence"), F.lit(m)).cast("int")
    trees = cut(rows.groupBy("dim", place(n_shards).alias("shard")).applyInArrow(plant, "dim int, shard int, tree binary"))
    queries = rows.where(is_query).withColumn("batch", place(n_batches))
    names = ("query_id", "query_occurrence", "score", "vec_id", "occurrence")

    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if trees.num_rows and queries.num_rows:
            own = list(zip(queries.column("vec_id").to_pylist(), queries.column("occurrence").to_pylist()))
            best: list[list] = [[] for _ in own]
            shard = Shard(trees.column("tree")[0].as_py())
            shard.search(values(queries).reshape(queries.num_rows, shard.vectors.shape[1]), own, best, k, queries.column("least").to_pylist())
            found = [(q, o, s, None if not has else -i, -c) for (q, o), heap in zip(own, best) for s, has, i, c in heap]
        return pa.table({name: pa.array([x[i] for x in found], pa.int64()) for i, name in enumerate(names)})

    of_query = Window.partitionBy("query_id", "query_occurrence").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "occurrence")
    best, start = None, 0
    while best is None or start < n_shards:
        end = min(n_shards, max(first_shards, 2 * start))
        bars = queries.withColumn("least", F.lit(None).cast("long"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("query_occurrence").alias("occurrence"), F.col("score").alias("least"))
            bars = queries.join(kth, ["vec_id", "occurrence"], "left")
        left = trees.where(F.col("shard").between(start, end - 1)).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
        right = bars.withColumn("shard", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
        group = ["dim", "shard", "batch"]
        found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(search, ", ".join(f"{name} long" for name in names))
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = cut(found.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k))
        start = end
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
