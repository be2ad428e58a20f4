"""Exact top-k inner-product search with a KD-tree in each shard.

Candidates are dealt into shards by a hash of their id.  A shard's tree is
built once and stored as a row of a table, however many queries there are.  It
splits at the median of its widest dimension, down to leaves of ``LEAF``
vectors, and keeps each node's tight bounding box.  A query goes best-first:
a heap holds nodes by the largest score that any point of their box can
reach; the search ends when that bound falls below the k-th score so far.
The k-th score is propagated: a first pass lets every shard answer from each
query's best leaf alone, and the k-th best of those answers, which no final
k-th score can be below, bounds the full pass in every shard.

Defined cases: vectors that are null or hold a null or non-finite component
take no part, as queries or candidates; vectors of different lengths don't
meet; null ids take no part; ties go to the smaller id; rows that repeat an
id are candidates each, and a query is not answered by rows of its own id;
query rows that repeat an id and vector ask once, and different vectors of one
id share one ranking of all their scores, where a candidate may come for each;
fewer candidates than k give all; an empty table gives no rows.

Components are integers of 64 bits (beyond, they are the nearest such number);
scores are exact, and beyond 64 bits rank by their true value and are given as
the nearest number of 64 bits.

Scale: queries are taken in blocks of a bounded number of rows; each block
goes to all tasks, which open the stored trees one after the other; nothing
else is collected or broadcast.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from climekin.llm.scratch import Tables, new_path

LEAF = 128
#: Vectors of a shard, about.
SHARD_ROWS = 8192
#: Queries of a block, about; 64 components of them take 10 MB.
BLOCK_ROWS = 20_000


class KDTree:
    """Median splits over integer vectors, with a tight box for every node."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.children: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        low, high = [], []

        def build(a: int, b: int) -> int:
            own = points[order[a:b]]
            node = len(self.span)
            self.span.append((a, b))
            self.children.append(None)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            width = high[node] - low[node]
            if b - a > leaf and width.max() > 0:
                mid = (a + b) // 2
                part = np.argpartition(own[:, int(width.argmax())], mid - a)
                order[a:b] = order[a:b][part]
                self.children[node] = (build(a, mid), build(mid, b))
            return node

        build(0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(low), np.array(high)

    def pack(self) -> tuple[bytes, ...]:
        """ids, points, boxes, children and spans, as 64-bit integers."""
        children = [c or (-1, -1) for c in self.children]
        return tuple(np.ascontiguousarray(x, "<i8").tobytes() for x in (self.ids, self.points, self.low, self.high, children, self.span))

    @classmethod
    def unpack(cls, packed: tuple[bytes, ...], kind=np.int64) -> KDTree:
        """The tree again, numbers as ``kind``."""
        ids, points, low, high, children, span = (np.frombuffer(x, "<i8") for x in packed)
        tree = cls.__new__(cls)
        tree.ids = ids
        tree.points, tree.low, tree.high = (x.reshape(-1, len(points) // max(1, len(ids))).astype(kind) for x in (points, low, high))
        tree.children = [(a, b) if a >= 0 else None for a, b in children.reshape(-1, 2).tolist()]
        tree.span = [tuple(x) for x in span.reshape(-1, 2).tolist()]
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes) largest inner product that a point in each box can have."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return plus @ self.high.T + minus @ self.low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, kth: int | None, leaves: int | None = None) -> list[tuple[int, int]]:
        """Best (-score, id) pairs, best first; kth: a score that the k-th best can't be below."""
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            floor = kth if len(best) < k else max(-best[-1][0], kth if kth is not None else -best[-1][0])
            if floor is not None and -b < floor:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if floor is None or bound[c] >= floor:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            i, j = self.span[node]
            score, ids = self.points[i:j] @ query, self.ids[i:j]
            use = ids != own
            if floor is not None:
                use &= score >= floor
            score, ids = score[use], ids[use]
            if len(ids) > k:
                top = np.lexsort((ids, -score))[:k]
                score, ids = score[top], ids[top]
            best = sorted(best + list(zip((-score).tolist(), ids.tolist())))[:k]
            if leaves is not None:
                leaves -= 1
                if leaves <= 0 and len(best) >= k:
                    break
        return best


def _kind(most: int, size: int):
    """Numbers in which inner products of ``size`` components up to ``most`` are exact: doubles, which are fast, 64-bit or Python integers."""
    top = most * most * max(1, size)
    return np.float64 if top < 2**52 else np.int64 if top < 2**62 else object


def _most(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


_TREES = "shard int, size int, most decimal(20,0), ids binary, points binary, low binary, high binary, children binary, span binary"


def _build(batches):
    """Rows (shard, id, vector) of whole shards, sorted -> a tree for each shard and length of vectors."""
    from decimal import Decimal

    def trees(shard, ids, vectors):
        out = []
        for size in sorted({len(v) for v in vectors}):
            at = [i for i, v in enumerate(vectors) if len(v) == size]
            points = np.array([vectors[i] for i in at], np.int64).reshape(len(at), size)
            most = _most(points)
            # Differences of components, which the splits take, have to fit too.
            tree = KDTree(np.array([ids[i] for i in at], np.int64), points if most < 2**62 else points.astype(object), LEAF) if size else None
            out.append((shard, size, Decimal(most), *(tree.pack() if tree else (np.array([ids[i] for i in at], "<i8").tobytes(), *[b""] * 5))))
        names = [c.split()[0] for c in _TREES.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.decimal128(20, 0), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    shard, ids, vectors = None, [], []
    for batch in batches:
        for s, k, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if s != shard and ids:
                yield trees(shard, ids, vectors)
                ids, vectors = [], []
            shard = s
            ids.append(k)
            vectors.append(np.array(v, np.int64))
    if ids:
        yield trees(shard, ids, vectors)


def _answer(queries: dict, k: int, first: bool):
    """Stored trees -> (query_id, vec_id, score) of each shard's best candidates for each query; score as text where it may pass 64 bits."""
    edge = 2**63

    def answer(batches):
        for batch in batches:
            for _, size, most, *packed in zip(*(batch.column(c).to_pylist() for c in range(9))):
                if size not in queries:
                    continue
                q_ids, q, kth = queries[size]
                got: list[tuple[int, int, int]] = []
                if size == 0:
                    ids = np.sort(np.frombuffer(packed[0], "<i8"))[: k + 1].tolist()
                    got = [(i, v, 0) for i in q_ids.tolist() for v in [x for x in ids if x != i][:k]]
                else:
                    kind = _kind(max(int(most), _most(q)), size)
                    tree, asked = KDTree.unpack(tuple(packed), kind), q.astype(kind)
                    for a in range(0, len(q), 256):
                        bound = tree.bounds(asked[a : a + 256])
                        for i, b in enumerate(bound):
                            own = int(q_ids[a + i])
                            got += [(own, v, int(-s)) for s, v in tree.search(asked[a + i], own, b, k, kth.get(own) if kth else None, 1 if first else None)]
                cols = [*zip(*got)] or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([str(x) for x in cols[2]], pa.string()), pa.array([max(-edge, min(edge - 1, x)) for x in cols[2]], pa.int64())], ["query_id", "vec_id", "exact", "score"])

    return answer


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best others by integer inner product.

    ``vector`` holds arrays of integers.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<bigint>").alias("v"), is_query.alias("q")).where("k is not null and v is not null")
    tables = Tables(spark)
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.select(F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("shard"), "k", "v").repartition(tasks, "shard").sortWithinPartitions("shard", "k")
    trees = tables.stage(dealt.mapInArrow(_build, _TREES), "topk-trees")
    asked = tables.stage(rows.where("q").select("k", "v").dropDuplicates(["k", "v"]), "topk-queries")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(blocks)))
    out = new_path(spark, "topk-answers")
    # Sums may have more digits than a decimal: their order is that of sign and length, then digits.
    down = F.col("exact").startswith("-")
    digits = F.lpad(F.ltrim(F.col("exact"), F.lit("-")), 60, "0")
    best = Window.partitionBy("query_id").orderBy(down, F.when(~down, digits).desc(), F.when(down, digits), "vec_id")
    for block in range(blocks):
        some = asked.where(F.col("block") == block).select("k", "v").toPandas()
        if some.empty:
            continue
        queries = {}
        for size in some["v"].map(len).unique():
            own = some[some["v"].map(len) == size]
            queries[int(size)] = [own["k"].to_numpy(np.int64), np.array(own["v"].tolist(), np.int64).reshape(len(own), int(size)), {}]
        schema = "query_id long, vec_id long, exact string, score long"
        near = trees.mapInArrow(_answer(queries, k, True), schema)
        kth = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", "exact").toPandas()
        lowest = {int(i): int(x) for i, x in zip(kth["query_id"], kth["exact"])}
        for entry in queries.values():
            entry[2] = {int(i): lowest[int(i)] for i in entry[0] if int(i) in lowest}
        found = trees.mapInArrow(_answer(queries, k, False), schema)
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    nothing = asked.isEmpty()
    tables.drop()
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if nothing else spark.read.parquet(out)


def integers(vector: Column, factor: int = 256) -> Column:
    """floor(factor * component) of every component; null if the vector is null or holds a null, NaN or infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", integers(F.col("embedding")).alias("vector"))
    return search(rows, F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
