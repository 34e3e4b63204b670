"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists.

The vectors are dealt into blocks of about ``BLOCK`` rows.  Every block gets the whole stated query set, row by
row behind its own rows, so a task holds one block and some queries; a block sorts each dimension once.  For a query
the algorithm walks all lists down from the end that the sign of the query's component prefers, to depths that
double; every vector met gets its full score.  At each depth the inner product of the query with the values
that the lists stand at bounds all vectors not met yet, and so does the largest length of a vector by the
query's length; the walk stops when a bound is below the k-th score (Fagin, Lotem and Naor,
"Optimal aggregation algorithms for middleware").  The k best of each block are then merged, in two
steps, so that no task takes all of a query's candidates at once.

How early it stops is up to the data: with few dimensions or a query of few large components after a small
part of the lists; with many alike dimensions (the 64 of the test tables) not before every vector has been met.

Components become ``floor(256 x)``.  Defined results.  Vectors that are null, or hold a null or a
non-finite component, take no part, nor do rows without id.  Only vectors of the query's length are
compared; empty vectors score 0.  Ties go to the smaller id.  Repeated ids are separate candidates,
but no row whose id is the query's own is one.  Scores beyond a signed 64-bit number become the
nearest such number.  An empty table, or one without queries, gives no rows.  Very long vectors make a block as
many times larger; ``block`` is a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
FIRST_DEPTH = 16
EXACT = 1 << 53
_HITS = "query_id long, vec_id long, score long"


class SortedLists:
    """A block of vectors with, for each dimension, its rows in ascending order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.order, axis=0)
        self.largest = float(np.abs(rows).max()) if rows.size else 0.0
        self.length = float(np.sqrt((rows * rows).sum(1).max())) if rows.size else 0.0
        self.scored = 0

    def _scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores: in floating point while every sum is exact there, else in whole numbers."""
        if self.largest * float(np.abs(query).sum()) < EXACT:
            return self.rows[rows] @ query
        exact = [sum(int(a) * int(b) for a, b in zip(r, query)) for r in self.rows[rows]]
        return np.array(exact, object)

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the ``k`` best, the query's own id left out."""
        n, d = self.rows.shape
        met = self.ids == query_id
        best_rows, best = np.zeros(0, np.int64), np.zeros(0)
        used = np.flatnonzero(query)
        up, down = used[query[used] > 0], used[query[used] < 0]
        ceiling = self.length * float(np.sqrt((query * query).sum())) * (1 + 1e-9)
        depth, before = FIRST_DEPTH if len(used) else n, 0
        while True:
            depth = min(depth, n)
            fresh = np.zeros(n, bool)
            if len(used):
                fresh[self.order[n - depth : n - before, up].ravel()] = True
                fresh[self.order[before:depth, down].ravel()] = True
            else:  # no list says anything: all scores are 0
                fresh[:] = True
            rows = np.flatnonzero(fresh & ~met)
            met |= fresh
            self.scored += len(rows)
            best_rows = np.concatenate([best_rows, rows])
            best = np.concatenate([best, self._scores(query, rows)])
            order = np.lexsort((best_rows, -best))[:k] if best.dtype != object else np.array(sorted(range(len(best)), key=lambda i: (-best[i], best_rows[i]))[:k], np.int64)
            best_rows, best = best_rows[order], best[order]
            if depth >= n or met.all():
                break
            bound = float(self.values[n - depth, up] @ query[up] + self.values[depth - 1, down] @ query[down])
            bound = min(bound + abs(bound) * 1e-9, ceiling)  # only sums beyond the exact range are rounded
            if len(best) == k and bound < best[-1]:
                break
            before, depth = depth, depth * 2
        top = (1 << 63) - 1
        return [(int(self.ids[r]), max(-top - 1, min(top, int(s)))) for r, s in zip(best_rows, best)]


class _Block:
    """Vectors of one block as they come, and its sorted lists once the first query does."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.lists: dict[int, SortedLists] | None = None

    def sorted(self) -> dict[int, SortedLists]:
        if self.lists is None:
            self.lists = {}
            for n in sorted({int(x) for _, lengths, _ in self.parts for x in np.unique(lengths)}):
                ids, rows = zip(*((i[l == n], v[np.repeat(l == n, l)].reshape(-1, n) if n else np.zeros(((l == n).sum(), 0))) for i, l, v in self.parts))
                self.lists[n] = SortedLists(np.concatenate(ids), np.concatenate(rows))
            self.parts = []
        return self.lists


def _whole(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of some vectors and their components as whole numbers, one after the other."""
    return np.diff(values.offsets.to_numpy()), np.floor(values.flatten().to_numpy(zero_copy_only=False) * 256)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """For each row of ``queries`` (same columns as ``vectors``) the ``k`` rows of ``vectors`` of
    the highest scores: ``query_id, rank, vec_id, score``."""
    def sound(df: DataFrame) -> DataFrame:
        v = F.col("v")
        usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & usable)

    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = vectors.count()
    blocks = max(1, -(-n // block), min(partitions, n // 512))
    # The row's number alone deals the rows out, so repeated ones share no block; all rows meet the stated query set, block by block.
    dealt = sound(vectors).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    asked = sound(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "v")
    rows = dealt.unionByName(asked).repartition(min(blocks, 16 * partitions), "block").sortWithinPartitions("block", "asks")

    def search(batches):
        number, own = None, _Block()
        for b in batches:
            of, asks = b["block"].to_numpy(), b["asks"].to_numpy()
            ids = b["id"].to_numpy()
            cuts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])))[: len(of)].tolist() if len(of) else []
            for start, end in zip(cuts, [*cuts[1:], len(of)]):
                if of[start] != number:
                    number, own = of[start], _Block()
                lengths, values = _whole(b["v"].slice(start, end - start))
                if not asks[start]:
                    own.parts.append((ids[start:end], lengths, values))
                    continue
                lists, at, hits = own.sorted(), 0, []
                for q, size in zip(ids[start:end].tolist(), lengths.tolist()):
                    if size in lists:
                        hits += [(q, i, s) for i, s in lists[size].top(q, values[at : at + size], k)]
                    at += size
                yield pa.record_batch([pa.array([h[c] for h in hits], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    hits = rows.mapInArrow(search, _HITS)
    order = [F.desc("score"), F.asc("vec_id")]
    near = Window.partitionBy("query_id", "part").orderBy(*order)
    parted = hits.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16))).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")
    return parted.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
