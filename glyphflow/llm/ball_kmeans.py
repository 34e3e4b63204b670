"""Centroid clustering of whole-number vectors by Ball k-means.

A cluster is a ball: its centroid and the largest distance of a member.  One pass over the vectors makes
one round.  Before it, the driver knows the k centroids, and for each ball a bound of its radius after the
centroid has moved (the last radius and the way moved); centroid j is a neighbour of centroid i only if it
is no farther than twice that radius.  In the pass a member of ball i gets its exact distance to centroid i.
Members nearer than half the way to the nearest neighbour are the stable core and stay where they are.  The others
lie in rings between half the ways to one neighbour and the next, and are compared exactly with the
neighbours up to their ring only (Xia et al., "Ball k-Means: Fast Adaptive Clustering With No Bounds").

Each pass is a ``mapInArrow`` without a shuffle: it writes the members with their cluster to the shared folder
and, beside them, one row for each cluster that a task met: exact sums, counts, radius.  Those rows are added
up by Spark, so what reaches the driver is k rows of the vectors' width, however many vectors there are.  A
lost executor costs the tasks of one pass.  The table of the pass before is deleted after each pass.

Components become ``floor(256 x)``; all sums and distances are whole numbers, in floating point only while every
result is exact there.  Defined results.  Rows without id take no part, nor do vectors that are null, have another
number of components than ``dims``, or hold a null or non-finite one.  Repeated rows are so many vectors.  Distance ties
go to the smaller cluster number.  Of equal hashes of the start the smaller vector comes first.  With fewer than ``k``
vectors there are as many clusters; an empty cluster keeps its centroid; an empty table gives no rows.  Components
beyond 2^53 become that, distances and sums beyond a signed 64-bit number the nearest such number.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.storage import drop, materialize

K, ROUNDS, DIMS, SEED = 40, 5, 64, "2"
SCALE = 256
EXACT = 1 << 53
TOP = (1 << 63) - 1
_WHOLE = pa.decimal128(38, 0)
_OUT = "member boolean, vec_id long, x array<long>, cluster int, distance long, sums array<decimal(38,0)>, n long, inertia decimal(38,0), radius decimal(38,0), compared long"
_FIELDS = pa.schema(
    [("member", pa.bool_()), ("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("sums", pa.list_(_WHOLE)), ("n", pa.int64()), ("inertia", _WHOLE), ("radius", _WHOLE), ("compared", pa.int64())]
)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: the usable vectors with components ``floor(scale * x)``."""
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(EXACT)), F.least(F.lit(float(EXACT)), x * scale)))).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of seed and id, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.x) for r in vectors.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()]


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances; objects of Python where a double could round."""
    if not len(rows):
        return np.zeros(0)
    most = max(int(np.abs(rows).max(initial=0)), max((abs(int(c)) for c in centre), default=0))
    if 4 * most * most * max(1, rows.shape[1]) < EXACT:
        apart = rows.astype(np.float64) - np.asarray(centre, np.float64)
        return np.einsum("ij,ij->i", apart, apart)
    apart = rows.astype(object) - np.array([int(c) for c in centre], object)
    return (apart * apart).sum(1)


@dataclass
class Balls:
    """The centroids of a round and for each its neighbours, nearest first, with exact squared distances."""

    centres: list[list[int]]
    near: list[list[int]]
    ways: list[list[int]]

    @staticmethod
    def around(centres: list[list[int]], radii: list[float]) -> Balls:
        """``radii``: bounds of the balls' radii; infinite: every other centroid is a neighbour."""
        near, ways = [], []
        for i, c in enumerate(centres):
            to = [(sum((a - b) ** 2 for a, b in zip(c, o)), j) for j, o in enumerate(centres) if j != i]
            kept = sorted((d, j) for d, j in to if float(d) ** 0.5 <= 2 * radii[i] * (1 + 1e-9) + 1e-9)
            near.append([j for _, j in kept])
            ways.append([d for d, _ in kept])
        return Balls(centres, near, ways)

    def assign(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New cluster and squared distance of members whose cluster was ``own``, and how many distances that took."""
        cluster, distance, compared = own.copy(), np.zeros(len(rows)), len(rows)
        for i in np.unique(own):
            at = np.flatnonzero(own == i)
            best = squared(rows[at], self.centres[i])
            new, ways = np.full(len(at), i, np.int32), self.ways[i]
            # Neighbour j can be as near as the own centroid only if its way is at most twice the distance.
            if best.dtype == object or (ways and ways[-1] >= EXACT):
                ring = np.array([np.searchsorted(np.array(ways, object), 4 * int(d), side="right") for d in best], np.int64)
            else:
                ring = np.searchsorted(np.array(ways, np.float64), 4 * best, side="right")
            for n, j in enumerate(self.near[i]):
                out = np.flatnonzero(ring > n)
                if not len(out):
                    break
                found = squared(rows[at[out]], self.centres[j])
                compared += len(out)
                nearer = (found < best[out]) | ((found == best[out]) & (j < new[out]))
                if found.dtype == object and best.dtype != object:
                    best = best.astype(object)
                best[out[nearer]], new[out[nearer]] = found[nearer], j
            if best.dtype == object and distance.dtype != object:
                distance = distance.astype(object)
            cluster[at], distance[at] = new, best
        return cluster, distance, compared


def _long(value: int) -> int:
    return max(-TOP - 1, min(TOP, int(value)))


def _pass(members: DataFrame, balls: Balls, dims: int, keep_x: bool) -> DataFrame:
    """Every member (``member``: true) with its new cluster, and a row for each cluster that a task met."""

    def run(batches):
        n, inertia, radius, compared = {}, {}, {}, 0
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            flat = b["x"].flatten().to_numpy(zero_copy_only=False)
            rows = flat.reshape(b.num_rows, dims)
            cluster, distance, some = balls.assign(rows, b["cluster"].to_numpy())
            compared += some
            safe = len(flat) == 0 or int(np.abs(flat).max()) * len(rows) < TOP
            exact = distance.dtype != object and float(distance.max(initial=0)) * len(rows) < EXACT
            for i in np.unique(cluster).tolist():
                at = cluster == i
                own = rows[at].sum(0).astype(object) if safe else rows[at].astype(object).sum(0)
                sums[i] = sums.get(i, 0) + own
                n[i] = n.get(i, 0) + int(at.sum())
                inertia[i] = inertia.get(i, 0) + (int(distance[at].sum()) if exact else sum(map(int, distance[at])))
                radius[i] = max(radius.get(i, 0), int(max(distance[at])))
            size = b.num_rows
            none = lambda kind: pa.nulls(size, kind)
            told = pa.array([_long(d) for d in distance] if distance.dtype == object else distance.astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([True] * size, pa.bool_()), b["vec_id"], b["x"] if keep_x else none(pa.list_(pa.int64())), pa.array(cluster, pa.int32()), told, none(pa.list_(_WHOLE)), none(pa.int64()), none(_WHOLE), none(_WHOLE), none(pa.int64())], schema=_FIELDS)
        if n:
            rows = [{"member": False, "vec_id": None, "x": None, "cluster": i, "distance": None, "sums": [Decimal(int(s)) for s in sums[i]], "n": n[i], "inertia": Decimal(inertia[i]), "radius": Decimal(radius[i]), "compared": compared if i == min(n) else 0} for i in sorted(n)]
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return members.select("vec_id", "x", "cluster").mapInArrow(run, _OUT)


@dataclass
class Round:
    """What a pass found: of each cluster sums, members, inertia and squared radius, and all comparisons."""

    sums: dict[int, list[int]]
    n: dict[int, int]
    inertia: dict[int, int]
    radius: dict[int, int]
    compared: int


def _told(written: DataFrame) -> Round:
    """The tasks' rows added up: one row for each cluster."""
    parts = written.where("not member")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.max("radius").alias("radius"), F.sum("compared").alias("compared"))
    cells = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"))
    rows = cells.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("s")).join(totals, "cluster").collect()  # k rows
    return Round({r.cluster: [int(c.s) for c in r.s] for r in rows}, {r.cluster: r.n for r in rows}, {r.cluster: int(r.inertia) for r in rows}, {r.cluster: int(r.radius) for r in rows}, sum(r.compared for r in rows))


def moved(centres: list[list[int]], told: Round) -> tuple[list[list[int]], list[float]]:
    """The next centroids and bounds of their balls' radii."""
    after, radii = [], []
    for i, c in enumerate(centres):
        if i not in told.n:
            after.append(c)
            radii.append(0.0)
            continue
        new = [s // told.n[i] for s in told.sums[i]]
        after.append(new)
        radii.append(float(told.radius[i]) ** 0.5 + float(sum((a - b) ** 2 for a, b in zip(c, new))) ** 0.5)
    return after, radii


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, seed: str = SEED) -> tuple[DataFrame, list[list[int]], list[Round]]:
    """``vec_id, cluster, distance`` of every usable vector after ``rounds`` rounds and a last assignment; the last centroids; what each pass found."""
    usable = whole_vectors(vectors, id_col, vector_col, dims)
    centres = first_centroids(usable, k, seed)
    if not centres:
        return usable.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    # Before the first pass all vectors are in ball 0, of which no radius is known.
    members, last, radii, found = usable.withColumn("cluster", F.lit(0)), None, [float("inf")] * len(centres), []
    for n in range(rounds + 1):
        written = materialize(_pass(members, Balls.around(centres, radii), dims, n < rounds), "balls", "member")
        found.append(_told(written))
        if last is not None:
            drop(last)
        last, members = written, written.where("member")
        if n < rounds:
            centres, radii = moved(centres, found[-1])
    return members.select("vec_id", "cluster", "distance"), centres, found


def query(spark, sf_dir: str) -> DataFrame:
    members, centres, found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = found[-1].inertia if found else {}
    told = [(i, _long(inertia[i]), _long(sum(inertia.values())), sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres) if i in inertia]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return members.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED) -> str:
    """SQL of the same: every round compares all vectors with all centroids."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS cluster, e FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k})
)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, any_value(e) AS e, min(s) AS s FROM (
    SELECT v.vec_id, v.e, {{'d': CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c.cluster}} AS s FROM v CROSS JOIN c{n} c
  ) GROUP BY vec_id
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
      SELECT s.c AS cluster, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM a{n} CROSS JOIN range(1, {dims + 1}) t(i) GROUP BY ALL
    ) GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.s.c AS cluster, a.s.d AS distance, CAST(sum(a.s.d) OVER (PARTITION BY a.s.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.s.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.s.c"""


ORACLE = _oracle()
