"""Clustering and whitening of vectors against plain loops."""

import random
from hashlib import sha256

import numpy as np
import pytest

from glyphflow.llm import ball_kmeans, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, x int, member int, id int, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "d", 2, 3, 4, 5) for i, v in rows], SCHEMA).repartition(3)


def kmeans_by_hand(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [int(np.floor(max(-(2.0**53), min(2.0**53, 256 * float(np.float32(c)))))) for c in v]))
    centres = [v for _, v in sorted(kept, key=lambda r: (sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for n in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if n < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, b) in zip(kept, best) if b == j]
                if own:
                    centres[j] = [sum(c) // len(own) for c in zip(*own)]
    top = (1 << 63) - 1
    return sorted((i, b, min(top, d)) for (i, _), (d, b) in zip(kept, best)), centres


def ties(n, seed):
    """Vectors on a small grid: many equal ones, many equal distances."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 0, 1]) / 64 for _ in range(4)]) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, [0.0] * 4), (900, None), (901, []), (902, [0.0] * 3), (903, [0.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0])]


def apart(n, seed):
    """Twelve clouds far from each other."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 4, (12, 4))
    return [(i, [float(c) for c in middles[i % 12] + rng.normal(0, 0.05, 4)]) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [ties(150, 1), apart(240, 2), [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)], ties(3, 3)[:3], [*apart(40, 4), (50, [1e30, -1e30, 1e-30, 0.0]), (51, [3e38, 0.0, 0.0, 0.0]), (52, [-3e38, 0.0, 0.0, 0.0])]],
    ids=["ties", "apart", "equal", "few", "huge"],
)
def test_clusters(spark, rows):
    members, centres, found = ball_kmeans.cluster(table(spark, rows), k=8, rounds=3, dims=4)
    want, want_centres = kmeans_by_hand(rows, 8, 3, 4)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in members.collect()) == want
    assert centres == want_centres
    assert sum(found[-1].n.values()) == len(want)


def test_balls_spare_comparisons(spark):
    """With clouds far apart, members are compared with few centroids once the balls are known."""
    rows = apart(600, 5)
    _, centres, found = ball_kmeans.cluster(table(spark, rows), k=8, rounds=3, dims=4)
    assert found[-1].compared < 600 * len(centres) / 2 and found[0].compared > found[-1].compared


def test_stable_members_are_in_the_core():
    balls = ball_kmeans.Balls.around([[0, 0], [10, 0], [0, 30]], [6.0, 1.0, 1.0])
    assert balls.near == [[1], [], []] and balls.ways[0] == [100]
    cluster, distance, compared = balls.assign(np.array([[4, 0], [5, 0], [6, 0]]), np.zeros(3, np.int32))
    assert (cluster.tolist(), distance.tolist(), compared) == ([0, 0, 1], [16, 25, 16], 5)


def test_no_vectors(spark):
    members, centres, found = ball_kmeans.cluster(table(spark, []))
    assert members.count() == 0 and not centres and not found


def test_clustering_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(120)] + [(500, [0.1] * 63)]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, centres = kmeans_by_hand(rows, 40, 5, 64)
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    found = ball_kmeans.query(spark, str(tmp_path))
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(tuple, found.collect())) == [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in want]


def whitened_by_hand(rows, most=32):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], np.longdouble)
    y = x - x.mean(0)
    covariance = np.array(y.T @ y / len(x), float)
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    n, s = len(kept), [sum(c) for c in zip(*(v for _, v in kept))]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for _, v in kept]
    return [i for i, _ in kept], np.array(y, float), e, u, covariance, deviation


def cloud(n, dims, seed, spread=None):
    rng = np.random.default_rng(seed)
    spread = np.linspace(3, 0.3, dims) if spread is None else spread
    turn = np.linalg.qr(rng.normal(0, 1, (dims, dims)))[0]
    return [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(0, 1, (n, dims)) * spread @ turn)]


def test_whitening(spark):
    rows = cloud(300, 6, 1)
    rows += [rows[5], rows[5], (None, [1.0] * 6), (900, None), (901, []), (902, [1.0] * 5), (903, [None] * 6), (904, [float("nan")] * 6), (905, [1.0, float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    found, fit = whitening.whiten(table(spark, rows), most=4)
    own = [(i, v) for i, v in rows if not v or len(v) == 6]
    ids, y, e, u, covariance, deviation = whitened_by_hand(own)
    want = y @ u / np.sqrt(e)
    got = sorted(found.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.whitened, r.component))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {len(ids)} and max(r.identity_error for r in got) < 1e-9
    signs = np.sign((fit.components * u[:, :4]).sum(0))
    assert np.abs(fit.components * signs - u[:, :4]).max() < 1e-12
    by_id = {}
    for i, w, d in zip(ids, want[:, :4] * signs, deviation):
        by_id.setdefault(i, []).append((w, d))
    for r in got:
        assert any(abs(w[r.component - 1] - r.whitened) < 1e-9 and d == r.deviation for w, d in by_id[r.vec_id])
        assert abs(r.explained - e[r.component - 1] / np.trace(covariance)) < 1e-9
    for i, many in by_id.items():
        assert sum(r.vec_id == i for r in got) == 4 * len(many)


def test_small_deviations_keep_their_digits(spark):
    """Dimensions whose deviations are far apart: rotations find the small ones to their own precision."""
    spread = np.array([1e6, 1e3, 1.0, 3e-2])
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(0, 1, (500, 4)) * spread)]
    _, fit = whitening.whiten(table(spark, rows))
    _, y, e, _, _, _ = whitened_by_hand(rows)
    assert np.abs(fit.deviations**2 / e - 1).max() < 1e-6


@pytest.mark.parametrize("dims", [1, 2, 5, 8])
def test_rotations(dims):
    rng = np.random.default_rng(dims)
    r = np.triu(rng.normal(0, 1, (dims, dims)))
    lengths, v = whitening.rotate(r)
    assert np.abs(lengths - np.linalg.svd(r, compute_uv=False)).max() < 1e-13
    assert np.abs(v.T @ v - np.eye(dims)).max() < 1e-13
    assert np.abs((r @ v).T @ (r @ v) - np.diag(lengths**2)).max() < 1e-12


def test_what_does_not_vary(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)]):
        found, fit = whitening.whiten(table(spark, rows))
        assert fit is None and found.count() == 0 and found.columns[0] == "vec_id"
    flat = [(i, [*v, v[0]]) for i, v in cloud(50, 2, 3)]  # three dimensions, two of them equal
    found, fit = whitening.whiten(table(spark, flat))
    assert len(fit.deviations) == 2 and found.count() == 100 and found.first().identity_error < 1e-9
    found, fit = whitening.whiten(table(spark, cloud(3, 6, 2)))  # fewer rows than dimensions
    assert len(fit.deviations) == 2 and found.count() == 6


def test_deviations_beyond_a_long():
    sums = whitening.Sums(4, 2, [0, 0], 1 << 52)
    assert sums.deviations(np.array([[1 << 52, 0], [3, 4]])).tolist() == [(1 << 63) - 1, 16 * 25]


def test_whitening_query(spark, tmp_path):
    rows = cloud(200, 40, 6)
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = whitening.query(spark, str(tmp_path))
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = found.collect()
    ids, y, e, u, covariance, deviation = whitened_by_hand(rows)
    want = np.abs(y @ u[:, :32] / np.sqrt(e[:32]))
    assert len(got) == 200 * 32
    for r in got:
        assert abs(abs(r.whitened) - want[r.vec_id, r.component - 1]) < 1e-8 and r.deviation == deviation[r.vec_id]
        assert abs(r.explained - e[r.component - 1] / np.trace(covariance)) < 1e-9 and r.identity_error < 1e-9
