"""Operators that go over a whole table in order, and numbers, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glyphflow.operators import evaluate as E
from glyphflow.operators import graph as G
from glyphflow.operators import numeric as N
from glyphflow.operators import search as P


def sequential(rows):
    """The edges that are taken in order, graph by graph."""
    out, used = set(), set()
    for g, o, u, v in sorted({r for r in rows if None not in r}, key=lambda r: r[1:]):
        if (g, u) not in used and (g, v) not in used:
            used |= {(g, u), (g, v)}
            out.add((g, o, u, v))
    return out


def some_graphs(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), rng.randrange(200), rng.randrange(25), rng.randrange(25)) for _ in range(160)]
    rows += [(5, k, k, k + 1) for k in range(30)]  # a chain in order: an edge waits for the one before
    rows += [(6, 100 - k, 0, k) for k in range(1, 60)] + [(6, 200, 7, 8), (6, 1000, 61, 62)]  # a hub
    rows += [(7, 1, 4, 4), (7, 2, 4, 5), (7, 3, 5, 6)]  # a loop
    return [*rows, rows[0], rows[0], (None, 1, 1, 2), (1, None, 1, 2), (1, 3, None, 2)]


@pytest.mark.parametrize("few", [0, 40, 1 << 16])
def test_ordered_matching(spark, few):
    rows = some_graphs(1)
    edges = spark.createDataFrame([(*r, "x") for r in rows], "graph_id int, ord long, u long, v long, vertex string")
    found = G.ordered_matching(edges, few=few)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(rows)
    want = {}
    for g, _, u, v in sequential(rows):
        size, n = want.get(g, (0, 0))
        want[g] = (size + len({u, v}), n + 1)
    assert {r.graph_id: (r["size"], r.matched) for r in G.cover_counts(edges, found).collect()} == want
    assert all(r.covers for r in G.cover_counts(edges, found).collect())
    missing = G.cover_counts(edges.where("graph_id = 5"), found.where("graph_id = 5 and ord < 4"))
    assert [r.covers for r in missing.collect()] == [False]
    assert G.ordered_matching(edges.where("false"), few=few).count() == 0


def test_rounds_of_the_matching_compare_by_hashing(spark, monkeypatch):
    """Minima of whole edges would be sorted for, twice in every round."""
    plans, write = [], G.settled
    monkeypatch.setattr(G, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    edges = spark.createDataFrame([(0, 5, k, k + 100) for k in range(30)] + [(0, 4, 3, 101), (0, 4, 2, 101)], "graph_id int, ord long, u long, v long")
    got = {(r.ord, r.u, r.v) for r in G.ordered_matching(edges, few=0).collect()}
    assert got == {(5, k, k + 100) for k in range(30) if k not in (1, 2)} | {(4, 2, 101)}
    assert len(plans) > 2 and any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p for p in plans)


def test_matching_agrees_with_the_fold(spark):
    """The rounds take the edges that the fold over a small graph's list takes."""
    rows = [r for r in some_graphs(2) if None not in r]
    edges = spark.createDataFrame(rows, "graph_id int, ord int, u int, v int")
    lists = G.edge_lists(edges.dropDuplicates()).withColumn("a", G.approximate_cover(F.col("edges"))).select("graph_id", "a.matched", F.size("a.cover").alias("size"))
    assert {tuple(r) for r in lists.collect()} == {(r.graph_id, r.matched, r["size"]) for r in G.cover_counts(edges, G.ordered_matching(edges, few=0)).collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_table_scan(spark, partitions):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(50), rng.choice([None, 0, rng.randrange(-5, 100), 1 << 40])) for _ in range(700)]
    rows = list({r[:2]: r for r in rows}.values()) + [(None, 1, 4), (None, 2, 5)] + [(50, 1, 0)] * 60
    frame = spark.createDataFrame([(*r, "x") for r in rows], "d int, line int, n long, other string").repartition(5)
    scanned = N.table_scan(frame, "n", ["d", "line"], partitions=partitions)
    assert scanned.columns == ["d", "line", "n", "other", "scan"]
    got = sorted((tuple(r) for r in scanned.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))
    total, want = 0, []
    for d, line, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((d, line, n, "x", total))
        total += n or 0
    assert got == want
    assert tuple(N.table_scan_check(scanned, "n").first()) == (len(rows), total, True)
    wrong = scanned.withColumn("scan", F.when((F.col("d") == 7), F.col("scan") + 1).otherwise(F.col("scan")))
    assert not N.table_scan_check(wrong, "n").first().agrees
    assert N.table_scan(frame.where("false"), "n", ["d", "line"]).count() == 0
    assert tuple(N.table_scan_check(N.table_scan(frame.where("false"), "n", ["d", "line"]), "n").first()) == (0, 0, True)


def is_prime(n):
    return n >= 2 and all(n % d for d in range(2, math.isqrt(n) + 1))


def test_primes_without_python(spark):
    """Every number up to some thousand, strong pseudoprimes, and numbers whose products need more than 64 bits."""
    hard = [2047, 1373653, 25326001, 3215031751, 2152302898747, 3474749660383, 341550071728321, 3825123056546413051]
    primes = [2**31 - 1, 3037000493, 3037000507, 10**12 + 39, 10**18 + 9, 2**61 - 1, 9223372036854775783]
    squares = [3037000493**2, 1000003 * 1000033, 2**62, 9223372036854775807]
    numbers = [*range(-3, 3000), *hard, *primes, *squares, -(2**63), None]
    frame = spark.createDataFrame([(n,) for n in numbers], "n long")
    tested = N.miller_rabin(frame, "n")
    plan = tested._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    known = set(primes)
    assert {r.n: r.is_prime for r in tested.collect()} == {n: None if n is None else n in known or (n < 3000 and is_prime(n)) for n in numbers}


def test_primes_in_blocks(spark, monkeypatch):
    for limit, width in ((1, 8192), (2, 4), (100, 7), (1000, 64), (9000, 8192)):
        blocks = {r.block: list(r.primes) for r in N.prime_blocks(spark, limit, width).collect()}
        assert [p for k in sorted(blocks) for p in blocks[k]] == [p for p in range(limit + 1) if is_prime(p)]
        assert all(p // width == k for k, own in blocks.items() for p in own)
    numbers = [*range(-2, 200), 8191**2, 8209 * 8191, 8209**2, 999983 * 999979, 10**12, 10**12 + 1, 999999999989, 97, 97, None]
    found = N.prime_by_trial(spark.createDataFrame([(n, 1) for n in numbers], "n long, block int"), "n", "p")
    assert found.columns == ["n", "block", "p"]
    got = sorted((tuple(r) for r in found.select("n", "p").collect()), key=str)
    assert got == sorted(((n, None if n is None or n > 10**12 else is_prime(n)) for n in numbers), key=str)
    assert N.prime_by_trial(spark.createDataFrame([(1,), (3,)], "n long"), "n", "p").where("p").count() == 1


def test_positions_in_both_units(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab🙂é𝒳 ") for _ in range(rng.randrange(400))) for _ in range(40)] + ["", None, "🙂", "aaaa", "🙂" * 300]
    for pattern in ("a", "aa", "🙂", "b🙂", "é ", "𝒳a"):
        frame = spark.createDataFrame([(t, pattern) for t in texts], "t string, p string")
        found = frame.select("t", P.positions(F.col("t"), F.col("p")).alias("points"), P.positions(F.col("t"), F.col("p"), P.utf16_length).alias("units")).collect()
        for r in found:
            if r.t is None:
                continue
            starts = [k for k in range(len(r.t)) if r.t.startswith(pattern, k)]
            assert r.points == starts
            assert r.units == [len(r.t[:k].encode("utf-16-le")) // 2 for k in starts]


@pytest.mark.parametrize("size", [1, 5, 1500])
def test_stratified_sample(spark, size):
    from hashlib import md5

    rows = [(k, "big" if k % 3 else f"s{k % 7}", None if k % 11 == 0 else "en") for k in range(3000)]
    frame = spark.createDataFrame(rows, "k long, source string, lang string").repartition(6)
    found = E.stratified_sample(frame, ["source", "lang"], size, 4, "k")
    groups = {}
    for r in rows:
        groups.setdefault(r[1:], []).append(r)
    want = set()
    for own in groups.values():
        own.sort(key=lambda r: md5(f"4:{r[0]}".encode()).hexdigest())
        want |= {(*r, n + 1) for n, r in enumerate(own[:size])}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert E.stratified_sample(frame.where("false"), ["source"], size, 4, "k").count() == 0


def test_random_trials(spark):
    """Failures are listed; without common words of five letters there are no trials and no shares."""
    words = spark.createDataFrame([(w, len(w)) for w in ("hello", "world", "there", "the")], "word string, len int")
    common = spark.createDataFrame([("hello", 0), ("world", 1), ("the", 2)], "word string, rank int")
    tried = E.random_trials(words, common, 40, 3)
    assert tried.count() == 2
    failed = {r.word for r in E.trial_failures(tried).collect()}
    assert failed == {r.word for r in tried.collect() if not r.detected or r.top1 != r.word}
    everything_known = tried.withColumn("detected", F.lit(False))
    assert [tuple(r)[2:] for r in E.trial_failures(everything_known.withColumn("top1", F.lit(None).cast("string")), 1).collect()] == [("(none)", True)]
    nothing = E.monte_carlo(words, common.where("word = 'the'")).first()
    assert nothing.trials == 0 and set(tuple(nothing)[1:]) == {None}
