"""Scalar functions: values known from the rules, and properties."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphflow.functions import text as T
from glyphflow.functions.distance import bounded_osa, close_pairs, osa
from glyphflow.operators import numeric as N
from glyphflow.operators import search as P
from glyphflow.plans.oracles import ORACLES
from glyphflow.plans.queries import QUERIES


def values(spark, items, make):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").select("i", make(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_counters(spark):
    assert values(spark, ["", "  ", "a b", "\ta\n b ", "x"], T.count_words) == [1, 1, 2, 2, 1]
    assert values(spark, ["", " \n", "a b"], T.count_article_words) == [0, 0, 2]
    assert values(spark, ["don't stop", "123", "é ß"], T.count_letter_words) == [3, 0, 2]
    assert values(spark, ["Hi. You?! ...", "", "no end"], T.count_sentences) == [2, 0, 1]
    assert values(spark, ["AbÉⅠß"], T.count_uppercase) == [3]
    assert values(spark, ["Education y é"], T.count_vowels) == [5]
    assert values(spark, ["A man, a plan, a canal: Panama", "", "ab"], T.is_palindrome) == [True, True, False]
    assert values(spark, ["a\r\nb\n", "", "a\n\n"], lambda c: F.size(T.lines(c))) == [2, 0, 2]
    assert values(spark, ["a\n\n", "", "\n\n", "a\nb"], lambda c: F.size(T.lines_to_last(c))) == [1, 1, 0, 2]


def test_words(spark):
    assert values(spark, ["helloooo", "hello"], T.has_long_run) == [True, False]
    assert values(spark, ["helloooo"], lambda c: T.squeeze(c, 2)) == ["helloo"]
    assert values(spark, ["helloooo"], lambda c: T.squeeze(c, 1)) == ["helo"]
    words = ["ashcraft", "recieve", "receive", "mesage", "message", "phone", "fone", "tymczak", "", "école", "ßa"]
    assert values(spark, words, T.sound) == ["A226", "R210", "R210", "M220", "M220", "P500", "F500", "T522", "0000", "É240", "ß000"]
    assert values(spark, ["RECIEVE", "recieve", "Écoel"], lambda c: T.copy_case(c, F.lit("receive"))) == ["Receive", "receive", "Receive"]
    assert values(spark, ["going", "gong"], lambda c: T.contains_in_order(c, F.lit("goin"))) == [True, False]
    assert values(spark, ["ababc", "aabaaab", "a", ""], T.prefix_table) == [[0, 0, 1, 2, 0], [0, 1, 0, 1, 2, 2, 3], [0], []]


def test_estimates_without_words(spark, tmp_path):
    """A share without denominator is printed as such, as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["one two", "123", "", None] + ["two"] * 5
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {tuple(r) for r in QUERIES["accuracy_estimates"](spark, str(tmp_path)).collect()}
    assert (1, f"{T.NO_SHARE} (0/0), 95 % interval +-{T.NO_SHARE}") in found
    documents = f"WITH documents AS (FROM '{tmp_path}/documents.parquet/*.parquet'), "
    assert found == set(duckdb.connect().sql(documents + ORACLES["accuracy_estimates"].removeprefix("WITH ")).fetchall())


def test_composed(spark):
    frame = spark.createDataFrame([("Å",), ("plain",), ("é",)], "w string")
    assert sorted(r.w for r in T.composed(frame, "w").collect()) == sorted(["Å", "plain", "é"])


def by_hand(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance(spark):
    rng = random.Random(1)
    pairs = [("recieve", "receive"), ("wat", "what"), ("mesage", "message"), ("ca", "abc"), ("kitten", "sitting"), ("", "ab"), ("ab", ""), ("", "")]
    assert [by_hand(*p) for p in pairs[:5]] == [1, 1, 1, 3, 3]
    pairs += [tuple("".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(2)) for _ in range(300)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", osa("a", "b").alias("d"), *(bounded_osa("a", "b", k).alias(f"d{k}") for k in (1, 2, 3))).collect():
        d = by_hand(r.a, r.b)
        assert r.d == d
        assert [r.d1, r.d2, r.d3] == [d if d <= k else None for k in (1, 2, 3)]


def test_close_pairs_are_all_pairs(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    found = close_pairs(frame, frame.select(F.col("word").alias("candidate")), 2)
    assert {(r.word, r.candidate, r.distance) for r in found.collect()} == {(a, b, by_hand(a, b)) for a in words for b in words if by_hand(a, b) <= 2}


def test_search(spark):
    cases = [("abababa", "aba", [0, 2, 4]), ("aaaa", "aa", [0, 1, 2]), ("abc", "", []), ("ab", "abc", []), ("x\\Ey\\E", "\\E", [1, 4]), ("", "a", []), ("xaab", "aa", [1]), ("ééa", "a", [2])]
    frame = spark.createDataFrame([c[:2] for c in cases], "t string, p string")
    rows = frame.select("t", "p", P.positions(F.col("t"), F.col("p")).alias("x"), P.occurrences(F.col("t"), F.col("p")).alias("n")).collect()
    assert [(r.t, r.p, r.x) for r in rows] == cases
    assert [r.n for r in rows] == [len(c[2]) for c in cases]
    texts = spark.createDataFrame([(1, "ushers"), (2, "")], "doc_id int, text string")
    patterns = P.pattern_table(spark, ["he", "she", "his", "hers", "he"])
    found = P.in_scan_order(P.multi_search(texts, patterns)).orderBy("ord").collect()
    assert [(r.pattern, r.start, r.end_index) for r in found] == [("she", 1, 3), ("he", 2, 3), ("he", 2, 3), ("hers", 2, 5)]
    one = spark.createDataFrame([(" a, b,,a ,",)], "p string").select(P.clean_patterns(F.col("p")).alias("c")).first()
    assert one.c == ["a", "b"]


def test_numbers(spark):
    numbers = [0, 1, 2, 3, 4, 9, 97, 561, 1000003, 2**61 - 1, 3215031751, 10**12 + 39]
    frame = N.prime_by_trial(spark.createDataFrame([(n,) for n in numbers], "n long"), "n", "trial")
    found = {r.n: (r.is_prime, r.trial) for r in N.miller_rabin(frame, "n").collect()}
    prime = {2, 3, 97, 1000003, 2**61 - 1, 10**12 + 39}
    assert {n: p for n, (p, _) in found.items()} == {n: n in prime for n in numbers}
    assert all(t is None if n > 10**12 else t == p for n, (p, t) in found.items())
    arrays = spark.createDataFrame([([3, 1, 2],), ([],)], "v array<int>").select(N.scan_array(F.col("v")).alias("s")).collect()
    assert [r.s for r in arrays] == [[0, 3, 4], []]


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__file__).resolve().parents[1] / "glyphflow"
    assert not [f for f in root.rglob("*.py") if "llm" not in f.parts and "glyphflow.llm" in f.read_text()]
