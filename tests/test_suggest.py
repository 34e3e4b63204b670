"""Joins within few edits and searches without a limit, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.functions import distance as X
from glyphflow.operators import nearest as N
from glyphflow.operators import suggest as S
from glyphflow.plans.queries import QUERIES


def osa(a, b):
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def some_words(rng, n, letters="abcdé", most=7):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)})


def column(spark, words, name="word"):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


LONG = ["abcde" * 5, "abcde" * 5 + "f", "abcde" * 4 + "abced", "abcd" * 11, "abcd" * 10 + "abdc"]


@pytest.mark.parametrize("hot", [0, 3, 1024])
@pytest.mark.parametrize("most", [1, 2, 3])
def test_close_pairs(spark, monkeypatch, hot, most):
    """Whichever remainders count as those of very many words, the pairs are the same."""
    monkeypatch.setattr(X, "HOT_ENTRIES", hot)
    rng = random.Random(most)
    one, other = some_words(rng, 90) + LONG, some_words(rng, 90) + LONG[::-1]
    found = sorted(map(tuple, X.close_pairs(column(spark, one + one[:5]), column(spark, other, "candidate"), most).collect()))
    assert found == sorted((a, b, osa(a, b)) for a in one for b in other if osa(a, b) <= most)


def test_one_remainder_of_very_many_words(spark, monkeypatch):
    """Words of one family share a remainder; with its places, those that meet are no longer all pairs of the family."""
    monkeypatch.setattr(X, "HOT_ENTRIES", 20)
    stem = "qwertyuiop"
    family = sorted({stem[:k] + c + stem[k:] for k in range(len(stem) + 1) for c in "abcdefgh"})
    found = X.close_pairs(column(spark, family), column(spark, family, "candidate"), 1)
    assert sorted(map(tuple, found.collect())) == sorted((a, b, osa(a, b)) for a in family for b in family if osa(a, b) <= 1)
    keys = column(spark, family).select("word", F.explode(X._placed_keys("word", 1, True)).alias("k")).where(F.col("k.__rest") == stem).select("word", F.explode("k.__places").alias("p"))
    others = column(spark, family).select(F.col("word").alias("o"), F.explode(X._placed_keys("word", 1, False)).alias("k")).where(F.col("k.__rest") == stem).select("o", F.explode("k.__places").alias("p"))
    assert keys.join(others, "p").select("word", "o").distinct().count() < len(family) ** 2 / 3


@pytest.mark.parametrize("hot", [3, 1024])
def test_remainders_are_not_broadcast(spark, monkeypatch, hot):
    """Remainders are some hundred times the words that Spark goes by, so neither side of their joins goes through the driver."""
    monkeypatch.setattr(X, "HOT_ENTRIES", hot)
    words = some_words(random.Random(3), 60)
    found = X.close_pairs(column(spark, words), column(spark, words, "candidate"), 2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    inner = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert "== Final Plan ==" in plan and len(inner) == (2 if hot == 3 else 1) and all("SortMergeJoin" in line for line in inner)


def test_full_tables(spark):
    rng = random.Random(5)
    one, other = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 30))) for _ in range(300)], ["".join(rng.choice("abé") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    assert X.osa_of_rows(one, other).tolist() == [osa(a, b) for a, b in zip(one, other)]
    rows = spark.createDataFrame(list(zip(one, other))[:40], "a string, b string")
    assert [r.d for r in rows.select(X.osa("a", "b").alias("d")).collect()] == [osa(a, b) for a, b in list(zip(one, other))[:40]]


def by_hand(word, entries, top, band=2):
    """Best entries, repeats included, by distance less a half for an equal tag."""
    ranked = sorted((osa(word, c) - 0.5 * alike, c, n, osa(word, c), alike) for c, n, alike in entries if abs(len(c) - len(word)) <= band)
    out, n = [], 0
    for r in ranked:
        if n < top:
            out.append(r)
            n += r[2]
    return out


def test_blocks_of_nearest():
    rng = random.Random(7)
    words = [w for w in some_words(rng, 800, most=10) if w] + ["ab" * 35, "ab" * 34 + "ba"]
    tags, copies = [rng.choice("xy") for _ in words], [rng.choice([1, 1, 2]) for _ in words]
    block = N.Block(words, tags, copies, 2)
    for asked in sorted({*some_words(rng, 60, most=12)[1:], "zzzzz", "zqzqzqz", "abc" * 23}, key=len):
        assert block.top(asked, "x", 3) == by_hand(asked, [(w, n, t == "x") for w, t, n in zip(words, tags, copies)], 3)


def test_words_of_one_length_together(monkeypatch):
    """Words that share a threshold's distances find what each finds alone, at every size of machine words."""
    monkeypatch.setattr(N, "FIRST", 20)
    rng = random.Random(29)
    sizes = (1, 2, 15, 16, 17, 32, 33, 63, 64)
    words = sorted({"".join(rng.choice("abcé") for _ in range(n + rng.randint(-1, 2))) for n in sizes for _ in range(25)})
    entries = [(w, rng.choice([1, 1, 2]), rng.choice("xy")) for w in words]
    block = N.Block([w for w, _, _ in entries], [t for _, _, t in entries], [n for _, n, _ in entries], 2)
    for n in sizes:
        asked = ["".join(rng.choice("abcéz") for _ in range(n)) for _ in range(3)]
        assert block.tops(asked, ["x", "y", "?"], 3) == [by_hand(w, [(c, k, t == tag) for c, k, t in entries], 3) for w, tag in zip(asked, "xy?")]


def test_one_very_long_entry():
    """Letters are kept as numbers up to the bits of a machine word, so one long entry does not widen the rows of all."""
    block = N.Block(["abc", "abd" * 30000, "abe" * 30000, "abcd"], ["x"] * 4, [1] * 4, 2)
    assert block.codes.shape == (4, 2)
    assert block.top("abce", "y", 3) == by_hand("abce", [("abc", 1, False), ("abcd", 1, False)], 3)


def test_bits_and_rows_agree():
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 100, (200, 12))
    lengths = np.sort(rng.integers(0, 13, 200))[::-1]
    codes[np.arange(12) >= lengths[:, None]] = -1
    for n in (0, 1, 5, 12, 62):
        word = rng.integers(97, 101, n)
        assert N.distances(word, codes, lengths).tolist() == N._rows(word, codes, lengths).tolist()


@pytest.mark.parametrize("block", [7, 10000])
def test_nearest(spark, block):
    rng = random.Random(11)
    entries = [(w, rng.choice("xy"), rng.choice([1, 2])) for w in some_words(rng, 60, "abcdefg", 9) if w]
    asked = [(w, "x") for w in some_words(rng, 30, "abchijk", 9)]
    found = N.nearest(spark.createDataFrame(asked, "word string, tag string"), spark.createDataFrame(entries, "candidate string, tag string, copies long"), 3, 2, block)
    got = {}
    for r in found.collect():
        got.setdefault(r.word, []).append((r.distance - 0.5 * r.alike, r.candidate, r.copies, r.distance, r.alike))
    want = {w: by_hand(w, [(c, n, t == "x") for c, t, n in entries], 3) for w, _ in asked if w}
    assert {w: sorted(r) for w, r in got.items()} == {w: r for w, r in want.items() if r}
    none = spark.createDataFrame([], "candidate string, tag string, copies long")
    assert N.nearest(spark.createDataFrame(asked, "word string, tag string"), none).count() == 0


def sound_of(spark, words):
    from glyphflow.functions.text import sound

    return {r.word: r.s for r in column(spark, sorted(words)).select("word", sound(F.col("word")).alias("s")).collect()}


def test_phonetic_suggestions(spark):
    """Uncapped: words with many, few and no entries near by; entries that stand twice; the empty word and none."""
    rng = random.Random(13)
    entries = some_words(rng, 70, "abcde", 8) + ["hello", "hello", "hallo", "world"]
    asked = some_words(rng, 25, "abcde", 9) + some_words(rng, 12, "vwxyz", 9) + ["helo", "wrold", "hello"]
    code = sound_of(spark, {*entries, *asked})
    found = S.suggest_phonetic(column(spark, [*asked, *asked[:4], None]), column(spark, entries))
    want = []
    for w in set(asked):
        ranked = sorted((osa(w, c) - 0.5 * (code[w] == code[c]), c) for c in entries if abs(len(c) - len(w)) <= 2)[:3]
        want += [(w, k + 1, c, osa(w, c), code[w] == code[c]) for k, (_, c) in enumerate(ranked)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_few_words_make_no_remainders(spark, monkeypatch):
    """Few words are met with the entries at once: no remainders of the entries are made, and the suggestions are those of the joins."""
    rng = random.Random(19)
    entries = column(spark, some_words(rng, 60, "abcde", 8) + ["hello", "hello", "h", ""])
    asked = column(spark, some_words(rng, 20, "abcdxyz", 9) + ["", "helo", "hello", None])
    with monkeypatch.context() as m:
        m.setattr(S, "close_pairs", None)
        found = sorted(map(tuple, S.suggest_phonetic(asked, entries).collect()))
    monkeypatch.setattr(S, "FEW", 0)
    assert found == sorted(map(tuple, S.suggest_phonetic(asked, entries).collect()))


def test_many_words_and_few_entries_make_no_remainders(spark, monkeypatch):
    """However many the words, entries of one block are met at once, and the suggestions are those of the joins."""
    rng = random.Random(31)
    entries = column(spark, some_words(rng, 60, "abcde", 8) + ["hello", "hello", "h", ""])
    asked = column(spark, some_words(rng, 40, "abcdxyz", 9) + ["", "helo", "hello", None])
    monkeypatch.setattr(S, "FEW", 0)
    with monkeypatch.context() as m:
        m.setattr(S, "close_pairs", None)
        found = sorted(map(tuple, S.suggest_phonetic(asked, entries).collect()))
    monkeypatch.setattr(S, "SCANNED", 0)
    assert found == sorted(map(tuple, S.suggest_phonetic(asked, entries).collect()))


def test_few_words_on_either_side_make_no_remainders(spark, monkeypatch):
    """The common words are compared with all others, in batches, and nothing is found but what the joins find."""
    rng = random.Random(37)
    words, entries = some_words(rng, 60, "abcdxy", 9) + ["aaaab", "ab" * 40], some_words(rng, 50, "abcde", 8) + ["ab" * 39 + "ba"]
    want = sorted((a, b, osa(a, b)) for a in set(words) for b in set(entries) if osa(a, b) <= 3)
    monkeypatch.setattr(S, "close_pairs", None)
    assert sorted(map(tuple, S.pairs_within(column(spark, words + words[:3]), column(spark, entries), 3).collect())) == want
    found = N.within(column(spark, entries, "candidate"), words, 3, "candidate", "word").select("word", "candidate", "distance")
    assert sorted(map(tuple, found.collect())) == want


def test_marks_drop_only_pairs_that_are_far(spark):
    words = some_words(random.Random(41), 150, "abcé", 8)
    marked = column(spark, words).withColumn("m", X.letter_marks("word"))
    pairs = marked.select(F.col("word").alias("a"), F.col("m").alias("ma")).crossJoin(marked.select(F.col("word").alias("b"), F.col("m").alias("mb")))
    for most in (1, 2, 3):
        assert pairs.where(~X.may_be_near("a", "b", "ma", "mb", most) & X.bounded_osa("a", "b", most).isNotNull()).count() == 0
        assert pairs.where(X.may_be_near("a", "b", "ma", "mb", most)).count() < pairs.count()


def test_remainders_are_made_by_all_tasks(spark):
    """Both sides are dealt by number before they are exploded, and pairs that are too far apart do not reach Python."""
    words = some_words(random.Random(23), 60)
    found = X.close_pairs(column(spark, words), column(spark, words, "candidate"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert {c for c in ("word", "candidate") for line in plan if f"hashpartitioning({c}#" in line and "REPARTITION_BY_NUM" in line} == {"word", "candidate"}
    python = next(k for k, line in enumerate(plan) if "ArrowEvalPython" in line)
    join = next(k for k, line in enumerate(plan) if "SortMergeJoin" in line and "Inner" in line)
    assert any("Filter" in line and "levenshtein" in line for line in plan[python:join])
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for most in (1, 2, 3):
        assert pairs.where(~X.may_be_close("a", "b", most) & X.bounded_osa("a", "b", most).isNotNull()).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents whose dictionary, common words and errors follow from the texts."""
    rng = random.Random(17)
    known = [w for w in some_words(rng, 120, "abcdefgh", 8) if w]
    wrong = ["".join(rng.choice("abcdefghxyz") for _ in range(rng.randint(1, 12))) for _ in range(80)]
    texts = [" ".join(rng.sample(known, len(known))) for _ in range(5)] + [" ".join(wrong[k::4]) for k in range(4)] + ["", None]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    every = {w for t in texts for w in (t or "").split()}
    counts = {w: sum(w in (t or "").split() for t in texts) for w in every}
    return str(path), every, {w for w, n in counts.items() if n >= 5}


def test_suggestions_of_all_documents(spark, corpus):
    """The queries over whole tables, uncapped and within two edits."""
    path, every, dictionary = corpus
    code = sound_of(spark, every)
    found = sorted(map(tuple, QUERIES["suggest_gen1_documents"](spark, path).collect()))
    want = []
    for w in every - dictionary:
        ranked = sorted((osa(w, c) - 0.5 * (code[w] == code[c]), c) for c in dictionary if abs(len(c) - len(w)) <= 2)[:3]
        want += [(w, k + 1, c, osa(w, c), code[w] == code[c]) for k, (_, c) in enumerate(ranked)]
    assert found == sorted(want)
    common = {r.word: r["rank"] for r in QUERIES["common_words"](spark, path).collect()}

    def in_order(big, small):
        rest = iter(big)
        return all(c in rest for c in small)

    near = {w for w in every if len(w) <= 4 and w in dictionary and w not in common and any(osa(w, c) == 1 and not w.startswith(c) and not c.startswith(w) for c in common)}
    want, staged = [], []
    for w in (every - dictionary) | near:
        for most, pool in ((2, dictionary), (3, dictionary & set(common))):
            keys = sorted((osa(w, c), c not in common, not in_order(c, w), code[w] != code[c], common.get(c, 2**31 - 1), abs(len(c) - len(w)), c) for c in pool if c != w and osa(w, c) <= most)[:3]
            if most == 2:
                want += [(w, k + 1, x[-1], x[0], code[w] == code[x[-1]]) for k, x in enumerate(keys)]
            if keys:
                staged += [(w, most, k + 1, x[-1], x[0]) for k, x in enumerate(keys)]
                break
    assert sorted(map(tuple, QUERIES["suggest_gen2_documents"](spark, path).collect())) == sorted(want)
    stretched = {w for w in every if any(w[k] == w[k + 1] == w[k + 2] for k in range(len(w) - 2))}
    got = sorted(tuple(r) for r in QUERIES["suggest_documents"](spark, path).collect() if r.word not in stretched)
    assert got == sorted(r for r in staged if r[0] not in stretched)


def test_checks_of_all_documents(spark, corpus):
    """Summaries and corrected texts of whole tables follow from the suggestions that the test above holds against plain loops."""
    path, every, _ = corpus
    staged = {}
    for r in QUERIES["suggest_documents"](spark, path).collect():
        staged.setdefault(r.word, {})[r.rank] = r.candidate
    dictionary = {r.word for r in QUERIES["dictionary_words"](spark, path).collect()}
    short = {r.word for r in QUERIES["short_uncommon_errors"](spark, path).collect()}
    wrong = (every - dictionary) | short
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    fixed = {i: " ".join(staged.get(w, {}).get(1, w) if w in wrong else w for w in t.split(" ")) for i, t in texts.items() if t is not None}
    got = {r.doc_id: r.corrected for r in QUERIES["corrected_documents"](spark, path).collect()}
    assert {i: got[i] for i in fixed} == fixed
    for r in QUERIES["check_documents"](spark, path).collect():
        own = (texts[r.doc_id] or "").split()
        assert (r.errors_found, r.suggestions_generated) == (sum(w in wrong for w in own), sum(len(staged.get(w, {})) for w in own if w in wrong))
        if texts[r.doc_id] is not None:
            assert r.total_tokens == len(own)
