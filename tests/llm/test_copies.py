"""Substring dedup, near duplicates and line dedup against brute force."""

import random

import pytest
from corpus import rows, sentence, table, written
from pyspark.sql import functions as F

from glyphflow.llm import line_dedup, ngram_jaccard, substring_dedup
from glyphflow.llm.blocks import Words
from glyphflow.llm.components import components


def removed_by_hand(given, n=13):
    split = {i: (t or "").encode().split() for i, t in given}
    first = {}
    for i in sorted(split):
        for j in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][j : j + n]), i)
    out = {}
    for i, w in split.items():
        gone = {k for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i for k in range(j, j + n)}
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_words_that_cancel():
    """A word of a pattern that sums of powers cannot tell from its complement, and long words that differ late."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    words = [word.encode(), word.translate(str.maketrans("ab", "ba")).encode(), b"x" * 300, b"x" * 299 + b"y", b"x" * 8, b"x" * 9, b"x" * 9 + b"\x00", b"", b"abcdefgh1", b"abcdefgh2"]
    assert len(set(Words(words).hash.tolist())) == len(words) - 1
    given = [(1, " ".join(["k"] * 12 + [words[0].decode()])), (2, " ".join(["k"] * 12 + [words[1].decode()]))]
    assert len({Words([t.encode() for _, t in given]).windows(13, f)[1].tobytes()[:8] for f in (0, 1)}) == 2
    assert removed_by_hand(given)[2][1] == 0


def test_substrings(spark):
    found = substring_dedup.dedup_substrings(table(spark)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == removed_by_hand(rows())


def test_substrings_of_repeated_ids_and_no_ids(spark):
    text = " ".join(f"w{k}" for k in range(20))
    found = substring_dedup.dedup_substrings(table(spark, [(5, text), (5, text), (None, text), (9, text), (None, None)])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in found) == [(-1, 0), (-1, 0), (5, 0), (5, 0), (9, 20)]


def test_empty_tables(spark, tmp_path):
    none = written(spark, tmp_path / "none", [])
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert ngram_jaccard.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def components_by_hand(given):
    sets = {}
    for i, t in given:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j : j + 5]) for j in range(len(w) - 4)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("chunk", [512, 4])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_jaccard.link_sets, "__defaults__", (80, chunk))
    monkeypatch.setattr(ngram_jaccard, "HOT", chunk)  # tokens of more than four nodes are joined apart
    found = ngram_jaccard.near_duplicates(table(spark)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_by_hand(rows())


def test_chains_are_whole(spark):
    """Each is like the next; the first and the last have nothing in common."""
    words = [f"w{k}" for k in range(400)]
    given = [(100 - k, " ".join(words[k * 6 : k * 6 + 100])) for k in range(20)]
    by_hand = components_by_hand(given)
    assert len({c for _, c in by_hand.values()}) == 1
    found = ngram_jaccard.near_duplicates(table(spark, given)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == by_hand


def test_one_of_each_group_stays(spark, tmp_path):
    docs = written(spark, tmp_path / "docs")
    kept = ngram_jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in components_by_hand(rows()).values()})


def test_rows_without_id(spark, tmp_path):
    text = sentence(random.Random(1), 40)
    docs = written(spark, tmp_path / "ids", [(None, text), (None, text), (7, text), (7, text), (None, None)])
    found = ngram_jaccard.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 7), (0, 7), (7, 7), (7, 7)]
    assert ngram_jaccard.drop_near_duplicates(docs).count() == 2


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (6, 6), (9, 8), (8, 7), (7, 3)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, edits + 2)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        pairs.append((a, "".join(b)))
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within("a", "b", edits).alias("w")).collect()
    assert [r.w for r in found] == [distance(r.a, r.b) <= edits for r in found]


def lines_by_hand(given, edits=1, least=24):
    first = {}
    for i, t in given:
        for p, x in enumerate(t.split("\n") if t else []):
            if x.strip():
                first.setdefault(x, (i, p))
    long = [x for x in first if len(x) >= least]
    near = {b for a in long for b in long if first[a] < first[b] and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    out = {}
    for i, t in given:
        kept, repeated, close = [], 0, 0
        for p, x in enumerate(t.split("\n") if t else []):
            if x in first and first[x] != (i, p):
                repeated += 1
            elif x in near:
                close += 1
            else:
                kept.append(x)
        out[i] = (repeated, close, "\n".join(kept))
    return out


@pytest.mark.parametrize(("edits", "bucket"), [(1, 32), (1, 2), (2, 32)])
def test_lines(spark, tmp_path, monkeypatch, edits, bucket):
    """Bucket 2 sends all shared segments through the fragments and the single letters."""
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    rng = random.Random(5)
    base = sentence(rng, 8)
    lines = [sentence(rng, rng.randint(1, 9)) for _ in range(20)]
    for _ in range(60):
        k = rng.randrange(len(base))
        lines.append(rng.choice([base, base[:k] + base[k + 1 :], base[:k] + "Z" + base[k:], base[:k] + rng.choice("XY") + base[k + 1 :], base[:k] + "UV" + base[k + 1 :]]))
    given = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 4)))) for i in range(50)]
    given += [(50, None), (51, ""), (52, "\n"), (53, base + "\r\n" + base)]
    found = line_dedup.dedup_lines(written(spark, tmp_path / "lines", given), edits=edits).collect()
    assert {r.doc_id: (r.n_repeated, r.n_near, r.kept_text) for r in found} == lines_by_hand(given, edits)


def test_short_lines(spark, tmp_path):
    """Exact copies go whatever their length, near copies only if they are long; blank lines stay."""
    given = [(1, "And ornd.\n\n}\n  \nOf, edti oner."), (2, "}\n\nAnd ornd.\nAnd ornd!\n  \nx"), (3, "x\nOf, edti oner.")]
    written(spark, tmp_path / "sf" / "documents.parquet", given)
    docs = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    kept = {1: given[0][1], 2: "\nAnd ornd!\n  \nx"}  # nothing is left of the third
    assert {r.doc_id: r.text for r in line_dedup.clean(docs).collect()} == kept
    found = {r.doc_id: (r.n_lines, r.n_repeated, r.n_near) for r in line_dedup.query(spark, str(tmp_path / "sf")).collect()}
    assert found == {1: (5, 0, 0), 2: (6, 2, 0), 3: (2, 2, 0)}


def test_lines_cleaned(spark, tmp_path):
    docs = written(spark, tmp_path / "cleaned").withColumn("n_lines", F.lit("own"))
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns
    by_hand = lines_by_hand(rows())
    found = out.collect()
    assert {r.doc_id for r in found} == {i for i, (repeated, near, kept) in by_hand.items() if not repeated + near or kept.strip()}
    for r in found:
        repeated, near, kept = by_hand[r.doc_id]
        assert r.n_lines == "own"
        assert r.text == (kept if repeated + near else dict(rows())[r.doc_id])
        assert r.n_chars == len(r.text or "")
