"""Operators on small inputs."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphflow.operators import checking as C
from glyphflow.operators import dictionary as D
from glyphflow.operators import evaluate as E
from glyphflow.operators import graph as G
from glyphflow.operators import search as P
from glyphflow.operators import suggest as S
from glyphflow.operators import tokens as K
from glyphflow.sources import readers, reports

WORDS = ["what", "is", "your", "name", "hello", "hell", "receive", "the", "then", "than", "message", "form", "from"]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w, len(w)) for w in WORDS], "word string, len int").cache()


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([(w, k) for k, w in enumerate(["the", "is", "what", "from", "hello", "name"])], "word string, rank int").cache()


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_tokens(spark):
    found = K.tokens(frame(spark, "Teh cat\r\n\nÉtait l'été\n")).orderBy("doc_id", "line", "word_number").collect()
    assert [(r.line, r.word_number, r.raw, r.word) for r in found] == [(1, 1, "Teh", "teh"), (1, 2, "cat", "cat"), (3, 1, "Était", "était"), (3, 2, "l", "l"), (3, 3, "été", "été")]
    assert K.tokens_composed(frame(spark, "")).count() == 0
    sample = frame(spark, "fun are hackathons are fun hackathons", " x", "")
    assert {(r.doc_id, r.word, r.n) for r in K.most_frequent(K.word_frequency(K.raw_words(sample), ["doc_id"]), ["doc_id"]).collect()} == {(0, "are", 2), (1, "", 1), (2, "", 1)}
    patterns = spark.createDataFrame([("he",), ("she",), ("hers",), ("",)], "pattern string")
    assert K.pattern_nodes(patterns).first().nodes == 1 + len({"h", "he", "her", "hers", "s", "sh", "she"})


def test_near_common_words(spark, tmp_path):
    """Against brute force, with long words; one has far more letters than any common word."""
    from glyphflow.plans.queries import QUERIES

    rng = random.Random(6)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 11))) for _ in range(60)]
    for w in base[:30]:
        k = rng.randrange(len(w))
        base += [w[:k] + rng.choice("xyz") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]]
    many = [f"{a}{b}{c}q" for a in "efgh" for b in "ijklmnop" for c in "rstuvwxyzabcdefghijklmnop"] + [f"{a}{b}{c}qq" for a in "efgh" for b in "ijklmnop" for c in "rstu"]
    frequent = [w for w in base[:40] if w] + many
    texts = [" ".join(frequent)] * 2 + [" ".join(w for w in base if w)] + ["w" * 400]
    frame(spark, *texts).select(F.col("doc_id").cast("long").alias("doc_id"), "text").write.parquet(str(tmp_path / "documents.parquet"))
    common = {r.word for r in QUERIES["common_words"](spark, str(tmp_path)).collect()}

    def one_edit(a, b):
        if len(a) == len(b):
            wrong = [k for k in range(len(a)) if a[k] != b[k]]
            return len(wrong) == 1 or (len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]])
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    every = {w for t in texts for w in t.split()}
    by_hand = {w for w in every if any(one_edit(w, c) and not w.startswith(c) and not c.startswith(w) for c in common)}
    found = [r.word for r in QUERIES["near_common_words"](spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) and set(found) == by_hand
    assert any(len(w) > 4 for w in by_hand) and by_hand != every


def test_lookup(spark, words, common):
    given = spark.createDataFrame([("teh",), ("the",), ("form",), ("then",), ("zz",)], "word string")
    assert {r.word for r in D.known(given, words).collect()} == {"the", "form", "then"}
    assert {r.word for r in D.unknown(given, words).collect()} == {"teh", "zz"}
    # "form" is one swap from "from"; "then" begins with "the"; "than" is two edits from it and one letter from "what" is not.
    assert {(r.word, r.known) for r in D.potential_errors(given, words, common).collect()} == {("teh", False), ("zz", False), ("form", True)}
    prefixes = spark.createDataFrame([("",), ("th",), ("zz",), ("receives",)], "prefix string")
    assert {r.prefix: r.found for r in D.starts_with(prefixes, words).collect()} == {"": True, "th": True, "zz": False, "receives": False}
    assert D.linear_lookup(given, words).count() == 3
    assert {r.prefix: r.found for r in D.starts_with(prefixes, words.where("false")).collect()} == {"": True, "th": False, "zz": False, "receives": False}


def test_suggestions(spark, words, common):
    given = spark.createDataFrame([("wat",), ("helloooo",), ("recieve",), ("qjvxzkq",), ("xhatze",)], "word string")
    staged = S.suggest_staged(given, words, common).collect()
    best = {r.word: (r.stage, r.candidate, r.distance) for r in staged if r.rank == 1}
    assert best == {"wat": (2, "what", 1), "helloooo": (1, "hello", 1), "recieve": (2, "receive", 1), "xhatze": (3, "what", 3)}
    one = S.suggest_phonetic(given, words.unionByName(words.where("word = 'what'"))).where("word = 'wat'").orderBy("rank").collect()
    assert [(r.candidate, r.distance) for r in one[:2]] == [("what", 1), ("what", 1)]
    counts = {r.word: r.comparisons for r in S.comparisons(given, words, True).collect()}
    assert counts["wat"] == sum(1 <= len(w) <= 5 for w in WORDS) and counts["helloooo"] == sum(6 <= len(w) <= 10 for w in WORDS)


def test_documents(spark, words, common):
    docs = frame(spark, "Wat is yuor name\r\nRECIEVE!", "", "the name")
    errors, suggestions = C.check(docs, words, common)
    fixed = {r.doc_id: r.corrected for r in C.corrected_text(docs, errors, suggestions).collect()}
    assert fixed == {0: "What is your name\nReceive!", 1: "", 2: "the name"}
    summary = {r.doc_id: r for r in C.check_summary(docs, errors, suggestions).collect()}
    assert (summary[0].total_tokens, summary[0].errors_found, summary[0].input_type) == (5, 3, "Short Sentence")
    assert (summary[1].total_tokens, summary[1].accuracy, summary[1].input_type) == (0, 0.0, "Single Word")
    totals = C.document_accuracy(docs, K.tokens(docs), words)
    assert {r.doc_id: (r.total_words, r.errors_found, r.accuracy_percent) for r in totals.collect()} == {0: (5, 3, 40.0), 1: (0, 0, 0.0), 2: (2, 0, 100.0)}
    assert tuple(C.overall(totals).first()) == (3, 7, 3, 57.1)
    report = reports.batch_report(C.analyze(docs, words), totals)
    first = json.loads(report.where("source = '0'").select(F.to_json(F.struct("*")).alias("j")).first().j)
    assert [(e["line"], e["word_number"], e["word"]) for e in first["errors"]] == [(1, 1, "Wat"), (1, 3, "yuor"), (2, 1, "RECIEVE")]
    assert first["errors"][0]["suggestions"][0] == "what"
    assert reports.overall_summary(totals.where("false")).count() == 0


def test_strategy(spark):
    counts = [0, 1, 2, 20, 21, 300, 301]
    found = spark.createDataFrame([(n,) for n in counts], "n int").select("n", C.strategy(F.col("n")).alias("s")).collect()
    assert [(r.s.input_type.split()[0], r.s.use_filtering) for r in found] == [("Single", False), ("Single", False), ("Short", False), ("Short", False), ("Paragraph", True), ("Paragraph", True), ("Large", True)]


def test_evaluation(spark, words, common):
    pairs = spark.createDataFrame([("what", "wat"), ("form", "from"), ("name", "name"), ("odd", "odd"), ("receive", "recieve")], "correct string, corrupted string")
    flags = E.flag_pairs(pairs, words, common)
    confused = E.confusion(flags)
    assert tuple(confused.first()) == (2, 1, 1, 1)
    assert E.precision_recall(confused).first().recall == pytest.approx(2 / 3)
    assert tuple(E.top_accuracy(flags).first()) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert [(r.correct, r.not_detected) for r in E.failures(flags).collect()] == [("form", True)]
    nothing = E.precision_recall(E.confusion(flags.where("false"))).first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (None, None, None)
    assert E.reservoir(words, 5, 1).count() == 5 and E.reservoir(words, 100, 1).count() == len(WORDS)
    many = spark.createDataFrame([("aab",), ("x",), ("hello",)] * 50, "word string")
    assert E.corrupt(many, 3).where("word = corrupted").count() == 0
    drawn = E.monte_carlo(words, common, 1)
    assert drawn.first().trials == 1  # the common words of five letters or more are fewer than five


def test_flows(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        for k in range(14):
            u, v = rng.sample(range(6), 2)
            rows.append((g, k, u, v, rng.randint(1, 9), 0, 5))
    edges = spark.createDataFrame(rows, "graph_id int, ord int, u int, v int, cap int, source int, sink int")
    cuts = {r.graph_id: r.c for r in G.min_cut(edges).groupBy("graph_id").agg(F.sum("cap").alias("c")).collect()}
    for r in G.max_flow(edges).collect():
        own = [x for x in rows if x[0] == r.graph_id]
        least = min(sum(c for _, _, u, v, c, _, _ in own if mask >> u & 1 and not mask >> v & 1) for mask in range(64) if mask & 1 and not mask >> 5)
        assert r.flow == r.cut_capacity == least == cuts.get(r.graph_id, 0)
    with pytest.raises(ValueError):
        G.Network(2).shortest_paths(0, 0)
    choices = spark.createDataFrame([(1, "a", 1, "x", 1), (1, "b", 2, "x", 1), (1, "b", 2, "y", 2), (1, "c", 3, None, None), (1, "d", 4, "x", 1)], "doc_id int, error string, error_ord int, candidate string, rank int")
    assert {r.error: r.candidate for r in G.assign(choices).collect()} == {"a": "x", "b": "y", "c": None, "d": None}


def test_covers(spark):
    lists = G.edge_lists(readers.edges(spark, "0-1, 1-2,2-3,3-4,4-0,1-5,5-6,bad,1-2-3"))
    report = G.cover_report(lists).first()
    assert (report.vertices, report.approximate, report.matched, report.minimum, report.covers, report.ratio, report.within_twice) == (7, 6, 3, 4, True, 1.5, True)


def test_readers(spark, tmp_path):
    (tmp_path / "words.txt").write_text("The\n\n  cat \nthe\r\nÉté")
    assert sorted(r.word for r in readers.word_list(spark, str(tmp_path / "words.txt")).collect()) == ["cat", "the", "the", "été"]
    assert [(r.word, r.rank) for r in readers.common_words(spark, str(tmp_path / "words.txt")).orderBy("rank").collect()] == [("the", 0), ("cat", 1), ("été", 2)]
    assert readers.common_words(spark, str(tmp_path / "none.txt")).count() == 0
    folder = tmp_path / "articles"
    folder.mkdir()
    (folder / "a.txt").write_text("T\nA\nD\none two\nthree\n")
    (folder / "b.txt").write_text("only title")
    (folder / "c.TXT").write_text("x")
    found = readers.articles(spark, str(folder)).orderBy("article_no").collect()
    assert [(r.title, r.author, r.date, r.content) for r in found] == [("T", "A", "D", "one two three "), ("only title", "Unknown Author", "Unknown Date", "")]
    assert [r.words for r in reports.listing(readers.articles(spark, str(folder))).orderBy("article_no").collect()] == [3, 0]
    assert [r.doc_id for r in readers.documents(spark, str(folder), 2).orderBy("doc_id").collect()] == ["a.txt", "b.txt"]
    assert readers.text_or_file(spark, f" {folder}/b.txt ").first().text == "only title"
    assert readers.text_or_file(spark, "just text").first().text == "just text"
    (tmp_path / "pairs.csv").write_text("# c\ncorrect,corrupted\nWhat, wat \na,b,c\n\nname,name\n")
    assert sorted(tuple(r) for r in readers.labelled_pairs(spark, str(tmp_path / "pairs.csv")).collect()) == [("name", "name"), ("what", "wat")]


def test_streams(spark, words, tmp_path):
    from glyphflow.streaming import checker

    frame(spark, "wat is", "the name. Oh").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    for name, df in (("wrong", checker.misspelled(stream, words)), ("counts", checker.counters(stream))):
        run = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination(60)
    assert sorted(r.word for r in spark.table("wrong").collect()) == ["oh", "wat"]
    assert sorted((r.words, r.sentences) for r in spark.table("counts").collect()) == [(2, 1), (3, 2)]


def test_given_texts(spark, tmp_path):
    assert readers.pasted(spark, "one\ntwo\n \nthree").first().text == "one\ntwo"
    assert readers.pasted(spark, "\nx").first().text == readers.SAMPLE_TEXT
    assert readers.words_given(spark, ["a", "b"]).first().text == "a b"
    (tmp_path / "t.txt").write_text("a\nb\n")
    assert readers.whole_file(spark, str(tmp_path / "t.txt")) == ("a\nb\n", None)
    text, why = readers.whole_file(spark, str(tmp_path / "none.txt"))
    assert text is None and "none.txt cannot be read" in why


def test_long_words_have_few_keys(spark):
    """Long words are cut into segments: swaps, insertions and deletions are found, and thousands of letters are no load."""
    from glyphflow.functions.distance import close_pairs

    base = "".join(chr(97 + k * 7 % 26) for k in range(60))
    words = [base, base[:20] + base[21:], base[:30] + base[31] + base[30] + base[32:], base + "xy", "q" + base + "zz", base[:41], base[:39], "z" * 5000]
    others = [base, base[:40], "z" * 4999]
    found = {(r.word, r.candidate): r.distance for r in close_pairs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in others], "candidate string"), 2).collect()}
    assert found == {(words[0], base): 0, (words[1], base): 1, (words[2], base): 1, (words[3], base): 2, (words[5], base[:40]): 1, (words[6], base[:40]): 1, (words[7], others[2]): 1}


def test_drawn_errors(spark):
    """Each is one edit away; letters come at the end, too; the same each time."""
    words = spark.createDataFrame([(w,) for w in ["a", "ab", "aa", "hello"] + [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]], "word string")
    found = E.corrupt(words, 3).collect()
    assert found == E.corrupt(words, 3).collect()
    assert all(r.word != r.corrupted and abs(len(r.word) - len(r.corrupted)) <= 1 for r in found)
    assert any(r.corrupted[:-1] == r.word for r in found) and any(r.corrupted[1:] == r.word for r in found)
    assert E.reservoir(words, 10, 1, "word").collect() == E.reservoir(words, 10, 1, "word").collect()


def test_lookup_times(spark):
    words = spark.createDataFrame([("a",), ("b",), ("a",)], "word string")
    took = D.lookup_times(words, words.where("word = 'a'"))
    assert took["hashed"] > 0 and took["linear"] > 0 and took["speed_up"] > 0


def test_positions_of_many_matches(spark):
    """Sums run by run: more matches than a run has, overlaps, a start that is one."""
    texts = ["ab" * 500, "xab" * 300, "aaaa", "", "b", "aab" * 130 + "a"]
    for pattern in ("ab", "a", "aa", "aba"):
        found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.positions(F.col("t"), F.lit(pattern)).alias("p")).collect()
        assert all(r.p == [i for i in range(len(r.t)) if r.t.startswith(pattern, i)] for r in found)


def test_vocabulary_of_odd_words(spark):
    """Counts by text and in all, lower-cased word by word: a capital sigma before an apostrophe ends its word, a dotted I becomes two characters."""
    texts = ["The the THE end", "ΟΔΟΣ'ΑΣ ΟΔΟΣ İstanbul", "", "  12 ", None, "the\nend the", "é É 𝒳y ß"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = D.vocabulary(frame)
    want = {}
    for t in texts:
        given = re.findall(r"[^\W\d_]+", t or "")
        own = [r[0] for r in spark.createDataFrame([(w,) for w in given], "w string").select(F.lower("w")).collect()]
        for w in own:
            n, docs = want.get(w, (0, 0))
            want[w] = (n + 1, docs)
        for w in set(own):
            want[w] = (want[w][0], want[w][1] + 1)
    assert {r.word: (r.n, r.docs) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan  # which Spark interprets for each word


def test_one_vocabulary_for_flags(spark, monkeypatch):
    from glyphflow.plans import queries as Q

    made = []
    monkeypatch.setattr(Q, "_vocabulary", lambda *a, own=Q._vocabulary: made.append(1) or own(*a))
    assert Q.confusion(spark, "/root/testdata/sf0.001").count() == 1
    assert len(made) == 1


def test_frequent_words_stay_where_they_are(spark, monkeypatch):
    """The same rows with and without; words of the dictionary that are frequent do not reach its join, nor do those that are not wrong reach the errors'."""
    texts = [(k, "the cat\r\nThe the dog " + "the " * k + f"rare{'abcdefghij'[k % 10]} odd") for k in range(12)] + [(20, None), (21, ""), (22, "12"), (23, "zzz\nyyy the")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    vocabulary = D.vocabulary(docs).localCheckpoint()
    monkeypatch.setattr(D, "FREQUENT", 10)
    words, dictionary, frequent = K.tokens(docs), D.known_words(vocabulary), D.frequent_words(vocabulary)
    assert {r.word for r in frequent.collect()} == {"the", "odd", "rare", "cat", "dog"} & {r.word for r in vocabulary.collect() if 10 * r.n > sum(x.n for x in vocabulary.collect())}
    assert D.without(words, frequent).where("word = 'the'").count() == 0
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(D.unknown(words, dictionary, frequent)) == rows(D.unknown(words, dictionary))
    assert rows(C.document_accuracy(docs, words, dictionary, frequent=frequent)) == rows(C.document_accuracy(docs, words, dictionary))
    wrong = spark.createDataFrame([("the", True), ("zzz", False)], "word string, known boolean")
    assert rows(C.occurrences(words, wrong, frequent)) == rows(C.occurrences(words, wrong))
    assert D.frequent_words(vocabulary.where("false")).count() == 0


def test_matches_leave_in_small_batches():
    """However many matches texts have, a task holds few of them at once; the matches are the same."""
    import pyarrow as pa

    texts = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["ab" * 50_000, None, "", "xaby"])], names=["doc_id", "text"])
    made = list(P.found_in([texts], {"ab": 2, "b": 1}, "doc_id", "text"))
    assert max(b.num_rows for b in made) == P.MATCHES
    rows = sorted(tuple(r.values()) for b in made for r in b.to_pylist())
    assert rows == sorted([(1, p, s + 2 * k, 2 * k + 1) for k in range(50_000) for p, s in (("ab", 0), ("ab", 0), ("b", 1))] + [(4, "ab", 1, 2)] * 2 + [(4, "b", 2, 2)])


def test_words_of_a_millionth_part_are_frequent(spark):
    """A tenth of the tokens of a large corpus would be left for the join, not a third, with the words that are rarer."""
    found = spark.createDataFrame([("the", 99_990, 90), ("seldom", 6, 5), ("typo", 4, 4)], "word string, n long, docs long")
    assert {r.word for r in D.frequent_words(found).collect()} == {"the", "seldom"}
    assert not D.frequent_words(found.withColumn("n", F.when(F.col("word") == "the", 10**7).otherwise(F.col("n")))).where("word <> 'the'").count()
