"""Folders of files and JSON arrays, read and written by Spark."""

import json
import os

import pytest
from pyspark.sql import functions as F

from glyphflow.operators import tokens as K
from glyphflow.plans.queries import QUERIES
from glyphflow.sources import folder, readers, reports


@pytest.fixture
def files(tmp_path):
    own = tmp_path / "files"
    own.mkdir()
    for name, content in (("b.txt", b"Title\nAuthor\nDate\nsome words\nmore"), ("a.txt", "Ünï\r\nx".encode()), ("C.TXT", b"upper"), ("d.md", b"no"), ("bad.txt", b"\xff\xfe\xfa"), ("empty.txt", b"")):
        (own / name).write_bytes(content)
    os.symlink("/nowhere/at/all", own / "gone.txt")
    (own / "folder.txt").mkdir()
    return own


def test_reading_a_folder(spark, files):
    found = {r.name: (r.text, r.reason) for r in folder.read_folder(spark, str(files), ".txt", True).collect()}
    assert set(found) == {"a.txt", "b.txt", "C.TXT", "bad.txt", "empty.txt"}
    assert found["a.txt"] == ("Ünï\r\nx", None) and found["empty.txt"] == ("", None)
    assert found["bad.txt"][0] is None and found["bad.txt"][1].startswith("bad.txt cannot be read: ")
    assert {r.name for r in readers.unreadable(spark, str(files)).collect()} == {"bad.txt"}
    assert [(r.article_no, r.name, r.title, r.author, r.date, r.content) for r in readers.articles(spark, str(files)).orderBy("article_no").collect()] == [
        (1, "a.txt", "Ünï", "x", "Unknown Date", ""), (2, "b.txt", "Title", "Author", "Date", "some words more "), (3, "empty.txt", "Untitled", "Unknown Author", "Unknown Date", "")]
    assert sorted(r.doc_id for r in readers.documents(spark, str(files), 3).collect()) == ["C.TXT", "a.txt", "b.txt"]
    assert readers.documents(spark, files.as_uri(), None).count() == 4
    with pytest.raises(Exception, match="is no folder"):
        readers.documents(spark, str(files / "nothing")).count()


def test_a_file_that_goes_after_it_was_listed(files):
    reader = folder._FolderReader({"path": str(files), "suffix": ".txt"})
    groups = reader.partitions()
    os.remove(files / "a.txt")
    found = {name: (text, reason) for g in groups for name, text, reason in reader.read(g)}
    assert found["a.txt"][0] is None and found["a.txt"][1].startswith("a.txt cannot be read: ") and found["empty.txt"] == ("", None)


def test_groups_of_files(spark, tmp_path):
    """A partition for each group, by bytes and by number of files."""
    own = tmp_path / "many"
    own.mkdir()
    for k in range(25):
        (own / f"{k:02d}.txt").write_text("x" * (100 if k != 7 else 1000))
    spark.dataSource.register(folder.TextFolder)
    by_bytes = spark.read.format(folder.TextFolder.name()).option("groupbytes", 350).load(str(own)).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()
    assert sum(r.n for r in by_bytes) == 25 and all(r["size"] <= 350 or r.n == 1 for r in by_bytes) and len(by_bytes) < 25
    by_files = spark.read.format(folder.TextFolder.name()).option("groupfiles", 4).load(str(own)).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sorted(r["count"] for r in by_files) == [1, 4, 4, 4, 4, 4, 4]


def test_writing_a_folder(spark, tmp_path):
    rows = [(f"{k}.txt", f"text {k}\r\nñ🙂") for k in range(30)] + [("none.txt", None)]
    path = tmp_path / "out" / "files"
    folder.write_folder(spark.createDataFrame(rows, "name string, text string").repartition(5), str(path))
    assert {f.name: f.read_bytes().decode() for f in path.iterdir()} == {n: t or "" for n, t in rows}
    assert os.listdir(tmp_path / "out") == ["files"]
    # A task that fails leaves nothing, and what was there stays.
    bad = spark.createDataFrame([("ok.txt", "x"), ("a/b.txt", "x")], "name string, text string").repartition(2, "name")
    with pytest.raises(Exception, match="is no file name"):
        folder.write_folder(bad, str(path))
    assert not (path / "ok.txt").exists() and os.listdir(tmp_path / "out") == ["files"]


def test_one_array(spark, tmp_path):
    rows = [(f"doc {k:03d}", k, None if k % 5 == 0 else [f'"q"\n{k}', "é"]) for k in range(60)]
    frame = spark.createDataFrame(rows, "source string, n int, words array<string>").repartition(7)
    path = tmp_path / "output" / "batch" / "report.json"
    reports.write_json_array(frame, str(path), ["source"])
    assert json.loads(path.read_text()) == [{"source": s, "n": n, "words": w} for s, n, w in rows]
    reports.write_json_array(frame.where("n < 2"), path.as_uri(), ["source"])
    assert [r["n"] for r in json.loads(path.read_text())] == [0, 1]
    reports.write_json_array(frame.where("false"), str(path), ["source"])
    assert json.loads(path.read_text()) == []
    reports.write_json_array(frame, str(path), ["source"])
    before = path.read_text()
    broken = frame.withColumn("n", F.when(F.col("n") == 33, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        reports.write_json_array(broken, str(path), ["n"])
    assert path.read_text() == before and os.listdir(path.parent) == ["report.json"]


def test_rows_numbered_over_a_table(spark, tmp_path):
    frame = spark.createDataFrame([(k * 7 % 50, "x") for k in range(50)], "k int, o string").repartition(6)
    assert sorted(map(tuple, K.numbered(frame, ["k"]).collect())) == [(k, "x", k + 1) for k in range(50)]
    assert sorted(r.n for r in K.numbered(frame, ["k"], by=["o"]).collect()) == list(range(1, 51))
    words = tmp_path / "common.txt"
    words.write_text("The\nof\n\n the \nand\n")
    assert {r.word: r["rank"] for r in readers.common_words(spark, str(words)).collect()} == {"the": 0, "of": 1, "and": 2}
    assert readers.common_words(spark, str(tmp_path / "none.txt")).count() == 0


def test_from_files_to_report(spark, tmp_path):
    texts = ["the cat sat on the mat\nthe end", "the cat sat on teh mat", "the cat sat", "the cat the cat", "cat the sat on mat", "", "on the mat sat the cat"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    rows.withColumnRenamed("doc_id", "item_id").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = {"the", "cat", "sat"}
    known |= {w for w in ("on", "mat") if sum(w in t.split() for t in texts) >= 5}
    by_doc = {f"{k}.txt": (len(t.split()), sum(w not in known for w in t.split())) for k, t in enumerate(texts)}
    assert {r.doc_id: (r.total_words, r.errors_found) for r in QUERIES["folder_accuracy"](spark, str(tmp_path)).collect()} == by_doc
    found = {r.source: json.loads(r.report) for r in QUERIES["folder_json_report"](spark, str(tmp_path)).collect()}
    plain = {f"{r.source}.txt": json.loads(r.report) for r in QUERIES["json_batch_report"](spark, str(tmp_path)).collect()}
    assert found == {n: {**r, "source": n} for n, r in plain.items()}
    assert [(e["line"], e["word_number"], e["word"]) for e in found["1.txt"]["errors"] if e["word"] == "teh"] == [(1, 5, "teh")]
