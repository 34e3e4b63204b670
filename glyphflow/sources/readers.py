"""Readers of word lists, documents, articles, labelled pairs and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.text import composed, trim
from glyphflow.operators.graph import parse_edges
from glyphflow.operators.numeric import table_scan
from glyphflow.sources.folder import read_folder

#: Fixed values.
DEFAULT_TITLE, DEFAULT_AUTHOR, DEFAULT_DATE = "Untitled", "Unknown Author", "Unknown Date"
MOST_FILES = 100


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value`` of a text file's lines; any of the three line ends counts."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("pos", "value"))


def parse_word_list(lines: DataFrame) -> DataFrame:
    """``word, len`` of each of the lines ``value`` that is not blank, trimmed, lower-cased, in normal form C; repeats stay."""
    words = lines.select(F.lower(trim(F.col("value"))).alias("word")).where("word <> ''")
    return composed(words, "word").withColumn("len", F.length("word"))


def parse_distinct_words(lines: DataFrame) -> DataFrame:
    """``pos, word, len`` of lines ``pos, value``: trimmed, lower-cased, each at its first place."""
    words = lines.select("pos", F.lower(trim(F.col("value"))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.min("pos").alias("pos")).select("pos", "word", F.length("word").alias("len"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_list(_lines(spark, path))


def distinct_words(spark: SparkSession, path: str) -> DataFrame:
    return parse_distinct_words(_lines(spark, path))


def common_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, rank`` from 0 in the order of the file; a file that cannot be read gives none."""
    from pyspark.errors import AnalysisException

    try:
        words = distinct_words(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], "word string, rank int")
    counted = table_scan(words.select("word", "pos", F.lit(1).cast("long").alias("__one")), "__one", ["pos"], "rank")
    return counted.select("word", F.col("rank").cast("int").alias("rank"))


def parse_article(text: Column) -> Column:
    """Title, author and date from the first three lines, the others each with a space after it as content."""
    own = F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r", -1)
    some = F.when(text == "", F.array().cast("array<string>")).otherwise(own)
    part = lambda i, other: F.coalesce(F.get(some, F.lit(i)), F.lit(other))
    rest = F.when(F.size(some) > 3, F.array_join(F.transform(F.slice(some, F.lit(4), F.greatest(F.size(some) - 3, F.lit(0))), lambda x: F.concat(x, F.lit(" "))), "")).otherwise("")
    return F.struct(part(0, DEFAULT_TITLE).alias("title"), part(1, DEFAULT_AUTHOR).alias("author"), part(2, DEFAULT_DATE).alias("date"), rest.alias("content"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def numbered_by_name(names: DataFrame, name: str, number: str) -> DataFrame:
    """``name, number`` from 1 in the order of distinct names, by ranges of them and not in one task."""
    counted = table_scan(names.select(name).distinct().withColumn("__one", F.lit(1).cast("long")), "__one", [name], "__before")
    return counted.select(name, (F.col("__before") + 1).cast("int").alias(number))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """``article_no, name, title, author, date, content`` of the ``.txt`` files that can be read, numbered by name."""
    own = read_folder(spark, folder, ".txt").where("reason is null")
    # Only names are numbered; the texts stay where they are.
    order = numbered_by_name(own, "name", "article_no")
    return own.select("name", parse_article(F.col("text")).alias("a")).join(order, "name").select("article_no", "name", "a.*")


def documents(spark: SparkSession, folder: str, most: int | None = MOST_FILES) -> DataFrame:
    """``doc_id`` (file name) and ``text`` of the first files by name that end in ``.txt`` in any case, those that cannot be read left out;
    ``most``: none for all."""
    return read_folder(spark, folder, ".txt", True, most).where("reason is null").select(F.col("name").alias("doc_id"), "text")


def unreadable(spark: SparkSession, folder: str, suffix: str = ".txt", any_case: bool = False, most: int | None = None) -> DataFrame:
    """``name, reason`` of the files that ``articles`` or ``documents`` leave out."""
    return read_folder(spark, folder, suffix, any_case, most).where("reason is not null").select("name", "reason")


SAMPLE_TEXT = "Teh quikc brown fox jumsp over teh lazzy dog. It wass a suny mornign."


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """One document from a string, up to its first blank line; a sample if that is the first one."""
    lines = text.splitlines() or [""]
    end = next((k for k, line in enumerate(lines) if not line.strip()), len(lines))
    return spark.createDataFrame([("pasted", "\n".join(lines[:end]) or SAMPLE_TEXT)], "doc_id string, text string")


def words_given(spark: SparkSession, words: list[str]) -> DataFrame:
    """One document from the words of a command line."""
    return spark.createDataFrame([("given", " ".join(words))], "doc_id string, text string")


def whole_file(spark: SparkSession, path: str) -> tuple[str | None, str | None]:
    """A text file's content, or none and why it cannot be read."""
    from pyspark.errors import PySparkException

    try:
        row = spark.read.text(path, wholetext=True).first()
    except PySparkException as error:
        return None, f"{path} cannot be read: {str(error).splitlines()[0]}"
    return row["value"] if row else "", None


def text_or_file(spark: SparkSession, given: str) -> DataFrame:
    """The file that the trimmed string names, or the string itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(given.strip() or ".")
    try:
        there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isFile()
    except Exception:  # noqa: BLE001  no such file, or not a path at all
        there = False
    if there:
        return _files(spark, given.strip()).select(F.col("name").alias("doc_id"), "text")
    return spark.createDataFrame([("pasted", given)], "doc_id string, text string")


def parse_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """``correct, corrupted`` of lines of two fields; blank lines, comments, headers and other lines are skipped."""
    own = lines.select(trim(F.col(value)).alias("line")).where("line <> '' and not startswith(line, '#') and not startswith(line, 'correct,')")
    parts = F.split(F.regexp_replace("line", ",+$", ""), ",", -1)
    two = own.select(parts.alias("p")).where(F.size("p") == 2)
    return two.select(F.lower(trim(F.col("p")[0])).alias("correct"), F.lower(trim(F.col("p")[1])).alias("corrupted"))


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_pairs(_lines(spark, path))


def edges(spark: SparkSession, text: str, graph_id: int = 0) -> DataFrame:
    """``graph_id, ord, u, v`` of ``"0-1,1-2"``."""
    one = spark.createDataFrame([(graph_id, text)], "graph_id int, text string")
    return one.select("graph_id", F.posexplode(parse_edges(F.col("text"))).alias("ord", "e")).select("graph_id", "ord", "e.u", "e.v")
