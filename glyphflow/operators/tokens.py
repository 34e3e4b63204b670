"""Words with their places, and word frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.functions import text as T
from glyphflow.operators.numeric import table_scan


def _placed(docs: DataFrame, id_col: str, lines) -> DataFrame:
    by_line = docs.select(F.col(id_col), F.posexplode(lines).alias("line", "__line"))
    return by_line.select(id_col, (F.col("line") + 1).alias("line"), F.posexplode(F.regexp_extract_all("__line", F.lit(T.LETTERS), F.lit(0))).alias("word_number", "raw")).withColumn("word_number", F.col("word_number") + 1)


def tokens_composed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line, word_number, raw, word`` of each word, from 1; ``word`` is lower-cased, in normal form C."""
    by_line = docs.select(F.col(id_col), F.posexplode(T.lines(F.col(text_col))).alias("line", "__line")).select(id_col, "line", F.regexp_extract_all("__line", F.lit(T.LETTERS), F.lit(0)).alias("raw"))
    own = by_line.where(F.size("raw") > 0).withColumn("word", F.transform("raw", F.lower))
    placed = own.withColumn("word", T.composed_array(F.col("word"))).select(id_col, (F.col("line") + 1).alias("line"), F.posexplode(F.arrays_zip("raw", "word")).alias("at", "w"))
    return placed.select(id_col, "line", (F.col("at") + 1).alias("word_number"), "w.raw", "w.word")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with every line break of Unicode and lower-casing only."""
    return _placed(docs, id_col, T.all_lines(F.col(text_col))).withColumn("word", F.lower("raw"))


def raw_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words between white space after punctuation is stripped.  A text that begins with white space, or
    has nothing, gives one empty word."""
    cut = F.split(T.strip_punctuation(F.col(text_col)), r"\s+")
    whole = F.transform(F.array(cut), lambda w: F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w))
    return docs.select(id_col, F.explode(F.get(whole, F.lit(0))).alias("word"))


def word_frequency(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    return words.groupBy(*(by or []), "word").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(frequency: DataFrame, by: list[str]) -> DataFrame:
    """The word with the highest count; of equal counts the first in order."""
    best = F.min_by(F.struct("word", "n"), F.struct((-F.col("n")).alias("a"), F.col("word").alias("b"))).alias("best")
    return frequency.groupBy(*by).agg(best).select(*by, "best.word", "best.n")


def pattern_nodes(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Nodes of the trie of all patterns: the root and their distinct prefixes."""
    prefixes = patterns.where(F.length(pattern) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(pattern)), lambda i: F.substring(F.col(pattern), F.lit(1), i))).alias("prefix"))
    return prefixes.agg((F.count_distinct("prefix") + 1).alias("nodes"))


def numbered(df: DataFrame, order: list[str], name: str = "n", by: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 in the given order, within ``by``; without it over the whole table, by ranges of the order."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    counted = table_scan(df.withColumn("__one", F.lit(1).cast("long")), "__one", order, name)
    return counted.withColumn(name, F.col(name) + 1).drop("__one")
