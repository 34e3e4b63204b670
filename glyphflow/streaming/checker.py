"""The stateless operators over streams of documents (an extension: nothing else here streams).

A dictionary is a table, so every operator that joins one works on a stream as it does on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.functions import text as T
from glyphflow.operators import tokens as K


def counters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The text counters of each document."""
    c = F.col(text_col)
    return docs.withColumns({"words": T.count_words(c), "sentences": T.count_sentences(c), "uppercase": T.count_uppercase(c), "vowels": T.count_vowels(c)})


def misspelled(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unknown words with their places, as documents come."""
    return K.tokens(docs, id_col, text_col).join(dictionary.select("word"), "word", "left_anti")


def word_counts(docs: DataFrame, time_col: str, delay: str, window: str, text_col: str = "text") -> DataFrame:
    """Words counted in windows of time; what comes later than ``delay`` is left out."""
    words = docs.withWatermark(time_col, delay).select(time_col, F.explode(T.normalized_words(F.col(text_col))).alias("word"))
    return words.groupBy(F.window(time_col, window), "word").agg(F.count(F.lit(1)).alias("n"))
