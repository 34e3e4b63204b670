"""Scalar functions on strings, as columns."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LETTERS = r"\p{L}+"
LINE_BREAK = r"\r\n|\n|\r"
ANY_BREAK = r"\R"
#: Letters and their phonetic digits.
SOUND_LETTERS = "abcdefghijklmnopqrstuvwxyz"
SOUND_DIGITS = "01230120022455012623010202"


def trim(c: Column) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def count_words(c: Column) -> Column:
    """Words between white space; a blank text counts as one."""
    return F.size(F.split(trim(c), r"\s+"))


def count_article_words(c: Column) -> Column:
    """Words between white space; a blank text has none."""
    return F.when(trim(c) == "", 0).otherwise(count_words(c))


def count_letter_words(c: Column) -> Column:
    """Runs of letters."""
    return F.regexp_count(c, F.lit(LETTERS))


def count_sentences(c: Column) -> Column:
    """Pieces between ``.``, ``!`` and ``?`` that are not blank."""
    return F.size(F.filter(F.split(c, "[.!?]+"), lambda x: trim(x) != ""))


def count_uppercase(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{IsUppercase}"))


def count_vowels(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit("[aeiou]"))


def is_palindrome(c: Column) -> Column:
    """The A-Z letters read the same from both ends; none do, too."""
    own = F.lower(F.regexp_replace(c, "[^a-zA-Z]", ""))
    return own == F.reverse(own)


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-zA-Z\s]", "")


def normalized_words(c: Column) -> Column:
    """Lower-cased runs of letters, as an array (see ``composed`` for the normal form)."""
    return F.transform(F.regexp_extract_all(c, F.lit(LETTERS), F.lit(0)), F.lower)


def lower_words(c: Column) -> Column:
    """``normalized_words`` by one pass over all words of a text, without a function for each; no words give one empty word."""
    return F.split(F.lower(F.array_join(F.regexp_extract_all(c, F.lit(LETTERS), F.lit(0)), " ")), " ")


def lines(c: Column) -> Column:
    """Lines of a text as a file reader gives them: no empty one at the end."""
    own = F.split(c, LINE_BREAK, -1)
    return F.when(F.try_element_at(own, F.lit(-1)) == "", F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own)


def all_lines(c: Column) -> Column:
    """Lines with the empty ones at the end."""
    return F.split(c, ANY_BREAK, -1)


def lines_to_last(c: Column) -> Column:
    """Lines up to the last that is not empty; the empty text has one line."""
    own = all_lines(c)
    last = F.greatest(F.array_max(F.transform(own, lambda x, i: F.when(x != "", i + 1).otherwise(0))), F.when(c == "", 1).otherwise(0))
    return F.slice(own, F.lit(1), last)


def has_long_run(c: Column) -> Column:
    """Some character stands three times in a row."""
    return c.rlike(r"(.)\1\1")


def squeeze(c: Column, most: int) -> Column:
    """At most one or two copies of a repeated character."""
    if most not in (1, 2):
        raise ValueError("runs are squeezed to 1 or 2")
    return F.regexp_replace(c, r"(.)\1+", "$1") if most == 1 else F.regexp_replace(c, r"(.)\1{2,}", "$1$1")


def upper_letter(letter: Column) -> Column:
    """Upper case where that is one letter too."""
    return F.when(F.length(F.upper(letter)) == 1, F.upper(letter)).otherwise(letter)


def copy_case(original: Column, suggestion: Column) -> Column:
    """The suggestion, with an upper-case first letter if the original has one; the rest stays."""
    return F.when(original.rlike(r"^\p{IsUppercase}"), F.concat(upper_letter(F.substring(suggestion, 1, 1)), F.substring(suggestion, 2, 1 << 30))).otherwise(suggestion)


def contains_in_order(big: Column, small: Column) -> Column:
    """The letters of ``small`` are in ``big`` in their order."""
    return F.call_function("like", big, F.concat(F.lit("%"), F.array_join(F.split(small, ""), "%"), F.lit("%")))


def sound(c: Column) -> Column:
    """Phonetic code: first letter and three digits.  Every letter without digit ends a run of equal digits."""
    own = F.regexp_replace(F.lower(c), r"\P{L}", "")
    digits = F.regexp_replace(F.translate(own, SOUND_LETTERS, SOUND_DIGITS), "[^0-9]", "0")
    tail = F.regexp_replace(F.substring(F.regexp_replace(digits, r"(.)\1+", "$1"), 2, 1 << 30), "0", "")
    return F.when(own == "", "0000").otherwise(F.concat(upper_letter(F.substring(own, 1, 1)), F.substring(F.rpad(tail, 3, "0"), 1, 3)))


def prefix_table(pattern: Column) -> Column:
    """For each position, the length of the longest border of the prefix that ends there."""
    def border(i: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), i - 1), lambda k: F.substring(pattern, F.lit(1), k) == F.substring(pattern, i - k + 1, k))
        return F.array_max(fits)

    return F.when(F.length(pattern) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(pattern)), border))


def estimate(share: Column, n: Column) -> tuple[Column, Column, Column]:
    """A share with the ends of its 95 % interval."""
    half = 1.96 * F.sqrt(share * (1 - share) / n)
    return share, share - half, share + half


#: What a report prints for a share without denominator.
NO_SHARE = "N/A (division by zero)"


def percent(share: Column) -> Column:
    """Percent to one place, half up; ``NO_SHARE`` for no share."""
    # Of a null, ``format_string`` prints the first letter and the sign.
    return F.when(share.isNull(), NO_SHARE).otherwise(F.format_string("%.1f%%", F.floor(share.cast("double") * 1000 + 0.5) / 10.0))


def format_estimate(hits: Column, n: Column) -> Column:
    """A share with its counts and the half width of its 95 % interval."""
    share = F.try_divide(hits.cast("double"), n.cast("double"))
    half = 1.96 * F.sqrt(share * (1 - share) / n)
    return F.concat(percent(share), F.lit(" ("), hits.cast("string"), F.lit("/"), n.cast("string"), F.lit("), 95 % interval +-"), percent(half))


def format_suggestions(suggestions: Column, most: int = 3) -> Column:
    """``word (distance), ...`` of an array of ``word, distance``."""
    shown = F.array_join(F.transform(suggestions, lambda s: F.concat(s["word"], F.lit(" ("), s["distance"].cast("string"), F.lit(")"))), ", ")
    return F.when(F.size(suggestions) > 0, shown).otherwise(f"none within {most} edits")


def preview(c: Column, most: int = 300) -> Column:
    """The trimmed text, or its first characters and how many more there are."""
    own = trim(c)
    more = F.length(own) - most
    return F.when(more > 0, F.concat(F.substring(own, 1, most), F.lit(" ["), more.cast("string"), F.lit(" more characters]"))).otherwise(own)


#: Characters below it are in normal form C already.
ODD = "[\\x{0300}-\\x{10FFFF}]"


def _nfc_of_arrays(s: pd.Series) -> pd.Series:
    return s.map(lambda ws: None if ws is None else [unicodedata.normalize("NFC", w) for w in ws])


def composed_array(words: Column) -> Column:
    """An array of words in normal form C.  Spark has no function for it: arrays that need one go through Python, the
    others are sent there as nulls."""
    odd = F.exists(words, lambda w: w.rlike(ODD))
    nfc = F.pandas_udf(_nfc_of_arrays, ArrayType(StringType()))
    return F.coalesce(nfc(F.when(odd, words)), words)


def composed(words: DataFrame, col: str) -> DataFrame:
    """``words`` with ``col`` in normal form C.

    Spark has no function for it.  Characters below U+0300 are in that form already, so only the distinct
    words with others go through Python."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x))

    odd = words.where(F.col(col).rlike(ODD)).select(col).distinct()
    odd = odd.withColumn("__nfc", nfc(col))
    return words.join(odd, col, "left").withColumn(col, F.coalesce("__nfc", col)).drop("__nfc")
