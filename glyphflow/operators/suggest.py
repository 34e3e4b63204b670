"""Suggestions for misspelled words.

All of them work on distinct words, join on equality of what is left of words after deletions, and
rank with a window whose limit Spark pushes into the sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.functions.distance import close_pairs
from glyphflow.functions.lineage import settled
from glyphflow.functions.text import contains_in_order, has_long_run, sound, squeeze
from glyphflow.operators.nearest import BLOCK, nearest, within

TOP = 3
STRETCHED_TOP = 10
FAR = 2**31 - 1
#: So many words are compared with an entry in about the time that its remainders take.
FEW = 4096
#: A word is compared with so many entries in about the time that its own remainders take: one block of ``nearest``.
SCANNED = BLOCK
#: So many words, the common ones among them, go to every task and are compared with all others.
MET = 1024


def pairs_within(words: DataFrame, dictionary: DataFrame, most: int) -> DataFrame:
    """``close_pairs`` of words and dictionary.  Where either has ``MET`` words or less, no remainders are made: the others, of which
    there would be up to some hundred each, meet those few in batches."""
    own = words.select("word").where("word is not null").distinct()
    entries = dictionary.select(F.col("word").alias("candidate")).where("candidate is not null").distinct()
    few = [r.candidate for r in entries.limit(MET + 1).collect()]
    if len(few) <= MET:
        return within(own, few, most)
    few = [r.word for r in own.limit(MET + 1).collect()]
    if len(few) <= MET:
        return within(entries, few, most, "candidate", "word").select("word", "candidate", "distance")
    return close_pairs(own, entries, most)


def _top(pairs: DataFrame, keys: list, n: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(*keys))).where(F.col("rank") <= n)


def suggest_phonetic(words: DataFrame, dictionary: DataFrame, top: int = TOP, band: int = 2) -> DataFrame:
    """``word, rank, candidate, distance, sounds_alike``: by distance less a half for an equal phonetic
    code, then alphabetically, among words whose length differs by at most ``band``; no limit of the distance.
    Repeated dictionary entries stay repeated.

    The threshold rises: candidates within two edits come before all others, so words with ``top`` of them are done; the
    others are joined once more, within three.  What is left has next to nothing near by and is looked for entry by
    entry in ``nearest``, where the threshold rises on.

    The joins make some hundred remainders of every entry, whatever the number of words, and up to some hundred of every word. ``FEW`` words
    or less, and all words if there are ``SCANNED`` entries or less, are met with the entries in ``nearest`` at once, which costs
    less than that and finds the same."""
    left = settled(words.select("word").where("word is not null").distinct())
    entries = settled(dictionary.groupBy(F.col("word").alias("candidate")).agg(F.count(F.lit(1)).alias("copies")))
    found = []
    few = left.limit(FEW + 1).count() <= FEW or entries.limit(SCANNED + 1).count() <= SCANNED
    if few:  # the empty word, which has no letters to look for, is as far from an entry as that is long
        found.append(left.where("word = ''").join(entries.where(F.length("candidate") <= min(2, band)), how="cross").select("word", "candidate", "copies", F.length("candidate").alias("distance")))
    for most in () if few else (2, 3):
        near = settled(close_pairs(left, entries, most).where(F.abs(F.length("candidate") - F.length("word")) <= band).join(entries, "candidate"))
        enough = near.groupBy("word").agg(F.sum("copies").alias("n")).where((F.col("n") >= top) | (F.col("word") == "")).select("word")
        found.append(near.join(enough, "word", "left_semi").select("word", "candidate", "copies", "distance"))
        left = settled(left.join(enough, "word", "left_anti"))
    tagged = lambda df, c: df.withColumn("tag", sound(F.col(c)))
    found.append(nearest(tagged(left, "word"), tagged(entries, "candidate"), top, band).select("word", "candidate", "copies", "distance"))
    pairs = reduce(DataFrame.unionByName, found).withColumn("sounds_alike", sound(F.col("word")) == sound(F.col("candidate")))
    score = F.col("distance") - F.when(F.col("sounds_alike"), 0.5).otherwise(0.0)
    # The best ``top`` entries hold the best ``top`` copies.
    best = _top(pairs, [score, F.col("candidate")], top).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(top)).cast("int"))))
    return _top(best, [score, F.col("candidate")], top).select("word", "rank", "candidate", "distance", "sounds_alike")


def _keyed(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """``pairs`` with what the seven keys of the order need."""
    return pairs.join(common.select(F.col("word").alias("candidate"), F.col("rank").alias("common_rank")), "candidate", "left").withColumns(
        {
            "common": F.col("common_rank").isNotNull(),
            "in_order": contains_in_order(F.col("candidate"), F.col("word")),
            "sounds_alike": sound(F.col("word")) == sound(F.col("candidate")),
            "apart": F.abs(F.length("candidate") - F.length("word")),
        }
    )


def _keys() -> list:
    return [F.col("distance"), F.desc("common"), F.desc("in_order"), F.desc("sounds_alike"), F.coalesce("common_rank", F.lit(FAR)), F.col("apart"), F.col("candidate")]


def suggest_ranked(words: DataFrame, dictionary: DataFrame, common: DataFrame, top: int = TOP, most: int = 2) -> DataFrame:
    """``word, rank, candidate, distance, sounds_alike, common``: candidates within ``most`` edits, the word
    itself left out, by distance, common, letters in order, sound, common rank, length, word."""
    pairs = pairs_within(words, dictionary, most).where("distance > 0")
    return _top(_keyed(pairs, common), _keys(), top).select("word", "rank", "candidate", "distance", "sounds_alike", "common")


def suggest_staged(words: DataFrame, dictionary: DataFrame, common: DataFrame, top: int = TOP) -> DataFrame:
    """``word, stage, rank, candidate, distance, sounds_alike``.

    Stage 1: for words with a letter three times in a row, the ten best for the word squeezed to two and
    to one letter, merged by the smaller distance, common words first.  Stage 2: ``suggest_ranked``.
    Stage 3: common words at three edits.  A word gets the first stage that has any.  The first two stages'
    results, at most ``top`` rows a word, are written, as the later ones leave out their words."""
    own = settled(words.select("word").distinct())
    columns = ["word", "stage", "rank", "candidate", "distance", "sounds_alike"]

    long = own.where(has_long_run(F.col("word")))
    forms = long.select("word", F.explode(F.array(*(F.struct(F.lit(n).alias("kept"), squeeze(F.col("word"), n).alias("form")) for n in (2, 1)))).alias("f")).select("word", "f.kept", "f.form")
    best = suggest_ranked(forms.select(F.col("form").alias("word")), dictionary, common, STRETCHED_TOP)
    merged = forms.join(best.withColumnRenamed("word", "form"), "form").groupBy("word", "candidate").agg(F.min(F.struct("distance", (-F.col("kept")).alias("order"), "sounds_alike", "common")).alias("m"))
    one = settled(_top(merged.select("word", "candidate", "m.*"), [F.desc("common"), F.col("distance"), F.col("candidate")], top).withColumn("stage", F.lit(1)).select(columns))

    left = own.join(one.select("word").distinct(), "word", "left_anti")
    two = settled(suggest_ranked(left, dictionary, common, top).withColumn("stage", F.lit(2)).select(columns))

    left = left.join(two.select("word").distinct(), "word", "left_anti")
    left, frequent = settled(left), dictionary.join(common.select("word"), "word", "left_semi")
    three = suggest_ranked(left, frequent, common, top, 3).withColumn("stage", F.lit(3)).select(columns)
    return one.unionByName(two).unionByName(three)


def comparisons(words: DataFrame, dictionary: DataFrame, filtered: bool, most: int = 2) -> DataFrame:
    """``word, comparisons``: how many distances a search compares: the sizes of the length buckets, or all."""
    own = words.select("word").distinct()
    if not filtered:
        return own.crossJoin(F.broadcast(dictionary.agg(F.count(F.lit(1)).alias("comparisons"))))  # one row
    buckets = dictionary.groupBy(F.length("word").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    wanted = own.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.length("word") - most), F.length("word") + most)))
    return wanted.join(buckets, "len", "left").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).alias("comparisons"))


def staged_comparisons(words: DataFrame, dictionary: DataFrame, staged: DataFrame) -> DataFrame:
    """``word, comparisons``: how many distances the staged search of each word compares, with candidates filtered by
    length: two passes for the squeezed forms of a word with a long run, one with the word if those gave nothing, and
    a wider one if that gave nothing.  ``staged``: what the search found."""
    own = words.select("word").distinct().join(staged.select("word", "stage").distinct(), "word", "left").withColumn("stage", F.coalesce("stage", F.lit(4)))
    stretched = has_long_run(F.col("word"))
    passes = F.array(
        *(F.when(stretched, F.struct(squeeze(F.col("word"), n).alias("form"), F.lit(2).alias("most"))) for n in (2, 1)),
        F.when(F.col("stage") > 1, F.struct(F.col("word").alias("form"), F.lit(2).alias("most"))),
        F.when(F.col("stage") > 2, F.struct(F.col("word").alias("form"), F.lit(3).alias("most"))),
    )
    done = own.select("word", F.explode(passes).alias("p")).where("p is not null").select("word", F.length("p.form").alias("n"), "p.most")
    buckets = dictionary.groupBy(F.length("word").alias("len")).agg(F.count(F.lit(1)).alias("n_words"))
    wanted = done.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - F.col("most")), F.col("n") + F.col("most"))))
    return wanted.join(buckets, "len", "left").groupBy("word").agg(F.sum(F.coalesce("n_words", F.lit(0))).alias("comparisons"))
