"""Evaluation on labelled pairs, and by random typing errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.functions.text import estimate
from glyphflow.operators import dictionary as D
from glyphflow.operators import suggest as S

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def flag_pairs(pairs: DataFrame, dictionary: DataFrame, common: DataFrame) -> DataFrame:
    """``correct, corrupted, flagged, is_error, top1, in_top3``: detection by plain lookup, and suggestions
    for every real error, found or not."""
    flagged = pairs.join(dictionary.select(F.col("word").alias("corrupted"), F.lit(True).alias("__known")), "corrupted", "left").withColumn("flagged", F.col("__known").isNull()).drop("__known")
    real = flagged.withColumn("is_error", F.col("correct") != F.col("corrupted"))
    ranked = S.suggest_staged(real.where("is_error").select(F.col("corrupted").alias("word")), dictionary, common)
    listed = ranked.groupBy(F.col("word").alias("corrupted")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda s: s["candidate"]).alias("found"))
    none = F.array().cast("array<string>")
    out = real.join(listed, "corrupted", "left").withColumn("found", F.when(F.col("is_error"), F.coalesce("found", none)).otherwise(none))
    return out.select("correct", "corrupted", "flagged", "is_error", F.try_element_at("found", F.lit(1)).alias("top1"), F.array_contains(F.slice("found", 1, 3), F.col("correct")).alias("in_top3"))


def confusion(flags: DataFrame) -> DataFrame:
    flagged, error = F.col("flagged"), F.col("is_error")
    return flags.agg(F.count_if(flagged & error).alias("tp"), F.count_if(flagged & ~error).alias("fp"), F.count_if(~flagged & error).alias("fn"), F.count_if(~flagged & ~error).alias("tn"))


def precision_recall(confused: DataFrame) -> DataFrame:
    """Shares that have no denominator are null."""
    share = lambda a, b: F.col(a).cast("double") / F.nullif(F.col(a) + F.col(b), F.lit(0))
    p, r = share("tp", "fp"), share("tp", "fn")
    return confused.select(p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def top_accuracy(flags: DataFrame) -> DataFrame:
    """Shares of all real errors whose right word is suggested first, or among three, after being detected."""
    errors = F.nullif(F.count_if(F.col("is_error")), F.lit(0))
    hit = F.col("is_error") & F.col("flagged")
    return flags.agg((F.count_if(hit & (F.coalesce("top1", F.lit("")) == F.col("correct"))) / errors).alias("top1_accuracy"), (F.count_if(hit & F.col("in_top3")) / errors).alias("top3_recall"))


def failures(flags: DataFrame) -> DataFrame:
    """Real errors whose first suggestion is not the right word, or that were not detected."""
    wrong = F.col("is_error") & (~F.col("flagged") | (F.coalesce("top1", F.lit("")) != F.col("correct")))
    return flags.where(wrong).select("correct", "corrupted", F.coalesce("top1", F.lit("(none)")).alias("suggested"), (~F.col("flagged")).alias("not_detected"))


def corrupt_at(word: Column, kind: Column, at: Column, letter: Column) -> Column:
    """One typing error: 0 deletes (words of more than a letter), 1 inserts, 2 substitutes, 3 swaps, at place ``at`` from 0."""
    before, own, after = F.substring(word, F.lit(1), at), F.substring(word, at + 1, F.lit(1)), F.substring(word, at + 2, F.length(word))
    following, rest = F.substring(word, at + 2, F.lit(1)), F.substring(word, at + 3, F.length(word))
    return (
        F.when((kind == 0) & (F.length(word) > 1), F.concat(before, after))
        .when(kind == 1, F.concat(before, letter, own, after))
        .when(kind == 2, F.concat(before, letter, after))
        .when((kind == 3) & (following != ""), F.concat(before, following, own, rest))
        .otherwise(F.concat(word, letter))
    )


def corrupt_plainly(word: Column) -> Column:
    """The same error every time: kind by the length modulo 4, in the middle, with a letter that differs there."""
    at = F.floor(F.length(word) / 2).cast("int")
    here = F.substring(word, at + 1, F.lit(1))
    return corrupt_at(word, F.length(word) % 4, at, F.when(here == "q", "z").otherwise("q"))


ATTEMPTS = 8


def draw(seed: int, attempt: Column, what: str, key: Column, n: Column) -> Column:
    """A number below ``n`` from a hash of the key: the same on every machine, unlike the next draw's."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), attempt.cast("string"), F.lit(f"{what}:"), key).cast("binary")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), n.cast("long")).cast("int")


def corrupt(words: DataFrame, seed: int, word: str = "word", name: str = "corrupted") -> DataFrame:
    """One random typing error in each word, never the word itself: a letter goes, comes (anywhere, also at the end), is
    another one or changes places with the next.  What leaves the word as it was is drawn again."""
    w = F.col(word)
    kinds = F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda k: F.struct(k.alias("k"), draw(seed, k, "kind", w, F.lit(4)).alias("kind"), draw(seed, k, "letter", w, F.lit(26)).alias("letter")))
    kinds = F.filter(kinds, lambda d: (F.length(w) > 1) | d["kind"].isin(1, 2))
    places = lambda d: F.greatest(F.lit(1), F.when(d["kind"] == 1, F.length(w) + 1).when(d["kind"] == 3, F.length(w) - 1).otherwise(F.length(w)))
    drawn = F.transform(kinds, lambda d: F.struct(d["kind"].alias("kind"), F.substring(F.lit(LETTERS), d["letter"] + 1, F.lit(1)).alias("letter"), draw(seed, d["k"], "at", w, places(d)).alias("at")))
    made = F.filter(F.transform(drawn, lambda d: corrupt_at(w, d["kind"], d["at"], d["letter"])), lambda x: x != w)
    return words.withColumn(name, F.coalesce(F.get(made, F.lit(0)), F.concat(w, F.lit("x"))))


def reservoir(df: DataFrame, size: int, seed: int, key: str | None = None) -> DataFrame:
    """Exactly ``min(size, rows)`` rows, each equally likely; by the hash of a key without repeats, if one is named,
    which draws the same rows each time."""
    order = F.rand(seed) if key is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(order).limit(size)


def stratified_sample(df: DataFrame, by: list[str], size: int, seed: int, key: str, name: str = "rank") -> DataFrame:
    """``min(size, rows)`` rows of each group, numbered in ``name``, those with the smallest hashes of seed and key: the same rows each time.

    The smallest of a group are the smallest of its parts' smallest, so parts (16 of a group, by the key) keep ``size`` rows each
    before the group does, and Spark does so in each task before it shuffles: a group that holds a third of all rows sends
    no more than any other.  Nulls are a group of their own; rows of equal keys are ordered by nothing else, so keys should be unique."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    marked = df.withColumn("__mark", mark).withColumn("__part", F.conv(F.substring("__mark", 1, 1), 16, 10).cast("int"))
    own = marked.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__mark", key))).where(F.col("__n") <= size)
    ranked = own.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("__mark", key))).where(F.col(name) <= size)
    return ranked.drop("__mark", "__part", "__n")


MOST_FAILURES = 8


def random_trials(dictionary: DataFrame, common: DataFrame, trials: int = 40, seed: int = 7) -> DataFrame:
    """``word, corrupted, detected, top1, found`` of random errors in common words of five letters or more; the trials are between 5 and 300."""
    most = min(300, max(5, trials))
    pool = common.where(F.length("word") >= 5).select("word")
    # A few hundred rows, so they are made a local table: what follows needs them several times.
    drawn = pool.sparkSession.createDataFrame(corrupt(reservoir(pool, most, seed, "word"), seed + 1).collect(), "word string, corrupted string")
    wrong = D.potential_errors(drawn.select(F.col("corrupted").alias("word")), dictionary, common).select(F.col("word").alias("corrupted"), F.lit(True).alias("detected"))
    ranked = S.suggest_staged(wrong.select(F.col("corrupted").alias("word")), dictionary, common)
    listed = ranked.groupBy(F.col("word").alias("corrupted")).agg(F.min_by("candidate", "rank").alias("top1"), F.collect_set("candidate").alias("found"))
    return drawn.join(wrong, "corrupted", "left").join(listed, "corrupted", "left").select("word", "corrupted", F.coalesce("detected", F.lit(False)).alias("detected"), "top1", "found")


def monte_carlo(dictionary: DataFrame, common: DataFrame, trials: int = 40, seed: int = 7) -> DataFrame:
    """Detection, first-suggestion and three-suggestion shares with 95 % intervals over random errors; with no common word of five
    letters there are 0 trials and no shares (nulls)."""
    return accuracy_of(random_trials(dictionary, common, trials, seed))


def accuracy_of(tried: DataFrame) -> DataFrame:
    """The shares of ``random_trials``."""
    n = F.count(F.lit(1))
    share = lambda c: F.try_divide(F.count_if(c), n)
    out = tried.agg(n.alias("trials"), *(share(c).alias(a) for a, c in (("detection", F.col("detected")), ("top1", F.coalesce(F.col("top1") == F.col("word"), F.lit(False))), ("top3", F.coalesce(F.array_contains("found", F.col("word")), F.lit(False))))))
    some = F.nullif(F.col("trials"), F.lit(0))
    ends = [e.alias(f"{c}_{side}") for c in ("detection", "top1", "top3") for e, side in zip(estimate(F.col(c), some)[1:], ("low", "high"))]
    return out.select("trials", "detection", "top1", "top3", *ends)


def trial_failures(tried: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    """``word, corrupted, suggested, not_detected`` of the first ``most`` trials, by word, whose error was not detected or whose first suggestion is not the word."""
    wrong = ~F.col("detected") | (F.coalesce("top1", F.lit("")) != F.col("word"))
    return tried.where(wrong).orderBy("word", "corrupted").limit(most).select("word", "corrupted", F.coalesce("top1", F.lit("(none)")).alias("suggested"), (~F.col("detected")).alias("not_detected"))
