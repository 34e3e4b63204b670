"""Edit distance with adjacent swaps (optimal string alignment), and the join that finds close words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from glyphflow.functions.lineage import settled


def osa(a: str, b: str) -> Column:
    """Distance of two string columns: insertions, deletions, substitutions and swaps of neighbours, none
    of which touches another's letters.  Rows of the table are folded over the letters of ``a``; the
    state holds the last two rows and the letter before."""
    cell = (
        "list_min(x.row[j - 1] + 1, s.last[j] + 1, s.last[j - 1] + if(get(t.b, j - 1) = c, 0, 1),"
        " if(j > 1 and get(t.b, j - 1) = s.before and get(t.b, j - 2) = c, s.older[j - 2] + 1, 2147483647))"
    ).replace("list_min(", "least(")
    return F.expr(f"""
        transform(array(named_struct('a', filter(split({a}, ''), z -> z <> ''), 'b', filter(split({b}, ''), z -> z <> ''))), t ->
          aggregate(t.a,
            named_struct('older', cast(array() as array<int>), 'last', sequence(0, size(t.b)), 'before', cast('' as string)),
            (s, c) -> named_struct(
              'older', s.last,
              'last', if(size(t.b) = 0, array(s.last[0] + 1), aggregate(sequence(1, greatest(1, size(t.b))), named_struct('row', array(s.last[0] + 1)), (x, j) -> named_struct('row', array_append(x.row, {cell})), x -> x.row)),
              'before', c),
            s -> element_at(s.last, -1)))[0]""")


def letters(word: str) -> Column:
    """The letters of a word in order."""
    return F.array_join(F.array_sort(F.split(F.col(word), "")), "")


def letters_apart(a: str, b: str) -> Column:
    """Distance of the sorted letters: 0 for swaps, 1 for an insertion or deletion, 2 at most for a substitution."""
    return F.levenshtein(letters(a), letters(b))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words, a row each, and lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    codes = np.zeros((len(words), int(lengths.max(initial=0))), np.int32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    return codes, lengths


def osa_of_rows(one: list[str], other: list[str]) -> np.ndarray:
    """Distances of many pairs at once: a cell of all their tables is a few array operations."""
    (a, n), (b, m) = _codes(one), _codes(other)
    rows, width = len(one), b.shape[1]
    older, last = None, np.tile(np.arange(width + 1, dtype=np.int32), (rows, 1))
    out = last[np.arange(rows), m].copy()
    for i in range(a.shape[1]):
        here = np.empty_like(last)
        here[:, 0] = i + 1
        differ = a[:, i : i + 1] != b
        for j in range(1, width + 1):
            cell = np.minimum(np.minimum(here[:, j - 1], last[:, j]) + 1, last[:, j - 1] + differ[:, j - 1])
            if i and j > 1:
                swap = (a[:, i] == b[:, j - 2]) & (a[:, i - 1] == b[:, j - 1])
                cell = np.where(swap, np.minimum(cell, older[:, j - 2] + 1), cell)
            here[:, j] = cell
        older, last = last, here
        ended = np.flatnonzero(n == i + 1)
        out[ended] = last[ended, m[ended]]
    return out


#: Pairs of about one length that are worked out together.
TOGETHER = 4096


def _osa_where(one: pd.Series, other: pd.Series) -> pd.Series:
    """``osa`` of the rows that have both words."""
    out = np.full(len(one), np.nan)
    there = np.flatnonzero((one.notna() & other.notna()).to_numpy())
    a, b = one.to_numpy()[there], other.to_numpy()[there]
    order = np.argsort([max(len(x), len(y)) for x, y in zip(a, b)], kind="stable")
    for k in range(0, len(order), TOGETHER):
        some = order[k : k + TOGETHER]
        out[there[some]] = osa_of_rows(list(a[some]), list(b[some]))
    return pd.Series(out).astype("Int32")


def _bounds(a: str, b: str, most: int) -> tuple[Column, Column]:
    """Levenshtein's distance with a threshold (beyond: -1), and whether swaps may make it less."""
    lev = F.expr(f"levenshtein({a}, {b}, {2 * most})")
    room = F.when(lev <= most, lev - 2).otherwise(F.least(lev - 2, 2 * most - lev))
    return lev, (lev > 1) & (F.ceil(letters_apart(a, b) / 2) <= room)


def may_be_close(a: str, b: str, most: int) -> Column:
    """False only for pairs whose ``bounded_osa`` is null; a filter by it keeps them from Python."""
    lev, open_ = _bounds(a, b, most)
    return (lev >= 0) & ((lev <= most) | open_)


def bounded_osa(a: str, b: str, most: int) -> Column:
    """Distance where it is at most ``most``, else null.

    With x swaps and y other edits, Levenshtein's distance is at most 2x + y and the sorted letters are
    at most 2y apart.  So the built-in with a threshold drops most pairs, swaps can shorten the way only
    where the letters are close, and only such pairs need the full table: they alone go to Python, in Arrow batches."""
    lev, open_ = _bounds(a, b, most)
    table = F.pandas_udf(_osa_where, IntegerType())
    full = F.coalesce(table(F.when(open_, F.col(a)), F.when(open_, F.col(b))), lev)
    return F.when((lev >= 0) & (full <= most), full)


def letter_marks(word: str) -> Column:
    """A bit for the first and one for each further letter of 32 kinds: an insertion or deletion changes one bit, a substitution two, a swap none."""
    return F.expr(f"aggregate(filter(split({word}, ''), z -> z <> ''), 0L, (s, c) -> s | if((s & shiftleft(1L, ascii(c) & 31)) <> 0L, shiftleft(1L, 32 + (ascii(c) & 31)), shiftleft(1L, ascii(c) & 31)))")


def may_be_near(a: str, b: str, marks_of_a: str, marks_of_b: str, most: int) -> Column:
    """False only where ``may_be_close`` is, too.  Levenshtein's distance is worked out once, and letters are compared by their marks: with x swaps and y other
    edits, y is what swaps leave of ``most``, and 2y bits differ at most."""
    bits = [-1] + [64 if lev <= most else 2 * min(lev - 2, 2 * most - lev) for lev in range(2 * most + 1)]
    return F.bit_count(F.col(marks_of_a).bitwiseXOR(F.col(marks_of_b))) <= F.get(F.array(*map(F.lit, bits)), F.expr(f"levenshtein({a}, {b}, {2 * most})") + 1)


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it when up to ``most`` letters go."""
    def cut(ws: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>")))))

    found = [F.array(word)]
    for _ in range(most):
        found.append(cut(found[-1]))
    return F.array_distinct(F.flatten(F.array(*found)))


#: Words beyond this length have too many remainders; they are cut into segments instead.
LONG_WORD = {1: 40, 2: 40, 3: 20}
#: Remainders that more entries have than this are met together with the places of what was deleted.
HOT_ENTRIES = 1024


def _segments(word: Column, most: int, entered: bool) -> Column:
    """Keys of long words: ``2 * most + 1`` segments of its own length, or all that words within ``most`` edits can have
    as theirs.  An edit, a swap of neighbours too, breaks two segments at most and moves the others by ``most`` places."""
    parts = 2 * most + 1
    cut = lambda n, k: F.floor(n * k / parts).cast("int")
    key = lambda n, k, shift: F.concat_ws("\x00", F.lit(""), n.cast("string"), k.cast("string"), F.substring(word, cut(n, k) + 1 + shift, cut(n, k + 1) - cut(n, k)))
    numbers, around = F.sequence(F.lit(0), F.lit(parts - 1)), F.sequence(F.lit(-most), F.lit(most))
    if entered:
        return F.transform(numbers, lambda k: key(F.length(word), k, F.lit(0)))
    made = F.flatten(F.transform(around, lambda d: F.flatten(F.transform(numbers, lambda k: F.transform(around, lambda shift: F.when(cut(F.length(word) + d, k) + shift >= 0, key(F.length(word) + d, k, shift)))))))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def _placed_deletions(word: Column, n: int) -> Column:
    """``rest, slots`` for each way to delete ``n`` letters: the slot of a letter is the number of letters before it that stay."""
    found = F.array(F.struct(word.alias("rest"), F.array().cast("array<int>").alias("slots")))
    for _ in range(n):
        found = F.flatten(
            F.transform(
                found,
                lambda e: F.when(
                    F.coalesce(F.try_element_at(e["slots"], F.lit(-1)), F.lit(0)) < F.length(e["rest"]),
                    F.transform(
                        F.sequence(F.coalesce(F.try_element_at(e["slots"], F.lit(-1)), F.lit(0)), F.length(e["rest"]) - 1),
                        lambda j: F.struct(F.concat(F.substring(e["rest"], F.lit(1), j), F.substring(e["rest"], j + 2, F.length(e["rest"]))).alias("rest"), F.array_append(e["slots"], j).alias("slots")),
                    ),
                ).otherwise(F.array().cast("array<struct<rest:string,slots:array<int>>>")),
            )
        )
    return found


def _choices(slots: Column, n: int, given: int, shifted: bool) -> Column:
    """``n`` of ``given`` slots in every way, each one less in every way too if ``shifted``, as text."""
    from itertools import combinations, product

    ways = [F.concat_ws(",", *((F.get(slots, F.lit(i)) - s).cast("string") for i, s in zip(which, less))) for which in combinations(range(given), n) for less in product((0, 1) if shifted else (0,), repeat=n)]
    return F.array_distinct(F.array(*ways))


def _placed_keys(word: str, most: int, first: bool) -> Column:
    """``__rest, __places`` of a word: with p letters deleted from the first word and q from the second, at least p + q - most of
    them belong together (substituted, or one of two that changed places), and stand in the same slot, or the second's is one more."""
    def places(slots: Column, own: int) -> Column:
        ways = []
        for other in range(most + 1):
            p, q = (own, other) if first else (other, own)
            ways.append(F.transform(_choices(slots, max(0, p + q - most), own, not first), _after(f"{p}{q}:")))
        return F.flatten(F.array(*ways))

    def entries(own: int) -> Column:
        return F.transform(_placed_deletions(F.col(word), own), lambda e: F.struct(e["rest"].alias("__rest"), places(e["slots"], own).alias("__places")))

    return F.flatten(F.array(*map(entries, range(most + 1))))


def _after(mark: str):
    return lambda c: F.concat(F.lit(mark), c)


def close_pairs(words: DataFrame, others: DataFrame, most: int, word: str = "word", other: str = "candidate") -> DataFrame:
    """Pairs (``word``, ``other``, ``distance``) of distinct words within ``most`` edits, three at most.

    Two words that close have a common remainder after up to ``most`` deletions from each, so an
    equi-join on remainders finds them all without comparing every word with every other.  Of long words, of
    which there would be very many remainders, one of few segments is common.

    Some remainders are those of very many words: short words all have the empty one.  Remainders of more than ``HOT_ENTRIES`` of
    the others are joined with a second key, the places of the letters that were deleted and belong together.
    There, words that meet are near each other but for letters of one place that moved, so no remainder pairs up all of its words.

    The joins are by merging: Spark estimates an exploded side by what it was before, some hundred times less, and would
    collect all remainders of the others on the driver to broadcast them."""
    if most not in LONG_WORD:
        raise ValueError("one to three edits")
    long = LONG_WORD[most]

    def rests(c: str) -> Column:
        return F.when(F.length(c) <= long, deletions(F.col(c), most)).otherwise(F.array().cast("array<string>"))

    def keys(c: str, entered: bool) -> Column:
        segments = F.when(F.length(c) > long - most, _segments(F.col(c), most, entered)).otherwise(F.array().cast("array<string>"))
        return marked(F.concat(rests(c), segments))

    def marked(texts: Column) -> Column:
        """Hashes of 64 bits take less room than texts; two texts of one hash only make a pair that is compared for nothing."""
        return F.explode(F.transform(texts, lambda t: F.xxhash64(t))).alias("__rest")

    def placed(df: DataFrame, c: str, first: bool) -> DataFrame:
        """Placed keys of the words that have a hot remainder: those are few, and short or of one family."""
        own = df.join(hot, "__rest", "left_semi").select(c, marks[c]).distinct()
        entries = own.select(c, marks[c], F.explode(_placed_keys(c, most, first)).alias("k")).select(c, marks[c], F.xxhash64("k.__rest").alias("__rest"), "k.__places").join(hot, "__rest", "left_semi")
        return entries.select(c, marks[c], F.explode(F.transform("__places", lambda p: F.xxhash64(F.col("__rest"), p))).alias("__rest"))

    # The number holds: few bytes of words become many remainders, which adaptive execution would leave to one task.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine, others = words.select(F.col(word)).repartition(tasks, word).distinct(), others.select(F.col(other)).repartition(tasks, other).distinct()
    marks = {word: "__marks", other: "__marks_other"}
    left, right = (df.withColumn(marks[c], letter_marks(c)).select(c, marks[c], keys(c, entered)) for df, c, entered in ((mine, word, True), (others, other, False)))
    pair = (word, other, *marks.values())
    counted = others.select(marked(rests(other))).groupBy("__rest").agg(F.count(F.lit(1)).alias("n"))
    hot = settled(counted.where(F.col("n") > HOT_ENTRIES).select("__rest"))
    if hot.isEmpty():
        met = left.join(right.hint("merge"), "__rest").select(*pair)
    else:
        cold = left.join(right.join(hot, "__rest", "left_anti").hint("merge"), "__rest").select(*pair)
        met = cold.unionByName(placed(left, word, True).join(placed(right, other, False).hint("merge"), "__rest").select(*pair))
    if most > 2:  # a pair meets many times
        met = met.distinct()
    near = met.where(may_be_near(word, other, *marks.values(), most)).select(word, other).where(may_be_close(word, other, most))
    return near.withColumn("distance", bounded_osa(word, other, most)).where("distance is not null").distinct()
