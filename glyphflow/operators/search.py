"""Exact search for one or many patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ahead(pattern: Column) -> Column:
    """A regular expression for the places where the pattern stands, which takes no letters: overlaps count."""
    return F.concat(F.lit("(?=\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))


def occurrences(text: Column, keyword: Column) -> Column:
    """How often the keyword stands in the text, overlaps included; an empty one never does."""
    return F.when(keyword == "", 0).otherwise(F.regexp_count(text, _ahead(keyword)))


RUN = 128


def sums_before(values: Column) -> Column:
    """For each number of an array, the sum of those before it: sums of runs first, then within each run, so the work
    grows with the array and not with its square."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / RUN).cast("int")), lambda r: F.slice(values, r * RUN + 1, F.lit(RUN)))

    def within(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + total(p)))
        return F.transform(F.array(ends), lambda e: F.flatten(F.transform(parts, lambda p, r: F.transform(p, lambda x, i: F.get(e, r) + total(F.slice(p, F.lit(1), i))))))[0]

    return F.transform(F.array(runs), within)[0]


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane take two."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def positions(text: Column, pattern: Column, length=F.length) -> Column:
    """All starts from 0, overlaps included: the text is cut before each occurrence and the lengths of the
    pieces add up to the starts.  ``length`` gives the unit: characters, or ``utf16_length``."""
    none = F.array().cast("array<int>")
    # Every piece but a first one without the pattern begins where the pattern does.
    starts = F.transform(F.array(F.transform(F.split(text, _ahead(pattern), -1), length)), sums_before)[0]
    return F.when((F.length(pattern) > 0) & F.contains(text, pattern), F.filter(starts, lambda k, i: (i > 0) | F.startswith(text, pattern))).otherwise(none)


def keyword_analytics(articles: DataFrame, keyword: str, text_col: str = "content") -> DataFrame:
    """``occurrences`` of a keyword in each article, in any case, zeros included."""
    return articles.withColumn("occurrences", occurrences(F.lower(text_col), F.lower(F.lit(keyword))))


def clean_patterns(patterns: Column) -> Column:
    """The patterns of a comma list, trimmed, without empty and repeated ones, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(patterns, ","), lambda p: F.regexp_replace(p, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), lambda p: p != ""))


def pattern_table(spark, patterns: list[str]) -> DataFrame:
    """``ord, pattern`` of a list, ``ord`` from 0."""
    return spark.createDataFrame(list(enumerate(patterns)), "ord int, pattern string")


#: Matches that leave a task together, so that it never holds those of a batch of texts.
MATCHES = 1 << 14


def found_in(batches, copies: dict[str, int], id_col: str, text_col: str):
    """Arrow batches of the matches of all patterns (``copies``: how often each is given) in batches of texts."""
    import ahocorasick
    import pyarrow as pa

    automaton = ahocorasick.Automaton()
    for p in copies:
        automaton.add_word(p, p)
    automaton.make_automaton()

    def batch(kind, ids, found, ends):
        starts = [e - len(p) + 1 for e, p in zip(ends, found)]
        return pa.record_batch([pa.array(ids, kind), pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "pattern", "start", "end_index"])

    for b in batches:
        kind, ids, found, ends = b.schema.field(id_col).type, [], [], []
        for i, text in zip(b[id_col], b[text_col]):  # a text at a time
            i = i.as_py()
            for end, p in automaton.iter(text.as_py() or "") if copies else ():
                for _ in range(copies[p]):
                    ids.append(i)
                    found.append(p)
                    ends.append(end)
                    if len(ids) == MATCHES:
                        yield batch(kind, ids, found, ends)
                        ids, found, ends = [], [], []
        yield batch(kind, ids, found, ends)


def multi_search(texts: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pattern, start, end_index`` (inclusive) of every occurrence; a repeated pattern matches again.

    The automaton of all patterns runs once over each text, in Arrow batches."""
    given = [(r["ord"], r["pattern"]) for r in patterns.orderBy("ord").collect() if r["pattern"]]  # a list that the caller wrote
    copies: dict[str, int] = {}
    for _, p in given:
        copies[p] = copies.get(p, 0) + 1
    kind = texts.schema[id_col].dataType.simpleString()

    def scan(batches):
        return found_in(batches, copies, id_col, text_col)

    return texts.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, pattern string, start int, end_index int")


def in_scan_order(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``ord``: by end, the longest pattern first, as one pass over the text reports them."""
    order = Window.partitionBy(id_col).orderBy("end_index", F.desc(F.length("pattern")))
    return matches.withColumn("ord", F.row_number().over(order))


def summary(texts: DataFrame, patterns: DataFrame, matches: DataFrame, id_col: str = "doc_id", shown: int = 10) -> DataFrame:
    """For each text and pattern, the number of matches and the first positions, zeros included."""
    every = texts.select(id_col).withColumn("pattern", F.explode(F.lit([r["pattern"] for r in patterns.orderBy("ord").collect()])))
    own = Window.partitionBy(id_col, "pattern")  # one pass over the matches counts and ranks them
    ranked = matches.select(id_col, "pattern", "start", F.count(F.lit(1)).over(own).alias("n"), F.row_number().over(own.orderBy("start")).alias("at")).where(F.col("at") <= shown)
    own = ranked.groupBy(id_col, "pattern").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("start")).alias("first"))  # ``shown`` at most
    none = F.array().cast("array<int>")
    return every.join(own, [id_col, "pattern"], "left").select(id_col, "pattern", F.coalesce("n", F.lit(0)).alias("matches"), F.coalesce("first", none).alias("first_positions"))


def demo_scan(words: DataFrame, texts: DataFrame, limit: int, order: str = "rank", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of the first ``limit`` words in texts in lower case; the words stay as they are."""
    first = words.orderBy(order).limit(limit).select((F.row_number().over(Window.orderBy(order)) - 1).alias("ord"), F.col("word").alias("pattern"))
    return multi_search(texts.select(id_col, F.lower(text_col).alias(text_col)), first, id_col, text_col)
