"""Removal of lines that an earlier document or line has, exactly or within a few edits.

DataFrame operations only.  Equal lines are found by 128-bit hash, pre-aggregated.  For near lines
each line is split into threshold-plus-one segments.  A line enters the segments of its own
length into an index and probes it with its substrings for every shorter length that the threshold
allows, at each place where a segment of such a line can stand.  One pass finds the keys that two
different lines have, of which one is in the index; a second one takes only the entries of these keys.
What meets is verified by the banded bit-parallel edit distance (Hyyro, "A bit-vector algorithm for
computing Levenshtein and Damerau distances", the variant along the diagonal), folded over the
characters between what both lines begin and end with.

With the threshold 1, the default, a segment that very many distinct lines share is never joined with
itself.  Its lines are compared by all but one of many short fragments instead, and lines that share
even those by all but one character of the fragment: such lines are linked to the earliest one.
So the pairs grow with the lines and not with the square of a hot segment's lines.  Larger
thresholds join hot segments with themselves.

Order is by id (none comes last), row, place in the text.  A line goes if an equal line comes before it, or
if the first line equal to it is within the threshold of a line whose first place is before its own.
Copies go whatever their length; lines of white space alone stay.  Near copies are lines of at least
``least`` characters: an edit is then at most one character in so many, while of two lines of a few characters
each is an edit from the other.

Defined results.  Lines end at line feeds.  A null or empty text has no lines and its kept text is
empty.  Repeated rows are later copies, and lose their lines.  Other columns are kept; columns of the
result's names are replaced.  An empty table gives an empty table.  A very long line is hashed and cut
like others; only lines that meet one with a common segment are carried to it whole.  A text of very many lines
is one row of places at the end, never more than the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.skew import inner_join, small
from glyphflow.llm.storage import materialize

EDITS = 1
LEAST = 24
BUCKET = 32


def lines_of(docs: DataFrame) -> DataFrame:
    """``row, doc_id, place, line`` of every line of a table of ``__row, __id, __text``."""
    return docs.where("__text <> ''").select(F.col("__row").alias("row"), F.col("__id").alias("doc_id"), F.posexplode(F.split("__text", "\n", -1)).alias("place", "line"))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2")]


def _first() -> Column:
    """Where a line stands: what it is ordered by, and the name of a distinct line."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "place").alias("id")


def _entries(length: Column, line: Column, edits: int) -> list[tuple[Column, int]]:
    """What a line enters into the segment index (0) and what it probes it with (1): keys, null
    where a substring would reach over the line's ends."""
    parts = edits + 1
    cut = lambda n, k: F.floor(n * k / parts).cast("int")
    key = lambda n, k, a, b, shift: F.xxhash64(n, F.lit(k), F.substring(line, a + 1 + shift, b - a))
    out = [(key(length, k, cut(length, k), cut(length, k + 1), 0), 0) for k in range(parts)]
    for shorter in range(edits + 1):
        n = length - shorter
        for k in range(parts):
            a, b = cut(n, k), cut(n, k + 1)
            # Before the segment at most k of the edits can have been made, after it at most the rest.
            for shift in range(max(-k, shorter - (edits - k)), min(k, shorter + (edits - k)) + 1):
                if shorter or shift:
                    out.append((F.when((a + shift >= 0) & (b + shift <= length), key(n, k, a, b, shift)), 1))
    return out


def _stripped(a: str, b: str) -> str:
    """SQL of ``p`` (the longer one) and ``t``: two strings less what they begin and end with alike.

    The common part is found by halving: a longer beginning is never equal where a shorter one differs."""
    steps = "array(" + ", ".join(str(1 << i) for i in range(30, -1, -1)) + ")"
    alike = lambda side, x, y, most: f"aggregate(filter({steps}, z -> z <= {most}), 0, (m, z) -> if(m + z <= {most} and {side}({x}, m + z) = {side}({y}, m + z), m + z, m))"
    least = "least(length(s.x), length(s.y))"
    head = f"transform(array(named_struct('x', {a}, 'y', {b})), s -> named_struct('x', s.x, 'y', s.y, 'n', {alike('left', 's.x', 's.y', least)}))"
    rest = f"transform({head}, s -> named_struct('x', substring(s.x, s.n + 1), 'y', substring(s.y, s.n + 1)))"
    tail = f"transform({rest}, s -> named_struct('x', s.x, 'y', s.y, 'n', {alike('right', 's.x', 's.y', least)}))"
    both = f"transform({tail}, s -> named_struct('x', left(s.x, length(s.x) - s.n), 'y', left(s.y, length(s.y) - s.n)))"
    return f"transform({both}, s -> if(length(s.x) >= length(s.y), named_struct('p', s.x, 't', s.y), named_struct('p', s.y, 't', s.x)))"


def within(a: str, b: str, edits: int) -> Column:
    """Whether the edit distance of two string columns is at most ``edits``.

    What both begin or end with takes no edits and goes first.  Bit ``i`` of a word stands for row
    ``j - edits + i`` of column ``j``; the cell that holds the distance is on the diagonal of the
    difference in length, where each step costs 1 less its bit of ``d0``."""
    width = 2 * edits + 1
    ones = (1 << width) - 1
    same = " + ".join(f"if(get(s.p, j - {edits - i}) = get(s.t, j), {1 << i}, 0)" for i in range(width))
    d0 = f"(((((m & x.vp) + x.vp) ^ x.vp) | m | x.vn) & {ones})"
    hp = f"(x.vn | ({ones} ^ ({d0} | x.vp)))"
    vp = f"((({d0} & x.vp) | ({ones} ^ (shiftright({d0}, 1) | {hp}))) & {ones})"
    vn = f"({hp} & shiftright({d0}, 1))"
    return F.expr(f"""
        abs(length({a}) - length({b})) <= {edits} and transform({_stripped(a, b)}, c ->
          if(length(c.t) = 0, length(c.p) <= {edits}, transform(
          array(named_struct('p', split(c.p, ''), 't', split(c.t, ''))),
          s -> aggregate(
            transform(sequence(0, size(s.t) - 1), j -> {same}),
            named_struct('vp', {ones ^ ((1 << edits) - 1)}, 'vn', {(1 << edits) - 1}, 'cost', size(s.p) - size(s.t)),
            (x, m) -> named_struct('vp', {vp}, 'vn', {vn}, 'cost', x.cost + 1 - (shiftright({d0}, {edits} + size(s.p) - size(s.t)) & 1)),
            x -> x.cost))[0] <= {edits}))[0]""")


def _shared(entries: DataFrame) -> DataFrame:
    """Of ``entries`` (``key, probe, h1, h2, id``) those whose key is in the index and belongs to two lines or
    more: each line once, with the number ``met`` of lines and probes of its key."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("h1", "h2") for n, f in (("least", F.min), ("most", F.max))]
    keys = entries.groupBy("key").agg(F.min("probe").alias("probe"), *ends).where("probe = 0 and (least_h1 <> most_h1 or least_h2 <> most_h2)").select("key")
    keys = materialize(keys, "keys")
    found = inner_join(entries, keys, ["key"], F.col("h1"), keys.count(), 16)
    rest = [F.first(c).alias(c) for c in entries.columns if c not in ("key", "probe", "h1", "h2", "id")]
    once = materialize(found.groupBy("key", "probe", "h1", "h2").agg(F.min("id").alias("id"), *rest), "shared")
    met = materialize(once.groupBy("key").agg(F.count(F.lit(1)).alias("met")), "met")
    return inner_join(once, met, ["key"], F.col("h1"), met.count(), 24)


def _pairs(entries: DataFrame) -> DataFrame:
    """Index entries with the other entries of their key: ``a, b``."""
    one, other = entries.where("probe = 0").select("key", F.col("id").alias("a")), entries.select("key", "probe", F.col("id").alias("b"))
    return one.join(other, "key").where("a <> b and (probe = 1 or a < b)").select("a", "b")


def _by_fragments(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For lines of hot segments and the threshold 1: entries by all but one fragment, and what
    is linked where even those are hot."""
    n = F.col("length") - F.col("probe")
    parts = F.greatest(F.lit(2), F.least(F.lit(32), F.floor(n / 16))).cast("int")
    spread = texts.select("id", "line", *_hashes(), F.length("line").alias("length"), F.explode(F.array(F.lit(0), F.lit(1))).alias("probe")).withColumn("n", n).withColumn("parts", parts)
    spread = spread.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = F.floor(F.col("n") * F.col("k") / F.col("parts")).cast("int"), F.floor(F.col("n") * (F.col("k") + 1) / F.col("parts")).cast("int")
    key = F.xxhash64("n", "k", F.substring("line", F.lit(1), a), F.substring("line", b + 1 + F.col("probe"), F.col("length")))
    entries = spread.select(key.alias("key"), "probe", "h1", "h2", "id", F.substring("line", a + 1, b - a + F.col("probe")).alias("fragment"))
    shared = materialize(_shared(entries), "fragments")
    hot = shared.where(F.col("met") > BUCKET)
    size = F.length("fragment")
    without = lambda f, i: F.concat(F.substring(f, F.lit(1), i), F.substring(f, i + 2, F.lit(1 << 30)))
    places = hot.where(size > 0).withColumn("i", F.explode(F.sequence(F.lit(0), size - 1)))
    same = places.where("probe = 0").select(F.xxhash64("key", F.lit("s"), "i", without(F.col("fragment"), F.col("i"))).alias("key"), "id")
    earliest = materialize(same.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "a"), "earliest")
    stars = inner_join(same, earliest, ["key"], F.col("id.place"), earliest.count(), 48).where("id <> a").select("a", F.col("id").alias("b"))
    # A longer line links to every line that it is with a letter less: one line, as lines are distinct.
    whole = hot.where("probe = 0").select(F.xxhash64("key", F.lit("d"), "fragment").alias("key"), F.col("id").alias("a"))
    longer = places.where("probe = 1").select(F.xxhash64("key", F.lit("d"), without(F.col("fragment"), F.col("i"))).alias("key"), F.col("id").alias("b")).distinct()
    return shared.where(F.col("met") <= BUCKET), stars.unionByName(whole.join(longer, "key").where("a <> b").select("a", "b"))


def near_lines(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """Links ``a``-``b`` of distinct lines of ``least`` characters or more within ``edits``; a line's name is its first place."""
    long = lines.where(F.length("line") >= least)
    made = _entries(F.length("line"), F.col("line"), edits)
    keyed = long.select(*_hashes(), _first(), *(k.alias(f"k{i}") for i, (k, _) in enumerate(made)))
    stacked = F.stack(F.lit(len(made)), *(x for i, (_, p) in enumerate(made) for x in (F.col(f"k{i}"), F.lit(p)))).alias("key", "probe")
    entries = keyed.select("h1", "h2", "id", stacked).where("key is not null")
    members = materialize(_shared(entries), "members")
    refine = edits == 1
    few = members.where(F.col("met") <= BUCKET) if refine else members
    pairs = materialize(_pairs(few).distinct(), "pairs")
    hot = members.where(F.col("met") > BUCKET).select("id", F.lit(True).alias("hot"))
    wanted = pairs.select(F.col("a").alias("id"), F.lit(False).alias("hot")).unionByName(pairs.select(F.col("b").alias("id"), F.lit(False).alias("hot")))
    wanted = (wanted.unionByName(hot) if refine else wanted).groupBy("id").agg(F.max("hot").alias("hot"))
    wanted = materialize(wanted.select("id", "hot", "id.row", "id.place"), "wanted")
    texts = materialize(lines.select("row", "place", "line").join(small(wanted, wanted.count(), 64), ["row", "place"]).select("id", "hot", "line"), "texts")
    if refine:
        some, linked = _by_fragments(texts.where("hot"))
        pairs = pairs.unionByName(_pairs(some)).unionByName(linked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    return met.where(within("line_a", "line_b", edits)).select("a", "b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_repeated`` (copies of an earlier line), ``n_near`` (first lines within
    the threshold of an earlier one) and ``kept_text`` (the other lines)."""
    names = ["n_lines", "n_repeated", "n_near", "kept_text"]
    kept = [c for c in docs.columns if c not in names]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # The rows are written with their numbers: read again after a loss, they have the same ones.
    rows = materialize(docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__own"), F.col(f"`{id_col}`").cast("long").alias("__id"), text.alias("__text"), F.monotonically_increasing_id().alias("__row")), "rows")
    lines = lines_of(rows)
    placed = lines.where(F.col("line").rlike(r"\S")).select("row", "place", "doc_id", *_hashes())
    repeats = materialize(placed.groupBy("h1", "h2").agg(F.min(_first()).alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "id"), "repeats")
    copies = inner_join(placed, repeats, ["h1", "h2"], F.col("row") + F.col("place"), repeats.count(), 64)
    copies = copies.where("row <> id.row or place <> id.place").select("row", "place", F.lit(True).alias("repeated"))
    links = near_lines(lines, edits, least)
    near = links.select(F.greatest("a", "b").alias("id")).distinct().select("id.row", "id.place", F.lit(False).alias("repeated"))
    gone = copies.unionByName(near).groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list("place")).alias("__gone"), F.count_if("repeated").alias("__repeated"), F.count_if(~F.col("repeated")).alias("__near"))
    gone = materialize(gone, "gone")
    total = gone.agg(F.sum(F.size("__gone") + 8)).first()[0] or 0
    text = F.col("__text")
    # One flag for each line up to the last that goes: as many zeros as lines between, then a one.
    flags = F.expr("split(array_join(transform(__gone, (p, i) -> concat(repeat('0', p - coalesce(get(__gone, i - 1), -1) - 1), '1')), ''), '')")
    left = F.filter(F.zip_with(F.split(text, "\n", -1), flags, lambda line, flag: F.when(F.coalesce(flag, F.lit("0")) == "0", line)), lambda line: line.isNotNull())
    return rows.join(small(gone, total, 8), "__row", "left").select(
        *(F.col("__own").getField(c).alias(c) for c in kept),
        F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce("__repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("__near", F.lit(0)).alias("n_near"),
        F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("kept_text"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with its texts less the lines that go, and their sizes.  A text of which nothing is left but white
    space goes with its row: all it said is in earlier rows."""
    names = ["n_lines", "n_repeated", "n_near", "kept_text"]
    free = docs.withColumnsRenamed({old: f"__own_{old}" for old in names if old in docs.columns})
    out = dedup_lines(free, id_col, text_col)
    cut = (F.col("n_repeated") + F.col("n_near")) > 0
    new = {text_col: F.when(cut, F.col("kept_text")).otherwise(F.col(f"`{text_col}`"))}
    if size_col in docs.columns:
        new[size_col] = F.when(cut, F.length("kept_text")).otherwise(F.col(f"`{size_col}`")).cast(docs.schema[size_col].dataType)
    left = out.where(~cut | F.col("kept_text").rlike(r"\S"))
    return left.select([new.get(c, F.col(f"`__own_{c}`" if c in names else f"`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_repeated", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


#: One edit: lines of one length differ in one place; a line that is longer by one gives the other without one letter.
ORACLE = """
WITH l AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text <> '')),
f AS (SELECT doc_id, line, place, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) > 1 AND regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') AS repeated FROM l),
u AS (SELECT doc_id, line, place, length(line) AS n FROM f WHERE NOT repeated AND length(line) >= 24),
pairs AS (SELECT a.line AS x, b.line AS y, a.n AS n, b.n AS k, a.doc_id AS da, a.place AS pa, b.doc_id AS db, b.place AS pb FROM u a JOIN u b ON b.n BETWEEN a.n AND a.n + 1 AND a.line <> b.line AND a.line[1:12] = b.line[1:12]
  UNION SELECT a.line, b.line, a.n, b.n, a.doc_id, a.place, b.doc_id, b.place FROM u a JOIN u b ON b.n BETWEEN a.n AND a.n + 1 AND a.line <> b.line AND a.line[-12:] = b.line[-12:]),
one AS (SELECT * FROM pairs WHERE CASE WHEN n = k THEN hamming(regexp_replace(x, '[^\\x00-\\x7F]', '~', 'g'), regexp_replace(y, '[^\\x00-\\x7F]', '~', 'g')) <= 1 AND len(list_filter(range(1, n + 1), lambda i: x[i] <> y[i])) = 1
  ELSE len(list_filter(range(1, k + 1), lambda i: y[1:i - 1] || y[i + 1:] = x)) > 0 END),
near AS (SELECT DISTINCT CASE WHEN (da, pa) < (db, pb) THEN db ELSE da END AS doc_id, CASE WHEN (da, pa) < (db, pb) THEN pb ELSE pa END AS place FROM one),
m AS (SELECT f.*, near.doc_id IS NOT NULL AS close FROM f LEFT JOIN near USING (doc_id, place)),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (repeated) AS n_repeated, count(*) FILTER (close) AS n_near, string_agg(line, chr(10) ORDER BY place) FILTER (NOT repeated AND NOT close) AS t FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_near, 0) AS n_near, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""
