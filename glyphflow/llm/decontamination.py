"""Benchmark decontamination by winnowed fingerprints.

Words are lower-cased (A-Z) runs of digits, letters and all characters beyond ASCII.  Of every
sliding window of hashes of ``k`` consecutive words only the smallest hash is kept, for documents
and benchmark items alike (Schleimer, Wilkerson and Aiken, "Winnowing").  With ``n + 1 - k`` hashes a
window, every span of ``n`` shared words has a kept hash in common.  Equal hashes are joined and
each hit is extended to the spans of ``n`` words around it, which are looked up among the benchmark's spans
and compared word by word; spans that follow each other make up the longest run.  So a hash that very
many items have costs a document no more than any other.  An item of fewer than ``n`` words is one span.

The benchmark is cut into parts of at most ``PART_WORDS`` words.  Each part's index goes to every task and costs
one pass; with more than one part what was found is written between them and the index before is given up, so
a task never holds two.  Parts report per row only the runs of words that were hit; the rows are never
collected by key.  A text of more than a slice is read in pieces that overlap by less than a span.

Defined results.  A null or empty text has no words: nothing is hit, and it is not contaminated.
A null or empty item is never found.  Items of equal id count once for a document.  Items without id
still mark words but are left out of the list of items.  Repeated rows and rows without id are
rows like others.  Other columns of ``docs`` are kept by ``clean``.  An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.blocks import SLICE_BYTES, U64, WORDS, give_back, mix, runs, slices
from glyphflow.llm.storage import materialize

SPAN = 13
GRAM = 5
PART_WORDS = 4_000_000
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BREAK = b" \xff "  # no UTF-8 text has this byte


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


def winnow(numbers: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the kept ``gram``-word hashes of a sequence of word numbers; -1 is a word of no item."""
    n = len(numbers) - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    hashes = grams(numbers, gram)
    known = np.cumsum(np.append(0, numbers < 0))
    unknown = known[gram:] - known[:-gram] > 0
    hashes[unknown] = U64(0xFFFFFFFFFFFFFFFF)
    blocked = np.append(0, np.cumsum(unknown))
    at = np.flatnonzero(blocked[window:] == blocked[: n - window + 1])
    if not len(at):
        return at
    best = at.copy()
    for k in range(1, window):
        later = hashes[at + k] <= hashes[best]
        best[later] = at[later] + k
    return np.unique(best)


def grams(numbers: np.ndarray, gram: int) -> np.ndarray:
    at = np.arange(max(0, len(numbers) - gram + 1))
    return mix(runs(mix(numbers.astype(U64)), WORDS[0], at, at + gram), gram)


class _Spans:
    """The distinct spans of ``need`` words of some items: hashes, a place of each, and whose they are."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, names: np.ndarray, need: int, gram: int) -> None:
        self.need, self.gram = need, min(gram, need)
        count = sizes - need + 1
        item = np.repeat(np.arange(len(starts)), count)
        at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + starts[item]
        hashes = _hash(words, at, need)
        order = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
        self.hash, self.place = hashes[order][first], at[order][first]
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        # Spans of one hash but other words would hide each other: such hashes are compared place by place.
        self.other = bool(np.any(words[at[order][:, None] + np.arange(need)] != words[self.place[number][:, None] + np.arange(need)]))
        if self.other:
            raise ValueError("two spans of the benchmark have one 64-bit hash; choose another family of powers")
        pair = np.unique(number * (int(names.max()) + 2) + names[item][order] + 1)
        owner, name = pair // (int(names.max()) + 2), pair % (int(names.max()) + 2) - 1
        owner, self.names = owner[name >= 0], name[name >= 0]  # items without id are not listed
        self.start = np.searchsorted(owner, np.arange(len(first) + 1))
        kept = [grams(words[s : s + n], self.gram)[winnow(words[s : s + n], self.gram, need - self.gram + 1)] for s, n in zip(starts.tolist(), sizes.tolist())]
        self.kept = np.unique(np.concatenate(kept))

    def find(self, numbers: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where spans begin in a sequence of word numbers, and which they are."""
        none = np.zeros(0, np.int64)
        at = winnow(numbers, self.gram, self.need - self.gram + 1)
        if not len(at):
            return none, none
        own = grams(numbers, self.gram)[at]
        place = np.minimum(np.searchsorted(self.kept, own), len(self.kept) - 1)
        at = at[self.kept[place] == own]
        around = np.unique(at[:, None] - np.arange(self.need - self.gram + 1))
        around = around[(around >= 0) & (around + self.need <= len(numbers))]
        if not len(around):
            return none, none
        hashes = _hash(numbers, around, self.need)
        which = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        met = self.hash[which] == hashes
        around, which = around[met], which[met]
        same = (numbers[around[:, None] + np.arange(self.need)] == words[self.place[which][:, None] + np.arange(self.need)]).all(1)
        return around[same], which[same]


def _hash(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return mix(runs(mix(numbers.astype(np.int64).view(U64)), WORDS[1], at, at + n), n)


class Index:
    """The spans of the items of one part of a benchmark."""

    def __init__(self, items: list[tuple[str | None, bytes]], span: int, gram: int) -> None:
        self.span = span
        self.number: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: k for k, name in enumerate(self.names)}
        found, names = [], []
        for name, text in items:
            words = words_of(text)
            if words:
                found.append(np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64))
                names.append(place.get(name, -1))
        self.number[b"\xff"] = -2
        sizes = np.array([len(w) for w in found], np.int64)
        self.words = np.concatenate(found) if found else np.zeros(0, np.int64)
        starts = np.cumsum(sizes) - sizes
        need = np.minimum(sizes, span)
        # Items shorter than the span need windows of their own length.
        self.kinds = [_Spans(self.words, starts[need == n], sizes[need == n], np.array(names)[need == n], n, gram) for n in np.unique(need).tolist()]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A number for each word: -1 for one that no item has."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def find(self, numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, _Spans]]:
        return [(*kind.find(numbers, self.words), kind) for kind in self.kinds]


def _union(hits: list[tuple[int, int]]) -> list[dict]:
    """Runs of words that overlap or follow each other as one."""
    out: list[dict] = []
    for a, b in sorted(hits):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def _of_one(found: list[tuple[np.ndarray, np.ndarray, _Spans]], base: int = 0) -> tuple[list[tuple[int, int]], set[int]]:
    """Runs and items of one text."""
    hits, items = [], set()
    for at, which, kind in found:
        hits += zip((at + base).tolist(), (at + base + kind.need).tolist())
        for w in np.unique(which).tolist():
            items.update(kind.names[kind.start[w] : kind.start[w + 1]].tolist())
    return hits, items


def _find_long(text: bytes, index: Index) -> tuple[int, list[dict], list[str]]:
    """A text of more than a slice, piece by piece; each piece begins with the last words of the one before."""
    before: list[bytes] = []
    at, base, hits, items = 0, 0, [], set()
    while at < len(text):
        end = at + SLICE_BYTES
        while end < len(text) and _SPLIT[text[end]] != 32:
            end += 1
        words = before + text[at:end].translate(_SPLIT).split()
        more, found = _of_one(index.find(index.numbers(words)), base)
        hits, items = [(r["start"], r["end"]) for r in _union(hits + more)], items | found
        before = words[max(0, len(words) - index.span + 1) :]
        base += len(words) - len(before)
        at = end
    return base + len(before), _union(hits), [index.names[i] for i in sorted(items)]


def _find_all(texts: list[bytes], index: Index) -> Iterator[tuple[int, list[dict], list[str]]]:
    for _, some in slices(texts):
        if len(some[-1]) > SLICE_BYTES:  # a slice ends with such a text
            some, long = some[:-1], some[-1]
        else:
            long = None
        words = _BREAK.join([t.translate(_SPLIT) for t in some] + [b""]).split()
        numbers = index.numbers(words)
        ends = np.flatnonzero(numbers == -2)
        cut = []
        for at, which, kind in index.find(numbers):
            of = np.searchsorted(ends, at, "right")
            bounds = np.searchsorted(of, np.arange(len(ends) + 1))
            cut.append((at, which, kind, bounds))
        begins = np.append(0, ends[:-1] + 1)
        for d, (base, end) in enumerate(zip(begins.tolist(), ends.tolist())):
            hits, items = _of_one([(at[k[d] : k[d + 1]] - base, which[k[d] : k[d + 1]], kind) for at, which, kind, k in cut if k[d + 1] > k[d]])
            yield end - base, _union(hits), [index.names[i] for i in sorted(items)]
        if long is not None:
            yield _find_long(long, index)


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in parts of at most ``PART_WORDS`` words (a longer item is a part by itself)."""
    part, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null").toLocalIterator()
    for name, text in rows:
        n = len(words_of(bytes(text)))
        if part and size + n > PART_WORDS:
            yield part
            part, size = [], 0
        part.append((name, bytes(text)))
        size += n
    yield part


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, prefix: str = "") -> DataFrame:
    """``docs`` with the columns ``n_words``, ``hits`` (runs of words, end exclusive) and ``items``
    (ids as strings, sorted), each name after ``prefix``; a column of ``docs`` of such a name is replaced."""
    spark = docs.sparkSession
    parts = _parts(benchmark, item_col, item_text_col)
    names = [prefix + c for c in ("n_words", "hits", "items")]
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    kept = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    schema = f"{fields}, `{names[0]}` long, `{names[1]}` array<struct<start:long,end:long>>, `{names[2]}` array<string>"
    items, number = next(parts), 0
    while items is not None:
        shared = spark.sparkContext.broadcast(items)
        following = next(parts, None)

        def add(batches, shared=shared, first=number == 0):
            index = Index(shared.value, span, gram)
            for b in batches:
                texts = [x or b"" for x in b[text_col].cast(pa.binary()).to_pylist()]
                found = list(_find_all(texts, index))
                columns = [pa.array([f[c] for f in found], k) for c, k in enumerate(kinds)]
                if not first:
                    old = b.select(names).to_pylist()
                    columns[1] = pa.array([_union([(h["start"], h["end"]) for h in o[names[1]] + f[1]]) for o, f in zip(old, found)], kinds[1])
                    columns[2] = pa.array([sorted({*o[names[2]], *f[2]}) for o, f in zip(old, found)], kinds[2])
                    b = b.select([c for c in b.schema.names if c not in names])
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *names])
            del index
            give_back()

        kept = kept.mapInArrow(add, schema)
        if following is not None:
            kept = materialize(kept, "decontaminate")
            shared.destroy()
        items, number = following, number + 1
    return kept


def n_hit(hits: str = "hits") -> F.Column:
    """How many words the runs cover together; they are sorted first."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(acc["to"], h["start"]))).cast("long").alias("n"), F.greatest(acc["to"], h["end"]).alias("to"))
    return F.aggregate(F.array_sort(hits), start, step)["n"]


def contaminated(hit: str = "n_hit", words: str = "n_words") -> F.Column:
    return (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(words))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of which a twentieth of the words or more are the benchmark's."""
    found = find_benchmark(docs, benchmark, text_col, prefix="__decontaminate_")
    hit = n_hit("__decontaminate_hits")
    return found.where(~((hit > 0) & (20 * hit >= F.col("__decontaminate_n_words")))).select([F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    counted = found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return counted.withColumn("contaminated", contaminated())


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS need, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS span FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
kinds AS (SELECT DISTINCT need FROM bw),
dw AS (SELECT doc_id, i, need, array_to_string(w[i:i + need - 1], ' ') AS span FROM (SELECT doc_id, w, need, unnest(range(1, len(w) - need + 2)) AS i FROM d, kinds WHERE len(w) >= need)),
hits AS (SELECT doc_id, i, need, item_id FROM dw JOIN bw USING (need, span)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + need)) AS p FROM (SELECT DISTINCT doc_id, i, need FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
