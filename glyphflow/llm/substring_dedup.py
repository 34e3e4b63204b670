"""Removal of passages that an earlier document has: a count-min prefilter, then an exact grouping.

1. Every block of documents counts its windows of ``n`` words into a routed count-min sketch
   (:mod:`glyphflow.llm.routed_sketch`), which over-estimates and so loses no repeated window.
2. Only windows estimated to be in two documents or more are sent, once per block with the
   smallest document id there, to the shard of their 128-bit hash (two families that hash the words
   themselves anew).  The shard finds the smallest id
   of all and answers one bit per window: whether a smaller id than the block's own exists.
3. The block marks the words that such windows cover.

All three steps read the same shuffled blocks.  A window that a third of all documents share is
one entry for each block, not one for each document, and no step sees more than a block or a shard.

Defined results.  A null or empty text has no words.  A text of fewer than ``n`` words has no
window and keeps all its words.  Rows with the same id never remove each other's words.  A row
without id neither removes words nor loses any.  Other columns of the input are ignored, so their
names cannot clash.  An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import routed_sketch as sketch
from glyphflow.llm.blocks import U64, Words, in_blocks, pack, pack_sorted, slices, text_bytes, unpack, unpack_sorted

WINDOW = 13
SHARD_WINDOWS = 1 << 20
_NOTE = "block int, shard int, hash1 binary, hash2 binary, least binary"


class _Windows:
    """The distinct windows of a block in order of their hashes, and where they are; by the first hash alone
    if that will do (for counts that may be too high)."""

    def __init__(self, t: pa.Table, n: int, both: bool = True) -> None:
        self.texts = [x or b"" for x in t["text"].cast(pa.binary()).to_pylist()]
        ids = t["doc_id"].to_pylist()
        self.known = np.array([x is not None for x in ids], bool)
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        parts, words = [], 0
        self.words = np.zeros(len(self.texts), np.int64)
        for start, some in slices(self.texts):
            w = Words(some)
            at, h1 = w.windows(n)
            h2 = w.windows(n, 1)[1] if both else h1
            doc = w.doc[at] + start
            self.words[start : start + len(some)] = w.count
            keep = self.known[doc]
            parts.append(((at + words)[keep], h1[keep], h2[keep], doc[keep].astype(np.int32)))
            words += len(w.hash)
        at, h1, h2, doc = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int32))
        order = np.argsort(h1, kind="stable")
        a, b = h1[order], h2[order]
        if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
        self.at, self.doc = at[order], doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first = np.flatnonzero(new)
        self.number = np.cumsum(new) - 1
        self.h1, self.h2 = a[self.first], b[self.first]
        id_of = self.ids[self.doc]
        # Documents with one id count as one.
        id_change = new | (np.append(True, id_of[1:] != id_of[:-1]) if len(a) else new)
        self.docs = np.add.reduceat(id_change.astype(np.int64), self.first) if len(a) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(id_of, self.first) if len(a) else np.zeros(0, np.int64)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (the kept words joined by one space)."""
    total = text_bytes(docs, text_col)
    base = in_blocks(docs, id_col, text_col, total)
    shape = sketch.Shape.of(total // 6)
    bits = max(0, (total // 6 // SHARD_WINDOWS).bit_length())

    def send(t: pa.Table) -> pa.Table:
        w = _Windows(t, window, both=False)
        return sketch.sent_table(sketch.cell_rows(t["block"][0].as_py(), w.h1, w.docs, shape))

    def shards(h1: np.ndarray) -> list[tuple[int, int, int]]:
        number = (h1 >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)
        cut = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(h1))
        return [(int(number[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:])]

    def note(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(t):
            w = _Windows(t, window)
            often = sketch.estimates(w.h1, w.docs, shape, dict(zip(answers["key"].to_pylist(), answers["totals"].to_pylist()))) >= 2
            block = key[0].as_py()
            h1, h2, least = w.h1[often], w.h2[often], w.least[often]
            rows = [(block, s, pack_sorted(h1[a:b]), pack(h2[a:b]), pack(least[a:b])) for s, a, b in shards(h1)]
            rows.append((block, -1 - block, pack(np.packbits(often)), b"", b""))
        return sketch.table(rows, ["block", "shard", "hash1", "hash2", "least"], [pa.int32(), pa.int32(), *[pa.binary()] * 3])

    def settle(t: pa.Table) -> pa.Table:
        out = []
        if t["shard"][0].as_py() < 0:  # a block's own note of which windows it sent
            out = t["hash1"].to_pylist()
        else:
            h1 = [unpack_sorted(x, U64) for x in t["hash1"].to_pylist()]
            sizes = [len(x) for x in h1]
            a = np.concatenate(h1)
            b = np.concatenate([unpack(x, U64) for x in t["hash2"].to_pylist()])
            least = np.concatenate([unpack(x, np.int64) for x in t["least"].to_pylist()])
            order = np.argsort(a, kind="stable")
            if np.any((np.diff(a[order]) == 0) & (np.diff(b[order]) != 0)):
                order = np.lexsort((b, a))
            first = np.flatnonzero(np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
            least_of_all = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(a))))
            smaller = np.empty(len(a), bool)
            smaller[order] = least_of_all < least[order]
            out = [pack(np.packbits(x)) for x in np.split(smaller, np.cumsum(sizes)[:-1])]
        return pa.table([t["block"], t["shard"], pa.array(out, pa.binary())], names=["block", "shard", "bits"])

    def cut(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Windows(t, window) if len(t) else None
        n_removed, kept = [], []
        if w:
            got = dict(zip(answers["shard"].to_pylist(), answers["bits"].to_pylist()))
            often = np.unpackbits(unpack(got[-1 - key[0].as_py()], np.uint8), count=len(w.h1)).astype(bool) if len(w.h1) else np.zeros(0, bool)
            smaller = np.zeros(len(w.h1), bool)
            where = np.flatnonzero(often)
            for s, a, b in shards(w.h1[often]):
                smaller[where[a:b]] = np.unpackbits(unpack(got[s], np.uint8), count=b - a)
            hit = often[w.number] & (smaller[w.number] | (w.ids[w.doc] > w.least[w.number]))
            cover = np.zeros(int(w.words.sum()) + window + 1, np.int32)
            np.add.at(cover, w.at[hit], 1)
            np.add.at(cover, w.at[hit] + window, -1)
            keep = np.cumsum(cover)[: int(w.words.sum())] == 0
            at = 0
            for text, n in zip(w.texts, w.words.tolist()):
                own = keep[at : at + n]
                at += n
                left = int(own.sum())
                n_removed.append(n - left)
                kept.append(b" ".join(text.split() if left == n else compress(text.split(), own.tolist())))
        return pa.table([t["doc_id"], pa.array(w.words if w else [], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    groups = lambda: base.groupBy("block")
    answers = sketch.merged(groups().applyInArrow(send, sketch.SENT), shape)
    notes = groups().cogroup(answers.groupBy("block")).applyInArrow(note, _NOTE)
    settled = notes.groupBy("shard").applyInArrow(settle, "block int, shard int, bits binary")
    return groups().cogroup(settled.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS span FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY span) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
