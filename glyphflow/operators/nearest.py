"""The nearest entries of a word list for words that have few entries near by.

The entries are dealt into blocks and the words into groups; each block meets each group once, so a task holds one block.
In a block, a bound that costs a few operations comes before any distance: with the letters of a word counted in
``BINS`` bins (up to two of each), one edit changes at most one letter on either side, so the larger of the two
one-sided differences is never above the distance.  For each word the threshold rises, from the first that ``FIRST`` entries are within:
entries whose bound is the threshold get their exact distance, all of them at once, and the word is done when ``top`` entries are certain, that
is, when no entry with a larger bound can come before them.  Distances are kept in machine words as small as the word that is looked for
allows, and words of one length share the array operations of their first threshold.  What leaves a block is ``top`` rows a word; a window merges the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 262144
BINS = 32
WORD_BITS = 63
_HITS = "word string, candidate string, copies long, distance int, alike boolean"


def _letters(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)


def marks(codes: np.ndarray) -> np.ndarray:
    """For each row of letters (-1: none) a bit for the first and one for the second letter of each bin."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        bit = np.where(codes[:, k] >= 0, np.uint64(1) << (codes[:, k] % BINS).astype(np.uint64), np.uint64(0))
        out |= np.where(out & bit, bit << np.uint64(BINS), bit)
    return out


def _rows(word: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Distances by the rows of the table, for words of any length."""
    m = codes.shape[1]
    older, last = None, [np.full(len(codes), j) for j in range(m + 1)]
    for i in range(len(word)):
        row = [np.full(len(codes), i + 1)]
        for j in range(1, m + 1):
            cell = np.minimum(np.minimum(row[j - 1], last[j]) + 1, last[j - 1] + (codes[:, j - 1] != word[i]))
            if i and j > 1:
                swap = (codes[:, j - 2] == word[i]) & (codes[:, j - 1] == word[i - 1])
                cell = np.where(swap, np.minimum(cell, older[j - 2] + 1), cell)
            row.append(cell)
        older, last = last, row
    return np.array(last)[lengths, np.arange(len(codes))]


def distances(word: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distances with swaps of neighbours from one word to many, which are the rows of ``codes``, longest first.

    The columns of all tables are kept as bits of their differences (Hyyro 2003), a machine word for each row."""
    n = len(word)
    if n > WORD_BITS:
        return _rows(word, codes, lengths)
    if n == 0:
        return lengths.astype(np.int64)
    one, last = np.uint64(1), np.uint64(n - 1)
    letters, where = np.unique(word, return_inverse=True)
    held = np.zeros(len(letters) + 1, np.uint64)
    for k, at in enumerate(where.tolist()):
        held[at] |= one << np.uint64(k)
    places = np.searchsorted(letters, codes)
    places[places == len(letters)] = 0
    matches = np.where(letters[places] == codes, held[places], np.uint64(0))
    size = len(codes)
    up, down, zero, before = np.full(size, ~np.uint64(0)), np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    out = np.full(size, n, np.int64)
    for j in range(codes.shape[1]):
        live = int(np.searchsorted(-lengths, -j, side="left"))  # rows longer than j
        if not live:
            break
        m, vp, vn = matches[:live, j], up[:live], down[:live]
        swap = ((~zero[:live] & m) << one) & before[:live]
        d = ((((m & vp) + vp) ^ vp) | m | vn) | swap
        hp, hn = vn | ~(d | vp), d & vp
        out[:live] += ((hp >> last) & one).astype(np.int64) - ((hn >> last) & one).astype(np.int64)
        hp, hn = (hp << one) | one, hn << one
        up[:live], down[:live], zero[:live], before[:live] = hn | ~(d | hp), hp & d, d, m
    return out


#: So many letters of long words are numbers at once.
LETTERS = 1 << 20
#: Words of one length that are looked for together, and the fewest entries that the first threshold takes.
TOGETHER, FIRST = 32, 1024


def _kind(n: int) -> type:
    """The smallest machine word with a bit for each letter."""
    return np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64


def _distances_to(n: int, matches, lengths: np.ndarray) -> np.ndarray:
    """``distances`` of rows in any order: ``matches(j)`` has for each row the bits of the letters of its own word, of ``n`` letters, that
    are the row's letter ``j``.  Rows may ask for different words of that length."""
    kind, size = _kind(n), len(lengths)
    one, last = kind(1), kind(n - 1)
    up, down, zero, before = np.full(size, ~kind(0)), np.zeros(size, kind), np.zeros(size, kind), np.zeros(size, kind)
    score, out = np.full(size, n, np.int16), np.full(size, n, np.int16)
    for j in range(int(lengths.max(initial=0))):
        m = matches(j)
        d = m & up
        d += up
        d ^= up
        d |= m
        d |= down
        np.bitwise_not(zero, out=zero)
        zero &= m
        zero <<= one
        zero &= before
        d |= zero
        hn = d & up
        up |= d
        hp = ~up
        hp |= down
        score += ((hp >> last) & one).view(np.int16) if kind is np.uint16 else ((hp >> last) & one).astype(np.int16)
        score -= ((hn >> last) & one).view(np.int16) if kind is np.uint16 else ((hn >> last) & one).astype(np.int16)
        hp <<= one
        hp |= one
        hn <<= one
        up, down = d | hp, hp
        np.bitwise_not(up, out=up)
        up |= hn
        down &= d
        zero, before = d, m
        np.copyto(out, score, where=lengths == j + 1)
    return out


class Block:
    """Some entries, longest first, so that those of about one length stand together; their letters are numbered."""

    def __init__(self, words: list[str], tags: list[str], copies: list[int], band: int) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        lengths = np.array([len(words[k]) for k in order], np.int64)
        self.places = np.argsort(-lengths, kind="stable")  # of a row among the entries in order
        self.words, self.tags, self.copies, self.band = [words[k] for k in order], [tags[k] for k in order], [copies[k] for k in order], band
        self.numbers = {t: k for k, t in enumerate(dict.fromkeys(self.tags))}
        self.tag_of = np.array([self.numbers[t] for t in self.tags], np.int32)[self.places]
        self.lengths = lengths[self.places]
        rows = [self.words[k] for k in self.places.tolist()]
        # Words of more bits than a machine word has are met row by row; their letters are not kept as numbers.
        self.wide = int(np.searchsorted(-self.lengths, -(WORD_BITS + band), side="left"))
        found, at = [], 0
        while at < self.wide:
            step = max(1, LETTERS // int(self.lengths[at]))
            found.append(marks(self._raw(rows[at : min(at + step, self.wide)])))
            at += step
        raw = self._raw(rows[self.wide :])
        self.marks = np.concatenate((*found, marks(raw)))
        self.ones = np.bitwise_count(self.marks)
        letters, numbered = np.unique(raw[raw >= 0], return_inverse=True)
        self.letters = {int(c): k + 1 for k, c in enumerate(letters.tolist())}
        raw[raw >= 0] = numbered + 1
        raw[raw < 0] = 0
        self.codes = np.ascontiguousarray(raw.T.astype(np.uint32 if len(letters) > 65534 else np.uint16))

    @staticmethod
    def _raw(words: list[str]) -> np.ndarray:
        """Letters of words, a row each (-1: none)."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.full((len(words), int(lengths.max(initial=0))), -1, np.int64)
        raw[np.arange(raw.shape[1]) < lengths[:, None]] = _letters("".join(words))
        return raw

    def _search(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Distances of words of one length, each given with its rows."""
        n = len(asked[0][0])
        if n == 0:
            return [self.lengths[r] for _, r in asked]
        if n > WORD_BITS:
            return [_rows(w, self._raw([self.words[k] for k in self.places[r].tolist()]), self.lengths[r]) for w, r in asked]
        rows = np.concatenate([r for _, r in asked]) - self.wide
        held = np.zeros((len(asked), len(self.letters) + 1), _kind(n))
        for k, (w, _) in enumerate(asked):
            for at, c in enumerate(w.tolist()):
                if c in self.letters:
                    held[k, self.letters[c]] |= _kind(n)(1 << at)
        flat, width = held.ravel(), held.shape[1]
        ends = np.cumsum([len(r) for _, r in asked])
        if len(asked) == 1:
            matches = lambda j: flat[self.codes[j].take(rows)]
        else:
            base = np.repeat(np.arange(len(asked), dtype=np.int32) * width, [len(r) for _, r in asked])
            matches = lambda j: flat[self.codes[j].take(rows) + base]
        return np.split(_distances_to(n, matches, self.lengths[rows + self.wide].astype(np.int16)), ends[:-1])

    def top(self, word: str, tag: str, top: int) -> list[tuple[float, str, int, int, bool]]:
        """The best entries as score, entry, copies, distance, equal tags, in order."""
        return self.tops([word], [tag], top)[0]

    def tops(self, words: list[str], tags: list[str], top: int) -> list[list[tuple[float, str, int, int, bool]]]:
        """``top`` of words of one length.  They share the first threshold's distances; each goes on by itself."""
        n = len(words[0])
        lo, hi = np.searchsorted(-self.lengths, (-n - self.band, -n + self.band + 1)).tolist()
        if lo == hi:
            return [[] for _ in words]
        own, size = slice(lo, hi), len(self.words)
        near_marks, ones, places, tag_of = self.marks[own], self.ones[own], self.places[own], self.tag_of[own]
        asked, first = [], []
        every = _letters("".join(words)).reshape(len(words), n)
        for letters, mark in zip(every, marks(every)):
            bounds = np.maximum(ones, np.bitwise_count(mark)) - np.bitwise_count(near_marks & mark)
            t = 0
            while t < 2 * BINS and np.count_nonzero(bounds <= t) < min(FIRST, hi - lo):
                t += 1
            asked.append((letters, bounds))
            first.append((t, np.flatnonzero(bounds <= t)))
        shared = self._search([(w, r + lo) for (w, _), (_, r) in zip(asked, first)])
        out = []
        for (w, bounds), (t, rows), found, tag in zip(asked, first, shared, tags):
            mine, best, most = self.numbers.get(tag, -1), np.zeros(0, np.int64), int(bounds.max())
            while True:
                if len(rows):
                    # Score, then place in order; each entry has a copy at least.
                    keys = (2 * found.astype(np.int64) - (tag_of[rows] == mine)) * size + places[rows]
                    if len(keys) > top:
                        keys = np.partition(keys, top - 1)[:top]
                    best = self._enough(np.sort(np.concatenate((best, keys))), top)
                if t >= most or (sum(self.copies[k % size] for k in best.tolist()) >= top and best[-1] // size <= 2 * t):
                    break
                t += 1
                rows = np.flatnonzero(bounds == t)
                if len(rows):
                    (found,) = self._search([(w, rows + lo)])
            out.append([])
            for key in best.tolist():
                double, k = divmod(key, size)
                alike = self.tags[k] == tag
                out[-1].append((double / 2, self.words[k], self.copies[k], (double + alike) // 2, alike))
        return out

    def within(self, words: list[str], most: int) -> list[np.ndarray]:
        """For words of one length, the rows and distances of all entries within ``most`` edits, at most the block's band."""
        n = len(words[0])
        lo, hi = np.searchsorted(-self.lengths, (-n - most, -n + most + 1)).tolist()
        every = _letters("".join(words)).reshape(len(words), n)
        near_marks, ones = self.marks[lo:hi], self.ones[lo:hi]
        rows = [lo + np.flatnonzero(np.maximum(ones, np.bitwise_count(mark)) - np.bitwise_count(near_marks & mark) <= most) for mark in marks(every)]
        found = self._search(list(zip(every, rows)))
        return [np.stack((r[d <= most], d[d <= most])) for r, d in zip(rows, found)]

    def _enough(self, keys: np.ndarray, top: int) -> np.ndarray:
        """The first keys whose entries have ``top`` copies."""
        n = 0
        for at, k in enumerate(keys.tolist()):
            n += self.copies[k % len(self.words)]
            if n >= top:
                return keys[: at + 1]
        return keys


def nearest(words: DataFrame, entries: DataFrame, top: int = 3, band: int = 2, block: int = BLOCK) -> DataFrame:
    """``word, candidate, copies, distance, alike``: for each row of ``words`` (``word, tag``) the best of ``entries``
    (``candidate, tag, copies``) whose length differs by at most ``band``, by distance less a half for an equal tag, then by the entry,
    until there are ``top`` copies.  Words and entries are distinct."""
    # Every group takes the whole block along, so there are no more cells than keep all cores at work.
    cells = 3 * words.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-entries.count() // block))
    groups = max(1, -(-cells // blocks))
    none = F.lit(None)
    kept = entries.select(F.pmod(F.xxhash64("candidate"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("asks"), F.col("candidate").alias("word"), "tag", F.col("copies").cast("long").alias("copies"))
    asked = words.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("word"), F.lit(groups)).cast("int").alias("group"), F.length("word").alias("asks"), "word", "tag", none.cast("long").alias("copies"))
    # Words without letters are not asked for: 0 marks the entries.
    rows = kept.unionByName(asked.where("asks > 0")).repartitionById(blocks * groups, F.col("block") * groups + F.col("group")).sortWithinPartitions("block", "group", "asks")

    def answers(own, together):
        words, tags = zip(*together)
        found = own.tops(words, tags, top)
        together.clear()
        return [(word, c, n, d, alike) for word, best in zip(words, found) for _, c, n, d, alike in best]

    def search(batches):
        cell, own, parts, together = None, None, ([], [], []), []
        for b in batches:
            hits = []
            for blk, grp, asks, word, tag, copies in zip(*(b[c].to_pylist() for c in ("block", "group", "asks", "word", "tag", "copies"))):
                if together and ((blk, grp) != cell or len(together[0][0]) != asks or len(together) == TOGETHER):
                    hits += answers(own, together)
                if (blk, grp) != cell:
                    cell, own, parts = (blk, grp), None, ([], [], [])
                if not asks:
                    for part, x in zip(parts, (word, tag, copies)):
                        part.append(x)
                    continue
                own = own or Block(*parts, band)
                together.append((word, tag))
            if together:
                hits += answers(own, together)
            yield pa.record_batch([pa.array([h[k] for h in hits], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()))], names=["word", "candidate", "copies", "distance", "alike"])

    hits = rows.mapInArrow(search, _HITS)
    order = Window.partitionBy("word").orderBy(F.col("distance") - F.when(F.col("alike"), 0.5).otherwise(0.0), "candidate")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hits.withColumn("before", before).where(F.col("before") < top).drop("before")


def within(words: DataFrame, asked: list[str], most: int, word: str = "word", other: str = "candidate") -> DataFrame:
    """``word, other, distance`` of the pairs within ``most`` edits of all ``words`` and few others, which go to every task: each batch of
    words is a block that the others are looked for in."""
    by_length: dict[int, list[str]] = {}
    for w in sorted(set(asked)):
        by_length.setdefault(len(w), []).append(w)
    parts = [own[k : k + TOGETHER] for own in by_length.values() for k in range(0, len(own), TOGETHER)]

    def search(batches):
        for b in batches:
            texts = b[word].to_pylist()
            block = Block(texts, [""] * len(texts), [1] * len(texts), most)
            columns = ([], [], [])
            for part in parts:
                for w, (rows, found) in zip(part, block.within(part, most)):
                    columns[0].extend(block.words[k] for k in block.places[rows].tolist())
                    columns[1].extend([w] * len(rows))
                    columns[2].extend(found.tolist())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int32()))], names=[word, other, "distance"])

    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = words.select(word).where(F.col(word).isNotNull()).repartition(tasks, word).distinct()
    return own.mapInArrow(search, f"{word} string, {other} string, distance int")
