"""Word and window hashes over blocks of documents, and compact number lists.

A *block* is a bounded set of documents (about ``BLOCK_BYTES`` of text) that one task holds at
once.  Everything here works on numpy arrays over a whole slice of a block, so no Python code runs
per word or per window.
"""

from __future__ import annotations

import ctypes
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, x in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, x, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


WORDS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


LANES = 32  # longer words are hashed by hashlib


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``: eight bytes at a time are mixed into what came before, so a word
    of eight bytes or fewer has a hash of its own and nothing is a sum that a pattern in a long word could cancel."""
    length = ends - starts
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(wide, 8)

    def lane(k: int, own: np.ndarray) -> np.ndarray:
        at = starts[own] + 8 * k
        left = np.minimum(length[own] - 8 * k, 8).astype(U64)
        return eight[at].view("<u8").reshape(-1) & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left))

    out = mix(lane(0, slice(None)), family) if len(starts) else np.zeros(0, U64)
    out = mix(out ^ length.astype(U64), 17)
    own = np.flatnonzero((length > 8) & (length <= 8 * LANES))
    k = 1
    while len(own):
        out[own] = mix(out[own] ^ lane(k, own), 19 + family)
        k += 1
        own = own[length[own] > 8 * k]
    for w in np.flatnonzero(length > 8 * LANES).tolist():
        out[w] = int.from_bytes(blake2b(data[starts[w] : ends[w]].tobytes(), digest_size=8, salt=bytes([family])).digest(), "little")
    return out


def runs(values: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of ``values[start:end]`` for each pair, the same wherever the run stands."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


class Words:
    """Words (runs of bytes other than space and 9-13) of some texts, with their hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = ~WHITE[data]
        step = np.diff(inside)
        starts, ends = self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        at = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=at[1:])
        self.data = data
        self.hash = word_hashes(data, starts, ends)
        self.first = np.searchsorted(starts, at)  # first word of each text
        self.count = np.diff(np.append(self.first, len(starts)))
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def windows(self, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first word of each window of ``n`` words within one text, and its hash."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        at = at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at
        return at, mix(runs(self._hashes(family), WORDS[family], at, at + n), n)

    def _hashes(self, family: int) -> np.ndarray:
        """Each family hashes the words anew, so words that are alike under one are not under the other."""
        return self.hash if family == 0 else word_hashes(self.data, self.starts, self.ends, family)

    def shorter(self, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Texts of fewer words than ``n``, but not none, and a hash of all their words."""
        docs = np.flatnonzero((self.count > 0) & (self.count < n))
        whole = runs(self._hashes(family), WORDS[family], self.first[docs], self.first[docs] + self.count[docs])
        return docs, mix(whole ^ mix(self.count[docs].astype(U64), 7), n)


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Runs of texts of about ``limit`` bytes: (number of the first, the texts)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def pack(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else values
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def in_blocks(docs: DataFrame, id_col: str, text_col: str, total: int, block_bytes: int = BLOCK_BYTES, tag: Column | None = None) -> DataFrame:
    """``doc_id``, ``text``, the ``block`` of each row, and ``tag`` if given; the number of blocks follows ``total``.

    The block comes from the id, the text and the row's number, if ``tag`` is one, so neither one source nor rows
    without id nor repeated rows share one."""
    key: Column = F.xxhash64(F.col(id_col), F.col(text_col), *([] if tag is None else [tag]))
    n = max(1, -(-total // block_bytes))
    more = [] if tag is None else [tag.alias("tag")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.pmod(key, F.lit(n)).cast("int").alias("block"), *more)
