"""Packing of documents into training sequences by lexical retrieval.

1. Every text becomes token ids, followed by an end id; the ids are written to the shared folder.  Texts are encoded by blocks: each distinct
   field of a block once, and words that a task has met before not again.
2. One pass counts in how many documents each id occurs: a table as long as the vocabulary.
3. Documents are routed by what they say: a document's weights (those of BM25) are projected on ``SKETCH``
   coordinates by sparse random signs, a tree of planes, fitted to a sample of about ``FIT_DOCS`` documents, gives each sketch
   its leaf, and the documents are spread over the tasks by ranges of leaves.  Inside a leaf they are
   ordered by the side of the leaf's middle on which each direction of the sketch lies, so that leaves of any size can be cut.
4. Each task deals its range into shards of at most ``SHARD_TOKENS`` ids and builds an inverted
   BM25 index of each shard, with the counts of the whole corpus.  The first document of a sequence
   is its seed.  The unused documents that score highest for all of the seed's ids follow it until the
   sequence is full; the one that does not fit is cut, and its rest begins
   the next sequence.  What a shard has left for its last sequence is cut at powers of two, so
   nothing is padded.

The ids are shuffled once, by ranges of about as many ids each, bounded by a sample of rows (``SAMPLED`` for each range, drawn by hash); the last key of
the order is the id of the document, so a group of copies of any size is cut like other documents.  Spark's own range bounds would
make all sketches twice.  Where equal rows are so many that the sample has to be cut off,
two evaluations may bound the ranges at other places: write the pieces before they are read twice.

A seed meets the documents of its own shard: the index is sharded, and a shard is what fits a task.  Routing brings
copies and documents of like words into one shard.  It finds neighbours that are set apart by their
words, not those that are nearest by chance; the README has the share found of the whole corpus's best neighbours.

Defined results.  A null text is an empty one: its document is the end id alone.  Rows without id and
repeated rows are packed like others.  Ties of the score go to the document that comes first in
the shard.  Other columns are ignored.  An empty table gives no pieces.  Texts that hold a special
token's own string get that token's id, as the tokenizer has it.  A text of more ids than a shard is a shard alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.blocks import give_back
from glyphflow.llm.storage import materialize

LENGTH = 2048
END_ID = 1
#: The most of a shard; a task aims at half of it.
SHARD_TOKENS = 4 << 20
#: The planes are fitted to about so many documents, whatever the size of the corpus.
FIT_DOCS = 16384
SKETCH = 256
SPREAD = 4
LEAF = 32
NEIGHBOURS = 64
#: Ids of more than one in so many documents of a shard; their rows take at most so many times the room of their postings.
FULL = 4
#: Shards of up to so many documents have the scores of all pairs worked out at once; rows are worth so many times more room there.
SQUARE, FULL_SQUARE = 3072, 4
#: Weights are multiples of one in so many.
STEPS = 2.0**30
#: So many documents of each range are sampled for the ranges' bounds.
SAMPLED = 128
K1, B = 1.2, 0.75
#: The pattern that ``FIELDS`` fits, and its white space (Unicode's; Python's ``\\s`` has four control characters more).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = r"!-&(-/:-@\[-`{-~"
#: Latin letters before a mark or white space; ASCII marks but the apostrophe before a letter or white space; what else there is up to white
#: space; each with the one blank before it; white space up to that blank.  The pattern cuts at each end of these, and cuts one the
#: same wherever it stands: none of its parts goes on from letters to marks or back, or has white space after other characters.
FIELDS = re.compile(f" ?[{LATIN}]++(?=[{SPACE}{MARKS}']|\\Z)| ?[{MARKS}]++(?=[{SPACE}{LATIN}]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: So many fields of so many characters at most are kept by a task with their ids.
SEEN, SEEN_LENGTH = 1 << 19, 32
#: Texts of about so many bytes are encoded at once, with the ids of so many fields of so many bytes at most that were met before.
BLOCK_BYTES = 8 << 20
KNOWN, KNOWN_LENGTH = 1 << 19, 32
#: So many bytes are cut at once: they stay in the processor's cache.
CUT_BYTES = 1 << 18
#: Kinds of bytes: those that are no white space, nor may begin any; ASCII letters; ASCII marks but the apostrophe; ASCII white space.
SOLID, LETTER, MARK, WHITE = 1, 2, 4, 8


def _kinds_of_bytes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = kinds[0x80:] = SOLID
    kinds[[0xC2, 0xE1, 0xE2, 0xE3]] = 0
    kinds[[b for b in range(128) if chr(b).isalpha()]] |= LETTER
    kinds[[b for b in range(128) if re.match(f"[{MARKS}]", chr(b))]] |= MARK
    kinds[[9, 10, 11, 12, 13, 32]] = WHITE
    return kinds


KINDS = _kinds_of_bytes().tobytes()


def kinds_of(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(KINDS), np.uint8)


def letters(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a letter of ASCII, or of two bytes up to U+023F, begins at each byte of UTF-8, and whether it ends there."""
    letter = (kinds & LETTER) != 0
    lead = (data >= 0xC3) & (data <= 0xC8)
    lead[:-1] &= (data[:-1] != 0xC3) | ((data[1:] != 0x97) & (data[1:] != 0xB7))  # but the signs of multiplication and division
    begun = letter | lead
    letter[1:] |= lead[:-1]
    return begun, letter


def runs(ends: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, end, where it begins, where it ends) of runs of things that end at ``ends``, of at most ``size`` or one thing each."""
    n = begin = 0
    while n < len(ends):
        m = max(n + 1, int(np.searchsorted(ends, begin + size, "right")))
        yield n, m, begin, int(ends[m - 1])
        n, begin = m, int(ends[m - 1])


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where fields of UTF-8 texts begin; the texts lie one after the other, none is empty, and end at ``ends``.

    A field has the ids it has in its text.  Cuts are before a blank that other than white space follows, between letters and marks, before
    white space that letters or marks precede, and after such of one character that is no blank.  What is not known from single bytes, or two of
    Latin letters beyond ASCII, is not cut."""
    kinds = kinds_of(data)
    solid, mark, white = ((kinds & k) != 0 for k in (SOLID, MARK, WHITE))
    begun, ended = letters(data, kinds)
    known = ended | (solid & (data < 0x80))  # as the last byte of a character that is no white space
    cut = np.zeros(len(data), bool)
    before_solid = np.zeros(len(data), bool)
    before_solid[:-1] = (data[:-1] == 32) & solid[1:]
    before_solid[ends - 1] = False
    cut[1:] = before_solid[1:] | (ended[:-1] & mark[1:]) | (mark[:-1] & begun[1:]) | (known[:-1] & white[1:])
    cut[2:] |= known[:-2] & (white[1:-1] & (data[1:-1] != 32)) & solid[2:]
    cut[0] = True
    cut[ends[:-1]] = True
    return np.flatnonzero(cut)


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """``values`` cut at ``offsets``, as binaries."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all of a column's binaries, one after the other, and where each begins and the last ends."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def distinct(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each document, ascending, how often each is, and where each document's begin and the last's end."""
    bits = 8 * ids.itemsize
    n = len(offsets) - 1
    wide = np.uint32 if n << bits <= 1 << 32 else np.uint64
    keys = np.repeat(np.arange(n, dtype=wide) << wide(bits), np.diff(offsets)) | ids
    keys.sort()
    first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    found = keys[first]
    return found.astype(ids.dtype), np.diff(np.append(first, len(keys))).astype(np.uint32), np.searchsorted(found >> wide(bits), np.arange(n + 1))
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Seen(dict):
    """The ids of a field as bytes, worked out when it is met first."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, field: str) -> bytes:
        own = array("I", self.encode(field)).tobytes()
        if len(field) <= SEEN_LENGTH and len(self) < SEEN:
            self[field] = own
        return own


class Encoder:
    """Ids of a byte-level BPE vocabulary file of ``tokenizers``.

    A vocabulary whose merges are in the order of the ids, with no other normaliser and the usual
    pattern, is run by ``tiktoken``, which gives the same ids several times as fast, once for each field that a block of texts has; all other
    vocabularies, and texts that hold a special token, are run by ``tokenizers`` itself."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast, self.lines = self._ranked(spec, PATTERN), self._ranked(spec, r"[^\n]+|\n")
        self.seen = Seen(self.fast.encode_ordinary) if self.fast else None
        self.known, self.known_ids, self.known_lengths = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    @staticmethod
    def _ranked(spec: dict, pattern: str):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or model.get("dropout") or model.get("ignore_merges"):
            return None
        import tiktoken

        # The printable stand-in of each byte: bytes that print stand for themselves, the others follow from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stands = {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in prints)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(stands[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [model["vocab"][a + b] for a, b in merges] != list(range(256, 256 + len(merges))) or len(ranks) != 256 + len(merges):
            return None
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.seen.__getitem__, FIELDS.findall(text))), np.uint32)

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings, one text after the other, and where each text's begin and the last's end."""
        data, offsets = numbers(texts, np.uint8)
        if self.fast is None or any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            own = [self.ids(t or "") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *own]), np.cumsum([0, *map(len, own)])
        if not len(data):
            return np.zeros(0, np.uint32), offsets
        ends = offsets[np.append(False, np.diff(offsets) > 0)]
        at = np.concatenate([a + cuts(data[a:b], ends[n:m] - a) for n, m, a, b in runs(ends, CUT_BYTES)])
        fields = binaries(data, np.append(at, len(data))).dictionary_encode()
        place = pc.fill_null(pc.index_in(fields.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = fields.dictionary.filter(pa.array(place < 0))
        own, lengths = self._fields(new)
        place[place < 0] = len(self.known) + np.arange(len(new))
        values, lengths = np.concatenate([self.known_ids, own]), np.concatenate([self.known_lengths, lengths])
        which = place[fields.indices.to_numpy()]
        length = lengths[which]
        end = np.cumsum(length)
        ids = values[np.repeat((np.cumsum(lengths) - lengths)[which] - end + length, length) + np.arange(end[-1])]
        self._keep(new, own, lengths[len(self.known) :])
        return ids, np.append(0, end)[np.searchsorted(at, offsets)]

    def _keep(self, fields: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        short = np.diff(numbers(fields, np.uint8)[1]) <= KNOWN_LENGTH
        short &= np.cumsum(short) <= KNOWN - len(self.known)
        self.known = pa.concat_arrays([self.known, fields.filter(pa.array(short))])
        self.known_ids = np.concatenate([self.known_ids, ids[np.repeat(short, lengths)]])
        self.known_lengths = np.concatenate([self.known_lengths, lengths[short]])

    def _fields(self, fields: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct fields, one field after the other, and how many each has.  Words are encoded as lines of one text."""
        if not len(fields):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, offsets = numbers(fields, np.uint8)
        begun, ended = letters(data, kinds_of(data))
        word = begun | ended
        word[offsets[:-1]] |= (data[offsets[:-1]] == 32) & (np.diff(offsets) > 1)
        plain = np.logical_and.reduceat(word, offsets[:-1])
        count = int(plain.sum())
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), fields.filter(pa.array(plain))), b"\n")[0].as_py()
        ids = np.array(self.lines.encode_ordinary(text.decode()), np.uint32)
        gaps = np.flatnonzero(ids == self.lines.encode_single_token(b"\n"))
        if len(gaps) != max(0, count - 1):
            raise AssertionError("a line's end is not an id of its own")
        others = [self.ids(f.decode()) for f in fields.filter(pa.array(~plain)).to_pylist()]
        lengths = np.zeros(len(fields), np.int64)
        if count:
            lengths[plain] = np.diff(np.concatenate([[-1], gaps, [len(ids)]])) - 1
        lengths[~plain] = [len(o) for o in others]
        out, of_plain = np.empty(lengths.sum(), np.uint32), np.repeat(plain, lengths)
        out[of_plain] = np.delete(ids, gaps)
        out[~of_plain] = np.concatenate([np.zeros(0, np.uint32), *others])
        return out, lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_size(path: str) -> int:
    """Without the tokenizer, which the driver has no other use for."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return len(spec["model"]["vocab"].keys() | {t["content"] for t in spec.get("added_tokens", [])})


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def tokenize(docs: DataFrame, path: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (the end id last), and the distinct ``terms`` before it with how often (``tfs``), as binaries."""
    kind = _kind(size)

    def encode(batches):
        own = encoder(path)
        for b in batches:
            texts = b["text"].fill_null("")
            for start, end, _, _ in runs(numbers(texts, np.uint8)[1][1:], BLOCK_BYTES):
                ids, offsets = own.block(texts.slice(start, end - start))
                ids = ids.astype(kind)
                terms, tfs, bags = distinct(ids, offsets)
                whole = np.insert(ids, offsets[1:], END_ID)
                columns = [b["doc_id"].slice(start, end - start), binaries(whole, offsets + np.arange(len(offsets))), binaries(terms, bags), binaries(tfs, bags)]
                yield pa.record_batch(columns, names=["doc_id", "ids", "terms", "tfs"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids binary, terms binary, tfs binary")


def document_counts(ids: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """In how many documents each id is; how many documents and ids there are."""
    kind = _kind(size)

    def count(batches):
        found, n, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            found += np.bincount(numbers(b["terms"], kind)[0], minlength=size)
            n += len(b)
            total += sum(b["size"].to_pylist()) // kind().itemsize
        used = np.flatnonzero(found)
        yield pa.record_batch([pa.array(np.append(used, [-1, -2]), pa.int64()), pa.array(np.append(found[used], [n, total]), pa.int64())], names=["id", "n"])

    rows = ids.select("terms", F.octet_length("ids").alias("size")).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row for each id of the vocabulary
    out = np.zeros(size + 2, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out[:size], int(out[-1]), int(out[-2])


@lru_cache(maxsize=2)
def _directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id ``SPREAD`` coordinates and signs."""
    rng = np.random.default_rng(size)
    return rng.integers(0, SKETCH, (size, SPREAD)), rng.choice(np.array([-1.0, 1.0]), (size, SPREAD))


def sketches(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """The weights of each document's distinct ids, projected by sparse signs, as vectors of length one (none: zeros)."""
    terms, tfs = (np.concatenate([np.zeros(0, np.uint32), *(b[c] for b in bags)]) for c in (0, 1))
    return _sketches(terms, tfs, np.cumsum([0, *(len(t) for t, _ in bags)]), idf)


def _sketches(terms: np.ndarray, tfs: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at) - 1, SKETCH), np.float32)
    coordinates, signs = _directions(len(idf))
    for n, m, a, b in runs(at[1:], 1 << 16):
        own, often = terms[a:b].astype(np.intp), tfs[a:b].astype(np.float64)
        weights = idf[own] * often * (K1 + 1) / (often + K1)
        row = np.repeat(np.arange(m - n) * SKETCH, np.diff(at[n : m + 1]))
        out[n:m] = np.bincount((coordinates[own] + row[:, None]).ravel(), (signs[own] * weights[:, None]).ravel(), (m - n) * SKETCH).reshape(m - n, SKETCH)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


class Planes:
    """A binary tree of planes that part sketches; ``key`` gives leaves in their order from left to right."""

    def __init__(self, sample: np.ndarray) -> None:
        self.normal, self.offset, self.below = [], [], []
        self.middle: list[np.ndarray] = []
        self._grow(sample, np.arange(len(sample)))
        self.normal = np.array(self.normal, np.float32).reshape(-1, SKETCH)
        self.offset = np.array(self.offset, np.float32)
        self.below = np.array(self.below, np.int32).reshape(-1, 2)
        self.middle = np.array(self.middle, np.float32).reshape(-1, SKETCH)

    def _grow(self, x: np.ndarray, own: np.ndarray) -> int:
        """The number of the node; leaf n is ``-1 - n``."""
        part = self._parted(x[own]) if len(own) > LEAF else None
        if part is None:
            self.middle.append(x[own].mean(axis=0, dtype=np.float64) if len(own) else np.zeros(SKETCH))
            return -len(self.middle)
        normal, offset = part
        side = x[own] @ normal > offset
        node = len(self.normal)
        self.normal.append(normal)
        self.offset.append(offset)
        self.below.append((0, 0))
        left = self._grow(x, own[~side])
        self.below[node] = (left, self._grow(x, own[side]))
        return node

    @staticmethod
    def _parted(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        """Two means from the median along the widest direction; None if nothing can be parted."""
        centred = x - x.mean(axis=0, dtype=np.float64).astype(x.dtype)
        widest = np.random.default_rng(len(x)).normal(size=SKETCH).astype(x.dtype)
        for _ in range(10):  # power iteration: a beginning for the means, so near is enough
            widest = centred.T @ (centred @ widest)
            widest /= np.linalg.norm(widest) or 1
        along = centred @ widest
        del centred
        side = along > np.median(along)
        normal = offset = None
        for _ in range(8):
            if side.all() or not side.any():
                return None
            a, b = (x.mean(axis=0, dtype=np.float64, where=part[:, None]) for part in (side, ~side))
            normal, offset = (a - b).astype(x.dtype), float((a - b) @ (a + b) / 2)
            side = x @ normal > offset
        return None if side.all() or not side.any() else (normal, offset)

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each sketch, and on which side of its middle the first 32 coordinates are, as a number."""
        node = np.full(len(x), 0 if len(self.normal) else -1, np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normal[at]) > self.offset[at]
            node[inner] = self.below[at, right.astype(np.int64)]
        leaf = -1 - node
        bits = (x - self.middle[leaf])[:, :32] > 0
        return leaf, bits @ (1 << np.arange(31, -1, -1, dtype=np.int64))


class Ranges:
    """Ranges of rows in the order of two whole numbers, of like sums of ``sizes`` by a sample of rows."""

    def __init__(self, first: np.ndarray, second: np.ndarray, sizes: np.ndarray, ranges: int) -> None:
        order = np.lexsort((second, first))
        sums = np.cumsum(sizes[order])
        order = order[np.searchsorted(sums, sums[-1] * np.arange(1, ranges) // ranges)] if len(order) else order
        self.first, self.second = first[order], second[order]

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The range of each row: the second number decides only where the first is that of a bound."""
        low, high = (np.searchsorted(self.first, first, side) for side in ("left", "right"))
        for n in np.flatnonzero(low < high).tolist():
            low[n] += np.searchsorted(self.second[low[n] : high[n]], second[n], "right")
        return low


def route(ids: DataFrame, idf: np.ndarray, n: int, tasks: int) -> DataFrame:
    """``doc_id, ids`` in ``tasks`` ranges of like documents, each in order."""
    kind = _kind(len(idf))

    def sketched(b):
        (terms, at), (tfs, _) = numbers(b["terms"], kind), numbers(b["tfs"], np.uint32)
        return _sketches(terms, tfs, at, idf)

    def drawn(size):
        return ids.where(F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.lit(max(1, n))) < size)

    def sampled(batches):
        for b in batches:
            yield pa.record_batch([pa.array([s.tobytes() for s in sketched(b)], pa.binary())], names=["sketch"])

    rows = drawn(FIT_DOCS).select("terms", "tfs").mapInArrow(sampled, "sketch binary").limit(2 * FIT_DOCS).toArrow()  # 1 KB each
    sample = b"".join(sorted(rows["sketch"].to_pylist()))
    del rows
    planes = Planes(np.frombuffer(sample, np.float32).reshape(-1, SKETCH))
    del sample
    give_back()

    def places(b):
        leaf, bits = planes.key(sketched(b))
        return leaf << 32 | bits, b["doc_id"].fill_null(-(1 << 63)).to_numpy()

    def keys(batches):
        for b in batches:
            yield pa.record_batch([*(pa.array(k) for k in places(b)), b["size"]], names=["place", "doc_id", "size"])

    rows = drawn(SAMPLED * tasks).select("doc_id", "terms", "tfs", F.octet_length("ids").cast("long").alias("size"))
    rows = rows.mapInArrow(keys, "place long, doc_id long, size long").limit(2 * SAMPLED * tasks).toArrow()  # 24 bytes each
    ranges = Ranges(*(rows[c].to_numpy() for c in ("place", "doc_id", "size")), tasks)
    del rows

    def keyed(batches):
        for b in batches:
            place, doc_id = places(b)
            yield pa.record_batch([b["doc_id"], b["ids"], pa.array(place), pa.array(ranges.of(place, doc_id), pa.int32())], names=["doc_id", "ids", "place", "range"])
        give_back()

    named = ids.mapInArrow(keyed, "doc_id long, ids binary, place long, range int").withColumn("last", F.crc32("ids"))
    return named.repartitionById(tasks, "range").sortWithinPartitions("place", "doc_id", "last").select("doc_id", "ids")


class Shard:
    """An inverted BM25 index of some documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        """``docs``: ids, the end id last."""
        self.n = len(docs)
        length = np.array([len(d) - 1 for d in docs])
        terms, tf, at = distinct(np.concatenate([d[:-1] for d in docs]).astype(_kind(len(idf))), np.append(0, np.cumsum(length)))
        self.doc, self.term = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(at)), terms.astype(np.int32)
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        # Multiples of a power of two: sums are exact, and the same in any order, so that copies have equal ones.
        weight = np.rint((idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32) * STEPS) / STEPS
        self.rows = np.searchsorted(self.doc, np.arange(self.n + 1))
        order = np.argsort(self.term, kind="stable")
        start = np.searchsorted(self.term[order], np.arange(len(idf) + 1))
        posted, value = self.doc[order].astype(np.intp), weight[order]
        # An id that more than one in FULL documents have has a weight for each document: rows are added faster than scattered.
        square = self.n <= SQUARE
        common = np.flatnonzero(np.diff(start) * FULL * (FULL_SQUARE if square else 1) > self.n)
        self.full = {t: np.bincount(posted[start[t] : start[t + 1]], value[start[t] : start[t + 1]], self.n) for t in common.tolist()}
        self.is_full = np.zeros(len(idf), bool)
        self.is_full[common] = True
        rest = ~self.is_full[self.term[order]]
        self.posted, self.value = posted[rest], value[rest]
        self.start = np.searchsorted(self.term[order][rest], np.arange(len(idf) + 1))
        self.used = np.zeros(self.n, bool)
        self.next = 0
        self.all = self._all() if square else None

    def _all(self) -> np.ndarray:
        """The scores of all documents (columns) for all seeds (rows): full rows by one product of matrices, and the postings."""
        common = np.flatnonzero(self.is_full)
        has = np.zeros((self.n, len(common)))
        own = self.is_full[self.term]
        has[self.doc[own], np.searchsorted(common, self.term[own])] = 1
        out = has @ np.array([self.full[t] for t in common.tolist()]).reshape(-1, self.n)
        doc, term = self.doc[~own], self.term[~own]
        begin, many = self.start[term], self.start[term + 1] - self.start[term]
        ends = np.append(0, np.cumsum(many))[np.searchsorted(doc, np.arange(self.n), "right")]  # of each seed's sums
        at = np.searchsorted(doc, np.arange(self.n + 1))
        for n, m, _, _ in runs(ends, 1 << 20):
            part = slice(at[n], at[m])
            k = np.cumsum(many[part])
            posting = np.repeat(begin[part] - k + many[part], many[part]) + np.arange(k[-1] if len(k) else 0)
            out[n:m] += np.bincount(np.repeat((doc[part] - n) * self.n, many[part]) + self.posted[posting], self.value[posting], (m - n) * self.n).reshape(m - n, self.n)
        return out

    def take(self, d: int) -> None:
        self.used[d] = True

    def first_unused(self) -> int | None:
        while self.next < self.n and self.used[self.next]:
            self.next += 1
        return self.next if self.next < self.n else None

    def _scores(self, terms: np.ndarray) -> np.ndarray:
        common = self.is_full[terms]
        rare = terms[~common]
        at = [slice(a, b) for a, b in zip(self.start[rare].tolist(), self.start[rare + 1].tolist())]
        if at:
            scores = np.bincount(np.concatenate([self.posted[s] for s in at]), np.concatenate([self.value[s] for s in at]), self.n)
        else:
            scores = np.zeros(self.n)
        for t in terms[common].tolist():
            scores += self.full[t]
        return scores

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents, the best first, as long as they share an id that the query has."""
        own = slice(self.rows[seed], self.rows[seed + 1])
        terms = self.term[own]
        if not len(terms):
            return
        scores = self.all[seed].copy() if self.all is not None else self._scores(terms)
        asked = NEIGHBOURS // 2
        while True:
            asked *= 2  # so that many neighbours cost no scan each few of them
            scores[self.used] = 0
            best = np.argpartition(-scores, asked)[:asked] if self.n > asked else np.arange(self.n)
            best = best[np.lexsort((best, -scores[best]))]
            best = best[scores[best] > 0]
            if not len(best):
                return
            yield from (d for d in best.tolist() if not self.used[d])


def order(shard: Shard, sizes: list[int], length: int = LENGTH) -> Iterator[int]:
    """The documents in the order in which they are packed."""
    filled = 0  # of the sequence begun
    near: Iterator[int] = iter(())
    while True:
        d = next((x for x in near if not shard.used[x]), None) if filled else None
        if d is None:
            d = shard.first_unused()
            if d is None:
                return
        shard.take(d)
        yield d
        before, filled = filled, (filled + sizes[d]) % length
        if before == 0 or before + sizes[d] >= length:  # the document begins a sequence
            near = shard.neighbours(d)


def pieces(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of such sizes, in this order."""
    total = sum(sizes)
    bounds = list(range(length, total + 1, length))
    at, left = total // length * length, total % length
    while left:
        part = 1 << (left.bit_length() - 1)
        at, left = at + part, left - part
        bounds.append(at)
    out, sequence, begun, at = [], 0, 0, 0
    for d, size in enumerate(sizes):
        start = 0
        while start < size:
            n = min(size - start, bounds[sequence] - at)
            out.append((d, start, n, sequence, at - begun))
            start, at = start + n, at + n
            if at == bounds[sequence]:
                sequence, begun = sequence + 1, at
    return out


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, if asked for, ``ids`` (little-endian unsigned 32-bit numbers)."""
    path = path or default_tokenizer()
    size = vocabulary_size(path)
    kind = _kind(size)
    ids = materialize(tokenize(docs, path, size, id_col, text_col), "ids")
    counts, n, total = document_counts(ids, size)
    idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
    mean = (total - n) / max(1, n)

    def deal(batches):
        first = TaskContext.get().partitionId() << 40
        names, own, tokens = [], [], 0

        def put():
            nonlocal first, names, own, tokens
            where = list(order(Shard(own, idf, mean), [len(o) for o in own], length))
            found = pieces([len(own[d]) for d in where], length)
            parts = [own[where[d]][a : a + k].astype("<u4").tobytes() for d, a, k, _, _ in found]
            columns = [
                pa.array([names[where[d]] for d, *_ in found], pa.int64()),
                *(pa.array([f[c] for f in found], pa.int64()) for c in (1, 2)),
                pa.array([crc32(p) for p in parts], pa.int64()),
                pa.array([len(own[where[d]]) for d, *_ in found], pa.int64()),
                pa.array([first + f[3] for f in found], pa.int64()),
                pa.array([f[4] for f in found], pa.int64()),
            ]
            first += found[-1][3] + 1
            names, own, tokens = [], [], 0
            named = [c.split()[0] for c in PIECE.split(", ")]
            return pa.record_batch([*columns, pa.array(parts, pa.binary())] if with_ids else columns, names=[*named, "ids"] if with_ids else named)

        for b in batches:
            for name, raw in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist()):
                one = np.frombuffer(raw, kind)
                if own and tokens + len(one) > SHARD_TOKENS:
                    yield put()
                names.append(name)
                own.append(one)
                tokens += len(one)
        if own:
            yield put()
        give_back()

    return route(ids, idf, n, max(1, -(-2 * total // SHARD_TOKENS))).mapInArrow(deal, PIECE + (", ids binary" if with_ids else ""))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
