"""BPE encoding by an index of pair occurrences, and decoding.

A task reads its documents in blocks of some million characters.  The distinct words of a block that it does not
know yet are laid out one after the other as symbols.  An index maps each pair of neighbouring symbols that has a
merge to all its positions in the block.  Ranks are taken in ascending order from a heap of those that have
positions: every position of the rank's pair is merged, left to right, and the pairs that a merge makes with its
neighbours are entered in the lists of their own, higher ranks.  A position whose symbols have changed since is
passed over when its list's turn comes.  So a merge is looked up once a block and not once a word.

Documents are not shuffled; nothing is collected; a task holds the vocabulary, one block, and the ids of about
``KNOWN`` fields (runs without white space) it has seen, after which it begins anew.  Words that many documents share are merged once for each task.

Words are what the file's normaliser and pre-tokenizer make of a text; fields that are ASCII take the same way by plain
expressions where the file is of the known kind.  Such a file drops white space, so its fields are taken one by one, and
a text of any length is read in slices.  Other byte-level files are encoded text by text.

Defined results.  A null or empty text has no ids, and no ids decode to the empty text; null ids to null.  Strings of
special tokens in a text get their ids.  Rows without id and repeated rows are encoded like others.  On decoding, ids
that the vocabulary lacks are left out, and so are bytes at the end that are no whole id.  An empty table gives no rows.  Other columns are
ignored, whatever their names.  A word takes about 40 bytes of memory for each of its bytes, however long.

Merge lists have to be those of trained vocabularies: a merge comes after those that make its parts.  Files
with unknown tokens, byte fallback, dropout or a prefix of continued words are refused (``ValueError``).
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.blocks import give_back

BLOCK_CHARS = 2 << 20
KNOWN = 1 << 19
LONGEST_KNOWN = 64
CHUNK = 1 << 16

#: The pattern of words of the file that drops white space, and its normalisers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The same pattern for lower-cased ASCII without white space.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
FIELD = re.compile(r"[^\x09-\x0d\x20]+")
SPACE = re.compile(r"[\x09-\x0d\x20]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: bytes that print stand for themselves, the others follow from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class PairIndex:
    """Symbols of many words, one word after the other, and for each rank the positions of its pair."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> None:
        n = len(symbols)
        self.merges = merges
        self.symbols = array("i", symbols.astype(np.int32).tobytes())
        ends = np.cumsum(lengths) - 1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends[lengths > 0]] = -1
        starts = ends - lengths + 1
        before[starts[lengths > 0]] = -1
        self.after, self.before = array("i", after.tobytes()), array("i", before.tobytes())
        self.first: dict[int, np.ndarray] = {}
        self.later: dict[int, array] = {}
        at = np.flatnonzero(after >= 0)
        if len(at):
            pairs, which = np.unique(symbols[at].astype(np.int64) * merges.size + symbols[at + 1], return_inverse=True)
            ranks = np.array([merges.rank.get(p, -1) for p in pairs.tolist()], np.int64)[which]
            order = np.argsort(ranks, kind="stable")
            order = order[np.searchsorted(ranks[order], 0) :]
            if len(order):
                cuts = np.flatnonzero(np.append(True, np.diff(ranks[order]) > 0))
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    self.first[int(ranks[order[a]])] = at[order[a:b]].astype(np.int32)
        self.active = list(self.first)
        heapify(self.active)

    def _enter(self, rank: int, position: int) -> None:
        if rank not in self.later:
            self.later[rank] = array("i")
            if rank not in self.first:
                heappush(self.active, rank)
        self.later[rank].append(position)

    def _positions(self, rank: int, sort: bool) -> Iterator[int]:
        lists = [self.first.pop(rank, np.zeros(0, np.int32)), np.array(self.later.pop(rank, []), np.int32)]
        found = lists[0] if not len(lists[1]) else np.concatenate(lists)
        if sort and len(lists[1]):
            found = np.sort(found)
        for k in range(0, len(found), CHUNK):
            yield from found[k : k + CHUNK].tolist()

    def run(self) -> None:
        symbols, after, before, rank_of, size = self.symbols, self.after, self.before, self.merges.rank, self.merges.size
        while self.active:
            rank = heappop(self.active)
            left, right, made = self.merges.parts[rank]
            for p in self._positions(rank, left == right):
                q = after[p]
                if symbols[p] != left or q < 0 or symbols[q] != right:
                    continue
                symbols[p], symbols[q] = made, -1
                n, b = after[q], before[p]
                after[p] = n
                if n >= 0:
                    before[n] = p
                    found = rank_of.get(made * size + symbols[n])
                    if found is not None:
                        self._enter(found, p)
                if b >= 0:
                    found = rank_of.get(symbols[b] * size + made)
                    if found is not None:
                        self._enter(found, b)

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left, and where."""
        symbols = np.array(self.symbols, np.int32)
        at = np.flatnonzero(symbols >= 0)
        return symbols[at], at


class Merges:
    """Pairs of ids with their rank, by one number for each pair."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        self.size = max(vocabulary.values(), default=0) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.parts = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        made: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        for n, (a, b, c) in enumerate(self.parts):
            self.rank[a * self.size + b] = n
            made.setdefault(c, n)
            made[c] = max(made[c], n)
        if any(made.get(x, -1) >= n for n, (a, b, _) in enumerate(self.parts) for x in (a, b)):
            raise ValueError("a merge comes before one that makes its part")


class Vocabulary:
    """A BPE file of ``tokenizers``, with what a task has encoded so far."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens") or []
        if model["type"] != "BPE" or any(model.get(x) for x in ("unk_token", "byte_fallback", "dropout", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError("not a plain BPE file")
        if any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens have to be plain strings")
        parts = Tokenizer.from_file(path)
        self.normaliser, self.cutter = parts.normalizer, parts.pre_tokenizer
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.merges = Merges(self.ids, model["merges"])
        self.special = {t["content"]: t["id"] for t in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        letters = byte_letters()
        self.letters = dict(zip(letters, range(256)))
        self.inside = np.array([self.ids.get(c, -1) for c in letters], np.int32)
        self.last = np.array([self.ids.get(c + self.suffix, -1) for c in letters], np.int32)
        if (self.inside < 0).any() or (self.last < 0).any():
            raise ValueError("the file lacks bytes")
        cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_field = (
            (spec.get("normalizer") or {}).get("normalizers") == NORMALISERS
            and [c.get("type") for c in cutters] == ["Split", "ByteLevel"]
            and cutters[0] == {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
            and not cutters[1].get("add_prefix_space")
            and not cutters[1].get("use_regex", True)
        )
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"decoder {self.decoder}")
        names: list = [None] * (max([*self.ids.values(), *self.special.values()], default=-1) + 1)
        for token, n in [*self.ids.items(), *self.special.items()]:
            names[n] = token
        self.names = names
        self.known: dict[str, bytes] = {}

    def _cut(self, field: str) -> list[str | int]:
        """The words of a field (each letter stands for a byte), and ids of special tokens."""
        if self.by_field and field.isascii() and "<|" not in field:
            return ASCII_WORDS.findall(field.lower())
        found: list[str | int] = []
        for part in self.marks.split(field) if self.marks else [field]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += [w for w, _ in self.cutter.pre_tokenize_str(self.normaliser.normalize_str(part) if self.normaliser else part)]
        return found

    def _bytes(self, word: str) -> bytes:
        return word.encode() if word.isascii() and word.isprintable() else bytes(self.letters[c] if c in self.letters else ord(c) for c in word)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as bytes, from one index of all their pairs."""
        raw = [self._bytes(w) for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        values = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inside[values]
        ends = np.cumsum(lengths) - 1
        symbols[ends[lengths > 0]] = self.last[values[ends[lengths > 0]]]
        index = PairIndex(symbols, lengths, self.merges)
        index.run()
        ids, at = index.left()
        out, cuts = ids.astype("<u4").tobytes(), np.searchsorted(at, np.append(0, ends + 1)) * 4
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def learn(self, fields: set[str]) -> dict[str, bytes]:
        """Ids of fields that are not known yet."""
        cut = {f: self._cut(f) for f in fields}
        words = list(dict.fromkeys(w for ws in cut.values() for w in ws if isinstance(w, str)))
        ids: dict[str | int, bytes] = dict(zip(words, self.encode_words(words)))
        ids |= {n: n.to_bytes(4, "little") for n in self.special.values()}
        return {f: b"".join([ids[w] for w in ws]) for f, ws in cut.items()}

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, little-endian, four bytes each."""
        fields = [FIELD.findall(t) if self.by_field else [t] if t else [] for t in texts]
        new = self.learn({f for fs in fields for f in fs} - self.known.keys())
        self.known |= new
        out = [b"".join(map(self.known.__getitem__, fs)) for fs in fields]
        if len(self.known) > KNOWN:
            self.known = {}
        for f in new:
            if len(f) > LONGEST_KNOWN:
                self.known.pop(f, None)
        return out

    def slices(self, text: str) -> Iterator[str]:
        """Parts of a text, cut at white space where the file drops that."""
        start = 0
        while self.by_field and len(text) - start > BLOCK_CHARS:
            gap = SPACE.search(text, start + BLOCK_CHARS)
            if gap is None:
                break
            yield text[start : gap.start()]
            start = gap.end()
        yield text[start:] if start else text

    def encode(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """Ids of texts, in lists of a block's texts each."""
        block: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if block and size + len(t) > BLOCK_CHARS:
                yield self.encode_block(block)
                block, size = [], 0
            if len(t) > BLOCK_CHARS:
                yield [b"".join(self.encode_block([s])[0] for s in self.slices(t))]
            else:
                block.append(t)
                size += len(t)
        if block:
            yield self.encode_block(block)

    def decode(self, ids: list[bytes | None]) -> pa.Array:
        """Texts of ids: with no decoder the tokens with blanks between them, else their bytes."""
        none = np.array([i is None for i in ids], bool)
        flat = [np.frombuffer(i or b"", "<u4", len(i or b"") // 4) for i in ids]
        own = [f[(f < len(self.names))] for f in flat]
        values = np.concatenate([*own, np.zeros(0, np.uint32)]).astype(np.int64)
        offsets = np.append(0, np.cumsum([len(f) for f in own]))
        tokens = pa.array(self.names, pa.large_string()).take(pa.array(values))
        if self.decoder is None:
            lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), tokens)
            texts = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
            return pc.if_else(pa.array(none), pa.scalar(None, pa.large_string()), texts).cast(pa.string())
        whole = [b"".join(t.encode() if t in self.special else self._bytes(t) for t in tokens[a:b].to_pylist()).decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.array([None if n else w for n, w in zip(none, whole)], pa.string())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: a document's ids as little-endian unsigned 32-bit numbers."""
    path = path or default_vocabulary()

    def run(batches):
        own = vocabulary(path)
        for b in batches:
            at = 0
            for found in own.encode(b["text"].to_pylist()):
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(found)), pa.array(found, pa.binary())], names=["id", "ids"])
                at += len(found)
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids, text``."""
    path = path or default_vocabulary()

    def run(batches):
        own = vocabulary(path)
        for b in batches:
            ids, start = b["ids"].to_pylist(), 0
            while start < len(ids):
                end, size = start + 1, len(ids[start] or b"")
                while end < len(ids) and size + len(ids[end] or b"") <= 4 * BLOCK_CHARS:
                    size += len(ids[end] or b"")
                    end += 1
                yield pa.RecordBatch.from_arrays([b["id"].slice(start, end - start), b["ids"].slice(start, end - start), own.decode(ids[start:end])], names=["id", "ids", "text"])
                start = end
        give_back()

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, text string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return decode(encode(docs)).select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
