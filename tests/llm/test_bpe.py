"""Encoding and decoding against the tokenizers library."""

import json
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from corpus import rows, table
from tokenizers import Tokenizer

from glyphflow.llm import bpe

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
HARD = [
    "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|> <|endoftext",
    "ha" * 300 + "<|endoftext|>" * 3,
    "aaaa aaaaa aaaaaaa AAAA",
    "Σας ΣΑΣ İstanbul ﬁ é 각 áb̈",
    "it's IT'S they'll'd 've ''s '",
    "tab\tform\x0cnext\x85line\xa0sep x\x1cy\x00z",
    "🙂🙂🙃 日本語 ñandú ٣٤ ½ Ⅷ",
    " \n\t ",
    "x" * 20000 + "y" * 3,
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def noise(n, seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(256), lambda: rng.randrange(0xD800), lambda: rng.choice([0x20, 0x301, 0x308, 0x130, 0x3A3, 0x85, 0xA0, 0x27, 0x73]), lambda: rng.randrange(0xE000, 0x2FFFF)]
    return ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = [t for _, t in rows()] + HARD + noise(300, 4)
    given = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    own = library(path)
    found = bpe.decode(bpe.encode(table(spark, given), path), path)
    assert found.columns == ["doc_id", "ids", "text"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.text) for r in found.collect())
    want = []
    for i, t in given:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, ids, own.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_small_blocks_and_memory(monkeypatch):
    """Slices, blocks and a full memory of words change nothing."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "KNOWN", 20)
    monkeypatch.setattr(bpe, "CHUNK", 3)
    own, lib = bpe.Vocabulary(bpe.default_vocabulary()), library(bpe.default_vocabulary())
    texts = [None, "", *noise(200, 9), "a b " * 100, "word" * 100, "the  end\n" * 30]
    got = [i for block in own.encode(texts) for i in block]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert max(map(len, own.known), default=0) <= bpe.LONGEST_KNOWN


def test_index_merges_by_rank():
    """Against the plain rule, word by word: the lowest rank, the leftmost place."""
    rng = random.Random(3)
    vocabulary = {c: n for n, c in enumerate("abc")}
    merges = []
    while len(merges) < 25:
        a, b = rng.choice(list(vocabulary)), rng.choice(list(vocabulary))
        if a + b not in vocabulary:
            vocabulary[a + b] = len(vocabulary)
            merges.append([a, b])
    given = bpe.Merges(vocabulary, merges)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    index = bpe.PairIndex(np.array([vocabulary[c] for w in words for c in w]), np.array([len(w) for w in words]), given)
    index.run()
    symbols, at = index.left()
    rank = {tuple(m): n for n, m in enumerate(merges)}
    start, names = 0, list(vocabulary)
    for w in words:
        parts = list(w)
        while True:
            places = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not places:
                break
            _, k = min(places)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert [names[s] for s in symbols[(at >= start) & (at < start + len(w))]] == parts
        start += len(w)


def test_refused_files(tmp_path):
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "aba": 3}, [["ab", "a"], ["a", "b"]])
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["unk_token"] = "!"
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(path))


def test_decoding_odd_ids(spark):
    own = library(bpe.default_vocabulary())
    given = [(1, np.array([320, 1 << 20, 49407], "<u4").tobytes()), (2, None), (3, b""), (4, np.array([320], "<u4").tobytes() + b"\x01")]
    found = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(given, "doc_id int, ids binary")).collect()}
    assert found == {1: own.decode([320, 49407], skip_special_tokens=False), 2: None, 3: "", 4: own.decode([320])}


def test_no_documents(spark):
    assert bpe.encode(table(spark, [])).count() == 0


def test_query(spark, tmp_path):
    table(spark, rows()).write.parquet(str(tmp_path / "documents.parquet"))
    found = bpe.query(spark, str(tmp_path))
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "string", "string"]
    own, want = library(bpe.default_vocabulary()), []
    for i, t in rows():
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, found.collect())) == sorted(want)
