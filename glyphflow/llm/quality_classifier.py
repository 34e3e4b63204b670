"""Quality of documents by weak supervision: overlapping labellers, a label model and a linear scorer.

1. Overlapping labellers (``LABELLERS``) each call a document good, bad or abstain.  Eight are measures of
   form; a share is held against its bound together with its standard error, so short texts are called bad
   only by what chance cannot explain.  The ninth counts words and beginnings of words that are significantly
   more frequent in texts labelled toxic; which these are is learned from the labels alone.  It
   works by passages of ``PASSAGE`` words, so abuse in a part of a long text counts.
2. Expectation-maximisation over the counts of the vote patterns of all documents estimates how often each
   labeller is right on good and on bad documents, and from that the posterior of each pattern.  Labelled
   documents are known to it and weigh as much as all others together; the prior has the weight of
   ``PRIOR`` votes at every size.
3. The posteriors, of labelled documents the labels, are the targets of a logistic regression on hashed
   features: words, beginnings of words, trigrams of character classes, and the measures.

All documents take part in the label model: one pass adds up the pattern counts (at most 3**9 patterns).
The toxic words are learned from at most ``LABELLED`` labels, counted where the texts are; the scorer is
fitted on a documented, bounded sample: about ``SAMPLE`` labelled documents and as many others, those with the smallest
hashes of id and text.  Only their features reach the driver.  A last pass scores.

Defined results.  A text that is null or has no words gets no score and is rejected.  Ties of the
score with the threshold are kept.  Rows without id and repeated rows are rows like others; a document that is labelled
twice is bad if any label says so; labels that are null say good.  Without labels, or without toxic ones, the ninth labeller abstains.
A very long text is a slice by itself: its arrays take some 50 bytes for each of its own.  Other
columns are kept; columns of the result's names are replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.blocks import U64, Words, give_back, mix, slices

THRESHOLD = 0.5
LABELLED = 20_000
SAMPLE = 2_000
PRIOR = 50.0
PASSAGE = 64
SIGNIFICANT = 25.0
LEAST_TOXIC = 3
CLASSES = 256
BUCKETS = 1 << 18
EPOCHS, STEPS, BATCH, RATE, RIDGE = 6, 300, 256, 0.1, 1e-6
ABSTAIN, BAD, GOOD = 0, 1, 2

#: (measure, bad from, good to)
LABELLERS = [
    ("symbols", 0.05, 0.02),  # of the visible characters
    ("capitals", 0.4, 0.12),
    ("repeats", 0.3, 0.1),  # words equal to the one before
    ("pipes", 0.1, 0.02),  # a word
    ("sameness", 0.6, 0.45),  # 1 - distinct words / words
    ("long_words", 6.6, 5.8),  # bytes a word
    ("shouts", 0.3, 0.1),  # exclamation marks a word
    ("ends", 0.7, 0.35),  # words that end in punctuation
    ("abuse", 3.0, 0.5),  # log likelihood ratio of the worst passage
]
PATTERNS = 3 ** len(LABELLERS)
ERRORS = 2.0  # standard errors that a measure is beyond its bound

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[32] = 5
_CLASS[33:48], _CLASS[58:65], _CLASS[91:97], _CLASS[123:128] = range(6, 21), range(21, 28), range(28, 34), range(34, 39)
_BUCKET = (mix(np.arange(64**3, dtype=U64), 31) % U64(CLASSES - 2 * len(LABELLERS))).astype(np.int64)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|~^_=<>@{}[]\\!", np.uint8))
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_MARK = (_CLASS >= 6) & (_CLASS < 39)
_PLAIN = bytes(32 if _MARK[b] else b + 32 * _CAPITAL[b] for b in range(256))


@dataclass
class Lexicon:
    """Terms of abusive passages, by ascending hash, with what each says; ``rate`` is what a word without any says."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 0.0

    def says(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, self.weight[at], 0.0)


@dataclass
class Texts:
    """What is told of some texts."""

    words: np.ndarray
    measures: np.ndarray  # text, labeller; the last one is for the lexicon
    error: np.ndarray
    classes: np.ndarray
    plain: np.ndarray  # words without punctuation of each text
    doc: np.ndarray  # the text of each such word
    terms: np.ndarray  # kind (whole, 4 bytes, 6 bytes), word: hashes

    def judged(self, lexicon: Lexicon) -> np.ndarray:
        """The measures with that of the lexicon: the worst passage, less what so many passages give by chance."""
        out = self.measures.copy()
        if len(lexicon.terms) and len(self.doc):
            said = np.max([lexicon.says(t) for t in self.terms], axis=0)
            first = np.cumsum(self.plain) - self.plain
            count = -(-self.plain // PASSAGE)
            start = np.cumsum(count) - count
            passage = start[self.doc] + (np.arange(len(self.doc)) - first[self.doc]) // PASSAGE
            ratio = np.bincount(passage, said - lexicon.rate, minlength=int(count.sum()))
            some = np.flatnonzero(count)
            out[some, -1] = np.maximum.reduceat(ratio, start[some]) - np.log(count[some])
        return out

    def pattern(self, lexicon: Lexicon) -> np.ndarray:
        """The votes as digits in base three."""
        judged = self.judged(lexicon)
        out = np.zeros(len(self.words), np.int64)
        for j, (name, bad, good) in enumerate(LABELLERS):
            x, e = judged[:, j], ERRORS * self.error[:, j]
            vote = np.where(x - e >= bad, BAD, np.where(x <= good, GOOD, ABSTAIN))
            if name == "abuse" and not len(lexicon.terms):
                vote[:] = ABSTAIN
            out = out * 3 + vote
        return out

    def buckets(self, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, value) of all features that are not 0; a bucket can stand several times for a text."""
        lexical = [CLASSES + (mix(t, 41 + k) >> U64(64 - 18)).astype(np.int64) for k, t in enumerate(self.terms)]
        share = 4 / np.maximum(1, self.plain)
        # A measure up to its bound, and beyond it.
        held = (self.judged(lexicon) - ERRORS * self.error) / [b for _, b, _ in LABELLERS]
        dense = np.hstack([np.clip(held, 0, 1), np.clip(4 * (held - 1), 0, 1), self.classes])
        doc, column = np.nonzero(dense)
        texts = [doc, *([self.doc] * len(lexical))]
        values = [dense[doc, column], *([share[self.doc]] * len(lexical))]
        return np.concatenate(texts), np.concatenate([column, *lexical]), np.concatenate(values)


def _beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the first ``n`` bytes of words; of a shorter word, of all of it."""
    value = np.full(len(starts), n, U64)
    for k in range(n):
        inside = starts + k < ends
        value = value * U64(257) + np.where(inside, data[np.minimum(starts + k, len(data) - 1)].astype(U64) + U64(1), U64(0))
    return mix(value, 61)


def describe(texts: list[bytes]) -> Texts:
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    length = np.array([len(t) + 1 for t in texts])
    doc = np.repeat(np.arange(n), length)
    w = Words(texts)
    words = w.count
    per_word = np.maximum(words, 1)
    kind = _CLASS[data]
    visible = np.bincount(doc[(kind != 4) & (kind != 5)], minlength=n)
    of = lambda mask: np.bincount(doc[mask], minlength=n)
    same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
    last = np.flatnonzero(_MARK[data[:-1]] & ((kind[1:] == 4) | (kind[1:] == 5)))
    shown = np.maximum(visible, 1)
    shares = [
        of(_SYMBOL[data]) / shown,
        of(_CAPITAL[data]) / shown,
        np.bincount(w.doc[1:][same], minlength=n) / per_word,
        of(data == 124) / per_word,
        1 - np.bincount(d[new], minlength=n) / per_word,
        visible / per_word,
        of(data == 33) / per_word,
        np.bincount(doc[last], minlength=n) / per_word,
        np.zeros(n),
    ]
    measures = np.stack(shares, 1)
    part = (np.clip(measures, 0, 1) * words[:, None] + 1) / (words[:, None] + 2)
    error = np.sqrt(part * (1 - part)) / np.sqrt(per_word)[:, None]
    error[:, 5] = 3 / np.sqrt(per_word)  # lengths of words differ by about three bytes
    error[:, 8] = 0
    k = kind.astype(np.int64)
    within = doc[2:] == doc[:-2]
    width = CLASSES - 2 * len(LABELLERS)
    cell = doc[:-2] * width + _BUCKET[(k[:-2] << 12) | (k[1:-1] << 6) | k[2:]]
    x = np.bincount(cell[within], minlength=n * width).reshape(n, width).astype(np.float64)
    x = np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))
    plain = [t.translate(_PLAIN) for t in texts]
    p = Words(plain)
    data = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
    terms = np.stack([p.hash, _beginnings(data, p.starts, p.ends, 4), _beginnings(data, p.starts, p.ends, 6)])
    return Texts(words, measures, error, x, p.count, p.doc, terms)


def learn_lexicon(terms: np.ndarray, texts1: np.ndarray, texts0: np.ndarray, in1: np.ndarray, in0: np.ndarray, n1: int, n0: int, w1: float, w0: float) -> Lexicon:
    """Terms that are significantly more frequent in toxic texts (1) than in others (0): of each, how many texts
    have it and how often; how many texts and words there are.  Significant: a log likelihood ratio of
    ``SIGNIFICANT`` by the numbers of texts."""
    if not n1 or not n0 or not len(terms):
        return Lexicon()
    share = (texts1 + texts0) / (n1 + n0)

    def part(a: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log(a / (n * share)), 0) + np.where(a < n, (n - a) * np.log((n - a) / (n * (1 - share))), 0)

    with np.errstate(invalid="ignore"):
        tells = (texts1 >= LEAST_TOXIC) & (texts1 / n1 > texts0 / n0) & (2 * (part(texts1, n1) + part(texts0, n0)) >= SIGNIFICANT)
    weight = np.log((in1 + 0.5) / max(1.0, w1)) - np.log((in0 + 0.5) / max(1.0, w0))
    tells &= weight > 1
    order = np.argsort(terms[tells])
    rate = float(in1[tells].sum() / max(1.0, w1) - in0[tells].sum() / max(1.0, w0)) / 3  # a word is counted whole and by two beginnings
    return Lexicon(terms[tells][order], weight[tells][order], max(0.0, rate))


def term_counts(t: Texts, toxic: np.ndarray) -> np.ndarray:
    """Of each term (first column) and, in the row of term 0, of the texts and words: texts and occurrences by class."""
    kinds, texts = len(t.terms), np.tile(t.doc, len(t.terms))
    h = t.terms.reshape(-1)
    order = np.lexsort((texts, h))
    h, texts = h[order], texts[order]
    new = np.append(True, (h[1:] != h[:-1]) | (texts[1:] != texts[:-1]))[: len(h)]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    bad = toxic[texts]
    add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    rows = np.stack([h[first].view(np.int64), add(new & bad), add(new & ~bad), add(bad), add(~bad)], 1)
    some = t.words > 0
    whole = np.array([[0, (toxic & some).sum(), (~toxic & some).sum(), t.plain[toxic].sum(), t.plain[~toxic].sum()]], np.int64)
    return np.concatenate([whole, rows]) if kinds else whole


def votes(pattern: np.ndarray) -> np.ndarray:
    """A row of votes for each pattern."""
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1) % 3


def label_model(pattern: np.ndarray, count: np.ndarray, good: np.ndarray | None = None, bad: np.ndarray | None = None, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: the posterior of good for each pattern, the accuracies (labeller; on bad, on good), the prior.

    ``count``: documents of each pattern; ``good`` and ``bad``: how many labelled ones of them there are.  Most labellers
    look for one kind of junk, and the kinds hardly go together, so there is a bad class for each labeller besides
    the good one; a labelled bad document is of any of them.  It starts from calling a document bad if any labeller
    does, of the kinds of those that do.  A labeller is expected to err on one good document in fifty, to find most of
    its own kind and few of others, each with ``PRIOR`` votes of evidence."""
    v = votes(pattern)
    k, n = len(LABELLERS), max(1.0, float(count.sum()))
    zero = np.zeros(len(pattern))
    good, bad = (zero if x is None else x for x in (good, bad))
    told = good.sum() + bad.sum()
    weigh = n / told if told else 0
    said, called = v != ABSTAIN, v == BAD
    none = ~called.any(1, keepdims=True)
    kinds = (called | none) / np.maximum(1, (called | none).sum(1, keepdims=True))
    of = np.hstack([np.where(none, 0.95, 0.05), np.where(none, 0.05, 0.95) * kinds])  # pattern; class, the good one first
    expected = np.full((k, k + 1), 0.05)
    expected[:, 0] = 0.02
    expected[np.arange(k), np.arange(k) + 1] = 0.9
    for _ in range(rounds):
        old = of
        junk = of[:, 1:] / np.maximum(1e-300, of[:, 1:].sum(1, keepdims=True))
        weight = count[:, None] * of + weigh * np.hstack([good[:, None], bad[:, None] * junk])
        share = weight.sum(0) + PRIOR / (k + 1)
        share = share / share.sum()
        rate = (called.T @ weight + PRIOR * expected) / (said.T @ weight + PRIOR)  # labeller; how often it calls the class bad
        log = np.log(share) + called @ np.log(rate) + (said & ~called) @ np.log(1 - rate)
        of = np.exp(log - log.max(1, keepdims=True, initial=-np.inf))
        of /= of.sum(1, keepdims=True)
        if np.abs(of - old).max(initial=0) < 1e-9:
            break
    found = rate[:, 1:] @ share[1:] / share[1:].sum()
    return of[:, 0], np.stack([found, 1 - rate[:, 0]], 1), float(share[0])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # the last one is the constant
    posterior: dict[int, float]
    accuracies: np.ndarray
    prior: float

    def scores(self, t: Texts) -> np.ndarray:
        doc, bucket, value = t.buckets(self.lexicon)
        return 1 / (1 + np.exp(-(np.bincount(doc, self.weights[bucket] * value, minlength=len(t.words)) + float(self.weights[-1]))))


def learn_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, seed: int = 1) -> np.ndarray:
    """Logistic regression by at least ``STEPS`` steps over batches, each weight with its own rate, which falls with what it has moved."""
    width = CLASSES + BUCKETS + 1
    weights, moved = np.zeros(width), np.full(width, 1e-8)
    rng = np.random.default_rng(seed)
    balance = np.clip(np.array([0.5 / max(1e-6, 1 - target.mean()), 0.5 / max(1e-6, target.mean())]), 0.2, 5) if len(target) else np.ones(2)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows)))) if rows else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            bucket = np.concatenate([np.append(rows[i][0], width - 1) for i in own])
            value = np.concatenate([np.append(rows[i][1], 1.0) for i in own])
            doc = np.repeat(np.arange(len(own)), [len(rows[i][0]) + 1 for i in own])
            z = np.bincount(doc, weights[bucket] * value, minlength=len(own))
            y = target[own]
            slope = (1 / (1 + np.exp(-z)) - y) * (balance[0] * (1 - y) + balance[1] * y) / len(own)
            step = np.bincount(bucket, slope[doc] * value, minlength=width) + RIDGE * weights
            moved += step * step
            weights -= RATE * step / np.sqrt(moved)
    return weights


def fit(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", known: int = LABELLED, sample: int = SAMPLE) -> Model:
    """``labels``: ``doc_id, quality, toxic``, of which at most ``known`` are used."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)))
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(toxic).alias("toxic"), F.max(toxic | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    marked = own.join(F.broadcast(told.orderBy(F.xxhash64("id"), "id").limit(known)), "id", "left")  # at most ``known`` rows of 10 bytes

    def texts_of(b):
        for start, some in slices([x or b"" for x in b["text"].cast(pa.binary()).to_pylist()]):
            yield start, len(some), describe(some)

    def terms(batches):
        for b in batches:
            flag = b["toxic"].to_numpy(zero_copy_only=False)
            for start, n, t in texts_of(b):
                found = term_counts(t, flag[start : start + n].astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(5)], names=["term", "texts1", "texts0", "in1", "in0"])
        give_back()

    sums = [F.sum(c).alias(c) for c in ("texts1", "texts0", "in1", "in0")]
    found = marked.where("toxic is not null").select("text", "toxic").mapInArrow(terms, "term long, texts1 long, texts0 long, in1 long, in0 long").groupBy("term").agg(*sums)
    found = found.where(F.col("texts1") >= LEAST_TOXIC).orderBy("term").toPandas()  # terms that three of the labelled texts have
    whole = found[found["term"] == 0].to_numpy(np.int64)
    found = found[found["term"] != 0]
    lexicon = learn_lexicon(found["term"].to_numpy(np.int64).view(U64), *(found[c].to_numpy(np.int64) for c in ("texts1", "texts0", "in1", "in0")), *whole[0, 1:].tolist()) if len(whole) else Lexicon()
    del found

    def count(batches):
        sums: dict[tuple[int, int], int] = {}
        for b in batches:
            label = b["bad"].fill_null(2).to_numpy()
            for start, n, t in texts_of(b):
                some = t.words > 0
                both = t.pattern(lexicon)[some] * 3 + label[start : start + n][some]
                for p, m in zip(*np.unique(both, return_counts=True)):
                    sums[divmod(int(p), 3)] = sums.get(divmod(int(p), 3), 0) + int(m)
        yield pa.record_batch([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array(sums.values(), pa.int64())], names=["pattern", "label", "n"])
        give_back()

    counts = marked.select("text", F.col("bad").cast("int").alias("bad")).mapInArrow(count, "pattern long, label long, n long").groupBy("pattern").pivot("label", [0, 1, 2]).agg(F.sum("n")).fillna(0).orderBy("pattern").toPandas()  # at most PATTERNS rows
    pattern, by_label = counts["pattern"].to_numpy(np.int64), counts[["0", "1", "2"]].to_numpy(float)
    posterior, right, prior = label_model(pattern, by_label.sum(1), by_label[:, 0], by_label[:, 1])
    of = dict(zip(pattern.tolist(), posterior.tolist()))
    n_told, n_rest = by_label[:, :2].sum(), by_label[:, 2].sum()

    def features(batches):
        for b in batches:
            label = b["bad"].to_pylist()
            for start, n, t in texts_of(b):
                doc, bucket, value = t.buckets(lexicon)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(n + 1))
                votes_of, rows = t.pattern(lexicon).tolist(), []
                for d in np.flatnonzero(t.words).tolist():
                    at = order[cut[d] : cut[d + 1]]
                    u, number = np.unique(bucket[at], return_inverse=True)
                    target = of.get(votes_of[d], prior) if label[start + d] is None else 1.0 - label[start + d]
                    rows.append((target, u.astype(np.int32).tobytes(), np.bincount(number, value[at]).astype(np.float16).tobytes()))
                yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.float64(), pa.binary(), pa.binary()))], names=["target", "buckets", "amounts"])
        give_back()

    # About ``sample`` rows of either kind, in the tasks where they are; sorted, so the steps come in the same order each time.
    chosen = lambda n: F.col("hash") * float(max(1, n)) < float(sample * (1 << 30))
    some = marked.where(F.when(F.col("bad").isNotNull(), chosen(n_told)).otherwise(chosen(n_rest)))
    drawn = some.select("text", F.col("bad").cast("int").alias("bad")).mapInArrow(features, "target double, buckets binary, amounts binary").orderBy(F.xxhash64("buckets", "amounts"), "target").toPandas()
    rows = [(np.frombuffer(b, np.int32), np.frombuffer(v, np.float16)) for b, v in zip(drawn["buckets"], drawn["amounts"])]
    model = Model(lexicon, learn_scorer(rows, drawn["target"].to_numpy(float)).astype(np.float32), of, right, prior)
    del rows, drawn
    give_back()
    return model


def classify(docs: DataFrame, model: Model | None = None, labels: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) with ``score``, ``label_posterior`` (null for a
    pattern that the fit has not seen) and ``accepted``, each name after ``prefix``."""
    model = model or fit(docs, labels, text_col, id_col)
    names = [prefix + c for c in ("score", "label_posterior", "accepted")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def score(batches):
        for b in batches:
            texts = [x or b"" for x in b[text_col].cast(pa.binary()).to_pylist()]
            out, label = np.zeros(len(texts)), []
            words_of = np.zeros(len(texts), np.int64)
            for start, some in slices(texts):
                t = describe(some)
                out[start : start + len(some)] = model.scores(t)
                words_of[start : start + len(some)] = t.words
                label += [model.posterior.get(p) if n else None for p, n in zip(t.pattern(model.lexicon).tolist(), t.words.tolist())]
            none = words_of == 0
            columns = [pa.array(out, pa.float64(), mask=none), pa.array(label, pa.float64()), pa.array((out >= threshold) & ~none, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *columns], names=[*keep, *names])
        give_back()

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.mapInArrow(score, ", ".join([*fields, *(f"`{c}` {k}" for c, k in zip(names, ("double", "double", "boolean")))]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
