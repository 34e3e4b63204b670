"""Near-duplicate documents: an exact Jaccard join on word shingles under several global orders.

1. Blocks of documents hash their distinct shingles and learn from a routed count-min sketch
   (:mod:`glyphflow.llm.routed_sketch`) how many documents have each of them at most.  Shingles
   counted once are certainly in no other document.
2. A set of ``n`` shingles that links to another shares at least ``ceil(0.8 n)`` with it, so under
   any one order of all shingles both have a common one among their first ``n - ceil(0.8 n) + 1``.
   All orders put the shingles counted once first; after them the first order goes by estimated
   count, the others by independent hashes.  Most documents have nothing left in their prefix and
   are done here.
3. Equal sets become one node.  Of the nodes with a prefix shingle the most central one (highest
   mean count) is the hub; nodes that share a prefix shingle thus share a hub, and nodes are
   compared within the circle of a hub.  First every node with the hub alone; then only nodes that
   do not link to the hub, with all of the circle, chunk by chunk.  A pair must share prefix
   shingles under every order before the shingles themselves are counted.
4. Links between nodes give components by star contraction.

A group of thousands of near copies costs one comparison for each that is like its hub, and
chunks of bounded size for the rest: no pairs are emitted, only links that join two components.

Defined results.  A null or empty text, or one without words, has no shingles and links with
nothing; a text of fewer words than a shingle has one shingle, all its words.  Rows without id
take part; the component's id is the smallest that is not null, null if there is none.  Repeated
rows are rows like others.  Other columns are ignored.  An empty table gives an empty table.
Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import routed_sketch as sketch
from glyphflow.llm.blocks import U64, Words, give_back, in_blocks, mix, slices, text_bytes
from glyphflow.llm.components import components
from glyphflow.llm.skew import inner_join, left_join, small
from glyphflow.llm.storage import materialize

SHINGLE = 5
PERCENT = 80
CHUNK = 512
ORDERS = 3
HOT = 4096
_FOUND = "doc_id long, tag long, n_shingles long, node binary, row long, size int, central float, prefix array<long>, others array<binary>, shingles binary"


def lower_ascii(texts: list[bytes]) -> list[bytes]:
    return [t.lower() for t in texts]


class _Shingles:
    """The distinct (shingle, document) pairs of a block, by shingle."""

    def __init__(self, t: pa.Table, n: int) -> None:
        texts = lower_ascii([x or b"" for x in t["text"].cast(pa.binary()).to_pylist()])
        self.rows = len(texts)
        parts = []
        for start, some in slices(texts):
            w = Words(some)
            at, h = w.windows(n)
            docs, whole = w.shorter(n)
            parts.append((np.concatenate([h, whole]), np.concatenate([w.doc[at], docs]).astype(np.int32) + np.int32(start)))
        h, doc = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U64), np.zeros(0, np.int32))
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        if np.any((h[1:] == h[:-1]) & (doc[1:] < doc[:-1])):  # within a slice the shorter texts come last
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
        new_h = np.append(True, h[1:] != h[:-1])[: len(h)]
        keep = new_h | np.append(True, doc[1:] != doc[:-1])[: len(h)]
        self.h, self.doc = h[keep], doc[keep]
        first = np.flatnonzero(new_h[keep])
        self.unique = self.h[first]
        self.docs = np.diff(np.append(first, len(self.h)))
        self.number = np.repeat(np.arange(len(first)), self.docs)


def _needed(n: np.ndarray | int, percent: int):
    """The least overlap with any set that a set of ``n`` links to."""
    return -(-percent * n // 100)


def _describe(s: _Shingles, count: np.ndarray, t: pa.Table, block: int, percent: int) -> pa.Table:
    """A row for each document, with its set only where it is the first of its node in the block."""
    order = np.argsort(s.doc, kind="stable")
    h, count, doc = s.h[order], count[s.number][order], s.doc[order]
    size = np.bincount(doc, minlength=s.rows)
    start = np.cumsum(size) - size
    single = np.bincount(doc[count <= 1], minlength=s.rows)
    prefix = np.where(size > 0, size - _needed(size, percent) + 1 - single, 0)
    sums = []
    for salt in (11, 12):
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h, salt), out=total[1:])
        sums.append(total[start + size] - total[start])
    node, central, first, others, shingles, sizes = ([None] * s.rows for _ in range(6))
    seen: set[bytes] = set()
    for d in np.flatnonzero(prefix > 0).tolist():
        key = b"".join(int(x).to_bytes(8, "big") for x in (sums[0][d], sums[1][d]))
        node[d] = key
        if key in seen:
            continue
        seen.add(key)
        a, b, p = start[d], start[d] + size[d], int(prefix[d])
        many = count[a:b] > 1
        own, often = h[a:b][many], count[a:b][many]
        sizes[d] = int(size[d])
        central[d] = float(np.log2(often).sum() / size[d])
        first[d] = own[np.lexsort((mix(own, 21), often))[:p]].view(np.int64).tolist()
        others[d] = []
        for salt in range(22, 21 + ORDERS):
            by = mix(own, salt)
            by.sort()
            others[d].append((by[:p] >> U64(32)).astype(np.uint32).tobytes())
        shingles[d] = own.tobytes()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.float32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
    row = (block << 32) + np.arange(s.rows)
    columns = [t["doc_id"], t["tag"], size, node, row, sizes, central, first, others, shingles]
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "tag", "n_shingles", "node", "row", "size", "central", "prefix", "others", "shingles"])


def _group(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated values and the number of the list each is from."""
    return np.concatenate(values), np.repeat(np.arange(len(values)), [len(x) for x in values])


class _Circle:
    """Nodes to compare with: which of them link with a given one."""

    def __init__(self, members: list[tuple], percent: int) -> None:
        self.size = np.array([m[1] for m in members])
        self.prefixes = [_group([m[2] for m in members])] + [_group([m[3][k] for m in members]) for k in range(ORDERS - 1)]
        self.sets = [m[4] for m in members]
        self.whole, self.owner = _group(self.sets)
        self.percent = percent

    def linked(self, x: tuple, among: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the nodes that link with ``x``, of those in the mask ``among``."""
        m = len(self.size)
        may = np.minimum(self.size, x[1]) * 100 >= self.percent * np.maximum(self.size, x[1])
        if among is not None:
            may &= among
        for (values, owner), own in zip(self.prefixes, [x[2], *x[3]]):
            if not may.any():
                break
            share = np.zeros(m, bool)
            share[owner[np.isin(values, own)]] = True
            may &= share
        left = np.flatnonzero(may)
        if len(left) > 8:
            place = np.minimum(np.searchsorted(x[4], self.whole), max(0, len(x[4]) - 1))
            common = np.bincount(self.owner[x[4][place] == self.whole], minlength=m)[left] if len(x[4]) else np.zeros(len(left), np.int64)
        else:
            common = np.array([len(np.intersect1d(x[4], self.sets[i], assume_unique=True)) for i in left], np.int64)
        return left[100 * common >= self.percent * (self.size[left] + x[1] - common)]


def _members(t: pa.Table) -> list[tuple]:
    return [
        (node, size, np.array(prefix, np.int64), [np.frombuffer(o, np.uint32) for o in others], np.frombuffer(s, U64))
        for node, size, prefix, others, s in zip(*(t[c].to_pylist() for c in ("node", "size", "prefix", "others", "shingles")))
    ]


def _by_circle(t: pa.Table):
    """(hub, chunk, chunk of the others, rows) of each comparison dealt to one task."""
    keys = list(zip(t["hub"].to_pylist(), t["i"].to_pylist(), t["j"].to_pylist()))
    rows: dict[tuple, list[int]] = {}
    for r, k in enumerate(keys):
        rows.setdefault(k, []).append(r)
    for (hub, i, j), own in rows.items():
        yield hub, i, j, t.take(pa.array(own))


def link_sets(nodes: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """Links ``a``-``b`` between nodes (``node, size, central, prefix, others, shingles``) that give
    the same components as all pairs at or above the threshold."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = nodes.select("node", "central", F.explode("prefix").alias("token"))
    hubs = posted.groupBy("token").agg(F.max(F.struct("central", "node")).getField("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "hub", "n")
    hubs = materialize(hubs, "hubs")
    # A token that very many nodes have is no key of one task: such tokens are few, and joined by broadcast or salted.
    often = hubs.where(F.col("n") > HOT)
    met = posted.join(hubs.where(F.col("n") <= HOT), "token").unionByName(inner_join(posted, often, ["token"], F.col("node"), often.count(), 96))
    circles = materialize(met.where("node <> hub").select("hub", "node").distinct(), "circles")
    met = circles.count()
    groups = max(partitions, -(-met // 2048))
    dealt = lambda df: df.withColumn("g", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(groups)))

    def with_sets(df: DataFrame, key: str = "node", rows: int = met) -> DataFrame:
        """The sets of the nodes in column ``key``, called ``node`` afterwards."""
        return nodes.withColumnRenamed("node", key).join(small(df, rows, 48), key).withColumnRenamed(key, "node")

    columns = ["g", "hub", "i", "j", "side", "node", "size", "prefix", "others", "shingles"]
    sizes = circles.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    chunks = lambda col: F.greatest(F.lit(1), F.ceil(F.col(col) / chunk)).cast("int")
    pick = lambda col: F.pmod(F.xxhash64("node"), chunks(col)).cast("int")

    members = with_sets(circles.join(sizes, "hub").select("hub", "node", pick("m").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    centres = with_sets(sizes.select("hub", F.col("hub").alias("centre"), F.explode(F.sequence(F.lit(0), chunks("m") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side")), "centre")

    def with_hub(t: pa.Table) -> pa.Table:
        out = []
        for hub, _, _, own in _by_circle(t):
            side = np.array(own["side"].to_pylist())
            found = _members(own)
            centre = next(x for x, s in zip(found, side) if s)
            rest = [x for x, s in zip(found, side) if not s]
            if rest:
                linked = set(_Circle(rest, percent).linked(centre).tolist())
                out += [(hub, x[0], k in linked) for k, x in enumerate(rest)]
        give_back()
        return sketch.table(out, ["hub", "node", "linked"], [pa.int64(), pa.int64(), pa.bool_()])

    tried = dealt(members.unionByName(centres)).select(columns).groupBy("g").applyInArrow(with_hub, "hub long, node long, linked boolean")
    tried = materialize(tried, "tried")

    others = tried.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("linked")).alias("r")).where("r > 0 and m > 1")
    both = materialize(tried.join(others, "hub").select("hub", "node", "linked", "m", "r"), "unlike")
    chunked = both.select(F.sum(F.when(~F.col("linked"), chunks("m"))), F.sum(chunks("r"))).first()
    left = both.where(~F.col("linked")).select("hub", "node", pick("r").alias("i"), F.explode(F.sequence(F.lit(0), chunks("m") - 1)).alias("j"), F.lit(0).alias("side"))
    right = both.select("hub", "node", F.explode(F.sequence(F.lit(0), chunks("r") - 1)).alias("i"), pick("m").alias("j"), (F.col("linked").cast("int") + 1).alias("side"))
    left, right = with_sets(left, rows=chunked[0] or 0), with_sets(right, rows=chunked[1] or 0)

    def rest(t: pa.Table) -> pa.Table:
        out = []
        for hub, _, _, own in _by_circle(t):
            side = np.array(own["side"].to_pylist())
            found = _members(own)
            ones = [x for x, s in zip(found, side) if s == 0]
            others = [(x, s) for x, s in zip(found, side) if s > 0]
            if not ones or not others:
                continue
            circle = _Circle([x for x, _ in others], percent)
            # Which members are known to be in one component: those that link to the hub, at first.
            group = np.array([0 if s == 2 else k + 1 for k, (_, s) in enumerate(others)])
            place = {x[0]: k for k, (x, _) in enumerate(others)}
            for x in ones:
                own_group = group[place[x[0]]] if x[0] in place else -1
                for k in circle.linked(x, group != own_group).tolist():
                    if group[k] != own_group and others[k][0][0] != x[0]:
                        out.append((x[0], others[k][0][0]))
                        if own_group < 0:
                            own_group = group[k]
                        else:
                            group[group == group[k]] = own_group
        give_back()
        return sketch.table(out, ["a", "b"], [pa.int64(), pa.int64()])

    more = dealt(left.unionByName(right)).select(columns).groupBy("g").applyInArrow(rest, "a long, b long")
    return tried.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id``, ``row`` (its number in ``docs``), ``n_shingles``, ``component_id`` and
    ``first``, which is true for one row of each component, one with the smallest id."""
    total = text_bytes(docs, text_col)
    base = in_blocks(docs, id_col, text_col, total, tag=F.monotonically_increasing_id())
    shape = sketch.Shape.of(total // 6)

    def send(t: pa.Table) -> pa.Table:
        s = _Shingles(t, shingle)
        out = sketch.sent_table(sketch.cell_rows(t["block"][0].as_py(), s.unique, s.docs, shape))
        del s
        give_back()
        return out

    def describe(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        s = _Shingles(t, shingle)
        count = sketch.estimates(s.unique, s.docs, shape, dict(zip(answers["key"].to_pylist(), answers["totals"].to_pylist())))
        out = _describe(s, count, t, key[0].as_py(), percent)
        del s, count
        give_back()
        return out

    answers = sketch.merged(base.groupBy("block").applyInArrow(send, sketch.SENT), shape)
    found = materialize(base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(describe, _FOUND), "shingles")
    first = found.where("size is not null").groupBy("node").agg(F.min("row").alias("row"))
    first = materialize(first, "nodes")
    n_nodes = first.count()
    sets = found.where("size is not null").select(F.col("row").alias("node"), "size", "central", "prefix", "others", "shingles")
    sets = sets.join(small(first.select(F.col("row").alias("node")), n_nodes, 16), "node", "left_semi")
    roots = components(link_sets(sets, percent), "similar")
    roots = materialize(first.join(roots, first["row"] == roots["node"], "left").select(first["node"], F.coalesce("root", "row").alias("root")), "roots")
    rooted = left_join(found.select("doc_id", "tag", "n_shingles", "node", "row"), roots, ["node"], F.col("row"), n_nodes, 48)
    rooted = materialize(rooted.select("doc_id", "tag", "n_shingles", "root", "row"), "rooted")
    least = rooted.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "least")
    out = left_join(rooted, least, ["root"], F.col("row"), n_nodes, 40)
    alone = F.col("least").isNull()
    return out.select("doc_id", F.col("tag").alias("row"), "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), (alone | (F.col("least.row") == F.col("row"))).alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component.  The plan of ``docs`` has to give the same rows in the same
    partitions each time it runs, as a table read from files does."""
    later = materialize(near_duplicates(docs, id_col, text_col, shingle, percent).where("not first").select(F.col("row").alias("__row")), "later")
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(small(later, later.count(), 16), "__row", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON node = d.doc_id GROUP BY d.doc_id, n.n
"""
