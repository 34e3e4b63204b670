"""Graphs: matchings and vertex covers of tables of edges, and exact covers, flows and assignments of small ones.

Graphs are tables of edges with their order.  A matching in that order is found by rounds over the whole table.  Exact covers
are native folds over a small graph's edges; flows need a residual network and run in Arrow batches, one graph at a time.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.functions.lineage import settled

MOST_VERTICES = 20


def parse_edges(text: Column) -> Column:
    """Edges of ``"0-1, 1-2"`` as an array of ``u, v``; parts that are not two fields are skipped, and a
    field that is no integer raises."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "-"))
    return F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(F.trim(p[0]).cast("int").alias("u"), F.trim(p[1]).cast("int").alias("v")))


def edge_lists(edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """``edges``: the edges of each graph in their order."""
    return edges.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "u", "v"))), lambda e: F.struct(e["u"].alias("u"), e["v"].alias("v"))).alias("edges"))


def is_cover(cover: Column, edges: Column) -> Column:
    return F.forall(edges, lambda e: F.array_contains(cover, e["u"]) | F.array_contains(cover, e["v"]))


def approximate_cover(edges: Column) -> Column:
    """``cover`` and ``matched``: both ends of each edge that no earlier one has touched."""
    start = F.struct(F.array().cast("array<int>").alias("cover"), F.lit(0).alias("matched"))

    def step(acc: Column, e: Column) -> Column:
        free = ~F.array_contains(acc["cover"], e["u"]) & ~F.array_contains(acc["cover"], e["v"])
        return F.struct(F.when(free, F.array_union(acc["cover"], F.array(e["u"], e["v"]))).otherwise(acc["cover"]).alias("cover"), (acc["matched"] + free.cast("int")).alias("matched"))

    return F.aggregate(edges, start, step)


def exact_cover_size(graphs: DataFrame, by: str = "graph_id") -> DataFrame:
    """``vertices`` and ``minimum``: the smallest cover, over all subsets; null for more than 20 vertices."""
    sized = graphs.withColumn("vertices", F.array_max(F.transform("edges", lambda e: F.greatest(e["u"], e["v"]))) + 1)
    masks = sized.where(F.col("vertices") <= MOST_VERTICES).withColumn("mask", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("vertices")) - 1)))
    bit = lambda v: F.call_function("bit_get", F.col("mask").cast("long"), v)
    covers = masks.where(F.forall("edges", lambda e: (bit(e["u"]) + bit(e["v"])) > 0))
    least = covers.groupBy(by).agg(F.min(F.bit_count("mask")).alias("minimum"))
    return sized.select(by, "vertices").join(least, by, "left")


def cover_report(graphs: DataFrame, by: str = "graph_id") -> DataFrame:
    own = graphs.withColumn("a", approximate_cover(F.col("edges")))
    own = own.select(by, F.size("a.cover").alias("approximate"), F.col("a.matched").alias("matched"), is_cover(F.col("a.cover"), F.col("edges")).alias("covers"))
    out = own.join(exact_cover_size(graphs, by), by)
    return out.select(by, "vertices", "approximate", "matched", "minimum", "covers", (F.col("approximate") / F.nullif(F.col("minimum"), F.lit(0))).alias("ratio"), (F.col("approximate") <= 2 * F.col("minimum")).alias("within_twice"))


#: Edges that one task takes in their order once so few are left.
FEW_EDGES = 1 << 16


def ordered_matching(edges: DataFrame, by: str = "graph_id", few: int = FEW_EDGES) -> DataFrame:
    """``by, ord, u, v``: the edges that one takes who goes through a graph's edges in order and takes each that touches no
    vertex of an earlier one.  Edges of equal ``ord`` come by ``u``, then ``v``; equal rows are one edge.  A loop takes its one
    vertex.  Rows with a null are left out.

    Edges get their place in the order, by ranges of it, so that what a round compares is one number.  An edge that comes first
    at both its ends is taken whatever the others are, so a round takes all of those, in all
    graphs at once, and drops the edges that touch them: an aggregate by vertex (minima, which Spark takes where the edges
    are, by hashing) and two anti-joins, whose hot vertices adaptive execution splits.  What is left is written after each round;
    a graph of n edges in random order needs some log n rounds.  Once ``few`` edges are left in all, one task takes them in order, so that
    a long chain does not cost a round for each of its edges.  A last join gives the places their edges."""
    columns = [by, "ord", "u", "v"]
    # Odd places are loops'.
    place = F.monotonically_increasing_id() * 2 + F.when(F.col("u") == F.col("v"), 1).otherwise(0)
    placed = settled(edges.select(columns).dropna().orderBy("ord", "u", "v").withColumn("place", place))
    left = placed.select(by, "place", "u", "v")
    rounds, n = [left.where("false").select("place")], left.count()
    while n > few:
        ends = left.select(by, "place", F.explode(F.array("u", "v")).alias("vertex"))
        first = ends.groupBy(by, "vertex").agg(F.min("place").alias("place"))
        sides = first.groupBy(by, "place").agg(F.count(F.lit(1)).alias("sides"), F.min("vertex").alias("one"), F.max("vertex").alias("other"))
        taken = settled(sides.where((F.col("sides") == 2) | (F.col("place") % 2 == 1)).drop("sides"))
        gone = taken.select(by, F.explode(F.array_distinct(F.array("one", "other"))).alias("vertex"))
        for end in ("u", "v"):
            left = left.join(gone.withColumnRenamed("vertex", end), [by, end], "left_anti").select(by, "place", "u", "v")
        rounds.append(taken.select("place"))
        left = settled(left)
        n = left.count()

    def in_order(batches):
        used, keep = set(), []
        for graph, at, u, v in sorted((r for b in batches for r in b[[by, "place", "u", "v"]].itertuples(index=False, name=None)), key=lambda r: r[1]):
            ends = {(graph, u), (graph, v)}
            if not ends & used:
                used |= ends
                keep.append(at)
        yield pd.DataFrame({"place": keep}, dtype="int64")

    if n:
        rounds.append(left.coalesce(1).mapInPandas(in_order, "place long"))  # ``few`` rows at most
    return placed.join(reduce(DataFrame.unionByName, rounds), "place", "left_semi").select(columns)


def matching_cover(matching: DataFrame, by: str = "graph_id") -> DataFrame:
    """``by, vertex``: both ends of the edges of a matching, which cover all edges and are twice as many as needed at most."""
    return matching.select(by, F.explode(F.array_distinct(F.array("u", "v"))).alias("vertex"))


def cover_counts(edges: DataFrame, matching: DataFrame, by: str = "graph_id") -> DataFrame:
    """``size, matched, covers`` of each graph that has edges: vertices of the cover, edges of the matching, and whether every edge has an end in the cover."""
    matching = settled(matching)  # four steps read it
    cover = matching_cover(matching, by)
    bare = edges.select(by, "u", "v").dropna()
    for end in ("u", "v"):
        bare = bare.join(cover.withColumnRenamed("vertex", end), [by, end], "left_anti").select(by, "u", "v")
    own = cover.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    taken = matching.groupBy(by).agg(F.count(F.lit(1)).alias("matched"))
    open_ = bare.select(by).distinct().withColumn("open", F.lit(True))
    return taken.join(own, by).join(open_, by, "left").select(by, "size", "matched", F.col("open").isNull().alias("covers"))


class Network:
    """Directed edges with capacities; edge ``i ^ 1`` is the other way of edge ``i``."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.full: list[int] = []

    def add(self, u: int, v: int, cap: int) -> None:
        for a, b, c in ((u, v, cap), (v, u, 0)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.left.append(c)
            self.full.append(c)

    def levels(self, source: int) -> tuple[list[int], list[int]]:
        """Distance of each node in edges that have room (-1: none), and the edge it was reached by."""
        level, via = [-1] * len(self.out), [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.left[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]], via[self.to[e]] = level[u] + 1, e
                    queue.append(self.to[e])
        return level, via

    def shortest_paths(self, source: int, sink: int) -> tuple[int, int]:
        """Flow and number of augmentations, always along a shortest path."""
        if source == sink:
            raise ValueError("source and sink are one node")
        flow, times = 0, 0
        while True:
            level, via = self.levels(source)
            if level[sink] < 0:
                return flow, times
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            room = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= room
                self.left[e ^ 1] += room
            flow, times = flow + room, times + 1

    def blocking_flows(self, source: int, sink: int) -> tuple[int, int]:
        """Flow and number of phases, each of which blocks all shortest paths."""
        if source == sink:
            raise ValueError("source and sink are one node")
        flow, phases = 0, 0
        while True:
            level, _ = self.levels(source)
            if level[sink] < 0:
                return flow, phases
            phases += 1
            at = [0] * len(self.out)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    room = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= room
                        self.left[e ^ 1] += room
                    flow += room
                    first = next(k for k, e in enumerate(path) if self.left[e] == 0)
                    u = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[u] < len(self.out[u]):
                    e = self.out[u][at[u]]
                    if self.left[e] > 0 and level[self.to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(self.out[u]):
                    path.append(self.out[u][at[u]])
                    u = self.to[path[-1]]
                elif u == source:
                    break
                else:
                    u = self.to[path.pop() ^ 1]
                    at[u] += 1

    def cut(self, source: int) -> list[tuple[int, int, int]]:
        """Edges from the nodes that have room from the source to the others, after a flow."""
        level, _ = self.levels(source)
        return [(self.to[e ^ 1], self.to[e], self.full[e]) for e in range(0, len(self.to), 2) if level[self.to[e ^ 1]] >= 0 > level[self.to[e]] and self.full[e] > 0]

    def used(self, u: int) -> list[int]:
        """Targets of the full edges out of a node."""
        return [self.to[e] for e in self.out[u] if e % 2 == 0 and self.left[e] == 0 and self.full[e] > 0]


def _network(rows: pd.DataFrame) -> Network:
    net = Network(int(max(rows["u"].max(), rows["v"].max(), rows["source"].max(), rows["sink"].max())) + 1)
    for u, v, c in rows.sort_values("ord")[["u", "v", "cap"]].itertuples(index=False):
        net.add(int(u), int(v), int(c))
    return net


def max_flow(edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """``flow, augmentations, phases, cut_capacity`` of each graph of ``ord, u, v, cap, source, sink``."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        source, sink = int(rows["source"].iloc[0]), int(rows["sink"].iloc[0])
        one, other = _network(rows), _network(rows)
        flow, times = one.shortest_paths(source, sink)
        again, phases = other.blocking_flows(source, sink)
        if flow != again:
            raise AssertionError("the two flows differ")
        return pd.DataFrame({by: rows[by].iloc[:1], "flow": [flow], "augmentations": [times], "phases": [phases], "cut_capacity": [sum(c for *_, c in one.cut(source))]})

    kind = edges.schema[by].dataType.simpleString()
    return edges.groupBy(by).applyInPandas(solve, f"{by} {kind}, flow long, augmentations long, phases long, cut_capacity long")


def min_cut(edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """``u, v, cap`` of the edges of the cut nearest to the source."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        source = int(rows["source"].iloc[0])
        net = _network(rows)
        net.shortest_paths(source, int(rows["sink"].iloc[0]))
        return pd.DataFrame([(rows[by].iloc[0], *e) for e in net.cut(source)], columns=[by, "u", "v", "cap"])

    kind = edges.schema[by].dataType.simpleString()
    return edges.groupBy(by).applyInPandas(solve, f"{by} {kind}, u long, v long, cap long")


def assign(choices: DataFrame, by: str = "doc_id") -> DataFrame:
    """``error, candidate`` for each error of a group: as many different candidates as possible, each used once.

    ``choices``: ``by, error, error_ord, candidate, rank``.  Errors and candidates are numbered as first seen, so
    the assignment is always the same; an error that gets none has a null candidate."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["error_ord", "rank"])
        errors = list(dict.fromkeys(rows["error"]))
        found = list(dict.fromkeys(rows["candidate"].dropna()))
        number = {c: 1 + len(errors) + k for k, c in enumerate(found)}
        sink = 1 + len(errors) + len(found)
        net = Network(sink + 1)
        for k in range(len(errors)):
            net.add(0, 1 + k, 1)
        place = {e: 1 + k for k, e in enumerate(errors)}
        for e, c in rows[["error", "candidate"]].dropna().drop_duplicates().itertuples(index=False):
            net.add(place[e], number[c], 1)
        for c in found:
            net.add(number[c], sink, 1)
        net.shortest_paths(0, sink)
        names = {n: c for c, n in number.items()}
        taken = [next((names[t] for t in net.used(place[e]) if t in names), None) for e in errors]
        return pd.DataFrame({by: rows[by].iloc[0], "error": errors, "candidate": taken})

    kind = choices.schema[by].dataType.simpleString()
    return choices.groupBy(by).applyInPandas(solve, f"{by} {kind}, error string, candidate string")
