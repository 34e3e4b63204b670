"""Connected components of a link table, by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond")
each are one aggregation and one join; the table of the links after each round is written to the
shared folder, so that lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.storage import drop, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour (``large``: only larger ones) of a node to the smallest of its circle."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of the undirected
    links ``a``-``b``.  Null ends and loops are ignored; no links give no rows."""
    own = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        done = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if done == mark or not done[0]:
            return own.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = done
        following = materialize(_star(_star(own, True), False), name)
        drop(own)
        own = following
