"""Shards by fixed virtual slots, in DataFrame operations only.

A record's id alone decides its virtual slot, one of ``SLOTS`` for good.  A versioned table maps slots
to shards: version 1 deals them out evenly, ``grow`` makes the next version for one more shard by
moving an even share of slots to it and none elsewhere, and ``rebalance`` makes a version that moves
no more slots than it takes to even out the bytes that were measured for each slot.  ``save_map`` and ``load_map`` keep all versions in
a folder.  The maps have ``SLOTS`` rows whatever the data, so they alone are broadcast.

A record's place in its shard is the number of records before it: counts for each bucket (``BUCKETS``
of them, a slot has several) are summed up before the records of a bucket are numbered, so no task
takes a whole shard.  Only id, size and checksum are shuffled, never a text.

Defined results.  A null text has no bytes and checksum 0.  All rows without id, and all rows of one
id, are in one slot, since the id decides; their places are dealt by size, checksum and the row's number, so a
hot id is numbered by many tasks.  Places of repeated rows are in any order, each once.  Other columns are ignored.  An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphflow.llm.storage import materialize, new_path

SHARDS = 24
SLOTS = 4096
SPLITS = 16
BUCKETS = SLOTS * SPLITS


def slot_of(id_col: str = "doc_id", slots: int = SLOTS) -> F.Column:
    """From the first 32 bits of the id's MD5; no id counts as an empty one."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: ``version, virtual_slot, shard``."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def latest(maps: DataFrame) -> DataFrame:
    """The newest version of a table of versions."""
    return maps.join(F.broadcast(maps.agg(F.max("version").alias("version"))), "version", "left_semi")


def grow(slot_map: DataFrame) -> DataFrame:
    """The next version, with one more shard.  Every shard gives the new one its slots beyond the new
    even share, the highest first; the number of shards alone decides which."""
    one = Window.partitionBy("version")
    ranked = slot_map.withColumns({"shards": F.max("shard").over(one) + 1, "slots": F.count(F.lit(1)).over(one), "n": F.row_number().over(Window.partitionBy("version", "shard").orderBy("virtual_slot"))})
    share = F.floor(F.col("slots") / (F.col("shards") + 1)) + F.when(F.col("shard") < F.col("slots") % (F.col("shards") + 1), 1).otherwise(0)
    return ranked.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("n") > share, F.col("shards")).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, slot_bytes: DataFrame) -> DataFrame:
    """The next version: the map edited so that the bytes of ``slot_bytes`` (``virtual_slot, bytes``) are more even.

    A shard beyond the even share gives up slots, the largest that still fit into its excess first; each of them, the largest first, goes to
    the shard that lacks most.  All other slots stay, so no more bytes move than were in excess, and an even map stays as it is.
    The folds are over the slots, of which there is a fixed number, whatever the data."""
    one = Window.partitionBy("version")
    sized = slot_map.join(F.broadcast(slot_bytes), "virtual_slot", "left").withColumn("bytes", F.coalesce(F.col("bytes"), F.lit(0)).cast("long"))
    share = sized.withColumns({"shards": F.max("shard").over(one) + 1, "total": F.sum("bytes").over(one)}).withColumn("share", F.expr("total div shards"))
    shards = share.groupBy("version", "shards", "share", "shard").agg(F.sum("bytes").alias("held"), F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False).alias("slots"))
    none = F.array().cast("array<struct<bytes:bigint,virtual_slot:int>>")

    def give(acc: F.Column, s: F.Column) -> F.Column:
        fits = (s["bytes"] > 0) & (s["bytes"] <= acc["excess"])
        return F.struct(F.when(fits, acc["excess"] - s["bytes"]).otherwise(acc["excess"]).alias("excess"), F.when(fits, F.array_append(acc["given"], s)).otherwise(acc["given"]).alias("given"))

    start = F.struct((F.col("held") - F.col("share")).alias("excess"), none.alias("given"))
    asked = shards.withColumn("given", F.aggregate("slots", start, give, lambda acc: acc["given"]))
    every = asked.groupBy("version", "shards").agg(
        F.sort_array(F.flatten(F.collect_list("given")), asc=False).alias("pool"),
        F.collect_list(F.struct((F.col("share") - F.col("held")).alias("lack"), F.col("shard"))).alias("known"),
        F.first("share").alias("share"),
    )  # one row: a version's slots and shards
    empty = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda k: F.struct(F.coalesce(F.get(F.transform(F.filter("known", lambda x: x["shard"] == k), lambda x: x["lack"]), F.lit(0)), F.col("share")).alias("lack"), k.alias("shard")))

    def take(acc: F.Column, s: F.Column) -> F.Column:
        to = F.array_max(acc["lacks"])["shard"]
        lacks = F.transform(acc["lacks"], lambda x: F.struct(F.when(x["shard"] == to, x["lack"] - s["bytes"]).otherwise(x["lack"]).alias("lack"), x["shard"].alias("shard")))
        return F.struct(lacks.alias("lacks"), F.array_append(acc["moves"], F.struct(s["virtual_slot"].alias("virtual_slot"), to.alias("to"))).alias("moves"))

    moves = F.aggregate("pool", F.struct(F.col("lacks"), F.array().cast("array<struct<virtual_slot:int,to:int>>").alias("moves")), take, lambda acc: acc["moves"])
    moved = every.withColumn("lacks", empty).select("version", F.explode(moves).alias("m")).select("version", "m.*")
    return slot_map.join(F.broadcast(moved), ["version", "virtual_slot"], "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the table in ``path``."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table in ``path``, the newest if none is named."""
    maps = spark.read.schema("virtual_slot int, shard int, version int").parquet(path).select("version", "virtual_slot", "shard")
    return latest(maps) if version is None else maps.where(F.col("version") == version)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` and the ``bucket`` within which records are numbered."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("virtual_slot", slot_of())
    split = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "row"), F.lit(SPLITS)).cast("int")
    return rows.withColumn("bucket", F.col("virtual_slot") * SPLITS + split)


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` (``measured``, written) with ``shard`` and their place ``slot`` in it."""
    buckets = rows.groupBy("bucket", "virtual_slot").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.select("bucket", "shard", before.alias("before"))  # BUCKETS rows at most
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32", "row")) - 1
    return rows.withColumn("number", number).join(F.broadcast(starts), "bucket").withColumn("slot", (F.col("before") + F.col("number")).cast("long")).drop("number", "before")


def query(spark, sf_dir: str) -> DataFrame:
    """Version 1 of the map is stored and loaded, edited for the measured bytes and stored as version 2; shards are those of version 1, since
    the id and the number of shards alone decide."""
    rows = materialize(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    slot_bytes = rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"))
    maps = new_path(spark, "slot-map")
    save_map(first_map(spark), maps)
    one = load_map(spark, maps, 1)
    save_map(rebalance(one, slot_bytes.withColumnRenamed("slot_bytes", "bytes")), maps)
    more = grow(one).select("virtual_slot", F.col("shard").alias("grown_shard"))
    even = load_map(spark, maps).select("virtual_slot", F.col("shard").alias("balanced_shard"))
    told = one.select("virtual_slot", F.col("version").alias("map_version")).join(more, "virtual_slot").join(even, "virtual_slot").join(slot_bytes, "virtual_slot")
    out = assign(rows, one).join(F.broadcast(told), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "map_version", "balanced_shard", "slot_bytes")
