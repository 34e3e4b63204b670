"""The slot map is edited, stored and loaded; the query's columns by hand."""

import random
from hashlib import md5
from zlib import crc32

from corpus import rows, table
from pyspark.sql import functions as F

from glyphflow.llm import sharding


def held(maps, sizes, shards):
    out = [0] * shards
    for slot, shard in maps.items():
        out[shard] += sizes.get(slot, 0)
    return out


def read(df):
    return {r.virtual_slot: r.shard for r in df.collect()}


def test_only_the_excess_moves(spark):
    rng = random.Random(2)
    one = sharding.first_map(spark, 6, 120)
    before = read(one)
    sizes = {k: rng.randrange(1, 50) * (8 if k % 6 == 2 else 1) for k in range(120) if k != 7} | {4: 0}
    found = sharding.rebalance(one, spark.createDataFrame(list(sizes.items()), "virtual_slot int, bytes long"))
    after = read(found)
    assert set(after) == set(before) and {r.version for r in found.collect()} == {2}
    was, now, share = held(before, sizes, 6), held(after, sizes, 6), sum(sizes.values()) // 6
    moved = [k for k in after if after[k] != before[k]]
    assert moved and sum(sizes.get(k, 0) for k in moved) <= sum(max(0, b - share) for b in was)
    assert all(was[before[k]] > share for k in moved)
    assert max(now) - min(now) < (max(was) - min(was)) / 4


def test_an_even_map_stays(spark):
    one = sharding.first_map(spark, 4, 64)
    even = spark.createDataFrame([(k, 10) for k in range(64)], "virtual_slot int, bytes long")
    assert read(sharding.rebalance(one, even)) == read(one)
    nothing = spark.createDataFrame([], "virtual_slot int, bytes long")
    assert read(sharding.rebalance(one, nothing)) == read(one)
    again = sharding.rebalance(one, even.withColumn("bytes", F.when(F.col("virtual_slot") < 8, 30).otherwise(F.col("bytes"))))
    assert read(sharding.rebalance(again, even.withColumn("bytes", F.when(F.col("virtual_slot") < 8, 30).otherwise(F.col("bytes"))))) == read(again)


def test_an_empty_shard_is_filled(spark):
    """Shard 1 has no slot at all."""
    given = spark.createDataFrame([(1, k, 0 if k < 8 else 2) for k in range(16)], "version int, virtual_slot int, shard int")
    sizes = {k: 6 for k in range(16)}
    after = read(sharding.rebalance(given, spark.createDataFrame(list(sizes.items()), "virtual_slot int, bytes long")))
    assert held(after, sizes, 3) == [36, 30, 30] or max(held(after, sizes, 3)) <= 36


def test_query(spark, tmp_path):
    given = [*rows(), (3, "again"), (3, "again"), (None, "no id"), (None, None)]
    table(spark, given).write.parquet(str(tmp_path / "documents.parquet"))
    found = sharding.query(spark, str(tmp_path)).collect()
    slot = lambda i: int(md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % 4096
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, crc32((t or "").encode()), slot(i) % 24) for i, t in given)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.shard) for r in found) == want
    places = {}
    for r in found:
        assert r.law == "key" and r.grown_shard in (r.shard, 24) and 0 <= r.balanced_shard < 24 and r.map_version == 1
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
