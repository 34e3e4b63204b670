"""Prefix sums in groups and over whole tables, work and span, primality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphflow.functions.lineage import settled

#: These bases decide primality for all 64-bit numbers.
WITNESSES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37]
TRIAL_LIMIT = 10**12


def exclusive_scan(df: DataFrame, value: str, order: list[str], by: list[str], name: str = "scan") -> DataFrame:
    """Sum of the values before each row of its group."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def scan_check(scanned: DataFrame, value: str, order: list[str], by: list[str], scan: str = "scan") -> DataFrame:
    """``agrees``: whether each scan is the one before it and that one's value, and the first is 0."""
    own = Window.partitionBy(*by).orderBy(*order)
    step = F.coalesce(F.lag(scan).over(own) + F.lag(value).over(own), F.lit(0))
    return scanned.withColumn("__same", F.col(scan) == step).groupBy(*by).agg(F.every("__same").alias("agrees"))


def table_scan(df: DataFrame, value: str, order: list[str], name: str = "scan", partitions: int | None = None) -> DataFrame:
    """Sum of the values of all rows before each row of the whole table, in the order of ``order`` (nulls first), rows of an equal order by value.

    Three steps, none of which has all rows in one task.  The rows are dealt out by ranges of the order and sorted there, and written;
    each range's sum is taken, and the sums before each range are added up on the driver, which holds a number for each
    range; then every range adds up its rows from there.  Null values count as 0; the sums are whole numbers of 64 bits."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, value]
    ranged = settled(df.withColumn(value, F.col(value).cast("long")).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__range", F.spark_partition_id()))
    own = {r["__range"]: r.s for r in ranged.groupBy("__range").agg(F.sum(F.coalesce(value, F.lit(0))).alias("s")).collect()}  # a row a range
    starts, total = {}, 0
    for k in sorted(own):
        starts[k], total = total, total + own[k]

    def run(batches):
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            if before is None:
                before = starts[b["__range"][0].as_py()]
            sums = np.cumsum(pc.fill_null(b[value], 0).to_numpy()) + before
            scan = np.append(before, sums[:-1])
            before = int(sums[-1])
            yield b.drop_columns(["__range"]).append_column(name, pa.array(scan, pa.int64()))

    schema = StructType([*(f for f in ranged.schema if f.name != "__range"), StructField(name, LongType())])
    return ranged.mapInArrow(run, schema)


def table_scan_check(scanned: DataFrame, value: str, scan: str = "scan") -> DataFrame:
    """One row: ``rows``, ``total`` and whether the scan ``agrees``, from the values alone: each range of a ``table_scan`` is checked
    where it is, and the driver sees where each begins and ends."""

    def run(batches):
        first, end, rows, good = None, None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            at, values = b[scan].to_numpy(), pc.fill_null(b[value], 0).to_numpy()
            first = int(at[0]) if first is None else first
            good &= (end is None or end == int(at[0])) and bool((at[1:] == at[:-1] + values[:-1]).all())
            end, rows = int(at[-1] + values[-1]), rows + b.num_rows
        if rows:
            yield pa.RecordBatch.from_pydict({"range": [TaskContext.get().partitionId()], "first": [first], "end": [end], "rows": [rows], "good": [good]})

    ranges = sorted(scanned.select(value, scan).mapInArrow(run, "range long, first long, end long, rows long, good boolean").collect())  # a row a range
    chained = all(a["end"] == b["first"] for a, b in zip(ranges, ranges[1:])) and (not ranges or ranges[0]["first"] == 0)
    told = (sum(r["rows"] for r in ranges), ranges[-1]["end"] if ranges else 0, chained and all(r["good"] for r in ranges))
    return scanned.sparkSession.createDataFrame([told], "rows long, total long, agrees boolean")


def scan_array(values: Column) -> Column:
    """The same for an array of integers."""
    return F.transform(values, lambda v, i: F.aggregate(F.slice(values, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))


def work_span(lines: DataFrame, by: list[str], count: str = "n", cores: int = 8) -> DataFrame:
    """Work, span, speed-up and Brent's bound of counting the words of each line in parallel."""
    out = lines.groupBy(*by).agg(F.sum(count).alias("work"), F.max(count).alias("longest"), F.count(F.lit(1)).alias("lines"))
    out = out.withColumn("span", (F.col("longest") + F.ceil(F.log2(F.greatest(F.lit(2), "lines").cast("double")))).cast("long"))
    return out.select(*by, "work", "span", (F.col("work") / F.greatest(F.lit(1), "span")).alias("speed_up"), (F.expr(f"work div {cores}") + F.col("span")).alias("bound"))


#: Width of the ranges of numbers that the primes are cut into.
WIDTH = 8192


def prime_blocks(spark: SparkSession, limit: int, width: int = WIDTH) -> DataFrame:
    """``block, primes``: the primes up to ``limit``, those from ``block * width`` on in one row.

    A segmented sieve: each row is sieved by itself, with the primes up to the root of the limit, so a task holds one range."""
    blocks = limit // width + 1

    def sieve(batches):
        root = int(limit**0.5) + 1
        small = np.ones(root + 1, bool)
        small[:2] = False
        for p in range(2, int(root**0.5) + 1):
            if small[p]:
                small[p * p :: p] = False
        base = np.flatnonzero(small)
        for b in batches:
            for k in b["id"].tolist():
                low = k * width
                own = np.ones(width, bool)
                for p in base[base * base < low + width].tolist():
                    own[max(p * p, -(-low // p) * p) - low :: p] = False
                if not k:
                    own[:2] = False
                found = np.flatnonzero(own) + low
                yield pd.DataFrame({"block": [k], "primes": [found[found <= limit]]})

    return spark.range(blocks, numPartitions=min(blocks, 64)).mapInPandas(sieve, "block long, primes array<long>")


def prime_by_trial(numbers: DataFrame, n: str, name: str = "is_prime", limit: int = TRIAL_LIMIT) -> DataFrame:
    """``numbers`` with whether ``n`` is prime, by division by all primes to the root; null above the limit and for null.

    A number meets the ranges of primes up to its root one by one, so a row holds ``WIDTH`` numbers at most, whatever the number is.
    The ranges are at most the root of the limit in all, so they are broadcast."""
    own = numbers.select(F.col(n).cast("long").alias("__n")).where(F.col("__n").between(4, limit)).distinct()
    most = own.agg(F.max("__n")).first()[0]
    if most is None:
        composite = own
    else:
        blocks = prime_blocks(numbers.sparkSession, math.isqrt(most))
        # The number holds: few bytes of numbers become many rows.
        tasks = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = own.repartition(tasks, "__n").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.sqrt(F.col("__n").cast("double")) / WIDTH).cast("long"))))
        divides = F.exists("primes", lambda p: (p * p <= F.col("__n")) & (F.col("__n") % p == 0))
        composite = met.join(F.broadcast(blocks), "block").where(divides).select("__n").distinct()
    value = F.col(n).cast("long")
    known = composite.withColumn("__composite", F.lit(True))
    out = numbers.join(known, value == F.col("__n"), "left")
    return out.withColumn(name, F.when(value <= limit, (value >= 2) & F.col("__composite").isNull())).drop("__n", "__composite")


#: Below each number, the first so many of the witnesses decide.
FEWER_WITNESSES = [(2047, 1), (1_373_653, 2), (25_326_001, 3), (3_215_031_751, 4), (3_474_749_660_383, 6), (341_550_071_728_321, 7)]
#: Fixed value: up to here a product of two remainders has 63 bits.
SHORT_PRODUCTS = 3_037_000_499


def is_prime(n: Column) -> Column:
    """Whether a 64-bit number is prime, by strong probable-prime tests for bases that leave no exception; null for null.

    Native: powers are folds over the bits of the exponent; products beyond 63 bits are decimals of 38 digits, which hold them exactly."""
    n = n.cast("long")
    wide = lambda c: c.cast("decimal(19,0)")

    def test(times) -> Column:
        m = n - 1
        twos = F.bit_count(m.bitwiseAND(-m) - 1)
        bits = F.filter(F.split(F.bin(F.call_function("shiftright", m, twos)), ""), lambda b: b != "")
        start = F.lit(1).cast("long")

        def power(base: Column) -> Column:
            return F.aggregate(bits, start, lambda y, bit: F.when(bit == "1", times(times(y, y), base)).otherwise(times(y, y)))

        def passes(base: Column) -> Column:
            first = F.transform(F.array(power(base)), lambda y: F.struct(y.alias("y"), ((y == 1) | (y == m)).alias("ok")))[0]
            step = lambda acc, _: F.transform(F.array(F.when(acc["ok"], acc["y"]).otherwise(times(acc["y"], acc["y"]))), lambda y: F.struct(y.alias("y"), (acc["ok"] | (y == m)).alias("ok")))[0]
            again = F.when(twos > 1, F.sequence(F.lit(2), twos)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(again, first, step, lambda acc: acc["ok"])

        used = F.coalesce(*(F.when(n < below, many) for below, many in FEWER_WITNESSES), F.lit(len(WITNESSES)))
        bases = F.slice(F.array(*(F.lit(w).cast("long") for w in WITNESSES)), F.lit(1), used)
        return F.forall(bases, lambda b: F.when(b % n == 0, True).otherwise(passes(b % n)))

    short = test(lambda a, b: a * b % n)
    long = test(lambda a, b: (wide(a) * wide(b) % wide(n)).cast("long"))
    odd = F.when(n <= SHORT_PRODUCTS, short).otherwise(long)
    return F.when(n < 2, False).when(n < 4, True).when(n % 2 == 0, False).when(n.isNotNull(), odd)


def miller_rabin(numbers: DataFrame, n: str, name: str = "is_prime") -> DataFrame:
    """``numbers`` with the same."""
    return numbers.withColumn(name, is_prime(F.col(n)))
