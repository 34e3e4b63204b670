"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = 16
SMALL_BYTES = 16 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint, only where so many rows of so many bytes are small."""
    return F.broadcast(df) if rows * row_bytes <= SMALL_BYTES else df


def salted_left_join(rows: DataFrame, one: DataFrame, keys: list[str], spread: Column, salt: int = SALT) -> DataFrame:
    """Left join of ``rows`` with ``one``, which has a row for each key at most.

    Rows of one key go to ``salt`` tasks by ``spread``; each row of ``one`` is sent to all of them."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, [*keys, "__salt"], "left").drop("__salt")


def left_join(rows: DataFrame, one: DataFrame, keys: list[str], spread: Column, one_rows: int, row_bytes: int) -> DataFrame:
    """Left join with a table of a row for each key at most: broadcast if that is small, else salted."""
    if one_rows * row_bytes <= SMALL_BYTES:
        return rows.join(F.broadcast(one), keys, "left")
    return salted_left_join(rows, one, keys, spread)


def inner_join(rows: DataFrame, one: DataFrame, keys: list[str], spread: Column, one_rows: int, row_bytes: int, salt: int = SALT) -> DataFrame:
    """Inner join with a table of a row for each key: broadcast if that is small, else salted."""
    if one_rows * row_bytes <= SMALL_BYTES:
        return rows.join(F.broadcast(one), keys)
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int"))
    return left.join(one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))), [*keys, "__salt"]).drop("__salt")
