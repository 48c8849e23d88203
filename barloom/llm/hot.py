"""Joins in which a key of the left side may hold a large share of all rows.

Keys with more than one ten-thousandth of the left side's rows are at most ten thousand, so the few rows of the right
side that they need are broadcast, and the left side's rows stay where they are. All other keys are shuffled; none of
them is more than a ten-thousandth of the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are broadcast.
MOST_HOT = 10_000


def hot_keys(left: DataFrame, key: str, least: int = 1) -> DataFrame:
    """(key, _rows) of the keys that stand in more than 1 / MOST_HOT of the rows, and in more than ``least``."""
    counted = left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > max(least, left.count() // MOST_HOT))


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = 1) -> DataFrame:
    """``left`` joined with ``right`` on the column ``key`` of both; inner, left or left_semi.

    ``right`` has each key once; ``left`` is read three times, so it should be a table. Null keys match nothing.
    """
    hot = F.broadcast(hot_keys(left, key, least).select(key))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    if how != "inner":
        few = F.broadcast(hot.join(few, key, "left")) if how == "left" else few
    cold = left.join(hot, key, "left_anti")
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(cold.join(right, key, how))


def _ways(left: DataFrame, key: str, least: int) -> DataFrame:
    """(key, _ways) of the hot keys: into how many parts their rows are dealt."""
    most = max(least, left.count() // MOST_HOT)
    counted = left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
    return F.broadcast(counted.select(key, F.ceil(F.col("_rows") / most).cast("int").alias("_ways")))


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame, least: int = 1) -> DataFrame:
    """``left`` joined with ``right``, which has each key once but may have large rows, so that none of them is broadcast.

    A hot key's rows on the left are dealt by a hash of the column ``by``, and its row on the right is sent to each part.
    ``counted`` is a table with the left side's keys.
    """
    ways = _ways(counted, key, least)
    dealt = left.join(ways, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_ways", F.lit(1))).cast("int")).drop("_ways")
    copied = right.join(ways, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def block_pairs(rows: DataFrame, key: str, by: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, with columns _one and _two: joined on (key, _one, _two), every pair of rows of a key meets, each
    order once. A hot key's rows are cut into blocks by a hash of ``by``; every pair of blocks is a group of its own."""
    ways = _ways(rows, key, least)
    cut = rows.join(ways, key, "left").withColumn("_ways", F.coalesce("_ways", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(by), "_ways").cast("int"))
    every = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways")
    return every.withColumnsRenamed({"_own": "_one", "_other": "_two"}), every.withColumnsRenamed({"_own": "_two", "_other": "_one"})
