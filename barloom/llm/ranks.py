"""Distributed gapless numbering of rows, in DataFrame operations only.

A plain ``row_number() over (partition by key)`` sends a whole key to one task, and a key may hold a third of all rows.
Here a key's rows are dealt into many buckets by a hash of their id, numbered inside each bucket, and shifted by the
number of rows in the key's earlier buckets. The bucket counts are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket holds on average at most, over all keys.
BUCKET_ROWS = 20_000
#: Fewest buckets, so that small inputs are spread as large ones are.
LEAST_BUCKETS = 256


def bucket_count(rows: int) -> int:
    """Buckets for a table of this many rows: in proportion to it."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def numbered(df: DataFrame, key: str, mixed: Column, ties: list[str], name: str, buckets: int) -> DataFrame:
    """``df`` with a column ``name``: a gapless number from 0 inside each value of ``key`` (null is a value too).

    ``mixed`` is a well-spread whole number of the row from 0 to 2 ** 60 - 1; rows are numbered by (itself, ``ties``). Its
    highest bits make the buckets, so their number never shows in the result. The ties should make the order total;
    rows equal in all of them are copies and may swap their numbers.
    """
    bits = max(0, (buckets - 1).bit_length())
    df = df.withColumn("_m", mixed).withColumn("_b", F.shiftright("_m", 60 - bits).cast("int"))
    counts = df.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_k", "_kb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_b").orderBy("_m", *ties)
    ranked = df.withColumn("_r", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, ranked[key].eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return joined.withColumn(name, (F.col("_start") + F.col("_r")).cast("long")).drop("_m", "_b", "_k", "_kb", "_start", "_r")
