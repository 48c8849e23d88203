"""Sharding by a minimax contiguous partition.

Rows with equal texts form one group, which no cut divides. Groups stand in the order of a 64-bit hash of their text.
The smallest capacity is sought for which a greedy walk over the ordered group sizes needs no more than the wanted
number of shards, and the cuts are made where that walk makes them.

The walk never sees all groups: it works on cells, ranges of the hash, whose sizes are summed by Spark. A probe of a
capacity is certain when it fails even if cells could be cut anywhere, or succeeds without cutting any. Between these
two, only cells that some greedy cut may fall into are split into 64 finer ones each, until those hold one group. So the driver
holds a number of cells that the number of shards bounds, whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranks
from .shared import through_table

#: Bits of the hash in a first cell, and bits that each refinement adds.
FIRST_BITS, MORE_BITS = 12, 6
SHARDS = 16
_SIGN = 1 << 63


def _text_hash(text: Column) -> Column:
    """An unsigned order of hashes, as signed longs."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _walk(cells: list[tuple[int, int, int, bool]], prefix: list[int], capacity: int, shards: int, loose: bool) -> list[float] | None:
    """Prefix sums at which a greedy walk with this capacity cuts, or None if it needs more shards.

    ``loose``: cells that hold several groups may be cut anywhere, else nowhere.
    """
    at, total, cuts = 0, prefix[-1], []
    for _ in range(shards):
        reach = at + capacity
        if reach >= total:
            return cuts
        i = bisect_right(prefix, reach) - 1  # cells before i fit whole
        here = prefix[i]
        if loose and not cells[i][3]:
            here = reach
        if here <= at:
            return None
        cuts.append(here)
        at = here
    return None


def _smallest(cells: list, prefix: list[int], low: int, high: int, shards: int, loose: bool) -> int:
    while low < high:
        mid = (low + high) // 2
        if _walk(cells, prefix, mid, shards, loose) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _cells(hashed: DataFrame, ranges: list[tuple[int, int]] | None, coarse: int, bits: int) -> list[tuple[int, int, int, bool]]:
    """(first hash, last hash, summed size, is one group) of the cells of ``bits`` with rows, in order; only inside the
    given ranges, which are cells of ``coarse`` bits."""
    shift = 64 - bits
    cell = F.shiftright(F.col("_h"), shift) if shift else F.col("_h")
    if ranges is not None:
        wanted = hashed.sparkSession.createDataFrame(ranges, "_lo long, _hi long")  # bounded: a few cells for each cut
        hashed = hashed.join(F.broadcast(wanted), F.shiftright("_h", 64 - coarse) == F.shiftright("_lo", 64 - coarse), "left_semi")
    rows = hashed.groupBy(cell.alias("c")).agg(F.sum("_size").alias("s"), F.min("_h").alias("a"), F.max("_h").alias("b")).collect()
    out = []
    for r in sorted(rows, key=lambda r: r["c"]):
        lo = r["c"] << shift
        out.append((lo, lo + (1 << shift) - 1, int(r["s"]), r["a"] == r["b"]))
    return out


def minimax_cuts(hashed: DataFrame, shards: int) -> tuple[list[int], int]:
    """(The hashes that shards 1, 2, ... begin with, the smallest capacity) of rows (_h, _size), which are read once for
    each level of cells."""
    cells = _cells(hashed, None, 0, FIRST_BITS)
    if not cells:
        return [], 0
    while True:
        prefix = [0]
        for c in cells:
            prefix.append(prefix[-1] + c[2])
        least = max([-(-prefix[-1] // shards), *(c[2] for c in cells if c[3])])
        low = _smallest(cells, prefix, least, prefix[-1], shards, loose=True)
        high = _smallest(cells, prefix, low, prefix[-1], shards, loose=False)
        # the k-th cut of the true walk lies between that of a walk that is too strict and one that is too generous
        strict = _walk_floor(cells, prefix, low, shards)
        generous = _walk(cells, prefix, high, shards, loose=True) or []
        split = set()
        for k in range(max(len(strict), len(generous))):
            a = strict[k] if k < len(strict) else prefix[-1]
            b = generous[k] if k < len(generous) else prefix[-1]
            a, b = min(a, b), max(a, b)
            for i in range(max(0, bisect_left(prefix, a) - 1), min(len(cells), bisect_right(prefix, b))):
                if not cells[i][3]:
                    split.add(i)
        if not split:
            capacity = _smallest(cells, prefix, least if not split else low, prefix[-1], shards, loose=False)
            cuts = _walk(cells, prefix, capacity, shards, loose=False) or []
            return [cells[bisect_left(prefix, c)][0] for c in cuts], capacity
        # only the widest cells are split further; narrower ones wait until the others have caught up
        widest = max(cells[i][1] - cells[i][0] for i in split)
        now = {i for i in split if cells[i][1] - cells[i][0] == widest}
        coarse = 64 - ((widest + 1).bit_length() - 1)
        finer = _cells(hashed, [(cells[i][0], cells[i][1]) for i in sorted(now)], coarse, min(64, coarse + MORE_BITS))
        kept = [c for i, c in enumerate(cells) if i not in now]
        cells = sorted(kept + finer)


def _walk_floor(cells: list, prefix: list[int], capacity: int, shards: int) -> list[float]:
    """Least prefix sums at which the k-th cut of a greedy walk with this capacity can lie."""
    at, cuts = 0, []
    for _ in range(shards):
        if at + capacity >= prefix[-1]:
            break
        i = bisect_right(prefix, at + capacity) - 1
        at = max(prefix[i], at)
        cuts.append(at)
        if i < len(cells) and prefix[i] == (cuts[-2] if len(cuts) > 1 else 0):
            break
    return cuts


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, size, text_crc32, shard, slot) of every row.

    Null texts count as empty ones: size 1, checksum 0, one group. Rows that repeat are rows of their own, with slots of
    their own. An empty table gives no rows. Shards may stay empty where few large groups fill the others.
    """
    none = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(none) + 1).cast("long").alias("_size"), F.crc32(none.cast("binary")).alias("text_crc32"), _text_hash(F.col(text)).alias("_h"))
    sized = through_table(sized, "hashes")  # texts are read and hashed once
    cuts, _ = minimax_cuts(sized.select("_h", "_size"), shards)
    shard = F.lit(0)
    for k, cut in enumerate(cuts, 1):
        shard = F.when(F.col("_h") >= F.lit(cut), F.lit(k)).otherwise(shard)
    placed = sized.select("doc_id", F.col("_size").alias("size"), "text_crc32", shard.cast("int").alias("shard"))
    n = sized.count()
    return ranks.numbered(placed, "shard", F.shiftrightunsigned(F.xxhash64("doc_id"), 4), ["doc_id", "text_crc32"], "slot", ranks.bucket_count(n))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
