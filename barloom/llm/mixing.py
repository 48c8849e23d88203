"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Shares are whole numbers; their sum is the period. Block i of a source with weight w = share / period is released at
floor(i / w) and due at ceil((i + 1) / w). One slot after the other takes the released block with the earliest deadline
(then the larger share, then the source's name), so after t slots every source has had less than one block more or less
than t * w. As the weights sum to one, all sources are exactly on target at the end of a period and the schedule repeats:
one period is scheduled, and a block's slot follows from its number by division. A source that runs out leaves its slots
empty, the others keep their order.

Sources with equal shares have the same releases and deadlines, so by that order they take turns: the schedule is made of
classes of equal shares, of which there are fewer than the root of twice the period, however many the sources. Tables of
sources and slots are broadcast up to a stated size only; larger ones are joined like any table.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranks
from .hot import hot_join
from .shared import size_of, through_table

#: Most rows of sources or of slots that are broadcast.
MOST_SENT = 20_000
BLOCK_DOCS = 8
#: Period and exponent of the weights that the query derives from the sources' sizes; with many sources the period is
#: ``SLOTS`` for each of them, so that the least weights still come near their targets.
PERIOD, SLOTS, EXPONENT = 500, 2, 0.5
#: Slots that are scheduled before what they hold is set aside.
CHUNK = 1_000
#: Bytes of one stretch of the mixture.
STRETCH_BYTES = 128 << 20

Shares = dict | DataFrame


def tempered_shares(docs: DataFrame, source: str = "source", period: int | None = None, exponent: float = EXPONENT) -> DataFrame:
    """(source, share): in proportion to (documents of a source) ** exponent, at least 1, near ``period`` in sum.

    With s sources, a share is within 0.5 of its target, but for targets under 0.5, which become 1.
    """
    found = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.pow(F.count(F.lit(1)), F.lit(exponent)).alias("_n"))
    whole = found.agg(F.sum("_n"), F.count(F.lit(1))).first()
    period = period or max(PERIOD, SLOTS * whole[1])
    return found.select("source", F.greatest(F.lit(1), F.floor(period * F.col("_n") / F.lit(float(whole[0] or 1)) + 0.5)).cast("long").alias("share"))


def _shares(spark: SparkSession, shares: Shares) -> DataFrame:
    """(source, share, rank) with shares reduced by what divides them all, and the source's place in its class."""
    if isinstance(shares, dict):
        shares = spark.createDataFrame([(k, int(v)) for k, v in shares.items()], "source string, share long")
    shares = shares.select(F.col("source").cast("string").alias("source"), F.col("share").cast("long").alias("share"))
    listed = [r[0] for r in shares.select("share").distinct().collect()]  # fewer than the root of twice the period
    if any(c is None or c < 1 for c in listed):
        raise ValueError("shares must be positive whole numbers")
    common = reduce(gcd, listed, 0) or 1
    place = F.row_number().over(Window.partitionBy("share").orderBy(F.col("source").asc_nulls_first())).cast("long") - 1
    return shares.withColumn("rank", place).withColumn("share", F.expr(f"share div {common}"))


def _class_slots(spark: SparkSession, classes: list[tuple[int, int]]) -> DataFrame:
    """(share, turn, slot) of one period: in which slot the class of a share has its turn 0, 1, ... ``classes`` are
    (share, sources), larger shares first."""
    period = sum(c * m for c, m in classes)
    listed = ", ".join(f"struct({c}L AS c, {m}L AS m)" for c, m in classes)
    # a step a slot: of the classes' next blocks, that are released, the earliest due; the state is the turns each has had
    step = f"""transform(array(array_min(transform(classes, (k, i) -> CASE WHEN a.had[i] < k.c * k.m AND ((a.had[i] div k.m) * {period}L) div k.c <= t THEN
            named_struct('due', ((a.had[i] div k.m + 1) * {period}L + k.c - 1) div k.c, 'i', i) END)).i),
        x -> named_struct('had', transform(a.had, (h, i) -> h + if(i = x, 1L, 0L)), 'out', concat(a.out, array(named_struct('i', x, 'turn', a.had[x])))))[0]"""
    empty = "cast(array() AS array<struct<i:int,turn:bigint>>)"
    chunks = -(-period // CHUNK)
    inner = f"aggregate(sequence(n * {CHUNK}, least((n + 1) * {CHUNK}, {period}) - 1), named_struct('had', s.had, 'out', {empty}), (a, t) -> {step})"
    steps = spark.sql(f"""
        SELECT aggregate(sequence(0, {chunks - 1}), named_struct('had', transform(classes, k -> 0L), 'all', cast(array() AS array<array<struct<i:int,turn:bigint>>>)),
            (s, n) -> transform(array({inner}), r -> named_struct('had', r.had, 'all', concat(s.all, array(r.out))))[0]).all AS all, transform(classes, k -> k.c) AS shares
        FROM (SELECT array({listed}) AS classes)""")
    rows = steps.select("shares", F.posexplode("all").alias("n", "out")).select("shares", "n", F.posexplode("out").alias("k", "x"))
    return rows.select(F.get("shares", F.col("x.i")).alias("share"), F.col("x.turn").alias("turn"), (F.col("n").cast("long") * CHUNK + F.col("k")).alias("slot"))


def period_schedule(spark: SparkSession, shares: Shares) -> DataFrame:
    """Rows (source, share, turn, slot, period): in which slot of a period a source's blocks 0, 1, ... stand."""
    given = _shares(spark, shares)
    slots, sizes, period, sources = _schedule(spark, given)
    slots = slots.join(sizes, "share").select("share", F.expr("turn div _m").alias("turn"), (F.col("turn") % F.col("_m")).alias("rank"), "slot")
    return given.join(slots, ["share", "rank"]).select("source", "share", "turn", "slot", F.lit(period).alias("period"))


def _schedule(spark: SparkSession, given: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(slots of classes, sources of each class, period, sources)."""
    classes = [(r["share"], r["n"]) for r in given.groupBy("share").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("share").desc()).collect()]
    period = sum(c * m for c, m in classes)
    sizes = spark.createDataFrame(classes, "share long, _m long")
    slots = _class_slots(spark, classes) if classes else spark.createDataFrame([], "share long, turn long, slot long")
    return slots, F.broadcast(sizes), period, sum(m for _, m in classes)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def mix(docs: DataFrame, shares: Shares, block_docs: int = BLOCK_DOCS, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row's doc_id and source with its ``block`` in the source, ``release``, ``deadline``, ``slot`` and ``place`` in the block.

    Sorted by (slot, place) the rows are the mixture. Other columns are left aside. Within a source, rows follow a hash of
    their id, so repeated rows stay apart rows. A null source is a source of its own, a null id an id. A source without a
    share is refused: nothing is dropped. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"))
    given = _shares(spark, shares)
    slots, sizes, period, sources = _schedule(spark, given)
    # the key of a null source is no text that a source can be
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    known = given.select(named.alias("_key"), F.col("share").alias("_share"), "rank").join(sizes.select(F.col("share").alias("_share"), "_m"), "_share")
    unknown = docs.select(named.alias("_key"), "source").distinct().join(_sent(known, sources), "_key", "left_anti").select("source").limit(5).collect()
    if unknown:
        raise ValueError(f"sources without a share: {[r[0] for r in unknown]}")
    mixed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    ranked = ranks.numbered(docs, "source", mixed, ["doc_id"], "_rank", ranks.bucket_count(docs.count()))
    ranked = ranked.withColumn("block", F.expr(f"_rank div {block_docs}")).withColumn("place", F.expr(f"cast(_rank % {block_docs} AS int)")).withColumn("_key", named)
    if sources <= MOST_SENT:
        ranked = ranked.join(F.broadcast(known), "_key")
    else:
        ranked = hot_join(through_table(ranked, "ranked"), known, "_key")
    # turns of the class: its sources' blocks of one number stand side by side
    ranked = ranked.withColumn("_turn", F.expr("(block % _share) * _m + rank"))
    of_class = _sent(slots.select(F.col("share").alias("_share"), F.col("turn").alias("_turn"), F.col("slot").alias("_slot")), period)
    return ranked.join(of_class, ["_share", "_turn"]).select(
        "doc_id",
        "source",
        "block",
        F.expr(f"(block * {period}) div _share").alias("release"),
        F.expr(f"((block + 1) * {period} + _share - 1) div _share").alias("deadline"),
        F.expr(f"(block div _share) * {period} + _slot").alias("slot"),
        "place",
    )


def in_order(docs: DataFrame, at: str | Column, partitions: int | None = None) -> DataFrame:
    """``docs`` sorted by ``at`` over all partitions: each is a stretch of the order, and they follow each other."""
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(docs) // STRETCH_BYTES))
    return docs.repartitionByRange(n, at).sortWithinPartitions(at)


def mixed_order(docs: DataFrame, shares: Shares | None = None, block_docs: int = BLOCK_DOCS, partitions: int | None = None, at: str | None = None) -> DataFrame:
    """All rows of ``docs`` with their own columns, laid out in the order of the mixture: each partition is a stretch of it.

    Only ids and sources are scheduled; the texts are joined to their slots and sorted once. Files that are written from
    the rows are not read again in their order: a column named ``at``, if any, keeps each row's place for ``in_order``.
    Rows that repeat an id stand side by side, in the first of their places.
    """
    shares = tempered_shares(docs) if shares is None else shares
    placed = mix(docs, shares, block_docs).select(F.col("doc_id").alias("_id"), "slot", "place")
    placed = placed.groupBy("_id").agg(F.min(F.struct("slot", "place", "_id")).alias("_at"))
    held = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"))
    joined = held.join(placed, F.col("_doc").eqNullSafe(F.col("_id"))).select("_row", "_at")
    partitions = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(docs) // STRETCH_BYTES))
    return in_order(joined, "_at", partitions).select("_row.*", *([F.col("_at").alias(at)] if at else []))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mixture of all sources by the square root of their sizes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, tempered_shares(docs))


SQL1 = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
s0 AS (SELECT source, greatest(1, floor(greatest({PERIOD}, {SLOTS} * (SELECT count(*) FROM n)) * sqrt(c) / (SELECT sum(sqrt(c)) FROM n) + 0.5))::BIGINT AS share FROM n),
s AS (SELECT source, share // (SELECT list_reduce(list(share), lambda a, b: gcd(a, b)) FROM s0) AS share FROM s0),
p AS (SELECT sum(share)::BIGINT AS period FROM s),
b AS (SELECT source, share, unnest(range(share)) AS turn FROM s),
j AS (SELECT source, share, turn, (turn * period) // share AS release, ((turn + 1) * period + share - 1) // share AS due,
             row_number() OVER (PARTITION BY source ORDER BY turn) AS k FROM b, p),
js AS (SELECT list(struct_pack(due := due, source := source, turn := turn, release := release) ORDER BY due, share DESC, source NULLS FIRST, turn) AS todo FROM j),
e AS (SELECT 0::BIGINT AS t, todo, NULL::VARCHAR AS source, NULL::BIGINT AS turn FROM js
      UNION ALL
      SELECT t + 1, list_filter(todo, lambda x: NOT (x.source IS NOT DISTINCT FROM pick.source AND x.turn = pick.turn)), pick.source, pick.turn
      FROM (SELECT t, todo, list_filter(todo, lambda x: x.release <= t)[1] AS pick FROM e WHERE len(todo) > 0)),
slots AS (SELECT source, turn, t - 1 AS slot FROM e WHERE turn IS NOT NULL),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY m, doc_id) - 1 AS k
      FROM (SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS m FROM documents)),
q AS (SELECT doc_id, r.source, k // {BLOCK_DOCS} AS block, (k % {BLOCK_DOCS})::INT AS place, share, period
      FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source, p)
SELECT doc_id, q.source, block, (block * period) // share AS release, ((block + 1) * period + share - 1) // share AS deadline,
       (block // share) * period + slot AS slot, place
FROM q JOIN slots ON q.source IS NOT DISTINCT FROM slots.source AND slots.turn = block % share
"""
