"""Similarity self-join of documents by the Jaccard index of their word shingles.

1. A table of counters counts shingles over all documents; by it every set is ordered, rare shingles first.
2. Of sets that agree in all (copies, but for the order and blanks), one stands for all; its row is their node. What
   follows knows nodes only, never ids, so rows that share an id, or have none, are rows like all others.
3. Two sets that reach the threshold share a shingle within their prefixes. Prefixes are dealt by shingle; shingles that
   only one set has are dropped there, every other becomes a bucket. Its leader is the set in which fewest rarer
   shingles stand before: of near copies, one with few changes, which most others are near to.
4. Each set is compared with the leaders of its buckets, once per pair, by exact intersection. Sets that reach one get
   its label, so a large group of near copies is joined by a star, not by all its pairs.
5. Pairs that still have different labels, share a prefix shingle and pass the length and positional filters are compared,
   once each, whatever their number. Nothing is capped.
6. Components of all links found, and of the sets that one id stands for.

The length, positional and suffix filters only drop pairs that cannot reach the threshold; the suffix filter, on counts of
the sets' hashes by their highest bits, is applied before any set is moved. Sets are compared by 64-bit hashes of
shingles, and are taken for one where 128 bits and their sizes agree. No key of a join or group is hot: see ``hot``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .fixed import fixed_table
from .hot import block_pairs, hot_join, salted_join
from .shared import Scratch, through_table

WIDTH = 4
#: Threshold in hundredths: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Width and threshold of a corpus's near copies, looser than the query's.
CORPUS_WIDTH, CORPUS_PERCENT = 5, 80
#: Counters for shingles. They decide the order of shingles, never a result: what shares a counter is ordered as one.
COUNT_BITS = 21
#: Most bits, as a power of two, of the filter that tells which sets a side of the pairs needs; its size follows the pairs.
#: Beyond, more sets are moved.
NEED_BITS = 27
#: Slots of a set in that filter, while it has bits for so many.
NEED_SLOTS = 4
#: Rows of one bucket that are passed in one task to find their leader, by the counters; a larger bucket has several.
BUCKET_ROWS = 20_000
#: Most bits, as a power of two, of the filter that tells which rows may go. Beyond, more rows are moved.
GONE_BITS = 27
#: Rows of one bucket that are joined with themselves in one task at least; of a larger bucket, blocks are joined.
BLOCK_ROWS = 64


def _count(text: str, width: int):
    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        data, off = W.buffers(batch.column(text))
        for _, _, part, cut in W.chunks(data, off):
            _, h = W.shingles(*W.word_hashes(part, cut, W.NON_BLANK), width)
            np.add(table, np.bincount((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(table)), out=table)

    return fill


def _prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n of which one at least is shared with any set that reaches the threshold."""
    return n - (n * percent + 99) // 100 + 1


def ordered_sets(data: np.ndarray, off: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, hashes): the distinct shingles of every text, rare ones first, then by hash."""
    text, h = W.shingles(*W.word_hashes(data, off, W.NON_BLANK), width)
    texts = len(off) - 1
    if not len(h):
        return np.zeros(texts + 1, np.int64), h
    rarity = np.floor(np.log2(counts[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] + 1.0) * 64).astype(np.uint64)
    if texts < 1 << 20:
        key = text.astype(np.uint64) << np.uint64(44) | rarity << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(key)
        k, s = key[order], h[order]
        same = k[1:] == k[:-1]
        clash = bool((same & (s[1:] != s[:-1])).any())
    else:
        clash = True
    if clash:
        order = np.lexsort((h, h & np.uint64(0xFFFFFFFF), rarity, text))
        s = h[order]
    t = text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    t, s = t[new], s[new]
    return np.searchsorted(t, np.arange(texts + 1)), s


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def plain_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, hashes): the distinct shingles of every text in order of their hashes."""
    text, h = W.shingles(*W.word_hashes(data, off, W.NON_BLANK), width)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.searchsorted(text[new], np.arange(len(off))), h[new]


def set_table(docs: DataFrame, counts: np.ndarray, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """(row, doc_id, n, print, cells, prefix, salts) of every row: a number of its own, its set's size, 128-bit print,
    counts of hashes by their highest bits, and prefix; ``salts`` has the number of leaders that a prefix shingle's bucket
    may have."""
    spark = docs.sparkSession
    # what a counter holds by chance isn't a sign of one frequent shingle
    likely = np.minimum(np.maximum(1, -(-(counts - 2 * int(counts.mean() + 1)) // BUCKET_ROWS)), 1 << 14).astype(np.int16)
    sent = spark.sparkContext.broadcast((counts.astype(np.float32), likely))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ways = sent.value
        for batch in batches:
            data, off = W.buffers(batch.column(2))
            for a, b, part, cut in W.chunks(data, off):
                edge, h = ordered_sets(part, cut, seen, width)
                n = np.diff(edge)
                size = np.where(n > 0, _prefix_size(n, percent), 0)
                cuts = np.concatenate(([0], np.cumsum(size)))
                first = h[np.arange(cuts[-1]) + np.repeat(edge[:-1] - cuts[:-1], size)]
                salts = ways[(first >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.int32)
                own = np.repeat(np.arange(b - a), n)
                cells = np.bincount(own * CELLS + (h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=(b - a) * CELLS)
                cells = np.minimum(cells, CELL_MOST).astype(np.int8)
                lists = lambda x, c=cuts: pa.ListArray.from_arrays(pa.array(c.astype(np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n), _prints(h, edge), lists(cells, np.arange(b - a + 1) * CELLS), lists(_signed(first)), lists(salts)],
                    ["row", "doc_id", "n", "print", "cells", "prefix", "salts"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n long, print binary, cells array<tinyint>, prefix array<long>, salts array<int>"
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id), F.col(text)).mapInArrow(run, schema)


#: What a set's two 64-bit prints are seeded with.
_SEEDS = tuple(np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC6A4A7935BD1E995))
CELL_BITS = 7
CELLS = 1 << CELL_BITS
#: Counts of cells are cut off here, so that they are bytes. Two cut counts differ by no more than the whole ones do.
CELL_MOST = 127


def _prints(h: np.ndarray, edge: np.ndarray) -> pa.Array:
    """128 bits for each set, whatever the order of its hashes."""
    n = np.diff(edge)
    both = np.stack([W.mix64(_sums(W.mix64(h ^ seed), edge) + n.astype(np.uint64)) for seed in _SEEDS], 1)
    return pa.Array.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(np.ascontiguousarray(both))]).cast(pa.binary())


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
    return total[edge[1:]] - total[edge[:-1]]


def _shared(entries: DataFrame) -> DataFrame:
    """``entries`` of buckets with two sets or more, with their bucket's leader.

    A bucket's rows pass in order of the place, so nothing of it is held but the leader. A salted bucket is passed in
    parts, each with a leader; all its rows stay.
    """
    fields = ["shingle", "salt", "salts", "node", "n", "place"]
    schema = ", ".join(f"{c} {k}" for c, k in entries.select(*fields).dtypes) + ", leader long, leader_n long, leader_place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, led = None, None  # the last bucket's first row, until a second one comes; its (key, node, n, place)
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, salt, node, n, place = (batch.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])
            if led is not None and led[0] == (shingle[0], salt[0]):
                new[0] = False
            begin = np.flatnonzero(new)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            old = first < 0
            at = np.maximum(first, 0)
            leader, leader_n, leader_place = (np.where(old, x, c[at]) if (x := (led[k] if led is not None else 0)) is not None else c[at] for k, c in ((1, node), (2, n), (3, place)))
            salted = batch.column(2).to_numpy() > 1
            last = np.append(new[1:], True)
            keep = ~new | ~last | salted
            if held is not None and old[0]:
                yield held
            held = None
            end = len(new) - 1
            if new[end] and not salted[end]:  # whether it stays alone, the next batch shows
                keep[end] = False
                one = batch.slice(end, 1)
                held = pa.RecordBatch.from_arrays([*one.columns, pa.array([node[end]]), pa.array([n[end]]), pa.array([place[end]], pa.int32())], names)
            if len(begin):
                k = begin[-1]
                led = ((shingle[k], salt[k]), node[k], n[k], place[k])
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(leader.astype(np.int64)), pa.array(leader_n.astype(np.int64)), pa.array(leader_place.astype(np.int32))], names)
            yield whole.filter(pa.array(keep))

    names = [*fields, "leader", "leader_n", "leader_place"]
    return entries.select(*fields).repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "place", "node").mapInArrow(run, schema)


def _possible(n: Column, place: Column, m: Column, other: Column, percent: int) -> Column:
    """Length and positional filter of sets of sizes n and m that share the shingle at these places of their orders.

    No pair that reaches the threshold fails it at the first shingle that the two share, in their common order: all that
    they have in common stands from there on.
    """
    most = F.least(n - place, m - other)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _alike(percent: int) -> Column:
    """Suffix filter: two sets whose counts of hashes in the cells differ so much cannot reach the threshold."""
    apart = F.aggregate(F.zip_with("_ca", "_cb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    return (F.col("_na") + F.col("_nb") - apart) * (100 + percent) >= 2 * percent * (F.col("_na") + F.col("_nb"))


def verified(docs: DataFrame, copies: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets reach the threshold; ``pairs`` is a table that has each pair once.

    Pairs that the suffix filter drops need no sets. The others' sets are made again from the texts, once for each print,
    and only they are moved.
    """
    spark = docs.sparkSession

    def known(side: str) -> DataFrame:
        return copies.select(F.col("node").alias(side), F.col("n").alias(f"_n{side}"), F.col("cells").alias(f"_c{side}"), F.col("print").alias(f"_p{side}"))

    half = scratch.table(hot_join(pairs.select("a", "b"), known("a"), "a"), "half")
    likely = scratch.table(hot_join(half, known("b"), "b").where(_alike(percent)).select("a", "b", "_pa", "_pb"), "likely")
    found = likely.count()
    bits = min(NEED_BITS, max(16, (64 * found).bit_length()))
    ways = max(1, min(NEED_SLOTS, (1 << bits) // (2 * found + 1)))

    def slots(prints: pa.Array, side: int) -> list[np.ndarray]:
        """Places of the sets in the filter of a side: ``ways`` of each."""
        both = np.frombuffer(prints.cast(pa.binary(16)).buffers()[1], np.uint64)[2 * prints.offset :][: 2 * len(prints)]
        place = (both[::2] + np.uint64(k) * (both[1::2] | np.uint64(1)) for k in range(ways))
        return [(p >> np.uint64(64 - bits)).astype(np.int64) + (side << bits) for p in place]

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for side in range(2):
            for s in slots(batch.column(side), side):
                np.bitwise_or.at(table, s >> 3, (1 << (s & 7)).astype(np.uint8))

    need = spark.sparkContext.broadcast(fixed_table(likely.select("_pa", "_pb"), 2 << bits - 3, np.dtype(np.uint8), fill, np.bitwise_or))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = need.value
        for batch in batches:
            data, off = W.buffers(batch.column(0))
            for _, _, part, cut in W.chunks(data, off):
                edge, h = plain_sets(part, cut, width)
                prints = _prints(h, edge)
                asked = [np.logical_and.reduce([table[s >> 3] >> (s & 7).astype(np.uint8) & 1 == 1 for s in slots(prints, side)]) & (np.diff(edge) > 0) for side in range(2)]
                keep = pa.array(asked[0] | asked[1])
                hashes = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(edge * 8), pa.py_buffer(h)])
                columns = [prints, pa.array(asked[0]), pa.array(asked[1]), hashes]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns[:3]] + [columns[3].filter(keep).cast(pa.binary())], ["print", "for_a", "for_b", "hashes"])

    # copies of one text are reduced before they are moved; the filter says the same of all of them
    needed = docs.select("text").mapInArrow(sets, "print binary, for_a boolean, for_b boolean, hashes binary")
    needed = scratch.table(needed.groupBy("print").agg(*(F.first(c).alias(c) for c in ("for_a", "for_b", "hashes"))), "needed")
    need.unpersist()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = intersection(one, two)
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    def moved(side: str) -> DataFrame:
        return needed.where(f"for_{side}").select(F.col("print").alias(f"_p{side}"), F.col("hashes").alias(f"_{side}"))

    both = salted_join(salted_join(likely, moved("a"), "_pa", "b", likely), moved("b"), "_pb", "a", likely)
    return both.select("a", "b", "_a", "_b").mapInArrow(compare, "a long, b long")


def _by_id(sets: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the nodes of the sets that one id stands for."""
    several = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("print").alias("_a"), F.max("print").alias("_b")).where("_a != _b").select("doc_id")
    several = scratch.table(several, "several")
    if several.isEmpty():
        return several.sparkSession.createDataFrame([], "a long, b long")
    rows = scratch.table(hot_join(sets.where("n > 0").select("doc_id", "print"), several, "doc_id", "left_semi").distinct(), "rows_of_several")
    nodes = scratch.table(hot_join(rows, copies.select("print", "node"), "print").select("doc_id", "node"), "nodes_of_several")
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    return hot_join(nodes, first, "doc_id").where("a != node").select("a", F.col("node").alias("b")).distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: set size, and the smallest id that links reach from the row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text of fewer than ``width`` words is one shingle; a null
    text, or one without words, has none and is linked with nothing. Rows that repeat are copies of each other. Rows of
    one id are one document: what links to any of its texts is linked. A row without an id is a document like others;
    its component is the smallest id that it reaches, or null. No rows give no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = fixed_table(own.select("text"), 1 << COUNT_BITS, np.dtype(np.int64), _count("text", width), np.add)
    with Scratch(spark) as scratch:
        sets = scratch.table(set_table(own, counts, "doc_id", "text", width, percent), "sets")
        some = sets.where("n > 0")
        copies = some.groupBy("print").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("cells").alias("cells"))
        copies = scratch.table(copies, "copies")
        standing = some.join(copies.select(F.col("node").alias("row")), "row", "left_semi")
        listed = standing.select(F.col("row").alias("node"), "n", F.posexplode(F.arrays_zip("prefix", "salts")).alias("place", "e"))
        entries = listed.select(F.col("e.prefix").alias("shingle"), F.pmod(F.xxhash64("node"), F.col("e.salts")).cast("int").alias("salt"), F.col("e.salts").alias("salts"), "node", "n", "place")
        shared = scratch.table(_shared(entries), "shared")

        star = shared.where((F.col("leader") != F.col("node")) & _possible(F.col("n"), F.col("place"), F.col("leader_n"), F.col("leader_place"), percent))
        star = scratch.table(star.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "star")
        links = scratch.table(verified(own, copies, star, width, percent, scratch).unionByName(_by_id(sets, copies, scratch)), "links")
        labels = components(links, scratch)

        # what has one label by now needs no further comparison
        named = shared.select("shingle", "node", "n", "place").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = scratch.table(named, "named")
        mixed = named.groupBy("shingle").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a != _b").select("shingle")
        mixed = scratch.table(hot_join(named, scratch.table(mixed, "mixed"), "shingle", "left_semi"), "left")
        one, two = block_pairs(mixed, "shingle", "node", BLOCK_ROWS)
        two = two.withColumnsRenamed({"node": "_node", "n": "_n", "place": "_place", "label": "_label"})
        rest = one.join(two, ["shingle", "_one", "_two"]).where((F.col("node") < F.col("_node")) & (F.col("label") != F.col("_label")) & _possible(F.col("n"), F.col("place"), F.col("_n"), F.col("_place"), percent))
        rest = rest.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
        rest = scratch.table(rest.join(star, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            labels = components(scratch.table(links.unionByName(verified(own, copies, rest, width, percent, scratch)), "all_links"), scratch)

        ids = scratch.table(copies.join(labels, "node", "left").select("print", "least", F.coalesce("label", "node").alias("label")), "ids")
        least = ids.groupBy("label").agg(F.min("least").alias("component_id"))
        by_print = scratch.table(hot_join(ids, least, "label").select("print", "component_id"), "by_print")
        found = hot_join(sets.select("doc_id", "n", "print"), by_print, "print", "left")
        found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        return scratch.table(found, "components", keep=True)


def _maybe(gone: DataFrame, number: str):
    """A function of a column of whole numbers: false for none that stands in ``gone``, true for few others, so only the
    texts of rows that may go are moved."""
    bits = min(GONE_BITS, max(16, (16 * gone.count()).bit_length()))

    def slots(numbers: pa.Array) -> np.ndarray:
        return (W.mix64(numbers.to_numpy().astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        s = slots(batch.column(0))
        np.bitwise_or.at(table, s >> 3, (1 << (s & 7)).astype(np.uint8))

    sent = gone.sparkSession.sparkContext.broadcast(fixed_table(gone.select(number), 1 << bits - 3, np.dtype(np.uint8), fill, np.bitwise_or))

    @F.arrow_udf("boolean")
    def held(numbers: pa.Array) -> pa.Array:
        s = slots(numbers)
        return pa.array(sent.value[s >> 3] >> (s & 7).astype(np.uint8) & 1 == 1)

    return held


def one_of_group(docs: DataFrame, width: int = CORPUS_WIDTH, percent: int = CORPUS_PERCENT) -> DataFrame:
    """One row of ``docs`` of each component: that of the smallest id, rows without an id last, any of rows that repeat it.

    Rows are compared by numbers of their own, so those that share an id, or have none, are rows like all others. The
    numbers are written with the rows in the shared folder, so that they stay. Rows without words all stay.
    """
    numbered = through_table(docs.select(F.monotonically_increasing_id().alias("_node"), F.struct("*").alias("_row")), "numbered")
    found = jaccard_components(numbered, "_node", "_row.text", width, percent).select(F.col("doc_id").alias("_member"), "component_id")
    named = found.join(numbered.select("_node", F.col("_row.doc_id").alias("_id")), F.col("_member") == F.col("_node"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_node")).alias("_first")).select(F.col("_first._node").alias("_kept"))
    later = through_table(found.join(first, F.col("_member") == F.col("_kept"), "left_anti").select("_member"), "later")
    maybe = _maybe(later, "_member")
    rows = numbered.withColumn("_maybe", maybe("_node"))
    asked = rows.where("_maybe").join(later, F.col("_node") == F.col("_member"), "left_anti")
    return rows.where("NOT _maybe").select("_row.*").unionByName(asked.select("_row.*"))


def op6_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=WIDTH, percent=PERCENT)


SQL6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {WIDTH - 1}) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT k.a, k.b FROM k JOIN n x ON x.doc_id = k.a JOIN n y ON y.doc_id = k.b WHERE 100 * k.k >= {PERCENT} * (x.n + y.n - k.k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT doc_id, min(seen) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
