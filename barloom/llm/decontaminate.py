"""Benchmark decontamination with suffix arrays over the training texts.

The training words are cut into shards of whole texts. A shard gets a suffix array over its word numbers, built by
prefix doubling; every suffix of every benchmark item is binary-searched in it, word by word, until its interval is
empty. That gives each suffix's longest verbatim match and, as the interval, all its locations. A window of ten words (or a
whole shorter item) that is matched marks the words it covers.

Texts are neither shuffled nor gathered: a shard is a part of a partition, and only the benchmark, in blocks of bounded
size, is sent to the executors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import through_table

#: Words of a window, and of a shard's suffix array (one text may be longer).
WINDOW = 10
SHARD_BYTES = 8 << 20
#: Bytes of benchmark texts that are sent out at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 8 << 20
#: Blocks that one pass over the texts searches, and so a bound of what is sent: 64 MB.
PASS_BLOCKS = 8


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a sequence of small whole numbers, in order of the suffixes."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    top = int(ids.max()) + 2
    # as many leading symbols as fit into 63 bits are sorted at once
    bits = max(1, top.bit_length())
    width = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] |= ids[k:].astype(np.int64) + 1
    order = np.argsort(key)
    rank, tied = _ranks(key[order], order, n)
    while len(tied):
        # only suffixes whose first ``width`` symbols some other shares are sorted again, by what follows
        at = order[tied]
        follow = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        again = np.lexsort((follow, rank[at]))
        at, follow = at[again], follow[again]
        order[tied] = at
        own = rank[at]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])
        start = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = start
        last = np.append(new[1:], True)
        tied = tied[~(new & last)]
        width *= 2
    return order


def _ranks(sorted_keys: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    last = np.append(new[1:], True)
    return rank, np.flatnonzero(~(new & last))


class Items:
    """Benchmark items as word hashes, one after the other."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        data, off = W.buffers(pa.array(["" if t is None else t for t in texts], pa.large_string()))
        self.hashes, first = W.word_hashes(data, off, W.LETTERS)
        self.ids, self.window = ids, window
        n = np.diff(first)
        self.item = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(self.hashes)) - first[:-1][self.item]
        self.left = n[self.item] - place  # words from here to the item's end
        need = np.minimum(window, n[self.item])
        self.need = np.where(self.left >= need, need, 0)  # words of the window that begins here, 0: none does


def search(shard: np.ndarray, order: np.ndarray, query: np.ndarray, left: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, lows, highs, lengths): begin and end bound the locations, in ``order``, of every suffix's window of
    ``need`` words; the others are the intervals of all matches, from a window's length to the longest, each at the
    greatest length that all of its locations share. Numbers under 0 stand for words that the shard lacks."""
    m, n = len(query), len(order)
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    matches: list[tuple] = []
    begin, end = np.zeros(m, np.int64), np.zeros(m, np.int64)
    live, depth = np.arange(m), 0
    while len(live):
        on = left[live] > depth
        on[on] = query[live[on] + depth] >= 0
        whole = live[~on & (need[live] > 0) & (depth >= need[live])]
        matches.append((low[whole], high[whole], np.full(len(whole), depth)))
        live = live[on]
        word = query[live + depth]
        if not len(live):
            break

        def bound(past: bool, lo: np.ndarray, hi: np.ndarray, word: np.ndarray = word, depth: int = depth) -> np.ndarray:
            lo, hi = lo.copy(), hi.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = order[np.minimum(mid, n - 1)] + depth
                here = np.where(at < n, shard[np.minimum(at, n - 1)], -1)
                right = (here <= word if past else here < word) & open_
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            return lo

        lo = bound(False, low[live], high[live])
        hi = bound(True, lo, high[live])
        # where fewer locations go on, or none, the interval so far is complete
        fewer = (hi - lo < high[live] - low[live]) & (need[live] > 0) & (depth >= need[live])
        matches.append((low[live[fewer]], high[live[fewer]], np.full(fewer.sum(), depth)))
        found = lo < hi
        live, lo, hi = live[found], lo[found], hi[found]
        low[live], high[live] = lo, hi
        depth += 1
        full = need[live] == depth
        begin[live[full]], end[live[full]] = lo[full], hi[full]
    return begin, end, *(np.concatenate(x) for x in zip(*matches, strict=True))


def _highest(n: int, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of n places the largest value of the intervals [begin, end) that hold it, else 0.

    An interval is covered by two of the longest power of two that fits; then each power's values are handed down.
    """
    power = np.floor(np.log2(np.maximum(1, end - begin))).astype(np.int64)
    top = np.zeros(n, np.int32)
    for k in range(int(power.max(initial=0)), -1, -1):
        at = power == k
        np.maximum.at(top, begin[at], value[at])
        np.maximum.at(top, end[at] - (1 << k), value[at])
        if k:
            half = 1 << k - 1
            lower = top.copy()
            np.maximum(lower[half:], top[: n - half], out=lower[half:])
            top = lower
    return top


class Shard:
    """Some whole texts, their suffix array, and what has been found in them so far."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        hashes, first = W.word_hashes(data, off, W.LETTERS)
        texts = len(off) - 1
        self.n_words = np.diff(first)
        # 0 ends each text, so that no match runs on into the next
        self.known, inverse = np.unique(hashes, return_inverse=True)
        self.symbols = np.zeros(len(hashes) + texts, np.int64)
        self.symbols[np.arange(len(hashes)) + np.repeat(np.arange(texts), self.n_words)] = inverse + 1
        self.order = suffix_array(self.symbols)
        self.starts = first + np.arange(texts + 1)
        self.hit = np.zeros(len(self.symbols), bool)
        self.found: list[set] = [set() for _ in range(texts)]
        self.longest, self.place = np.zeros(texts, np.int64), np.full(texts, -1, np.int64)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def look_for(self, items: Items) -> None:
        if not len(self.known) or not len(items.hashes):
            return
        at = np.searchsorted(self.known, items.hashes)
        query = np.where(self.known[np.minimum(at, len(self.known) - 1)] == items.hashes, at + 1, -1)
        begin, end, low, high, long = search(self.symbols, self.order, query, items.left, items.need)
        hit = np.flatnonzero(end > begin)
        if not len(hit):
            return
        self._keep_longest(low, high, long)
        # equal windows, of one item or of many, are one interval: its locations are looked up once
        key, first, group = np.unique(begin[hit] * (len(self.order) + 1) + end[hit], return_index=True, return_inverse=True)
        one = hit[first]
        count = end[one] - begin[one]
        which = np.repeat(np.arange(len(one)), count)
        spots = self.order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[one], count)]
        edge = np.zeros(len(self.symbols) + 1, np.int64)
        np.add.at(edge, spots, 1)
        np.add.at(edge, spots + items.need[one][which], -1)
        self.hit |= np.cumsum(edge[:-1]) > 0
        owners: list[set] = [set() for _ in one]
        for g, i in zip(group.tolist(), items.item[hit].tolist(), strict=True):
            if items.ids[i] is not None:
                owners[g].add(str(items.ids[i]))
        pairs = np.unique(self.text_of(spots) * len(one) + which)
        for t, g in zip((pairs // len(one)).tolist(), (pairs % len(one)).tolist(), strict=True):
            self.found[t] |= owners[g]

    def _keep_longest(self, low: np.ndarray, high: np.ndarray, long: np.ndarray) -> None:
        """The longest match of each text and its first place, from all locations of suffixes that match a window."""
        best = np.zeros(len(self.symbols), np.int32)
        best[self.order] = _highest(len(self.order), low, high, long.astype(np.int32))
        at = np.flatnonzero(best)
        text = self.text_of(at)
        at = at[np.lexsort((at, -best[at], text))]
        text, first = np.unique(self.text_of(at), return_index=True)
        at = at[first]
        better = (best[at] > self.longest[text]) | (best[at] == self.longest[text]) & (at - self.starts[text] < self.place[text])
        text, at = text[better], at[better]
        self.longest[text], self.place[text] = best[at], at - self.starts[text]

    def mark(self, places: list) -> None:
        """Hit words, per text, that an earlier pass has found."""
        for t, x in enumerate(places):
            self.hit[self.starts[t] + np.asarray(x, np.int64)] = True

    def n_hit(self) -> np.ndarray:
        covered = np.concatenate(([0], np.cumsum(self.hit)))
        return covered[self.starts[1:]] - covered[self.starts[:-1]]

    def hits(self) -> list:
        return [np.flatnonzero(self.hit[a:b]) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]


_FOUND = "n_words long, n_hit long, items array<string>, longest_match long, match_place long"


def _scanner(sent: list, more: bool):
    """A pass over batches (id, text, or an earlier pass's row); ``more``: texts and hit places are kept for another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = [Items(*pickle.loads(s.value)) for s in sent]
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            earlier = batch.num_columns > 2
            for a, b, part, cut in W.chunks(data, off, SHARD_BYTES):
                shard = Shard(part, cut)
                if earlier:
                    _, _, old_hits, old_items, old_long, old_place = (batch.column(k)[a:b] for k in range(6))
                    shard.mark(old_hits.to_pylist())
                    shard.found = [set(x) for x in old_items.to_pylist()]
                    shard.longest, shard.place = old_long.to_numpy().copy(), old_place.to_numpy().copy()
                for items in several:
                    shard.look_for(items)
                names = pa.array([sorted(x) for x in shard.found], pa.list_(pa.string()))
                tail = [names, pa.array(shard.longest), pa.array(shard.place)]
                if more:
                    columns = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(shard.hits(), pa.list_(pa.int64())), *tail]
                    named = [batch.schema.field(0).name, "_text", "_hits", "items", "longest_match", "match_place"]
                else:
                    columns = [batch.column(0)[a:b], pa.array(shard.n_words), pa.array(shard.n_hit()), *tail]
                    named = [batch.schema.field(0).name, "n_words", "n_hit", "items", "longest_match", "match_place"]
                yield pa.RecordBatch.from_arrays(columns, named)

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(item_id, text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "") + 8
        if size > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _passes(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[tuple[list, bool]]:
    """(broadcast blocks of a pass, is it the last one). The benchmark is read as it is sent; when the next pass is asked
    for, the one before is over and its blocks are dropped, so one pass's blocks are held at a time."""
    held: list = []
    for block in _blocks(benchmark, item_id, text):
        if len(held) == PASS_BLOCKS:
            yield held, False
            for sent in held:
                sent.destroy()
            held = []
        held.append(docs.sparkSession.sparkContext.broadcast(pickle.dumps((*block, window))))
    yield held, True


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (ids as strings, sorted), longest_match (words), match_place (its first word).

    Null and empty texts have no words and no hits; items without words match nothing; items that share an id count as
    one; an item without an id marks the words that it hits and is not listed. Repeated rows are judged alike; no rows
    give no rows. ``longest_match`` is the longest verbatim run of an item's words that holds a window, ``match_place`` its
    first place in the text; 0 and -1 without a hit. At most ``PASS_BLOCKS`` blocks of the benchmark are sent and
    searched in one pass over the texts; a larger benchmark takes more passes, each of which is written to the shared
    folder with the words hit so far.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    now = docs.select(F.col(doc_id).alias("doc_id"), text)
    for sent, last in _passes(docs, benchmark, item_id, text, window):
        if not last:
            schema = f"doc_id {kind}, _text string, _hits array<long>, items array<string>, longest_match long, match_place long"
            now = through_table(now.mapInArrow(_scanner(sent, True), schema), "pass")
    return now.mapInArrow(_scanner(sent, False), f"doc_id {kind}, {_FOUND}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with their own columns, in whose text no benchmark window occurs.

    Rows are judged where they are read and dropped there; nothing is joined or shuffled. Null and empty texts stay, rows
    that repeat are judged alike. A benchmark of several passes has what each leaves written to the shared folder.
    """

    def keep(sent: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            several = [Items(*pickle.loads(s.value)) for s in sent]
            for batch in batches:
                data, off = W.buffers(batch.column(text))
                for a, b, part, cut in W.chunks(data, off, SHARD_BYTES):
                    shard = Shard(part, cut)
                    for items in several:
                        shard.look_for(items)
                    yield batch.slice(a, b - a).filter(pa.array(shard.n_hit() == 0))

        return run

    for sent, last in _passes(docs, benchmark, item_id, text, window):
        docs = docs.mapInArrow(keep(sent), docs.schema)
        if not last:
            docs = through_table(docs, "pass")
    return docs


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "match_place",
    )


SQL2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
x AS (SELECT *, row_number() OVER () AS x FROM b WHERE len(ws) > 0),
w AS (SELECT x, item_id, j, least(10, len(ws)) AS k, array_to_string(ws[j:j + least(10, len(ws)) - 1], ' ') AS g
      FROM (SELECT x, item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS j FROM x)),
ks AS (SELECT DISTINCT k FROM w),
g AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT g.doc_id, g.i, g.k, w.item_id, w.x, w.j FROM g JOIN w USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id),
runs AS (SELECT doc_id, min(i) - 1 AS place, count(*) + any_value(k) - 1 AS size
         FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, x, i - j ORDER BY i) AS run FROM h) GROUP BY doc_id, x, i - j, run),
m AS (SELECT doc_id, max(size) AS longest, arg_min(place, (-size, place)) AS place FROM runs GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(m.longest, 0)::BIGINT AS longest_match, coalesce(m.place, -1)::BIGINT AS match_place
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""
