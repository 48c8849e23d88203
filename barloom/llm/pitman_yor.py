"""Scores of texts under a hierarchical Pitman-Yor bigram model.

Every word is a customer in the restaurant of the word before it. What opens a table there is a customer of the root,
which all context restaurants share; the root's discount is zero, so that its customers alone say its probabilities, and
its base is uniform over the vocabulary and one unknown word, with a strength in proportion to it. A Gibbs sweep seats the customers of every dish of every
context anew, given the root's customers and the context's tables after the sweep before. Scores average the predictive
probabilities of the last ``SAMPLES`` sweeps.

Customers of one dish are seated one after the other: a customer opens a table with a weight that looks ahead to those
who follow (``seat``), which is the law of the number of tables up to a small error that the tests measure. From the 64th
customer on, as many as one in 32 of those seated are seated at once. What is drawn follows from hashes of the pair, the
sweep and the place in line, so neither partitions nor batches nor their order bear on a score.

How it is spread: texts are cut into batches. A batch sends each context partition the distinct word pairs that fall to
it, with their counts and the texts they stand in; what holds no pair isn't sent. As every word but the last is the
context of the next, that partition also knows the plain count of its contexts. After each sweep a partition tells its
tables per word to the root's partitions, which hold ranges of the words, and hears the sums for just its words. A context
with very many words (by counters of fixed size, which only err on the side of more) is dealt over several partitions by
the word, and these add up its totals in the same exchange. At last each batch hears the sums of its texts. Everything
that is sent is bounded by the words of the input; no model is gathered anywhere.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, one end token closes each text, null texts are empty. The plain
unigram score beside it uses exact counts over the training texts. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .fixed import fixed_table

DISCOUNT, STRENGTH = 0.75, 1.0
#: The root's strength for each word of the vocabulary and for the unknown one.
ROOT_STRENGTH = 0.5
#: Sweeps, and how many of the last ones are averaged.
SWEEPS, SAMPLES = 2, 2
BATCH_BYTES = 8 << 20
BATCH_TEXTS = 1 << 16
#: Bytes of texts whose words are hashed at once.
HASH_BYTES = 1 << 20
#: Words of a context partition, and of a part of a context that is dealt; fewest partitions. They bear on no result.
PART_WORDS, LEAST_PARTS = 2_000_000, 16
COUNT_BITS = 20
END, START = (W.mix64(np.array([k], np.uint64))[0] for k in (0xE4D, 0x57A27))


def dump(*arrays: np.ndarray) -> bytes:
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)


def load(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    at, out = 4 + n, []
    for part in blob[4 : 4 + n].decode().split(";"):
        kind, _, size = part.partition(",")
        a = np.frombuffer(blob, np.dtype(kind), int(size), at)
        out.append(a)
        at += a.nbytes
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as the largest one needs."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(h: np.ndarray) -> np.ndarray:
    """A sorted array of hashes: the first one, then the steps in as few bytes as the largest one needs."""
    if not len(h):
        return np.zeros(0, np.uint8)
    steps = np.diff(h)
    n = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).ravel()
    return np.concatenate([np.array([n], np.uint8), h[:1].astype("<u8").view(np.uint8), body])


def _unpack(b: np.ndarray) -> np.ndarray:
    if not len(b):
        return np.zeros(0, np.uint64)
    n = int(b[0])
    out = np.zeros(((len(b) - 9) // n + 1, 8), np.uint8)
    out[0] = b[1:9]
    out[1:, :n] = b[9:].reshape(-1, n)
    return np.cumsum(out.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return W.mix64(u ^ w * np.uint64(0xD6E8FEB86659FD93))


def _uniform(key: np.ndarray, sweep: int, place: int, draw: int = 0) -> np.ndarray:
    """Numbers in (0, 1) that follow from a key, the sweep and the place in line."""
    seed = W.mix64(np.array([sweep << 48 | draw << 44 | place], np.uint64))[0]
    return ((W.mix64(key ^ seed) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _binomial(n: int, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial numbers by inversion, or, where 30 and more are expected on either side, from a normal one."""
    turned = p > 0.5
    q = np.where(turned, 1 - p, p)
    mean = n * q
    out = np.rint(mean + np.sqrt(mean * (1 - q)) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
    few = np.flatnonzero(mean < 30)
    if len(few):
        q, u = q[few], u[few]
        odds, mass = q / (1 - q), (1 - q) ** n
        total, k = mass.copy(), np.zeros(len(few))
        for i in range(1, min(n, 100) + 1):
            on = u > total
            if not on.any():
                break
            k += on
            mass = mass * odds * (n - i + 1) / i
            total += mass
        out[few] = k
    out = np.clip(out, 0, n)
    return np.where(turned, n - out, out).astype(np.int64)


def seat(customers: np.ndarray, base: np.ndarray, rest: np.ndarray, strength: float, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Numbers of tables of dishes with these customers, given the parent's probability of each dish and the number of
    tables that other dishes have in its restaurant.

    The law sought is that of a seating, given the dishes: each step's weight is that of the customer's choice times that
    of all that can follow. The latter shrinks with every table, as tables take from the weight of sitting down at one: by
    about (x / y) ** (d * (1 - base)), where x and y are the sums of the choices' weights now and for the last customer.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    live, n = np.flatnonzero(customers > 1), 1
    while len(live):
        block = max(1, n // 32)
        c, t, p = customers[live], tables[live], base[live]
        some = np.minimum(block, c - n)
        new = (strength + discount * (rest[live] + t)) * p
        less = discount * (1 - p)  # what one more table takes from the weight of every later step
        stay = np.maximum(n - discount * t, 1e-9)
        now = np.maximum(stay + new + block / 2 - less / 2, 0.05)
        chance = new / (stay + new)
        for _ in range(2):  # the tables that will be opened take more of it
            slope = 1 - less * chance
            ahead = (now / np.maximum(now + (c - n - block / 2 - 0.5) * slope, now)) ** (less / slope)
            chance = new * ahead / (stay + new * ahead)
        if block == 1:
            tables[live] += _uniform(key[live], sweep, n) < chance
        else:
            u, v = _uniform(key[live], sweep, n), _uniform(key[live], sweep, n, 1)
            for size in np.unique(some):  # the whole block, and what is left of those that end in it
                at = np.flatnonzero(some == size)
                tables[live[at]] += _binomial(int(size), chance[at], u[at], v[at])
        n += block
        live = live[customers[live] > n]
    return tables


def _groups(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, edges of keys 0..most-1)."""
    order = np.argsort(key, kind="stable")
    return order, np.searchsorted(key[order], np.arange(most + 1))


def _batch_rows(number: int, data: np.ndarray, off: np.ndarray, held: np.ndarray, parts: int, ways: np.ndarray) -> tuple[list, np.ndarray]:
    """((partition, batch, blob) for every context partition with pairs of these texts; tokens a text)."""
    some = [W.word_hashes(part, cut, W.NON_BLANK) for _, _, part, cut in W.chunks(data, off, HASH_BYTES)]
    hashes, n = np.concatenate([h for h, _ in some]), np.concatenate([np.diff(first) for _, first in some]) + 1
    texts = len(off) - 1
    text = np.repeat(np.arange(texts, dtype=np.int64), n)
    token = np.full(len(text), END, np.uint64)
    token[np.arange(len(hashes)) + np.repeat(np.arange(texts), n - 1)] = hashes
    known, word = np.unique(token, return_inverse=True)
    del token, hashes
    # pairs: (context, word, text) with counts; the context of a text's first token is START, numbered behind all words
    pair = np.empty(len(word), np.int64)
    pair[1:] = word[:-1]
    pair[np.cumsum(n) - n] = len(known)
    pair *= len(known) + 1
    pair += word
    del word
    kinds, pair = np.unique(pair, return_inverse=True)
    train = np.bincount(pair[~held[text]], minlength=len(kinds))
    pair <<= 16
    pair |= text
    del text
    key, count = np.unique(pair, return_counts=True)
    del pair
    where = (key & 0xFFFF).astype(np.uint16)
    key >>= 16
    edge = np.searchsorted(key, np.arange(len(kinds) + 1))
    u, w = kinds // (len(known) + 1), kinds % (len(known) + 1)
    named = np.append(known, START)
    # a context that is dealt lies with the partitions of its parts, each of which has some of the words
    dealt = ways[(named[u] >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
    whose = np.where(dealt > 1, W.mix64(named[u] + _pair_key(named[w], named[u]) % np.maximum(dealt, np.uint64(1)) + np.uint64(1)), named[u])
    order, cut = _groups(_part(whose, parts), parts)
    rows = []
    for p in np.flatnonzero(np.diff(cut)).tolist():
        mine = order[cut[p] : cut[p + 1]]
        contexts, run = np.unique(u[mine], return_inverse=True)  # numbers of words follow their hashes, but for START
        by_hash = np.argsort(named[contexts])
        place = np.empty(len(by_hash), np.int64)
        place[by_hash] = np.arange(len(by_hash))
        resort = np.argsort(place[run], kind="stable")  # pairs in order of the context's hash
        mine, run = mine[resort], place[run][resort]
        size = edge[mine + 1] - edge[mine]
        at = np.arange(size.sum()) + np.repeat(edge[mine] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        dishes, dish = np.unique(named[w[mine]], return_inverse=True)
        blob = dump(_pack(named[contexts][by_hash]), _narrow(np.bincount(run, minlength=len(contexts))), _pack(dishes), _narrow(dish), _narrow(train[mine]), _narrow(size), where[at], _narrow(count[at]))
        rows.append((p, number, blob))
    return rows, n


class Partition:
    """The restaurants of one partition: its distinct pairs, and for each batch which of them its entries are.

    ``hear`` takes what the root's partitions answered to ``ask``; by turns, the two run the sweeps.
    """

    def __init__(self, rows: list[tuple[int, bytes]], parts: int, ways: np.ndarray):
        rows = sorted(rows)
        loaded = [load(b) for _, b in rows]
        self.parts, self.batches = parts, [b for b, _ in rows]
        self.contexts, u = np.unique(np.concatenate([np.repeat(_unpack(x[0]), x[1]) for x in loaded]), return_inverse=True)
        self.words, w = np.unique(np.concatenate([_unpack(x[2])[x[3]] for x in loaded]), return_inverse=True)
        kinds, pair = np.unique(u.astype(np.int64) * len(self.words) + w, return_inverse=True)
        del u, w
        self.u, self.w = kinds // max(1, len(self.words)), kinds % max(1, len(self.words))
        self.customers = np.bincount(pair, np.concatenate([x[4] for x in loaded]), len(kinds)).astype(np.int64)
        cuts = np.cumsum([0, *(len(x[3]) for x in loaded)])
        self.entries = [(np.repeat(pair[a:b].astype(np.int32), x[5]), x[6], x[7]) for a, b, x in zip(cuts[:-1], cuts[1:], loaded, strict=True)]
        self.key = _pair_key(self.contexts[self.u], self.words[self.w])
        dealt = ways[(self.contexts >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] > 1
        self.dealt = np.flatnonzero(dealt)
        self.own_total = np.bincount(self.u, self.customers, len(self.contexts)).astype(np.int64)
        self.total = self.own_total.copy()
        self.start = self.contexts == START
        # one table for each pair that a training text has
        self.tables = np.minimum(self.customers, 1)
        self.sweep, self.base, self.vocabulary, self.mean = 0, None, None, np.zeros(len(kinds))

    def _own_tables(self) -> np.ndarray:
        return np.bincount(self.u, self.tables, len(self.contexts)).astype(np.int64)

    def ask(self) -> list[tuple[int, bytes]]:
        """(partition of the root, message): the tables of its words, the totals of dealt contexts, and, for the first
        of them, sums over all partitions. Words and contexts are named in the first exchange only."""
        values = np.bincount(self.w, self.tables, len(self.words)).astype(np.int64)
        tables = self._own_tables()[self.dealt]
        cut = np.searchsorted(_part(self.words, self.parts), np.arange(self.parts + 1))
        there = self.contexts[self.dealt]
        dealt_cut = np.searchsorted(_part(there, self.parts), np.arange(self.parts + 1))
        # a dealt context is known to be seen once in all: each of its parts adds its share
        seen = (self.total > 0) & ~self.start
        share = self.own_total / np.maximum(1, self.total)
        sums = np.array([self.tables.sum(), self.customers.sum(), share[seen].sum(), self.own_total[self.start].sum()], np.float64)
        out = []
        asked = np.flatnonzero((np.diff(cut) > 0) | (np.diff(dealt_cut) > 0))
        for q in np.union1d([0], asked).tolist():
            a, b, c, d = cut[q], cut[q + 1], dealt_cut[q], dealt_cut[q + 1]
            names = (_pack(self.words[a:b]), _pack(there[c:d]), self.own_total[self.dealt[c:d]]) if self.sweep == 0 else ()
            out.append((q, dump(_narrow(values[a:b]), tables[c:d], sums if q == 0 else sums[:0], *names)))
        return out

    def hear(self, answers: list[tuple[int, bytes]], last: bool = False) -> None:
        """Take the sums; if sweeps are left, seat all customers anew. The last ``SAMPLES`` sweeps' predictive
        probabilities are added up, each with the sums that follow from it."""
        got = [load(b) for _, b in sorted(answers)]
        root = np.concatenate([x[0] for x in got]).astype(np.float64)
        tables = self._own_tables()
        if len(self.dealt):
            tables[self.dealt] = np.concatenate([x[1] for x in got])
            if self.sweep == 0:
                self.total[self.dealt] = np.concatenate([x[3] for x in got])
        sums = next(x[2] for x in got if len(x[2]))
        self.root_customers, self.train, self.ends = sums[0], int(sums[1]), int(sums[3])
        if self.sweep:
            self.vocabulary = int(round(sums[2])) + (self.ends > 0)
        # the first exchange does not tell the size of the vocabulary yet; until the next, the root is taken to have none unseen
        words = 1 if self.vocabulary is None else self.vocabulary + 1
        self.base = ((root + ROOT_STRENGTH) / (self.root_customers + ROOT_STRENGTH * words))[self.w]
        if self.sweep:
            total = self.total[self.u]
            self.found = (np.maximum(self.customers - DISCOUNT * self.tables, 0) + (STRENGTH + DISCOUNT * tables[self.u]) * self.base) / (STRENGTH + total)
        self.sweep += 1
        if not last:
            self.tables = seat(self.customers, self.base, tables[self.u] - self.tables, STRENGTH, DISCOUNT, self.key, self.sweep)

    def run(self, answers: dict[int, list[tuple[int, bytes]]], sweeps: int, samples: int) -> None:
        """All sweeps whose answers are there, from the beginning."""
        for k in sorted(answers):
            self.hear(answers[k], last=k == sweeps)
            if k > sweeps - samples:
                self.mean += self.found / samples

    def sums(self) -> list[bytes]:
        """For each batch, of each of its texts with pairs here: the sums of log10 of the averaged predictive
        probabilities, and of log10(count + 0.1) of their contexts as words, and how many of these are known."""
        value, out = np.log10(self.mean), []
        plain, seen = np.where(self.start, 0, np.log10(self.total + 0.1)), (self.total > 0) & ~self.start
        about = np.array([self.train, self.vocabulary, self.ends], np.int64)
        for pair, text, many in self.entries:
            u, many = self.u[pair], many.astype(np.float64)
            there = np.unique(text)
            own = np.searchsorted(there, text)
            out.append(dump(about, there, np.bincount(own, many * value[pair]).astype(np.float32), np.bincount(own, many * plain[u]), _narrow(np.bincount(own, many * seen[u]).astype(np.int64))))
        return out


def answer(names: list[tuple[int, bytes]], asked: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """(context partition, sums) of a partition of the root: of each word and dealt context that it was asked for.

    ``names`` are the messages of the first exchange, ``asked`` those of this one."""
    names, asked = dict(names), dict(asked)
    parts = sorted(names)
    first, now = [load(names[p]) for p in parts], [load(asked[p]) for p in parts]
    words, w = np.unique(np.concatenate([_unpack(x[3]) for x in first]), return_inverse=True)
    customers = np.bincount(w, np.concatenate([x[0] for x in now]), len(words)).astype(np.int64)
    contexts, u = np.unique(np.concatenate([_unpack(x[4]) for x in first]), return_inverse=True)
    total = np.bincount(u, np.concatenate([x[5] for x in first]), len(contexts)).astype(np.int64)
    tables = np.bincount(u, np.concatenate([x[1] for x in now]), len(contexts)).astype(np.int64)
    sums = np.sum([x[2] for x in now if len(x[2])], 0) if len(now[0][2]) else np.zeros(0)
    out, a, c = [], 0, 0
    for p, x, y in zip(parts, first, now, strict=True):
        mine, its = w[a : a + len(y[0])], u[c : c + len(x[5])]
        a, c = a + len(y[0]), c + len(x[5])
        out.append((p, dump(_narrow(customers[mine]), tables[its], sums, total[its])))
    return out


def _rows(table: pa.Table, key: str) -> list[tuple[int, bytes]]:
    return list(zip(table.column(key).to_pylist(), table.column("blob").to_pylist(), strict=True))


def score_texts(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows with ``held`` teach nothing.

    A null or empty text is its end token alone; rows that repeat teach and are scored as often as they stand. Without
    any training row all words are unknown and the scores follow from the uniform base. No rows give no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("text"))

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        data, off = W.buffers(batch.column(0))
        for _, _, part, cut in W.chunks(data, off, HASH_BYTES):
            h, first = W.word_hashes(part, cut, W.NON_BLANK)
            table += np.bincount((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(table))
            table[int(START >> np.uint64(64 - COUNT_BITS))] += len(cut) - 1

    counts = fixed_table(own.select("text"), 1 << COUNT_BITS, np.dtype(np.int64), fill, np.add)
    parts = max(LEAST_PARTS, -(-int(counts.sum()) // PART_WORDS))
    sent = spark.sparkContext.broadcast(np.minimum(np.maximum(1, -(-counts // PART_WORDS)), parts).astype(np.int32))
    kind = docs.schema[doc_id].dataType

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            data, off = W.buffers(batch.column("text"))
            held_all = batch.column("held").to_numpy(zero_copy_only=False)
            for a, b, part, cut in W.chunks(data, off, BATCH_BYTES):
                for i in range(0, b - a, BATCH_TEXTS):
                    j = min(i + BATCH_TEXTS, b - a)
                    these = held_all[a + i : a + j]
                    rows, n = _batch_rows(task + seq, part[cut[i] : cut[j]], cut[i : j + 1] - cut[i], these, parts, sent.value)
                    for lo in range(0, len(rows), 32):
                        some = rows[lo : lo + 32]
                        ids = [None] * len(some)
                        if not lo:
                            ids[0] = batch.column("doc_id")[a + i : a + j].to_pylist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.binary()),
                                pa.array(ids, pa.list_(batch.schema.field("doc_id").type)), pa.array([None if x is None else dump(n.astype(np.int64), these.astype(np.uint8)) for x in ids], pa.binary()),
                            ],
                            ["part", "batch", "blob", "ids", "head"],
                        )
                    seq += 1

    sql = kind.simpleString()
    blobs = own.mapInArrow(cut_up, f"part int, batch long, blob binary, ids array<{sql}>, head binary")

    def partition(table: pa.Table, heard: pa.Table | None) -> Partition:
        p = Partition(_rows(table, "batch"), parts, sent.value)
        by: dict[int, list] = {}
        if heard is not None:
            for k, to, blob in zip(*(heard.column(c).to_pylist() for c in ("sweep", "to", "blob")), strict=True):
                by.setdefault(k, []).append((to, blob))
        p.run(by, sweeps, samples)
        return p

    def told(me: int, p: Partition) -> pa.Table:
        out = p.ask()
        return pa.table({"to": pa.array([q for q, _ in out], pa.int32()), "part": pa.array([me] * len(out), pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    asking = pa.schema([("to", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])

    def first_ask(table: pa.Table) -> pa.Table:
        return told(table.column("part")[0].as_py(), partition(table, None))

    def next_ask(key, table: pa.Table, heard: pa.Table) -> pa.Table:
        return told(key[0].as_py(), partition(table, heard)) if table.num_rows else asking.empty_table()

    def answered(rows: list[tuple[int, bytes]], me: int, sweep: int) -> pa.Table:
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "to": pa.array([me] * len(rows), pa.int32()), "sweep": pa.array([sweep] * len(rows), pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    def first_answer(table: pa.Table) -> pa.Table:
        rows = _rows(table, "part")
        return answered(answer(rows, rows), table.column("to")[0].as_py(), 0)

    def next_answer(sweep: int):
        return lambda key, names, asked: answered(answer(_rows(names, "part"), _rows(asked, "part")), key[0].as_py(), sweep)

    result = pa.schema([("batch", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(_arrow(spark, kind))), ("head", pa.binary())])

    def sums(key, table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        table = table.take(pa.array(np.argsort(table.column("batch").to_numpy(), kind="stable")))
        return pa.table([table.column("batch"), pa.array(partition(table, heard).sums(), pa.binary()), table.column("ids"), table.column("head")], schema=result)

    final = pa.schema([("doc_id", _arrow(spark, kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def assemble(table: pa.Table) -> pa.Table:
        heads = table.column("head").to_pylist()
        k = next(i for i, h in enumerate(heads) if h is not None)
        n, held_out = load(heads[k])
        got = [load(b) for b in sorted(table.column("blob").to_pylist())]  # sums in one order, whatever came first
        train, distinct, ends = got[0][0].tolist()
        # every text's end token, which is no context
        base, model, known = np.full(len(n), np.log10(ends + 0.1)), np.zeros(len(n)), np.full(len(n), int(ends > 0), np.int64)
        for _, there, *values in got:
            for total, part in zip((model, base, known), values, strict=True):
                total[there] += part.astype(total.dtype)
        base -= n * np.log10(train + 0.1 * (distinct + 1))
        ids = table.column("ids")[k].values
        return pa.table([ids, pa.array(held_out.astype(bool)), pa.array(n), pa.array(known), pa.array(np.full(len(n), train)), pa.array(base), pa.array(model)], schema=final)

    to_root, to_context = "to int, part int, blob binary", "part int, to int, sweep int, blob binary"
    named = blobs.groupBy("part").applyInArrow(first_ask, to_root)
    heard = named.groupBy("to").applyInArrow(first_answer, to_context)
    for sweep in range(1, sweeps + 1):
        asked = blobs.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(next_ask, to_root)
        heard = heard.unionByName(named.groupBy("to").cogroup(asked.groupBy("to")).applyInArrow(next_answer(sweep), to_context))
    summed = blobs.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(sums, f"batch long, blob binary, ids array<{sql}>, head binary")
    return summed.groupBy("batch").applyInArrow(assemble, f"doc_id {sql}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _arrow(spark: SparkSession, kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0


def op7_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), held_out())
