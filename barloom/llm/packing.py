"""Token ids as packed matrices.

Texts are cut into pre-tokens and every distinct pre-token of a stretch of input is encoded once. The token sequences,
each closed by an end token, are packed into rows of a fixed length: sequences longer than a row are split, longest
pieces come first, and each piece goes to the row whose free room fits best, which a segment tree over the possible
rooms finds. Nothing is cut off: the pieces of a document, in order, are its tokens.

A stretch of about ``GROUP_BYTES`` of consecutive input texts is packed on its own, where it is read; nothing is
shuffled, and the rows keep the order of the input, such as that of a mixture, from stretch to stretch. Which texts share
a stretch depends on how the input is split into tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens as P
from . import words as W

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
ROW_TOKENS = 2048
GROUP_BYTES = 4 << 20
#: Pre-tokens that a worker remembers; beyond, it starts afresh.
REMEMBERED = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Token ids of columns of texts; remembers what it has encoded by hash."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.one = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.kind = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        self.memo = W.Memo(REMEMBERED)
        self.at, self.size, self.pool = W.Column(np.int32), W.Column(np.int32), W.Column(self.kind)
        self._forget()

    def _forget(self) -> None:
        self.memo.forget()
        for column in (self.at, self.size, self.pool):
            column.clear()
        self.at.extend(np.zeros(1, np.int32))
        self.size.extend(np.zeros(1, np.int32))

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all tokens, each text's first token's number and one more at the end), by stretches of texts."""
        found, counts = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]
        for _, _, part, cut in W.chunks(data, off, W.HASH_BYTES):
            tokens, edge = self._encode(part, cut)
            found.append(tokens)
            counts.append(np.diff(edge))
        return np.concatenate(found), np.cumsum(np.concatenate(counts))

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, first = P.pretokens(data, off)
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64)
        if self.memo.full():
            self._forget()
        number, new = self.memo.numbers(W.span_hash(W.prefix_hash(data, False), start, end))
        if len(new):
            raw = data.tobytes()
            found = [self.one(raw[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            size = np.fromiter(map(len, found), np.int32, len(found))
            self.at.extend(self.pool.n + np.cumsum(size) - size)
            self.size.extend(size)
            self.pool.extend(np.fromiter(chain.from_iterable(found), self.kind, int(size.sum())))
        size = self.size.data[number]
        edges = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=edges[1:])
        shift = (self.at.data[number] - edges[:-1]).astype(np.int32)
        tokens = self.pool.data[np.arange(edges[-1], dtype=np.int32) + np.repeat(shift, size)]
        return tokens, edges[first]


class Rooms:
    """Which open row has the least room of at least a given size: a segment tree over rooms 0..capacity."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.width
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the best fit, which is removed."""
        i = size + self.width
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.width
        row = self.rows[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, row


def pack(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (sequence, offset, length): best fit, in order of decreasing length; ties keep the order of the sequences."""
    whole = sizes // capacity
    rows = [[(int(s), int(k) * capacity, capacity)] for s in np.flatnonzero(whole) for k in range(whole[s])]
    rest = sizes - whole * capacity
    rooms = Rooms(capacity)
    for s in np.argsort(-rest, kind="stable"):
        n = int(rest[s])
        if not n:
            break
        if (fit := rooms.take(n)) is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = fit
        rows[row].append((int(s), int(whole[s]) * capacity, n))
        rooms.add(room - n, row)
    return rows


def _packer(ranks, capacity: int, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks.value)
        kind = encode.kind if end is None or end < 1 << 16 else np.dtype(np.uint32)
        task, matrix = TaskContext.get().partitionId() << 32, 0
        spot = np.uint16 if capacity <= 1 << 16 else np.uint32
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            for a, b, part, cut in W.chunks(data, off, GROUP_BYTES):
                tokens, edge = encode(part, cut)
                if end is not None:
                    tokens = np.insert(tokens.astype(kind), edge[1:], end)
                    edge = edge + np.arange(len(edge))
                ids = batch.column(0)[a:b]
                rows = pack(np.diff(edge), capacity)
                out, places = np.full((len(rows), capacity), 0 if end is None else end, kind), np.zeros((len(rows), capacity), spot)
                cuts, owners, offsets = [], [], []
                for r, pieces in enumerate(rows):
                    at, own = 0, [0]
                    for s, o, n in pieces:
                        out[r, at : at + n] = tokens[edge[s] + o : edge[s] + o + n]
                        places[r, at : at + n] = np.arange(n)
                        at += n
                        own.append(at)
                    cuts.append(own)
                    owners.append([s for s, _, _ in pieces])
                    offsets.append([o for _, o, _ in pieces])
                flat = ids.take(pa.array([s for x in owners for s in x], pa.int64()))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in owners]))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), task + matrix)), pa.array(np.arange(len(rows), dtype=np.int32)),
                        pa.array([x.tobytes() for x in out], pa.binary()), pa.array([x.tobytes() for x in places], pa.binary()),
                        pa.array([x[-1] for x in cuts], pa.int32()), pa.array(cuts, pa.list_(pa.int32())), listed, pa.array(offsets, pa.list_(pa.int64())),
                    ],
                    ["matrix", "row", "ids", "position_ids", "n_tokens", "cu_seqlens", "doc_ids", "doc_offsets"],
                )
                matrix += 1

    return run


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, end: int | None = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of packed token ids.

    matrix and row say where a row stands; ids and position_ids are little-endian whole numbers of 2 bytes (4 if the
    vocabulary or the row needs them), padded with the end token; n_tokens is the row's length without padding;
    cu_seqlens begins with 0 and ends with n_tokens; positions start from 0 in each segment; doc_ids and doc_offsets
    name each segment's document and its first token in that document's sequence.

    A null or empty text is a segment of the end token alone (none if ``end`` is None). Rows that repeat are packed as
    often as they stand. The vocabulary is read by the driver and sent out: its file bounds it.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"matrix long, row int, ids binary, position_ids binary, n_tokens int, cu_seqlens array<int>, doc_ids array<{kind}>, doc_offsets array<long>"
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(_packer(ranks, row_tokens, end), schema)


def op4_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
