"""Words of whole columns of texts at once, in numpy, on the buffers that Arrow hands over.

A text column is one run of UTF-8 bytes with offsets. Words are runs of bytes of a class, cut at text boundaries; a word
gets a 64-bit hash from prefix sums of a polynomial over randomised bytes, so that any span costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (one text may be longer).
CHUNK_BYTES = 4 << 20
#: Bytes of text whose words are hashed at once (one text may be longer): each takes some 40 bytes meanwhile.
HASH_BYTES = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse mod 2**64
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))


def _class(skip: str) -> np.ndarray:
    table = np.ones(256, bool)
    table[[ord(c) for c in skip]] = False
    return table


#: Bytes of ``[^\x20\x09-\x0D]+``: all but blanks.
NON_BLANK = _class(" \t\n\x0b\x0c\r")
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are lower-cased: letters, digits, all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table(fold: bool) -> np.ndarray:
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


_TABLES = {fold: _byte_table(fold) for fold in (False, True)}
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_B, _BINV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of stretches of whole texts of about ``most`` bytes."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and each text's first word's number (one more entry at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    m = kind[data]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    inner = off[(off > 0) & (off < len(data))]
    before[inner] = False
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[inner - 1] = False
    start = np.flatnonzero(m & ~before)
    end = np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(start, off)


def prefix_hash(data: np.ndarray, fold: bool) -> np.ndarray:
    """Prefix sums (one more than bytes) from which ``span_hash`` takes the hash of any span."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[fold][data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, each text's first word's number)."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, part, cut in chunks(data, off, HASH_BYTES):
        start, end, first = spans(part, cut, kind)
        hashes.append(span_hash(prefix_hash(part, fold), start, end))
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def hash_words(words: list[bytes], fold: bool = True) -> np.ndarray:
    """The same hashes for words given one by one."""
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    start = end - np.array([len(w) for w in words], np.int64)
    return span_hash(prefix_hash(data, fold), start, end)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all runs of ``width`` words inside a text; a shorter text, if not empty, is one run."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    if not len(hashes):
        return text, hashes
    place = np.arange(len(hashes)) - first[:-1][text]
    left = n[text] - place
    run = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        # a run that ends early adds nothing for the words it lacks; its length is hashed with it
        here = hashes[np.minimum(np.arange(k, len(hashes) + k), len(hashes) - 1)] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        run += np.where(left > k, here, np.uint64(0))
    run = mix64(run + np.minimum(left, width).astype(np.uint64))
    keep = (left >= width) | (place == 0)
    return text[keep], run[keep]


class Memo:
    """Numbers for hashes: a direct-mapped table in front of lists that only grow, until they are dropped whole.

    A hash that was pushed out of the table gets a new number when it comes again, so a number always means its hash.
    """

    BITS = 22

    def __init__(self, most: int):
        self.most = most
        self.table = np.zeros(1 << self.BITS, np.int32)
        self.known, self.n = np.zeros(1, np.uint64), 1  # number 0 is nobody's

    def full(self) -> bool:
        return self.n > self.most

    def forget(self) -> None:
        self.table[:] = 0
        self.n = 1

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a number for each hash, the places of those that got a new number, in the order of these numbers)."""
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        number = self.table[slot]
        miss = np.flatnonzero(self.known[number] != hashes) if self.n > 1 else np.arange(len(hashes))
        if not len(miss):
            return number, miss
        new, sample, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
        end = self.n + len(new)
        if end > len(self.known):
            self.known = np.concatenate([self.known[: self.n], np.zeros(max(end, 2 * len(self.known)) - self.n, np.uint64)])
        self.known[self.n : end] = new
        own = np.arange(self.n, end, dtype=np.int32)
        self.table[slot[miss][sample]] = own
        number[miss] = own[inverse]
        self.n = end
        return number, miss[sample]


class Column:
    """A growing array."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def clear(self) -> None:
        self.n = 0

    def extend(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(end, 2 * len(self.data)) - self.n, self.data.dtype)])
        self.data[self.n : end] = more
        self.n = end
