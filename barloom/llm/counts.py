"""Token counts under a unigram vocabulary by dynamic programming over a trie.

The distinct pre-tokens of a stretch of texts are laid into a trie, one level after the other. The best score of a prefix
is a forward score that all pre-tokens with that prefix share, so it is computed once a node: the best, over the pieces
that end there, of the score at the piece's beginning plus the piece's own. A pre-token's count is stored where it ends,
and remembered; a text's count is the sum over its pre-tokens.

Pieces are byte strings with ranks; a piece's log-probability follows Zipf's law over the ranks. Scores are whole numbers
(``SCALE`` a unit of log-probability), so ties are exact: of equal scores the one with fewer tokens counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens as P
from . import words as W
from .packing import REMEMBERED, VOCABULARY, read_ranks

SCALE = 1 << 20
#: Tokens of one pre-token stay below this, so that the count can break ties of the score.
_TIE = 1 << 17
_WORST = np.int64(-(1 << 62))


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Whole-number scores of pieces: minus the logarithm of their place by rank."""
    return {piece: -round(float(np.log(rank + 1.0)) * SCALE) for piece, rank in ranks.items()}


class Pieces:
    """Piece scores by length and hash."""

    def __init__(self, scores: dict[bytes, int]):
        by: dict[int, list[bytes]] = {}
        for piece in scores:
            by.setdefault(len(piece), []).append(piece)
        self.by = {}
        for n, pieces in sorted(by.items()):
            h = W.hash_words(pieces, fold=False)
            order = np.argsort(h)
            self.by[n] = (h[order], np.array([scores[pieces[i]] for i in order], np.int64) * _TIE - 1)


#: Most nodes of a level below which the paths that are left, if none branches, are followed one by one.
FEW_PATHS = 64


def _path_counts(prefix: np.ndarray, begin: int, depth: int, sizes: list[int], past: list[tuple[int, int]], pieces: Pieces) -> list[int]:
    """Token counts of the pre-tokens of these ``sizes`` that begin at ``begin``, from a node at ``depth`` on.

    ``past`` holds (score, tokens) of the path's last nodes, (_WORST, 0) where no pieces reach one; the forward scores
    are the same as a level's. Where pieces end is looked up for many places at once.
    """
    best, found = list(past), {}
    first = depth + 1 - len(past)  # the depth of best[0]
    wanted, last = set(sizes), max(sizes)
    for low in range(depth + 1, last + 1, 1 << 16):
        high = min(last + 1, low + (1 << 16))
        at, length, score = [], [], []
        for n, (hashes, scores) in pieces.by.items():
            stop = begin + np.arange(max(low, n), high)
            h = W.span_hash(prefix, stop - n, stop)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[k] == h)
            at.append(stop[hit] - begin)
            length.append(np.full(len(hit), n))
            score.append((scores[k[hit]] + 1) // _TIE)
        at, length, score = (np.concatenate(x) for x in (at, length, score))
        order = np.argsort(at, kind="stable")
        at, length, score = at[order], length[order].tolist(), score[order].tolist()
        cut = np.searchsorted(at, np.arange(low, high + 1)).tolist()
        for i, d in enumerate(range(low, high)):
            top = (_WORST, 0)
            for k in range(cut[i], cut[i + 1]):
                v, t = best[d - length[k] - first]
                if v != _WORST and (v + score[k], t - 1) > top:
                    top = (v + score[k], t - 1)
            best.append(top)
            if d in wanted:
                found[d] = 1 if top[0] == _WORST else -top[1]
    return [found[s] for s in sizes]


def trie_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Token counts of the pre-tokens at these byte spans, which should be distinct; one that no pieces spell is one
    unknown token."""
    prefix = W.prefix_hash(data, False)
    size = end - start
    order = np.argsort(-size, kind="stable")  # those that reach a level are a leading part
    start, size = start[order], size[order]
    out = np.zeros(len(start), np.int64)
    # values and counts of the nodes above, one array a level, and the node that each pre-token passes there
    value, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    node = [np.zeros(len(start), np.int64)]
    lengths = list(pieces.by)
    for depth in range(1, int(size[0]) + 1 if len(size) else 0):
        live = int(np.searchsorted(-size, -depth, "right"))
        key = node[-1][:live] * 256 + data[start[:live] + depth - 1]
        _, sample, own = np.unique(key, return_index=True, return_inverse=True)
        best = np.full(len(sample), _WORST)
        tokens = np.zeros(len(sample), np.int64)
        stop = start[sample] + depth
        for n in lengths:
            if n > depth:
                break
            hashes, scores = pieces.by[n]
            h = W.span_hash(prefix, stop - n, stop)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            if not len(hit):
                continue
            above = node[-n][sample[hit]]
            v = value[-n][above]
            v = np.where(v == _WORST, _WORST, v + scores[at[hit]])
            better = v > best[hit]
            best[hit[better]] = v[better]
            tokens[hit[better]] = count[-n][above[better]] + 1
        value.append(best)
        count.append(tokens)
        node.append(own)
        if len(node) > lengths[-1]:
            value.pop(0), count.pop(0), node.pop(0)
        done = np.arange(int(np.searchsorted(-size, -depth, "left")), live)
        reached = own[done]
        out[order[done]] = np.where(best[reached] == _WORST, 1, tokens[reached])
        rest = int(np.searchsorted(-size, -depth, "left"))  # those that go on
        if depth % 64 == 0 and 0 < rest and len(np.unique(own[:rest])) <= FEW_PATHS:
            # the first of a node is its longest; if all others are its beginnings, nothing branches any more
            nodes, lead = np.unique(own[:rest], return_index=True)
            longest = start[lead][np.searchsorted(nodes, own[:rest])]
            stop = size[:rest]
            if (W.span_hash(prefix, start[:rest], start[:rest] + stop) == W.span_hash(prefix, longest, longest + stop)).all():
                for node_, i in zip(nodes.tolist(), lead.tolist(), strict=True):
                    mine = np.flatnonzero(own[:rest] == node_)
                    past = []
                    for v, t, places in zip(value, count, node, strict=True):
                        x, n = int(v[places[i]]), int(t[places[i]])
                        past.append((int(_WORST), 0) if x == _WORST else ((x + n) // _TIE, -n))
                    out[order[mine]] = _path_counts(prefix, int(start[i]), depth, stop[mine].tolist(), past, pieces)
                break
    return out


class Counter:
    """Token counts of columns of texts; remembers pre-tokens by hash."""

    def __init__(self, scores: dict[bytes, int]):
        self.pieces = Pieces(scores)
        self.memo, self.count = W.Memo(REMEMBERED), W.Column(np.int64)
        self.count.extend(np.zeros(1, np.int64))

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of every text."""
        start, end, first = P.pretokens(data, off)
        if not len(start):
            return np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
        if self.memo.full():
            self.memo.forget()
            self.count.n = 1
        number, new = self.memo.numbers(W.span_hash(W.prefix_hash(data, False), start, end))
        if len(new):
            self.count.extend(trie_counts(data, start[new], end[new], self.pieces))
        total = np.concatenate(([0], np.cumsum(self.count.data[number])))
        return np.diff(first), total[first[1:]] - total[first[:-1]]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, n_bytes, n_pretokens, n_tokens) of every row; a null or empty text counts 0, repeated rows count alike, no
    rows give no rows. A pre-token that the pieces cannot spell is one unknown token."""
    sent = docs.sparkSession.sparkContext.broadcast(zipf_scores(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            for a, b, part, cut in W.chunks(data, off):
                words, tokens = counter(part, cut)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(cut)), pa.array(words), pa.array(tokens)], [doc_id, "n_bytes", "n_pretokens", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"{doc_id} {kind}, n_bytes long, n_pretokens long, n_tokens long")


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
