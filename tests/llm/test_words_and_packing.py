import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from barloom.llm import counts, packing, pretokens
from barloom.llm import words as W

from .conftest import edge_rows

PATTERN = regex.compile(packing.PATTERN)


def test_words_and_hashes():
    texts = ["Ab ab\tAB  x", None, "", " ", "é\x0bé"]
    data, off = W.buffers(pa.array(texts))
    h, first = W.word_hashes(data, off, W.NON_BLANK)
    assert first.tolist() == [0, 4, 4, 4, 4, 6]
    assert h[0] == h[1] == h[2] != h[3] and h[4] == h[5]
    assert (W.hash_words([b"ab", b"x"]) == h[[0, 3]]).all()
    text, s = W.shingles(h, first, 4)
    assert text.tolist() == [0, 4]
    text, s = W.shingles(h, first, 3)
    assert text.tolist() == [0, 0, 4]


def test_memo_keeps_numbers():
    memo, names = W.Memo(1000), {}
    r = np.random.default_rng(0)
    for _ in range(50):
        h = r.integers(0, 1 << 64, 40, dtype=np.uint64)
        h[20:] = h[:20]
        number, new = memo.numbers(h)
        assert (number[20:] == number[:20]).all() and len(new) == 20
        for x, k in zip(h.tolist(), number.tolist(), strict=True):
            assert names.setdefault(k, x) == x


@pytest.mark.parametrize("seed", range(5))
def test_pretokens_follow_the_pattern(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(" \n\t'strevlmd!.1é²x　 漢🙂") for _ in range(r.randint(0, 30))) for _ in range(200)] + [t for _, t, _ in edge_rows() if t]
    data, off = W.buffers(pa.array(texts))
    start, end, first = pretokens.pretokens(data, off)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        assert [raw[start[i] : end[i]].decode() for i in range(first[k], first[k + 1])] == PATTERN.findall(t)


def test_pack_is_best_fit_decreasing_and_lossless():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = r.integers(0, 300, 120)
        rows = packing.pack(sizes, 100)
        assert all(sum(n for _, _, n in row) <= 100 for row in rows)
        spans = {}
        for row in rows:
            for s, o, n in row:
                spans.setdefault(s, []).append((o, n))
        for s, size in enumerate(sizes):
            at = 0
            for o, n in sorted(spans.get(s, [])):
                assert o == at
                at += n
            assert at == size
        free, used = [], int((sizes // 100).sum())
        for z in sorted((z % 100 for z in sizes), reverse=True):
            if z:
                fit = [f for f in free if f >= z]
                if fit:
                    free.remove(min(fit))
                    free.append(min(fit) - z)
                else:
                    free.append(100 - z)
                    used += 1
        assert len(rows) == used


def unpacked(rows, ranks):
    import tiktoken

    tok = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = {}
    for r in rows:
        ids, places = np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["position_ids"], np.uint16)
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] and len(cu) == len(r["doc_ids"]) + 1 and (ids[cu[-1] :] == packing.END).all()
        for a, b, d, o in zip(cu[:-1], cu[1:], r["doc_ids"], r["doc_offsets"], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(d, []).append((o, ids[a:b].tolist()))
    return tok, pieces


def test_packed_round_trip(clashing):
    ranks = packing.read_ranks(packing.VOCABULARY)
    rows = packing.packed(clashing, row_tokens=512).collect()
    tok, pieces = unpacked(rows, ranks)
    once = [(d, t) for d, t, _ in edge_rows() if d not in (None, 10)]
    for d, t in once:
        ids = [i for _, x in sorted(pieces[d]) for i in x]
        assert ids[-1] == packing.END and tok.decode(ids[:-1]) == (t or "") and ids[:-1] == tok.encode_ordinary(t or "")
    assert len([p for p in pieces[10] if p[0] == 0]) == 2 and len([p for p in pieces[None] if p[0] == 0]) == 2
    assert packing.packed(clashing.limit(0)).collect() == []


def test_packed_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tok, pieces = unpacked(packing.op4_packed_tokens(spark, small).collect(), packing.read_ranks(packing.VOCABULARY))
    for r in docs.collect():
        assert tok.decode([i for _, x in sorted(pieces[r["doc_id"]]) for i in x][:-1]) == r["text"]


def viterbi(word: bytes, scores: dict) -> int:
    best = [(0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        for n in range(1, i + 1):
            s = scores.get(word[i - n : i])
            if s is not None and best[i - n] is not None:
                found = (best[i - n][0] + s, best[i - n][1] - 1)
                best[i] = max(best[i], found) if best[i] else found
    return -best[-1][1]


def test_trie_counts_are_viterbi_counts(spark, clashing):
    scores = counts.zipf_scores(packing.read_ranks(packing.VOCABULARY))
    known = {}
    rows = counts.token_counts(clashing).collect()
    assert len(rows) == len(edge_rows())
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_pretokens"], r["n_tokens"]))
    for d, t, _ in edge_rows():
        found = PATTERN.findall(t or "")
        for w in found:
            if w not in known:
                known[w] = viterbi(w.encode(), scores)
        assert (len((t or "").encode()), len(found), sum(known[w] for w in found)) in got[d]
    assert counts.token_counts(clashing.limit(0)).collect() == []


def test_trie_agrees_with_a_unigram_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    scores = {"a": -1.0, "b": -1.25, "ab": -1.5, "abc": -4.0, "c": -2.0, "ca": -2.5, "bca": -2.75}
    model = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", -100.0), *scores.items()], 0))
    whole = {k.encode(): round(v * counts.SCALE) for k, v in scores.items()}
    r = random.Random(5)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(200)]
    data, off = W.buffers(pa.array(words))
    got = counts.trie_counts(data, off[:-1], off[1:], counts.Pieces(whole))
    for w, n in zip(words, got, strict=True):
        ids = model.encode(w).tokens
        assert sum(scores[t] for t in ids) == pytest.approx(best_score(w, scores)) and n == viterbi(w.encode(), whole)


@pytest.mark.parametrize("few", [0, 64])
def test_long_pretokens(monkeypatch, few):
    """Paths that no longer branch are followed by themselves; the counts are those of the levels."""
    monkeypatch.setattr(counts, "FEW_PATHS", few)
    whole = {k.encode(): round(v * counts.SCALE) for k, v in {"a": -1.0, "b": -1.25, "ab": -1.5, "abc": -4.0, "c": -2.0, "ca": -2.5, "bca": -2.75, "aaaa": -1.5}.items()}
    r = random.Random(6)
    one = "".join(r.choice("abc") for _ in range(900))
    words = [one, one[:300], one[:64], one[:500] + "d" + one[:100], "a" * 700, "a" * 701, "a" * 64, "b" * 65, "".join(r.choice("abc") for _ in range(200))]
    data, off = W.buffers(pa.array(words))
    got = counts.trie_counts(data, off[:-1], off[1:], counts.Pieces(whole))
    assert got.tolist() == [1 if "d" in w else viterbi(w.encode(), whole) for w in words]


def test_trie_counts_of_a_whole_table(spark, small):
    scores, known = counts.zipf_scores(packing.read_ranks(packing.VOCABULARY)), {}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in counts.op9_trie_token_counts(spark, small).collect():
        found = PATTERN.findall(texts[r["doc_id"]])
        for w in found:
            if w not in known:
                known[w] = viterbi(w.encode(), scores)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(found), sum(known[w] for w in found))


def best_score(w: str, scores: dict) -> float:
    best = [0.0] + [-1e9] * len(w)
    for i in range(1, len(w) + 1):
        for n in range(1, min(3, i) + 1):
            if w[i - n : i] in scores:
                best[i] = max(best[i], best[i - n] + scores[w[i - n : i]])
    return best[-1]
