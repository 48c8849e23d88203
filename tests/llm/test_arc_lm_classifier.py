import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import arc, classifier, pitman_yor
from barloom.llm import words as W
from barloom.llm.shared import shared_folder

from .conftest import edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    pages = [(1, "http://a.example/x y", b"<p>one\n\n\r\n\r\n</p>"), (None, None, b""), (-5, "http://b.example/", "é\n1 0 x\n".encode())]
    got = list(arc.read_arc(arc.write_arc(pages, version, "x.arc")))
    assert len(got) == 3 and all(set(f) == set(arc.FIELDS[version].split()) for f, _ in got)
    for (number, _, payload), (fields, body) in zip(pages, got, strict=True):
        head, found = arc.split_http(body)
        assert found == payload and arc.http_field(head, b"x-page-number") == (None if number is None else str(number))
    assert got[0][0]["URL"] == "http://a.example/x%20y" and got[1][0]["URL"] == "about:blank"


def test_arc_rejects_wrong_lengths():
    data = arc.write_arc([(1, "http://a/", b"abc")], 1, "x.arc")
    with pytest.raises(ValueError):
        list(arc.read_arc(data[:-3]))


def test_record_ids_hold_their_number():
    for n in (None, 0, 1, -1, 2**63 - 1, -(2**63), 12345678901):
        i = arc.record_id(n, b"x")
        assert arc.record_number(i) == n and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", i)


@pytest.mark.parametrize("most", [0, 50_000])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(arc, "MOST_SENT", most)
    monkeypatch.setattr(arc, "ARC_BYTES", 300)
    same, other = "<p>" + "same " * 30 + "\r\n\r\nWARC/1.1\r\n", "é" * 60
    pages = [(5, "http://a/1", same), (3, "http://a/2", same), (9, None, same), (3, "http://a/2", same), (4, "http://b", "tiny"), (6, "http://c", "tiny"), (7, "http://d", None), (8, "http://e", ""), (None, "http://f", same), (11, "x", other), (10, "y", other), (-2, "z", "long" * 500_000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit("x"))
    path = shared_folder(spark, "warc")
    arc.write_warc(arc.with_revisits(arc.convert(arc.arc_files(table.repartition(3)))), path)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in arc.read_warcs(spark, path).collect())
    first = {same: 3, other: 10}
    want = Counter()
    for d, _, html in pages:
        b = (html or "").encode()
        revisit = len(b) >= 100 and html in first and d != first[html]
        want[(d, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None)] += 1
    assert got == want
    empty = shared_folder(spark, "warc")
    arc.write_warc(arc.with_revisits(arc.convert(arc.arc_files(table.limit(0)))), empty)
    assert arc.read_warcs(spark, empty).collect() == []


def seating_law(c, strength, discount, rest, base):
    """Chances of 1..c tables of c customers of one dish, by the generalised Stirling numbers."""
    ways = np.zeros((c + 1, c + 1))
    ways[0, 0] = 1
    for n in range(c):
        for t in range(n + 1):
            ways[n + 1, t + 1] += ways[n, t]
            ways[n + 1, t] += ways[n, t] * (n - t * discount)
    law = np.array([ways[c, t] * math.prod((strength + discount * (rest + k)) * base for k in range(t)) for t in range(1, c + 1)])
    return law / law.sum()


def test_seats_follow_the_law():
    rng = np.random.default_rng(1)
    for c, base, rest, off in ((2, 0.1, 5, 0.01), (2, 0.5, 0, 0.01), (3, 0.01, 30, 0.01), (3, 0.5, 0, 0.01), (5, 0.1, 5, 0.03), (10, 0.01, 30, 0.04), (20, 0.05, 300, 0.04), (60, 0.001, 50, 0.01), (60, 0.1, 5, 0.09), (90, 0.05, 2000, 0.03)):
        want = seating_law(c, 1.0, 0.75, rest, base) @ np.arange(1, c + 1)
        got = pitman_yor.seat(np.full(20_000, c), np.full(20_000, base), np.full(20_000, rest), 1.0, 0.75, rng.integers(0, 1 << 64, 20_000, dtype=np.uint64), 1)
        assert got.min() >= 1 and got.max() <= c and got.mean() == pytest.approx(want, rel=off)


def test_binomials():
    rng = np.random.default_rng(3)
    for n, p in ((2, 0.3), (40, 0.02), (40, 0.97), (5000, 0.001), (5000, 0.4)):
        got = pitman_yor._binomial(n, np.full(40_000, p), rng.random(40_000), rng.random(40_000))
        assert got.mean() == pytest.approx(n * p, rel=0.03) and got.std() == pytest.approx(math.sqrt(n * p * (1 - p)), rel=0.04)


def spread(texts, held, parts, sweeps, samples, split=1, batches=1):
    """The operator's parts, run one after the other in this process: scores of the texts."""
    ways = np.full(1 << pitman_yor.COUNT_BITS, split, np.int32)
    rows, where = [], []
    for k, ids in enumerate(np.array_split(np.arange(len(texts)), batches)):
        data, off = W.buffers(pa.array([texts[i] for i in ids], pa.string()))
        rows += pitman_yor._batch_rows(k, data, off, np.array([held[i] for i in ids]), parts, ways)[0]
        where.append(ids)
    by = {p: pitman_yor.Partition([(b, x) for q, b, x in rows if q == p], parts, ways) for p in {r[0] for r in rows}}
    first = None
    for k in range(sweeps + 1):
        asked = {}
        for p, part in by.items():
            for q, blob in part.ask():
                asked.setdefault(q, []).append((p, blob))
        first = first or asked
        back = {}
        for q, got in asked.items():
            for p, blob in pitman_yor.answer(first[q], got):
                back.setdefault(p, []).append((q, blob))
        for p, part in by.items():
            part.hear(back[p], last=k == sweeps)
            if k > sweeps - samples:
                part.mean += part.found / samples
    score = np.zeros(len(texts))
    for part in by.values():
        for b, blob in zip(part.batches, part.sums(), strict=True):
            _, there, value, _, _ = pitman_yor.load(blob)
            score[where[b][there]] += value
    return score


def gibbs(texts, held, sweeps, burn, seed=0):
    """The same model by the textbook: tables with their sizes, one customer after the other taken out and seated again."""
    r = random.Random(seed)
    lines = [["<"] + t.split() + [">"] for t in texts]
    pairs = [list(zip(x[:-1], x[1:], strict=True)) for x in lines]
    train = [p for x, h in zip(pairs, held, strict=True) if not h for p in x]
    words = {w for _, w in train}
    sizes, root, total, tables = {}, Counter(), Counter(), Counter()
    base = lambda w: (root[w] + pitman_yor.ROOT_STRENGTH) / (pitman_yor.ROOT_STRENGTH * (len(words) + 1) + sum(root.values()))

    def sit(u, w):
        own = sizes.setdefault((u, w), [])
        weights = [n - pitman_yor.DISCOUNT for n in own] + [(pitman_yor.STRENGTH + pitman_yor.DISCOUNT * tables[u]) * base(w)]
        k = r.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(0)
            root[w] += 1
            tables[u] += 1
        own[k] += 1
        total[u] += 1

    def leave(u, w):
        own = sizes[u, w]
        k = r.choices(range(len(own)), own)[0]
        own[k] -= 1
        total[u] -= 1
        if not own[k]:
            own.pop(k)
            root[w] -= 1
            tables[u] -= 1

    for p in train:
        sit(*p)
    mean = {p: 0.0 for x in pairs for p in x}
    for k in range(sweeps):
        for p in train:
            leave(*p)
            sit(*p)
        if k >= burn:
            for u, w in mean:
                own = sizes.get((u, w), [])
                mean[u, w] += (sum(own) - pitman_yor.DISCOUNT * len(own) + (pitman_yor.STRENGTH + pitman_yor.DISCOUNT * tables[u]) * base(w)) / (pitman_yor.STRENGTH + total[u]) / (sweeps - burn)
    return np.array([sum(math.log10(mean[p]) for p in x) for x in pairs])


def small_corpus():
    r = random.Random(8)
    words, texts = [f"w{i}" for i in range(14)], []
    for i in range(24):
        at, text = r.randrange(14), []
        for _ in range(r.randrange(3, 40)):
            at = (at + r.choice([1, 1, 1, 2, 5])) % 14 if r.random() < 0.8 else r.randrange(14)
            text.append(words[at] if r.random() < 0.97 else f"rare{r.randrange(30)}")
        texts.append(" ".join(text))
    return texts, [i % 6 == 0 for i in range(24)]


def test_scores_are_those_of_a_plain_sampler():
    """Within 2 % of the log-probability of each text, and 1 % of all."""
    texts, held = small_corpus()
    want, got = gibbs(texts, held, 300, 50), spread(texts, held, 1, 40, 30)
    assert got == pytest.approx(want, rel=0.02) and got.sum() == pytest.approx(want.sum(), rel=0.01)


def test_scores_do_not_follow_the_spread():
    """Neither partitions nor batches, nor contexts that are dealt over several partitions, change a score."""
    texts, held = small_corpus()
    one = spread(texts, held, 1, 3, 2)
    for parts, split, batches in ((1, 1, 5), (7, 1, 3), (7, 3, 3), (40, 50, 1)):
        assert spread(texts, held, parts, 3, 2, split, batches) == pytest.approx(one, rel=1e-6)


def brute_base(rows, held):
    tok = [WORD.findall((t or "").translate(LOWER)) + ["\0"] for _, t in rows]
    c = Counter(w for (d, _), x in zip(rows, tok, strict=True) if not held(d) for w in x)
    n, v = sum(c.values()), len(c)
    return [(d, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for (d, _), x in zip(rows, tok, strict=True)]


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def test_base_scores_and_counts(spark, clashing, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_WORDS", 900)
    monkeypatch.setattr(pitman_yor, "LEAST_PARTS", 6)
    monkeypatch.setattr(pitman_yor, "BATCH_BYTES", 5_000)
    got = pitman_yor.score_texts(clashing, pitman_yor.held_out()).collect()
    rows = [(d, t) for d, t, _ in edge_rows()]
    want = brute_base(rows, is_held)
    scores = spread([(t or "").translate(LOWER) for _, t in rows], [is_held(d) for d, _ in rows], 1, pitman_yor.SWEEPS, pitman_yor.SAMPLES)
    key = lambda d, n, k: (str(d), n, k)
    got, want = sorted(got, key=lambda r: key(r["doc_id"], r["n_tokens"], r["n_known"])), sorted(zip(want, scores, strict=True), key=lambda r: key(*r[0][:3]))
    for r, (w, score) in zip(got, want, strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert r["held_out"] == is_held(r["doc_id"]) and r["score"] == pytest.approx(score, rel=1e-6)
    assert pitman_yor.score_texts(clashing.limit(0), pitman_yor.held_out()).collect() == []


def test_probabilities_sum_to_one(spark, monkeypatch):
    """From texts of one and two words the probabilities P(x | start) follow, if those behind each x sum to one."""
    monkeypatch.setattr(pitman_yor, "LEAST_PARTS", 3)
    train = [(i, t) for i, t in enumerate(["a b a b c", "a a c", "b c", "a b", "c", "a b c a b"] * 3)]
    words = ["a", "b", "c", "zzz"]
    asked = [(100 + k, t) for k, t in enumerate(["", *words, *(f"{x} {y}" for x in words for y in words)])]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string")
    rows = pitman_yor.score_texts(docs, F.col("doc_id") >= 100).where("doc_id >= 100").orderBy("doc_id").collect()
    p = {t: 10 ** r["score"] for (_, t), r in zip(asked, rows, strict=True)}
    # P(x|start) = P(x) + sum over y of P(x y) / P(end|y), and P(end|y) = P(y) / P(y|start)
    system = np.eye(4) - np.array([[p[f"{x} {y}"] / p[y] for y in words] for x in words])
    first = np.linalg.solve(system, np.array([p[x] for x in words]))
    assert p[""] + first.sum() == pytest.approx(1, abs=1e-6)


def test_held_out_perplexity_beats_the_base(spark, small):
    rows = pitman_yor.op7_pitman_yor_scores(spark, small).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_sum_of_squares_identity():
    m, rng = classifier.Machine.empty(), np.random.default_rng(0)
    m.linear[:] = rng.normal(size=len(m.linear))
    m.vectors[:] = rng.normal(size=m.vectors.shape)
    data, off = W.buffers(pa.array([prose(1, 12), "", prose(2, 7)]))
    edge, slot, value, stats = classifier.features(data, off, np.array([-1, -1, 3]))
    raw, _, x = m.raw(edge, slot, value, stats)
    for i in range(3):
        index = [*slot[edge[i] : edge[i + 1]], *range(1 << classifier.WORD_BITS, len(m.linear))]
        xs = [*value[edge[i] : edge[i + 1]], *x[i]]
        want = m.bias + sum(m.linear[a] * v for a, v in zip(index, xs, strict=True))
        want += sum(m.vectors[index[a]] @ m.vectors[index[b]] * xs[a] * xs[b] for a in range(len(xs)) for b in range(a))
        assert raw[i] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = classifier.op8_factorisation_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_classifier_edges(spark, clashing):
    labels = spark.createDataFrame([(1, 1), (16, 0), (16, 1), (13, 0), (9, 1), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    machine = classifier.train(clashing, labels, F.lit(True))
    rows = classifier.scored(clashing, machine).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert classifier.scored(clashing.limit(0), machine).collect() == []
    none = classifier.train(clashing, labels.limit(0), F.lit(True))
    assert {r["score"] for r in classifier.scored(clashing, none).collect()} == {0.5}
    one = classifier.train(clashing, labels.where("doc_id IN (1, 9)"), F.lit(True))
    assert {round(r["score"], 6) for r in classifier.scored(clashing, one).collect()} == {0.99}
