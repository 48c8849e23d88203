import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing, rules, sharding

from .conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, edge, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    rows = rules.op10_quality_rules(spark, str(tmp_path)).collect()
    got = Counter((r[0], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((d, *brute_counts(t)) for d, t, _ in edge_rows())
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_cascade_verdict_does_not_follow_the_order(edge):
    split = rules.with_words(edge)
    one = rules.cascade(split, rules.RULES).where("failed_rule IS NULL").select("doc_id").collect()
    two = rules.cascade(split, rules.RULES[::-1]).where("failed_rule IS NULL").select("doc_id").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_rules_are_ordered_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([("x " * 100,)] * 50 + [("a b",)] * 2, "text string")
    ordered = [r.name for r in rules.order_rules(docs, rules.RULES)]
    assert sorted(ordered) == sorted(r.name for r in rules.RULES)
    assert ordered.index("word_length") < ordered.index("symbols") and ordered.index("repeats") < ordered.index("exclamations")
    assert rules.order_rules(docs.limit(0), rules.RULES) == rules.RULES


def test_quality_filter_keeps_columns(clashing):
    kept = rules.quality_filter(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, t, _ in edge_rows() if d not in (13, 15, 16) and brute_counts(t)[0] and not _fails(d)}
    assert rules.quality_filter(clashing.limit(0)).collect() == []


def _fails(d):
    t = next(t for k, t, _ in edge_rows() if k == d)
    n, _, _, _, rep = brute_counts(t)
    return rep > n / 2


def edf(shares):
    """One period by the textbook: each slot to the released block with the earliest deadline."""
    names = sorted(shares, key=lambda x: (x is not None, x))
    period, had, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for t in range(period):
        ready = [(-(-(had[s] + 1) * period // shares[s]), -shares[s], i, s) for i, s in enumerate(names) if had[s] < shares[s] and had[s] * period // shares[s] <= t]
        *_, s = min(ready)
        out.append((s, had[s]))
        had[s] += 1
    return out


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 33, "b": 1, "c": 7, "d": 19, None: 3}, {"a": 1, "b": 1, "c": 1}, {"a": 2, "b": 2, "c": 4, "d": 1, "e": 1}, {f"s{i:02}": 1 + i * i % 7 for i in range(40)}])
def test_period_schedule(spark, shares):
    rows = mixing.period_schedule(spark, shares).orderBy("slot").collect()
    assert [(r["source"], r["turn"]) for r in rows] == edf(shares)[: len(rows)]
    period, had = len(rows), Counter()
    shares = {s: c * period / sum(shares.values()) for s, c in shares.items()}
    for t, r in enumerate(rows, 1):
        had[r["source"]] += 1
        for s, c in shares.items():
            assert abs(had[s] - t * c / period) < 1


def test_mix_places_every_row_once(clashing):
    shares = {"a": 3, "b": 2, "c": 1, None: 1}
    rows = mixing.mix(clashing, shares, block_docs=2).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _, _ in edge_rows())
    per = {}
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]
        per.setdefault(r["source"], []).append((r["block"], r["place"]))
    for got in per.values():
        assert sorted(got) == [(i // 2, i % 2) for i in range(len(got))]
    with pytest.raises(ValueError):
        mixing.mix(clashing, {"a": 1})
    assert mixing.mix(clashing.limit(0), {"a": 1}).collect() == []


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SENT", 1_000)
    docs = spark.range(15_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3_000, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"))
    rows = mixing.mix(docs, mixing.tempered_shares(docs)).collect()
    assert len(rows) == 15_000 and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert len({(r["slot"], r["place"]) for r in rows}) == 15_000
    hot = sorted({r["slot"] for r in rows if r["source"] == "hot"})
    assert len(hot) == 3_000 // mixing.BLOCK_DOCS and hot[-1] > 10_000


def test_mixed_order_keeps_all_rows(clashing):
    out = mixing.mixed_order(clashing, partitions=3)
    assert out.columns == clashing.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((d, t) for d, t, _ in edge_rows())


def test_mixed_order_is_the_mixture(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    place = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(docs, mixing.tempered_shares(docs)).collect()}
    order = [place[r["doc_id"]] for r in mixing.mixed_order(docs, partitions=4).select("doc_id").collect()]
    assert order == sorted(order)


def greedy(sizes, capacity):
    n, left = 1, capacity
    for s in sizes:
        if s > capacity:
            return 10**9
        if s > left:
            n, left = n + 1, capacity
        left -= s
    return n


def test_minimax_is_the_smallest_capacity(spark, small, edge):
    for docs, shards in ((spark.read.parquet(f"{small}/documents.parquet"), 16), (spark.read.parquet(f"{small}/documents.parquet"), 3), (edge, 4), (edge, 1)):
        hashed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("s")).collect()
        groups = Counter()
        for r in hashed:
            groups[r["h"]] += r["s"]
        sizes = [s for _, s in sorted(groups.items())]
        _, capacity = sharding.minimax_cuts(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("_size")), shards)
        assert greedy(sizes, capacity) <= shards < greedy(sizes, capacity - 1)
        rows = sharding.assign(docs, shards).collect()
        held = Counter()
        for r in rows:
            held[r["shard"]] += r["size"]
        assert max(held.values()) == capacity and max(held) < shards


def test_cells_are_split_to_single_hashes(spark, monkeypatch):
    """Neighbouring hashes, which only cells of all 64 bits tell apart."""
    rows = [((1 << 61) + i, 5 + i % 3) for i in range(40)] + [(-7, 3), (-6, 9)]
    hashed = spark.createDataFrame(rows, "_h long, _size long")
    cuts, capacity = sharding.minimax_cuts(hashed, 4)
    sizes = [s for _, s in sorted(rows)]
    assert greedy(sizes, capacity) <= 4 < greedy(sizes, capacity - 1) and set(cuts) <= {h for h, _ in rows}


def test_shards(clashing):
    rows = sharding.assign(clashing, 4).collect()
    texts = {}
    for d, t, _ in edge_rows():
        texts.setdefault(d, []).append(t or "")
    assert len(rows) == len(edge_rows())
    shard_of, slots = {}, {}
    for r in rows:
        match = [t for t in texts[r["doc_id"]] if zlib.crc32(t.encode()) == r["text_crc32"]]
        assert match and r["size"] == len(match[0].encode()) + 1
        assert shard_of.setdefault(match[0], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert sharding.assign(clashing.limit(0), 4).collect() == []
