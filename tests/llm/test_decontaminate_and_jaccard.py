import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import components, decontaminate, fixed, hot, jaccard

from .conftest import edge_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    a = r.integers(0, int(r.integers(1, 6)), int(r.integers(1, 150)))
    assert decontaminate.suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def brute_hits(text, items):
    w = LETTERS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for k, item in items:
        x = LETTERS.findall((item or "").translate(LOWER))
        n = min(10, len(x))
        for j in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[j : j + n]:
                    hit.update(range(i, i + n))
                    found |= {str(k)} - {"None"}
    return len(w), len(hit), sorted(found)


def brute_longest(text, items):
    """(length, first place) of the longest run of an item's words in a text that holds a window."""
    w, best = LETTERS.findall((text or "").translate(LOWER)), (0, 1)
    for _, item in items:
        x = LETTERS.findall((item or "").translate(LOWER))
        for j in range(len(x)):
            for i in range(len(w)):
                n = 0
                while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                    n += 1
                if n and n >= min(10, len(x)):
                    best = max(best, (n, -i))
    return best[0], -best[1]


def bench(spark):
    long = prose(1, 120).split()
    items = [(1, " ".join(long[20:50])), (2, " ".join(long[70:79])), (3, "The, the; THE"), (4, None), (5, ""), (6, "zzz"), (7, " ".join(long[:9]) + " nowhere " + " ".join(long[9:30])), (8, prose(9, 30)), (8, "one"), (None, "漢字 naïve")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def brute_rows(items):
    """The very long text is looked at around its own planted words only, as it holds no other item's."""
    rows = []
    for d, t, _ in edge_rows():
        words, hit, found = brute_hits(t, items) if d != 9 else (len(LETTERS.findall(t)), 9, ["9"])
        long, place = brute_longest(t, items) if d != 9 else (9, 20_000)
        rows.append((d, words, hit, tuple(found), long, place))
    return Counter(rows)


def test_contamination(spark, clashing, monkeypatch):
    items, _ = bench(spark)
    huge = next(t for d, t, _ in edge_rows() if d == 9).split()
    items.append((9, " ".join(huge[20_000:20_009])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_rows(items)
    shown = lambda rows: Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["longest_match"], r["match_place"]) for r in rows)
    assert shown(decontaminate.contamination(clashing, benchmark).collect()) == want
    kept = decontaminate.decontaminate(clashing, benchmark)
    clean = Counter((d, t) for d, t, _ in edge_rows() if d != 9 and brute_hits(t, items)[1] == 0)
    assert kept.columns == clashing.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == clean
    # a benchmark of many blocks and passes
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 3)
    assert shown(decontaminate.contamination(clashing, benchmark).collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in decontaminate.decontaminate(clashing, benchmark).collect()) == clean
    assert decontaminate.contamination(clashing.limit(0), benchmark).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(clashing, benchmark.limit(0)).collect())


def test_longest_match_of_every_copy():
    """All texts that hold a passage get its length, and many equal short items are one interval."""
    passage = [f"p{i}" for i in range(14)]
    texts = [" ".join(["x", "y"] + passage + ["z"]), " ".join(passage), " ".join(["q"] + passage[:11]), "the cat the dog the", "cat"]
    items = decontaminate.Items(list(range(501)), [" ".join(passage) + " tail"] + ["the"] * 500, 10)
    data, off = decontaminate.W.buffers(decontaminate.pa.array(texts))
    shard = decontaminate.Shard(data, off)
    shard.look_for(items)
    assert shard.longest.tolist() == [14, 14, 11, 1, 0] and shard.place.tolist() == [2, 0, 1, 0, -1]
    assert shard.n_hit().tolist() == [14, 14, 11, 3, 0] and [len(x) for x in shard.found] == [1, 1, 1, 500, 0]


def test_highest_of_intervals():
    r = np.random.default_rng(2)
    for n in (1, 2, 17, 64, 100):
        begin = r.integers(0, n, 12)
        end = np.array([r.integers(b + 1, n + 1) for b in begin])
        value = r.integers(1, 9, 12)
        want = [max([v for b, e, v in zip(begin, end, value, strict=True) if b <= i < e], default=0) for i in range(n)]
        assert decontaminate._highest(n, begin, end, value).tolist() == want


def shingles(t, width=4):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width=4, percent=85):
    sets = [(d, shingles(t, width)) for d, t in rows]
    label = {d: d for d, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            k = len(x & y)
            if x and y and 100 * k >= percent * (len(x) + len(y) - k):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {d: (len(x), root(d)) for d, x in sets}


def drifting(n=160, seed=2):
    """Chains and stars of near copies, so that links join what isn't alike, and copies that differ in blanks and case."""
    r, rows = random.Random(seed), []
    for g in range(8):
        now = prose(100 + g, r.choice([6, 20, 60, 150])).split()
        for _ in range(n // 8):
            now = [("new%d" % r.randrange(10**6)) if r.random() < 0.01 else w for w in now]
            rows.append((len(rows) * 3 + 1, ("  " if r.random() < 0.2 else " ").join(w.upper() if r.random() < 0.05 else w for w in now)))
    r.shuffle(rows)
    return rows


def test_components_of_drifting_copies(spark):
    rows = drifting()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_salted_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 3)
    rows = drifting(seed=5)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_jaccard_edges(clashing):
    got = jaccard.jaccard_components(clashing).collect()
    assert len(got) == len(edge_rows())
    rows = {d: t for d, t, _ in edge_rows() if d is not None}
    want = brute_components(list(rows.items()))
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] is None
    assert jaccard.jaccard_components(clashing.limit(0)).collect() == []


def test_unlike_texts_of_one_id(spark):
    """What links to any text of an id is linked to it, whatever the order of the rows."""
    a, b, c, d, e, f = (prose(50 + i, 100) for i in range(6))
    rows = [(5, a), (5, b), (9, b + " more"), (15, c), (15, d), (19, d + " more"), (13, c + " more"), (17, prose(60, 100))]
    rows += [(None, e), (28, e + " more"), (None, f), (24, ""), (24, e), (26, None)]
    want = {5: 5, 9: 5, 15: 13, 19: 13, 13: 13, 17: 17, 28: 24, 24: 24, 26: 26}
    for given in (rows, rows[::-1]):
        got = jaccard.jaccard_components(spark.createDataFrame(given, "doc_id long, text string").coalesce(1)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["24", "None"]


def test_hot_joins_are_joins(spark, monkeypatch):
    r = random.Random(4)
    left = [(r.choice([0, 0, 0, 1, 2, 3, None, 7]), i) for i in range(300)]
    right = [(k, 10 * k) for k in (0, 1, 2, 5)]
    monkeypatch.setattr(hot, "MOST_HOT", 5)
    a, b = spark.createDataFrame(left, "k long, v long"), spark.createDataFrame(right, "k long, w long")
    for how in ("inner", "left", "left_semi"):
        assert Counter(hot.hot_join(a, b, "k", how).select("k", "v").collect()) == Counter(a.join(b, "k", how).select("k", "v").collect())
    assert Counter(hot.salted_join(a, b, "k", "v", a).select("k", "v", "w").collect()) == Counter(a.join(b, "k").select("k", "v", "w").collect())
    one, two = hot.block_pairs(a, "k", "v", 4)
    got = one.join(two.withColumnRenamed("v", "x"), ["k", "_one", "_two"]).select("k", "v", "x").collect()
    assert Counter(got) == Counter(a.join(a.withColumnRenamed("v", "x"), "k").select("k", "v", "x").collect())


def test_jaccard_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = jaccard.op6_prefix_jaccard(spark, small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_long_chains(spark):
    r = random.Random(1)
    ids = list(range(300))
    r.shuffle(ids)
    edges = [(min(a, b), max(a, b)) for a, b in zip(ids[:200], ids[1:201], strict=False)] + [(ids[250], ids[251])]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = min(ids[:201])
    assert got == {**{i: low for i in ids[:201]}, ids[250]: min(ids[250:252]), ids[251]: min(ids[250:252])}


def test_fixed_table(spark):
    def fill(batch, table):
        np.add.at(table, batch.column(0).to_numpy(), 1)

    table = fixed.fixed_table(spark.range(0, 200_000, 3, 5), 200_000, np.dtype(np.int64), fill, np.add)
    assert table.sum() == 66_667 and (table[::3] == 1).all()


def test_suffix_filter_keeps_links_of_sets_whose_cells_are_cut_off(spark):
    from barloom.llm import jaccard as J

    words = [f"w{i}" for i in range(3 * J.CELLS * J.CELL_MOST)]
    near = list(words)
    near[::100] = [f"x{i}" for i in range(len(words[::100]))]
    far = list(words)
    far[::4] = [f"y{i}" for i in range(len(words[::4]))]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words[: len(words) // 2]))], "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()}
    assert found == {1: (len(words) - 3, 1), 2: (len(words) - 3, 1), 3: (len(words) - 3, 3), 4: (len(words) // 2 - 3, 4)}


def test_the_set_with_fewest_changes_leads(spark):
    """Of a bucket's sets that with least before the shingle leads, not the first row; copies of it are joined by a star."""
    rows = [(5, 0, 1, node, 100, place) for node, place in ((1, 7), (2, 5), (3, 0), (4, 9), (5, 3))] + [(6, 0, 1, 1, 100, 0)]
    got = jaccard._shared(spark.createDataFrame(rows, "shingle long, salt int, salts int, node long, n long, place int")).collect()
    assert sorted(r.node for r in got) == [1, 2, 3, 4, 5]
    assert {(r.leader, r.leader_n, r.leader_place) for r in got} == {(3, 100, 0)}


def test_rows_that_may_go(spark):
    """None of the rows that go is taken for one that stays, and few others for such a one, so few texts are moved."""
    gone = spark.range(0, 3_000_000_000, 1_000_000)
    held = jaccard._maybe(gone, "id")
    assert gone.where(~held("id")).isEmpty()
    assert spark.range(1, 20_001).where(held("id")).count() < 2_000
