"""The whole pipeline against brute force on a small table."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing, packing, rules
from barloom.llm.shared import through_table

from .conftest import edge_rows, prose
from .test_decontaminate_and_jaccard import brute_components, brute_hits
from .test_rules_mixing_sharding import brute_counts
from .test_words_and_packing import unpacked


def passes(t):
    n, chars, symbols, dup, rep = brute_counts(t)
    lines = len([x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")])
    upper, exclaims = sum(c.isupper() for c in t or ""), (t or "").count("!")
    return not (n < 1 or 100 * rep > 50 * n or 10 * symbols > n or 100 * dup > 50 * lines or chars < 2 * n or chars > 20 * n or 100 * upper > 30 * chars or 100 * exclaims > 30 * n)


def test_stages(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = [(r["doc_id"], r["text"]) for r in docs if passes(r["text"])]
    group = brute_components(kept, 5, 80)
    kept = [(d, t) for d, t in kept if group[d][1] == d]
    kept = {d: t for d, t in kept if brute_hits(t, items)[1] == 0}
    rows = corpus_pipeline.run(spark, small).collect()
    tok, pieces = unpacked(rows, packing.read_ranks(packing.VOCABULARY))
    assert set(pieces) == set(kept) and 0 < len(kept) < len(docs)
    for d, t in kept.items():
        assert tok.decode([i for _, x in sorted(pieces[d]) for i in x][:-1]) == t
    assert sum(len(np.frombuffer(r["ids"], np.uint16)) for r in rows) == len(rows) * packing.ROW_TOKENS
    assert len(rules.RULES) == 7


def test_near_copies_between_the_thresholds(spark):
    """Five-word Jaccard of 0.8 or more, four-word Jaccard under 0.85: the query leaves them apart, the pipeline doesn't."""
    base = prose(31, 1000).split()
    scattered = ["new%d" % i if i % 50 == 25 else w for i, w in enumerate(base)]
    scattered[10] = "new"
    rows = [(1, " ".join(base)), (2, " ".join(base) + " " + prose(32, 200)), (3, " ".join(base[:830])), (4, " ".join(scattered)), (5, prose(33, 1000))]
    near = {k: brute_components([rows[0], rows[k]]) for k in (1, 2, 3)}
    assert all(x[rows[k][0]][1] == rows[k][0] for k, x in near.items())
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5]


def test_packed_in_the_order_of_the_mixture(spark):
    """Later stretches of the mixture have longer files, which a scan reads first."""
    ids = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(400)], "doc_id long, source string")
    order = sorted(mixing.mix(ids, mixing.tempered_shares(ids)).collect(), key=lambda r: (r["slot"], r["place"]))
    at = {r["doc_id"]: i for i, r in enumerate(order)}
    docs = spark.createDataFrame([(r["doc_id"], r["source"], prose(i, 20 + i)) for i, r in enumerate(order)], "doc_id long, source string, text string")
    mixed = through_table(corpus_pipeline.source_mixing(spark, docs, ""), "mixed")
    assert len(mixed.inputFiles()) > 2
    found = {}
    for r in corpus_pipeline.token_packing(spark, mixed, "").collect():
        found.setdefault(r["matrix"], set()).update(at[d] for d in r["doc_ids"])
    assert len(found) > 2
    assert [i for _, x in sorted(found.items()) for i in sorted(x)] == list(range(400))


def test_one_row_of_a_group_stays(spark):
    """Repeated rows, copies without an id, and unlike texts under one id."""
    a, b, c, d = (prose(40 + i, 100) for i in range(4))
    rows = [(7, a), (7, a), (9, a + " more"), (None, a), (None, b), (None, b), (3, c), (3, d), (3, d), (5, d + " more"), (None, None), (None, "")]
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(str, kept.collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in [(7, a), (None, b), (3, c), (3, d), (None, None), (None, "")])


def test_edge_rows_through_all_stages(spark, edge, tmp_path):
    """Nulls, empties, one very long text, copies and repeated rows, from table to tokens, and an empty table."""
    items = spark.createDataFrame([(1, prose(3, 60)), (2, None)], "item_id long, text string")
    for rows, name in ((edge, "some"), (edge.limit(0), "none")):
        rows.withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    found = {d for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect() for d in r["doc_ids"]}
    # of 1, 2 and the near copy 3 the first, of 7 and 8 the first; "a b c" has short words; 10 is a benchmark's; null, blank and repetitive texts go
    assert found == {1, 7, 9, None, 17} - ({17} if not passes(dict((d, t) for d, t, _ in edge_rows())[17]) else set())
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
