"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule rejects a document by a predicate over its text. What a rule costs and how much it rejects is estimated on a
sample; the rules then stand in one CASE expression, most rejection per cost first, so that a rejected document never
reaches the dearer rules behind. The order changes the work and the name of the first rule that fails, never the verdict.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words and is treated as an empty one; every document gets one row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import size_of

#: About the bytes of the random sample that costs and rejections are estimated on, and the characters of one of its
#: texts. They decide the order of the rules only.
SAMPLE_BYTES, SAMPLE_CHARS = 2 << 20, 20_000
BLANKS = r"[\x20\x09-\x0D]+"

Metric = Callable[[Column, Column], Column]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def _left(text: Column, other: str) -> Column:
    """Characters of the text that the pattern ``other`` doesn't take away."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), other, "")).cast("long")


def _dup_lines(text: Column, words: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long")


def _repeat_words(text: Column, words: Column) -> Column:
    """Words that any 3-word window covers which stands in the text twice or more.

    The windows are sorted with their places, so that equal ones are neighbours: n log n, however repetitive the text.
    """

    def tail(a: Column, k: int) -> Column:
        return F.slice(a, k, F.greatest(F.size(a), F.lit(1)))

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, tail(places, 2), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def sorted_out(s: Column) -> Column:
        pairs = F.zip_with(s, tail(s, 2), lambda a, b: F.when(a.g == b.g, F.array(a.i, b.i)))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        return F.transform(F.array(places), covered)[0]

    def of_windows(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        many = F.size(F.array_distinct(g)) < F.size(g)
        return F.when(many, F.transform(F.array(placed), sorted_out)[0]).otherwise(0)

    def of_words(w: Column) -> Column:
        pairs = F.zip_with(w, tail(w, 2), lambda a, b: F.concat(a, F.lit(" "), b))
        threes = F.zip_with(pairs, tail(w, 3), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.transform(F.array(F.filter(threes, lambda x: x.isNotNull())), of_windows)[0]

    return F.transform(F.array(words), of_words)[0].cast("long")


METRICS: dict[str, Metric] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")).cast("long"),
    "n_symbols": lambda text, words: _left(text, r"[^#*$%&|<>]+"),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda text, words: F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long"),
    "n_upper": lambda text, words: _left(text, r"[^\p{Lu}]+"),
    "n_exclaims": lambda text, words: _left(text, r"[^!]+"),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``reject`` holds; it gets a function that gives a metric's column by name."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


#: Too short, or mostly repeated: these two are the base of every verdict.
BASE_RULES = [
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
]
RULES = [
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("capitals", lambda m: 100 * m("n_upper") > 30 * m("word_chars")),
    Rule("exclamations", lambda m: 100 * m("n_exclaims") > 30 * m("n_words")),
]


#: The rules of a corpus: a short text is no bad one.
CORPUS_RULES = [Rule("no_words", lambda m: m("n_words") < 1), *RULES[1:]]


def _metric_of(counted: list[str], text: str, words: str) -> Callable[[str], Column]:
    """A metric's column if it is one of the counted ones, else its expression over the text."""
    return lambda name: F.col(name) if name in counted else METRICS[name](F.col(text), F.col(words))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_words", words_of(F.col(text)))


def estimates(df: DataFrame, rules: list[Rule], text: str = "text", sample_bytes: int = SAMPLE_BYTES) -> dict[str, tuple[float, float]]:
    """(seconds, share of rows rejected) of each rule on a random sample of the table's rows; empty for an empty sample.

    The sample is gathered, long texts cut, as it is bounded, and counted in one task, so that neither its place nor
    scheduling shows in the times; of three runs the fastest counts, less that of a rule without work.
    """
    fraction = min(1.0, sample_bytes / max(1, size_of(df)))
    few = df.select(F.substring(F.col(text), 1, SAMPLE_CHARS)).sample(False, fraction, seed=11).collect()
    sample = with_words(df.sparkSession.createDataFrame(few, "text string").coalesce(1)).cache()
    try:
        rows = sample.count()
        if not rows:
            return {}

        def run(what: Column) -> tuple[float, int]:
            best, hit = float("inf"), 0
            for _ in range(3):
                began = time.perf_counter()
                hit = sample.agg(F.count_if(what)).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hit

        idle, _ = run(F.col("_words").isNull())
        found = {rule.name: run(F.coalesce(rule.reject(_metric_of([], "text", "_words")), F.lit(False))) for rule in rules}
        return {name: (max(took - idle, 1e-4), hit / rows) for name, (took, hit) in found.items()}
    finally:
        sample.unpersist()


def order_rules(df: DataFrame, rules: list[Rule], text: str = "text", sample_bytes: int = SAMPLE_BYTES) -> list[Rule]:
    """The rules, most rejected rows per second first, by a bounded sample of the table."""
    found = estimates(df, rules, text, sample_bytes)
    return sorted(rules, key=lambda r: (-found[r.name][1] / found[r.name][0], r.name)) if found else list(rules)


def verdict(rules: list[Rule], text: Column, words: Column, counted: list[str] | None = None) -> Column:
    """The first rule, in the given order, that rejects the row, else null; rules behind it aren't computed."""
    metric = lambda name: F.col(name) if name in (counted or []) else METRICS[name](text, words)
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.reject(metric), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def cascade(df: DataFrame, rules: list[Rule], text: str = "text", words: str = "_words", counted: list[str] | None = None) -> DataFrame:
    """``df`` with ``failed_rule``, the verdict.

    ``words`` names an array column of the text's words (see ``with_words``), ``counted`` columns that hold metrics.
    """
    return df.withColumn("failed_rule", verdict(rules, F.col(text), F.col(words), counted))


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns, whatever these are called.

    By default the corpus's rules: null and empty texts go, short ones stay if nothing else is against them. Rows that
    repeat are judged alike; no rows give no rows.
    """
    ordered = order_rules(docs, rules or CORPUS_RULES, text, sample_bytes)
    # bound to a variable, the words are split once a row; a filter would put the split in place of each mention
    failed = F.transform(F.array(words_of(F.col(text))), lambda words: verdict(ordered, F.col(text), words))[0]
    return docs.where(failed.isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document, and the cascade's verdict on those that the base does not fail.

    The counts are asked for of every row, so nothing can be spared there; the cascade computes what its rules need from
    the text, in its own order, up to the first rule that rejects.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ordered = order_rules(docs.select("text"), RULES)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = with_words(docs).withColumns({k: METRICS[k](F.col("text"), F.col("_words")) for k in base})
    metric = _metric_of(base, "text", "_words")
    failed = BASE_RULES[0].reject(metric) | BASE_RULES[1].reject(metric)
    kept = F.when(failed, False).otherwise(verdict(ordered, F.col("text"), F.col("_words")).isNull())
    return counted.select("doc_id", *base, failed.alias("base_failed"), kept.alias("kept"))


SQL10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclaims
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 100 * n_upper > 30 * word_chars OR 100 * n_exclaims > 30 * n_words) AS kept
FROM f
"""
