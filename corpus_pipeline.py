"""A corpus from raw documents to packed tokens, in five stages.

Each stage takes the documents that the one before kept, and decides: the quality rules reject, of each group of near
copies the first stays, documents with benchmark passages go, the rest is laid out in the order of a mixture of the
sources, and that order is packed, stretch by stretch, into rows of token ids. What a stage returns is written as
Parquet in the shared folder and read again, so lineage ends there. Files are read again longest first, so the mixture's
order goes with the rows as a column, by which they are sorted again before they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.decontaminate import decontaminate
from barloom.llm.jaccard import one_of_group
from barloom.llm.mixing import in_order, mixed_order
from barloom.llm.packing import packed
from barloom.llm.rules import quality_filter
from barloom.llm.shared import Scratch

#: Column of a document's place in the mixture.
PLACE = "mixture_place"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no rule of the corpus rejects. Null, empty and blank texts go; a short text is no bad one."""
    return quality_filter(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, any of rows that repeat it, rows without an id last."""
    return one_of_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no window of a benchmark text; items that are null or without words match nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture, with their places; a null source is a source, a null id an id."""
    return mixed_order(docs, at=PLACE)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of all texts in the order of the mixture; no rows give no rows."""
    return packed(in_order(docs, PLACE))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_packing", token_packing),
]

#: SQL can't express the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is removed once the next one's is written, but for the last."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(1)
    return STAGES[-1][1](spark, docs, sf_dir)
