"""Connected components by smallest labels with pointer jumping. Labels live in tables, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import hot_join, hot_keys
from .shared import Scratch


def components(edges: DataFrame, out: Scratch | None = None) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node that it is connected with, as a table of ``out``.

    A round gives each node the smallest label of its neighbours, hooks the root of that label where it is smaller, and
    follows labels once; rounds go on until none changes. Minima are taken before rows are shuffled, and a node with very
    many neighbours, or a label of very many nodes, is broadcast, so neither is a hot group.
    """
    with Scratch(edges.sparkSession) as scratch:
        both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        hubs = scratch.table(hot_keys(both, "b").select("b"), "hubs")  # at most ten thousand
        near_hub = scratch.table(both.join(F.broadcast(hubs), "b", "left_semi"), "near_hub")
        others = scratch.table(both.join(F.broadcast(hubs), "b", "left_anti"), "others")
        labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
        while True:
            known = labels.select(F.col("node").alias("b"), "label")
            few = F.broadcast(known.join(F.broadcast(hubs), "b", "left_semi"))
            seen = others.join(known, "b").select(F.col("a").alias("node"), "label").unionByName(near_hub.join(few, "b").select(F.col("a").alias("node"), "label"))
            near = seen.unionByName(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("near"))
            # a node's own label hears of the smaller one as well
            told = near.join(labels, "node").select(F.col("label").alias("node"), F.col("near").alias("to")).union(near.select("node", F.col("near").alias("to")))
            hooked = scratch.table(told.groupBy("node").agg(F.min("to").alias("label")), "hooked")
            up = hooked.select(F.col("node").alias("label"), F.col("label").alias("_up"))
            jumped = hot_join(hooked, up, "label", "left").select("node", F.least("label", "_up").alias("label"))
            now = jumped.join(labels.select("node", F.col("label").alias("_old")), "node").select("node", "label", (F.col("label") != F.col("_old")).alias("moved"))
            now = scratch.table(now, "labels")
            labels = now.select("node", "label")
            if now.where("moved").isEmpty():
                return (out or Scratch(edges.sparkSession)).table(labels, "components", keep=out is None)
