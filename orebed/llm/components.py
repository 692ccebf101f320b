"""Connected components of a link table, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, comp) for every node of links(a, b): comp is the smallest node it can reach.

    Each round a node takes the least label among its own and its neighbours', then the
    label of that label. Rounds end when no label changes; each is a written table, so
    lineage stays short and lost executors cost one round at most. Minima are combined
    before the shuffle, so a hub of many links is no hot task.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").selectExpr("b", "a")).toDF("node", "peer")
    edges = scratch.keep(both.distinct(), f"{label}-edges")
    labels = scratch.keep(edges.groupBy("node").agg(F.min("peer").alias("m")).selectExpr("node", "least(node, m) comp"), f"{label}-0")
    step = 0
    while True:
        near = edges.join(labels.toDF("peer", "pc"), "peer").groupBy("node").agg(F.min("pc").alias("pc"))
        low = labels.join(near, "node").selectExpr("node", "comp was", "least(comp, pc) low")
        jump = labels.toDF("low", "lower")
        new = scratch.keep(low.join(jump, "low").selectExpr("node", "least(low, lower) comp", "was"), f"{label}-{step + 1}")
        changed = new.where("comp <> was").limit(1).count()
        scratch.drop(f"{label}-{step}")
        labels, step = new.select("node", "comp"), step + 1
        if not changed:
            scratch.drop(f"{label}-edges")
            return labels
