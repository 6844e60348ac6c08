"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkproof.llm.common import keep


def follow(steps: DataFrame, by: DataFrame) -> DataFrame:
    """steps (id, label) with each label replaced by the label that `by` has for it."""
    nxt = by.select(F.col("id").alias("label"), F.col("label").alias("next"))
    return steps.join(nxt, "label", "left").select("id", F.coalesce("next", "label").alias("label"))


def connected(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in links (a, b): columns id, label.

    Each round moves every node to its least neighbour's, twice over, and draws the links between the
    nodes that are left. Only nodes that are less than all their neighbours stay, at most half of them, so
    rounds grow with the logarithm of the nodes and get smaller. Their tables are kept; a hub's links are
    pre-aggregated."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = keep(both, "links")
    labels = None
    while True:
        least = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"))
        step = keep(least.select("id", F.least("id", "b").alias("label")), "labels")
        step = keep(follow(follow(step, step), step), "labels")
        labels = step if labels is None else follow(labels, step)
        ends = [step.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        edges = keep(moved.where("a <> b").distinct(), "links")
        if edges.isEmpty():
            return keep(labels, "labels")
