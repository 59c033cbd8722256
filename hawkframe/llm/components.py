"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hawkframe.llm.common import durable


def counted(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """`df` written to the shared folder, and how many of its rows meet the condition, counted by the same job."""
    seen = Observation()
    written = durable(df.observe(seen, F.count(F.when(F.expr(condition), 1)).alias("n")))
    return written, seen.get["n"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the smallest node of the component.

    Each round every node takes the smallest label among its neighbours, then the label of its label, so the
    number of rounds grows with the logarithm of the longest path. Labels are written to the shared folder each
    round, by one job that also counts the changes; a node with very many neighbours is pre-aggregated before the
    shuffle. No edges give no rows.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("_old"))
        low = labels.select("node", "label", F.col("label").alias("_old")).union(near)
        low = low.groupBy("node").agg(F.min("label").alias("label"), F.max("_old").alias("_old"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        moved = low.join(up, low["label"] == up["_n"]).select("node", F.least("label", "_up").alias("label"), "_old")
        moved, changes = counted(moved, "label <> _old")
        labels = moved.select("node", "label")
        if not changes:
            return labels


def linked(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """`components` of a graph with components `labels` after edges (a, b) are added; only the labels that they join are
    gone through anew. A node without a label is its own component.
    """
    of = lambda s: labels.select(F.col("node").alias(f"_{s}"), F.col("label").alias(f"_l{s}"))
    ends = edges.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    ends = ends.select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b")).where("a <> b").distinct()
    ends, found = counted(ends, "true")
    if not found:
        return labels
    joined = components(ends)
    new = joined.join(labels.select("node"), "node", "left_anti")
    top = joined.select(F.col("node").alias("_n"), F.col("label").alias("_top"))
    old = labels.join(top, labels["label"] == top["_n"], "left").select("node", F.coalesce("_top", "label").alias("label"))
    return durable(old.union(new.select("node", "label")))
