"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskpanel.llm.store import Scratch


def components(scratch: Scratch, links: DataFrame, n: int, name: str) -> DataFrame | None:
    """(id, label) of every id in n links (a, b); the label is the smallest id reachable. None without links.

    Each round is one written table: the smallest label next to every id, then
    the label of that label, until nothing changes. Changes are counted as the
    rows are written, and only that number comes to the driver.
    """
    if not n:
        return None
    edges = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a"))
    labels = scratch.store(edges.groupBy("id").agg(F.least("id", F.min("other")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("lower"), F.col("label").alias("before"))
        jump = lower.select(F.col("id").alias("lower"), F.col("lower").alias("label"))
        moved = Observation()
        rows = lower.join(jump, "lower").select("id", "label", "before").observe(moved, F.count_if(F.col("label") < F.col("before")).alias("rows"))
        labels = scratch.store(rows.select("id", "label"), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        if not moved.get["rows"]:
            return labels


def joined(scratch: Scratch, labels: DataFrame | None, links: DataFrame, n: int, name: str) -> DataFrame | None:
    """The labels once n more links (a, b) are there: components of the labels that they tie together."""
    if labels is None or not n:
        return labels if not n else components(scratch, links, n, name)
    # an id without a label so far is its own
    at_a = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("label_a")), "a", "left")
    at_b = at_a.join(labels.select(F.col("id").alias("b"), F.col("label").alias("label_b")), "b", "left")
    ends = at_b.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y"))
    tied, n = scratch.counted(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), f"{name}-tied")
    over = components(scratch, tied, n, name)
    if over is None:
        return labels
    ids = ends.select(F.col("a").alias("id"), F.col("x").alias("label")).union(ends.select("b", "y")).distinct()
    known = labels.union(ids.join(labels.select("id"), "id", "left_anti"))
    named = known.join(over.select(F.col("id").alias("label"), F.col("label").alias("root")), "label", "left")
    return scratch.store(named.select("id", F.coalesce("root", "label").alias("label")), f"{name}-all")
