"""Connected components of a link table, by joins alone: nothing is collected, every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), any direction, repeats allowed.  Returns (node, label): label is the least node of its component.

    Each round moves every node to its least neighbour's least neighbour and contracts the links, so links within what has
    already met are gone, and later rounds only carry what is still apart.
    """
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    edges = save(links.where("a != b").select(*pair).distinct(), "links")
    out = None
    while out is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("_to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("_to")))
        least = both.groupBy("node").agg(F.least(F.min("_to"), F.first("node")).alias("_to"))
        jump = least.select(F.col("node").alias("_to"), F.col("_to").alias("label"))
        step = save(least.join(jump, "_to").select("node", "label"), "step")
        if out is None:
            out = step
        else:
            later = step.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            out = save(out.join(later, "label", "left").select("node", F.coalesce("_next", "label").alias("label")), "labels")
        moved = edges.join(step.withColumnsRenamed({"node": "a", "label": "_a"}), "a").join(step.withColumnsRenamed({"node": "b", "label": "_b"}), "b")
        edges = save(moved.where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).select(*pair).distinct(), "links")
    return out
