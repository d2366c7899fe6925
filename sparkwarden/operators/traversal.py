"""Pages that lead to other pages: a frontier moves by rounds of joins over a table of links, no page twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.plans.storage import keep


def reachable(links: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """links: (page, to); starts: (page).  (page, steps): every page that can be reached, with the fewest links to it.

    Each round joins the frontier with the links and drops what was visited, so a round costs the frontier's links; rounds
    end with an empty frontier, or after so many.  Nulls lead nowhere; loops, repeated links and starts do no harm.
    """
    edges = keep(links.where("page is not null and to is not null").select("page", "to").distinct(), "links")
    frontier = keep(starts.where("page is not null").select("page").distinct().withColumn("steps", F.lit(0)), "frontier")
    visited, n = frontier, 0
    while (rounds is None or n < rounds) and not frontier.isEmpty():
        n += 1
        found = frontier.join(edges, "page").select(F.col("to").alias("page")).distinct()
        frontier = keep(found.join(visited.select("page"), "page", "left_anti").withColumn("steps", F.lit(n)), "frontier")
        visited = visited.unionByName(frontier)
    return visited


def families(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, page): of every start the pages that are related to it, over any number of links in either direction.

    Labels are the least page of a component; each round takes the least label among a page and its neighbours and then the
    label's own label, so rounds grow with the logarithm of a chain.
    """
    both = links.where("page is not null and to is not null").select("page", "to").unionByName(links.where("page is not null and to is not null").select(F.col("to").alias("page"), F.col("page").alias("to")))
    edges = keep(both.distinct(), "links")
    own = edges.select("page").unionByName(starts.where("page is not null").select("page")).distinct()
    labels = keep(own.withColumn("label", F.col("page")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("page", "to"), "to").groupBy("page").agg(F.min("label").alias("_near"))
        least = labels.join(near, "page", "left").select("page", F.least("label", F.coalesce("_near", "label")).alias("label"))
        step = keep(least, "labels")
        jump = step.select(F.col("page").alias("label"), F.col("label").alias("_next"))
        new = keep(step.join(jump, "label").select("page", F.col("_next").alias("label")), "labels")
        moved = new.join(labels.withColumnRenamed("label", "_before"), "page").where("label != _before").isEmpty()
        labels = new
        if moved:
            break
    first = labels.join(starts.where("page is not null").select("page").distinct(), "page").select(F.col("page").alias("start"), "label")
    return first.join(labels, "label").select("start", "page")
