"""Connected components of a graph given by its links, by least labels and jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """v and label, the smallest vertex that v reaches, for every vertex of links of a and b.

    Each round a vertex takes the least label among its neighbours, then the label of that label, so that long
    chains shorten by doubling.  All rounds are tables in the shared folder; nothing comes to the driver but the
    number of labels that changed.  Links that repeat or join a vertex with itself do no harm; no links give an
    empty table.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "v", "left").select("v", F.least("label", "near").alias("label"), F.col("label").alias("was")), "lower")
        top = lower.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = written(lower.join(top, "label", "left").select("v", F.least("label", "further").alias("label"), "was"), "labels")
        moved = new.where("label <> was").limit(1).count()
        dropped(lower)
        dropped(labels)
        labels = new
        if not moved:
            dropped(both)
            out = labels.select("v", "label")
            out._shared_path = labels._shared_path
            return out
