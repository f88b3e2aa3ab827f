"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component is the least id reachable.

    Every round takes the least label among neighbours and then follows the
    label's own label, so paths shorten by more than half.  Each round's labels
    are a saved table; aggregations combine before the shuffle, and the joins
    are plain equi-joins that Spark may split where a key is hot.
    """
    both = scratch.saved(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    labels = scratch.saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("label")))
    while True:
        near = both.join(labels, both.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = scratch.saved(step)
        up = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = scratch.saved(step.join(up, "label", "left").select("id", F.coalesce("up", "label").alias("label"), "old"))
        moved = new.where("label != old").limit(1).count()
        scratch.drop(step)
        scratch.drop(labels)
        labels = scratch.saved(new.select("id", "label")) if moved else new.select("id", "label")
        if not moved:
            scratch.drop(both)
            return labels.withColumnRenamed("label", "component")
        scratch.drop(new)
