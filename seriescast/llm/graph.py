"""Connected components of a large edge list, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.llm.text import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``comp``) for every node of the undirected ``edges`` (``a``, ``b``);
    ``comp`` is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then follows
    the label's own label (pointer jumping), until nothing changes.  Neighbour
    minima are partially aggregated before they shuffle, so a node with very many
    neighbours costs one row per task.  Each round's labels are checkpointed."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                          .select("node", F.least("node", "m").alias("comp")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c")))
        step = (labels.join(near, "node")
                .select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp")))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = checkpointed(step.join(jump, "comp").select("node", "old", F.col("top").alias("comp")))
        changed = new.where("old <> comp").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels
