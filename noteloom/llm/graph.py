"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.session import cut_in_loop


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the ends of ``edges (a, b)``: the label is the component's least node.

    Each round every node takes the least label among its neighbours' and then its
    label's label, so labels jump over ever longer ways. Rounds are cut by reliable
    checkpoints without sizes, so plans stay as small as in the first round. Nothing but whether
    a label changed comes to the driver.
    """
    both = cut_in_loop(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut_in_loop(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near")
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = cut_in_loop(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels
