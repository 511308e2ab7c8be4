"""Connected components by label propagation with pointer jumping, every step a join over all nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def components(edges: DataFrame, a: str = "a", b: str = "b", salts: int = 16) -> DataFrame:
    """node, label (the least node of its component) for every end of an edge. Rounds grow with the log of the longest path."""
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = staged(pairs.union(pairs.select("y", "x")).distinct(), "cc-edges")
    labels = staged(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("node"), "label"), "cc-labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Where a label's own node has moved on, its followers move along; a giant component's rows are dealt over the salts.
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label")).where("up <> up_label")
        jumps = step.select(F.col("label").alias("up")).distinct().join(up, "up").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        step = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
        step = step.join(jumps, (F.col("label") == F.col("up")) & (step["salt"] == jumps["salt"]), "left").select("node", "old", F.least("label", "up_label").alias("label"))
        step = staged(step, "cc-labels")
        changed = step.where("old <> label").limit(1).count()
        drop_staged(labels)
        labels = step
        if not changed:
            drop_staged(both)
            return labels.select("node", "label")
