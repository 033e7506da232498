"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.scratch import drop_table, materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(v, component)`` for every end of a link: the smallest id that links reach.

    Each round takes the least label among a vertex and its neighbours (aggregated before the shuffle, so a vertex
    with very many links costs one row per task) and then its label's own label.  Rounds are written to the shared
    folder, so a lost executor costs no earlier round.  Rounds grow with the logarithm of the longest chain.
    """
    forward = links.select(F.col(a).alias("v"), F.col(b).alias("w"))
    both = materialise(forward.unionByName(links.select(F.col(b).alias("v"), F.col(a).alias("w"))).where("v <> w").distinct(), "links")
    labels = materialise(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("component"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "component"), "w").groupBy("v").agg(F.min("component").alias("near"))
        step = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        step = materialise(step, "labels-step")
        roots = step.select(F.col("v").alias("r"), F.col("new").alias("root"))
        nxt = step.join(roots, step["new"] == roots["r"], "left").select("v", "old", F.least("new", F.coalesce("root", "new")).alias("component"))
        nxt = materialise(nxt.select("v", "component", (F.col("component") != F.col("old")).alias("moved")), "labels")
        for gone in (step, labels):
            drop_table(gone)
        labels = nxt
        if labels.where("moved").isEmpty():
            drop_table(both)
            return labels.select("v", "component")
