"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import BROADCAST_ROWS, remove, scratch_path, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows id, label: the smallest id that each linked id can reach.

    Every round takes the smallest label among the neighbours (combined before the
    shuffle) and then the label's own label, so rounds grow with the logarithm of a
    component's length. Labels are written every round; nothing comes to the driver but
    the number of changes.
    """
    spark = links.sparkSession
    edge_path = scratch_path(spark, "edges")
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(
        links.select(F.col(b).alias("u"), F.col(a).alias("v"))), edge_path)
    path = scratch_path(spark, "labels")
    labels = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("id"), F.least("u", "m").alias("label")), path)
    # Labels keep their number of rows: a small table is held by all tasks, so that a round shuffles once.
    held = F.broadcast if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    while True:
        mine = labels.select(F.col("id").alias("v"), "label")
        near = edges.join(held(mine), "v").groupBy("u").agg(F.min("label").alias("m"))
        hooked = near.join(held(labels), near["u"] == labels["id"]).select("id", "label", F.least("label", "m").alias("low"))
        roots = labels.select(F.col("id").alias("root"), F.col("label").alias("far"))
        jumped = hooked.join(held(roots), hooked["low"] == roots["root"], "left").select(
            "id", F.col("label").alias("old"), F.least("low", F.coalesce("far", "low")).alias("label"))
        new_path = scratch_path(spark, "labels")
        new = written(jumped, new_path)
        moved = new.where("old <> label").limit(1).count()
        remove(spark, path)
        path, labels = new_path, new.select("id", "label")
        if not moved:
            remove(spark, edge_path)
            return labels
