"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that is reachable.

    Each round hooks the roots that meet at an edge to the smallest of their roots, then halves the paths. Hooks are
    minima by root, which Spark pre-aggregates, and lookups are plain joins that AQE may split, so a component that
    holds a third of all nodes makes no large task. Every round is a written table; what an executor held can be lost.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    both = written(both, "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root")), "labels")
    live = both
    for _ in range(most_rounds):
        at_a, at_b = (label.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("n1", "r1"), ("n2", "r2")))
        live = live.join(at_a, F.col("a") == F.col("n1")).join(at_b, F.col("b") == F.col("n2")).where("r1 <> r2")
        live = written(live.select(F.greatest("r1", "r2").alias("a"), F.least("r1", "r2").alias("b")).distinct(), "live")
        hooks = live.groupBy(F.col("a").alias("h")).agg(F.min("b").alias("to"))
        hooked = label.join(hooks, F.col("node") == F.col("h"), "left")
        hooked = hooked.select("node", F.when((F.col("node") == F.col("root")) & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("root")).alias("root"))  # only a root may hook: its own link isn't lost
        hooked = written(hooked, "labels")
        above = hooked.select(F.col("node").alias("n"), F.col("root").alias("r"))
        label = written(hooked.join(above, F.col("root") == F.col("n")).select("node", F.col("r").alias("root"), (F.col("r") != F.col("root")).alias("moved")), "labels")
        moved = not label.where("moved").isEmpty()
        label = label.drop("moved")
        if not moved and live.isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
