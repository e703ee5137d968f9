"""Connected components of a large graph, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, comp (the smallest node that can be reached) of every node of edges(a, b).

    Each round every component hooks to its smallest neighbour, and the hooks are followed three times; both
    the labels and the edges that still cross components are written tables, so nothing is recomputed and no
    edge passes through the driver. Loops and repeated edges do no harm; no edges give an empty table.
    """
    edges = edges.filter("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
    labels = None
    while True:
        edges = common.written(edges, f"{name}-edges")
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = common.written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), f"{name}-hooks")
        jumped = hooks
        for _ in range(3):
            after = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = jumped.join(after, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        step = common.written(jumped, f"{name}-step")
        if labels is None:
            labels = step.toDF("node", "comp")
        else:
            labels = labels.join(step, labels.comp == step.a, "left").select("node", F.coalesce("p", "comp").alias("comp"))
            labels = common.written(labels, f"{name}-labels")
        first, second = step.toDF("a", "x"), step.toDF("b", "y")
        edges = edges.join(first, "a").join(second, "b").filter("x <> y").selectExpr("least(x, y) as a", "greatest(x, y) as b").distinct()
        if edges.isEmpty():
            return labels
