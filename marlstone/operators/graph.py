"""Property graph: bounded traversal, retrieval with related vertices, explanation.

Edges have src, dst and type; vertices are named by strings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.shared import written

DIRECTIONS = ("OUTBOUND", "INBOUND", "ANY")


def directed(edges: DataFrame, direction: str, types: Sequence[str] | None = None, strength: str | None = None) -> DataFrame:
    """from, to, type, eid of the steps that a direction allows, and the edges' strength, if its column is named."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    chosen = edges if types is None else edges.filter(F.col("type").isin(list(types)))
    more = ["type", F.xxhash64("src", "dst", "type").alias("eid"), *([F.col(strength).cast("double").alias("strength")] if strength else [])]
    out = chosen.select(F.col("src").alias("from"), F.col("dst").alias("to"), *more)
    back = chosen.select(F.col("dst").alias("from"), F.col("src").alias("to"), *more)
    return {"OUTBOUND": out, "INBOUND": back, "ANY": out.unionByName(back)}[direction]


def traverse(edges: DataFrame, starts: DataFrame, min_depth: int = 1, max_depth: int = 1, direction: str = "ANY", types: Sequence[str] | None = None, unique: str = "vertices", strength: str | None = None) -> DataFrame:
    """start, vertex, depth, path (array of vertices), edge_types: one row for each path from starts(start).

    strength: a column of the edges, carried as the array `strengths`.

    unique: no vertex, or no edge, repeats in a path. The loop is bounded by max_depth, each step being a join.
    """
    if min_depth < 0 or max_depth < min_depth:
        raise ValueError("depths must be 0 <= min_depth <= max_depth")
    steps = directed(edges, direction, types, strength)
    carried = [F.array().cast("array<double>").alias("strengths")] if strength else []
    at = starts.select("start", F.col("start").alias("vertex"), F.lit(0).cast("long").alias("depth"), F.array("start").alias("path"), F.array().cast("array<string>").alias("edge_types"), F.array().cast("array<long>").alias("used"), *carried)
    found = at if min_depth == 0 else None
    for depth in range(1, max_depth + 1):
        new = at.join(steps, at.vertex == steps["from"])
        new = new.filter(~F.array_contains("path", F.col("to")) if unique == "vertices" else ~F.array_contains("used", F.col("eid")))
        at = new.select("start", F.col("to").alias("vertex"), F.lit(depth).cast("long").alias("depth"), F.array_append("path", F.col("to")).alias("path"), F.array_append("edge_types", F.col("type")).alias("edge_types"), F.array_append("used", F.col("eid")).alias("used"), *([F.array_append("strengths", F.col("strength")).alias("strengths")] if strength else []))
        if depth >= min_depth:
            found = at if found is None else found.unionByName(at)
    return found.drop("used")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "ANY", types: Sequence[str] | None = None) -> DataFrame:
    """start, vertex, depth (the least): paths are dropped after each step, so the frontier stays small.

    A step's frontier and what has been seen are written, so each step reads the edges once.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    steps = directed(edges, direction, types).select("from", "to").distinct()
    at = starts.select("start", F.col("start").alias("vertex"), F.lit(0).cast("long").alias("depth")).distinct()
    seen = [at]
    for depth in range(1, max_depth + 1):
        new = at.join(steps, at.vertex == steps["from"]).select("start", F.col("to").alias("vertex")).distinct()
        known = reduce(DataFrame.unionByName, seen).select("start", "vertex")
        at = written(new.join(known, ["start", "vertex"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "frontier")
        if at.isEmpty():
            break
        seen.append(at)
    return reduce(DataFrame.unionByName, seen).filter("depth > 0")


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (the smallest vertex that it is connected with) of every vertex of edges(a, b).

    In each round a vertex takes the smallest label of its neighbours, and labels follow each other (the label of a
    label), so that long chains take few rounds. Labels are written after each round.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = written(both, "component-edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "component-labels")
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = labels.join(near, "a").select("a", F.least("l", "m").alias("m"), F.col("l").alias("old"))
        jump = low.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        after = written(low.join(jump, "m", "left").select("a", F.least("m", F.coalesce("mm", "m")).alias("l"), "old"), "component-labels")
        labels = after.select("a", "l")
        if after.filter("l <> old").isEmpty():
            return labels.toDF("vertex", "component")


def edge_lookup(edges: DataFrame, vertex: str, direction: str = "ANY") -> DataFrame:
    """The edges at a vertex, by direction, with `other`: the vertex at the other end."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    ends = {"OUTBOUND": F.col("src") == vertex, "INBOUND": F.col("dst") == vertex}
    found = edges.filter(ends.get(direction, ends["OUTBOUND"] | ends["INBOUND"]))
    return found.withColumn("other", F.when(F.col("src") == vertex, F.col("dst")).otherwise(F.col("src")))


def graph_traverse(edges: DataFrame, start: str, vertices: DataFrame | None = None, vertex_filter: Column | str | None = None, vertex_key: str = "_key", limit: int | None = 10, **options) -> DataFrame:
    """Paths from one vertex, by depth and path; vertices that fail the filter are left out."""
    paths = traverse(edges, edges.sparkSession.createDataFrame([(start,)], "start string"), **options)
    if vertices is not None and vertex_filter is not None:
        good = vertices.filter(vertex_filter).select(F.col(vertex_key).cast("string").alias("vertex"))
        paths = paths.join(good, "vertex", "left_semi")
    paths = paths.orderBy("depth", F.array_join("path", "/"))
    return paths if limit is None else paths.limit(limit)


def graph_rag(hits: DataFrame, edges: DataFrame, key: str, **options) -> DataFrame:
    """Each hit with `related`: vertex, depth and path of what can be reached from it."""
    starts = hits.select(F.col(key).cast("string").alias("start"))
    paths = traverse(edges, starts, **options).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("depth", "vertex", "path"))).alias("related"))
    joined = hits.join(paths, hits[key].cast("string") == paths.start, "left").drop("start")
    return joined.withColumn("related", F.coalesce("related", F.array()))


def explain(label: Column, n_prerequisites: Column, n_complex: Column, n_simple: Column) -> Column:
    """Why a document may have its label."""
    return (
        F.when(label.isNull(), "semantic_only")
        .when((label == 1) & (n_prerequisites > 0), "has_prerequisites")
        .when((label == 1) & (n_complex > n_simple), "related_to_complex")
        .when((label == 0) & (n_simple > n_complex), "related_to_simple")
        .otherwise("primarily_semantic")
    )
