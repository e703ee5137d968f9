"""Edges from data: similarity, sequences of use, and what is new among them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import vector
from marlstone.operators.documents import condition


def similarity_edges(df: DataFrame, key: str, threshold: float = 0.85, per_row: int = 10, column: str = "embedding") -> DataFrame:
    """src, dst, type, strength, auto_generated, rationale: each row's best neighbours at or above the threshold."""
    best = vector.nearest_pairs(df, threshold, key, per_row, column).withColumnsRenamed({"a": "src", "b": "dst"})
    rationale = F.when(F.col("score") > 0.9, "very similar content").otherwise("similar content")
    return best.select("src", "dst", F.lit("semantic_similarity").alias("type"), F.col("score").alias("strength"), F.lit(True).alias("auto_generated"), rationale.alias("rationale"))


def filtered_similarity_edges(df: DataFrame, key: str, filter_expr: Column | str, threshold: float = 0.85, per_row: int = 10, column: str = "embedding") -> DataFrame:
    """Similarity edges of which both ends pass the filter."""
    return similarity_edges(df.filter(condition(filter_expr)), key, threshold, per_row, column)


def judged_edges(edges: DataFrame, vertices: DataFrame, key: str, fields: list[str], judge: Callable[[DataFrame], DataFrame], existing: DataFrame | None = None, min_strength: float = 0.8, limit: int = 100, confidence: float = 0.8) -> DataFrame:
    """src, dst, type, confidence, rationale of the pairs that a judge finds to be prerequisites.

    The judge takes strong pairs with fields of both ends, each pair once and none that an existing edge joins, and
    adds `direction` (1: src comes before dst; -1: the other way; 0 or null: none) and `rationale`.
    """
    ends = edges.withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")})
    once = ends.groupBy(F.col("_lo").alias("src"), F.col("_hi").alias("dst")).agg(F.max("strength").alias("strength"))
    once = once if existing is None else new_edges(once, existing, undirected=True)
    found = judge(with_endpoints(once, vertices, key, fields, min_strength, limit)).filter("direction in (1, -1)")
    forward = F.col("direction") == 1
    ends = (F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("src", "dst"), ("dst", "src")))
    return found.select(*ends, F.lit("prerequisite").alias("type"), F.lit(confidence).alias("confidence"), "rationale")


def all_relationships(vectors: DataFrame, key: str, steps: DataFrame, user: str, item: str, order: list[Column], judge: Callable[[DataFrame], DataFrame] | None = None, fields: list[str] = (), threshold: float = 0.85, min_strength: float = 0.8) -> DataFrame:
    """src, dst, type, strength: the edges of similarity, of sequences of use and, with a judge, of prerequisites."""
    similar = similarity_edges(vectors, key, threshold)
    used = sequence_edges(steps, user, item, order)
    parts = [
        similar.select(F.col("src").cast("string"), F.col("dst").cast("string"), "type", "strength"),
        used.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit("user_sequence").alias("type"), "strength"),
    ]
    if judge is not None:
        judged = judged_edges(similar, vectors, key, list(fields), judge, min_strength=min_strength)
        parts.append(judged.select(F.col("src").cast("string"), F.col("dst").cast("string"), "type", F.col("confidence").alias("strength")))
    return reduce(DataFrame.unionByName, parts)


def new_edges(candidates: DataFrame, existing: DataFrame, undirected: bool = False) -> DataFrame:
    """Candidates whose ends no existing edge joins, in their direction or in either."""
    if not undirected:
        return candidates.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    ends = existing.select(F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi"))
    return candidates.withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")}).join(ends, ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")


def with_endpoints(edges: DataFrame, vertices: DataFrame, key: str, fields: list[str], min_strength: float = 0.8, limit: int | None = 100) -> DataFrame:
    """Strong edges with fields of both ends, strongest first."""
    left = vertices.select(F.col(key).alias("src"), *[F.col(f).alias(f"src_{f}") for f in fields])
    right = vertices.select(F.col(key).alias("dst"), *[F.col(f).alias(f"dst_{f}") for f in fields])
    out = edges.filter(F.col("strength") >= min_strength).join(left, "src").join(right, "dst").orderBy(F.desc(F.round("strength", 12)), "src", "dst")
    return out if limit is None else out.limit(limit)


def sequence_edges(steps: DataFrame, user: str, item: str, order: list[Column], existing: DataFrame | None = None) -> DataFrame:
    """src, dst, strength, count of each step from one item to the next in a user's sequence.

    A new edge gains 0.6 and 0.1 for each further step, an existing one (src, dst, strength, count) 0.1 a step, up
    to 1. The rows of a user are ordered by a window, all else is aggregated.
    """
    nexts = steps.select(F.col(item).alias("src"), F.lead(item).over(Window.partitionBy(user).orderBy(*order)).alias("dst"))
    n = nexts.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))
    if existing is None:
        return n.select("src", "dst", F.least(F.lit(1.0), 0.6 + 0.1 * (F.col("n") - 1)).alias("strength"), F.col("n").alias("count"))
    joined = n.join(existing.select("src", "dst", F.col("strength").alias("s"), F.col("count").alias("c"), F.lit(True).alias("old")), ["src", "dst"], "full_outer")
    gained = F.coalesce("n", F.lit(0))
    strength = F.when(F.col("old"), F.least(F.lit(1.0), F.coalesce("s", F.lit(0.5)) + 0.1 * gained)).otherwise(F.least(F.lit(1.0), 0.6 + 0.1 * (gained - 1)))
    return joined.select("src", "dst", strength.alias("strength"), (F.coalesce("c", F.lit(0)) + gained).alias("count"))
