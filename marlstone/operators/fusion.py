"""Fusion of ranked lists, hybrid search, and search over several collections."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import bm25, graph, vector
from marlstone.operators.bm25 import TextIndex
from marlstone.operators.documents import condition, has_tags

# The legs' least scores, and their weights without and with the graph.
LEAST_SCORES = {"bm25": 0.1, "semantic": 0.7, "graph": 0.5}
WEIGHTS = {2: {"bm25": 0.5, "semantic": 0.5}, 3: {"bm25": 0.3, "semantic": 0.5, "graph": 0.2}}


def ranked(hits: DataFrame, key: str, score: str = "score") -> DataFrame:
    """key, score, rank (from 1) of a list of hits that a search has cut to its best ones."""
    return hits.select(key, score, F.row_number().over(Window.orderBy(F.desc(score), F.col(key))).cast("long").alias("rank"))


def reciprocal_rank_fusion(lists: Sequence[DataFrame], weights: Sequence[float], key: str, k: int = 60) -> DataFrame:
    """key, score = sum of weight / (k + rank), and rank_i, score_i of each list.

    A list that lacks a key ranks it after its last. A key that a list has more than once has its last rank there.
    The lists are read once: their lengths are counted in the plan.
    """
    places = None
    for i, hits in enumerate(lists):
        own = ranked(hits, key).select(key, F.lit(i).alias("list"), "rank", F.col("score").cast("double"))
        places = own if places is None else places.unionByName(own)
    whole = Window.partitionBy()  # lists that searches have cut
    lengths = {i: F.coalesce(F.max(F.when(F.col("list") == i, F.col("rank"))).over(whole), F.lit(0)) for i in range(len(lists))}
    places = places.withColumns({f"_n{i}": n for i, n in lengths.items()})
    best = []
    for i in range(len(lists)):
        here = F.when(F.col("list") == i, F.col("rank"))
        best.append(F.coalesce(F.max(here), F.max(f"_n{i}") + 1).alias(f"rank_{i}"))
        best.append(F.max_by(F.when(F.col("list") == i, F.col("score")), here).alias(f"score_{i}"))
    fused = places.groupBy(key).agg(*best)
    score = sum((weight / (k + F.col(f"rank_{i}")) for i, weight in enumerate(weights)), F.lit(0.0))
    return fused.withColumn("score", score)


def search_options(query: str | None, top_n: int, initial_k: int) -> tuple[str, int, int]:
    """A search's options in their normal form: no query is an empty one, numbers below 1 are the defaults."""
    return (query or "").strip(), top_n if top_n > 0 else 5, initial_k if initial_k > 0 else 20


def least_scores(given: float | Mapping[str, float] | None) -> dict[str, float]:
    """The legs' least scores: one number holds for all, names that are not given keep their default."""
    if given is None:
        return dict(LEAST_SCORES)
    if isinstance(given, Mapping):
        return LEAST_SCORES | dict(given)
    return dict.fromkeys(LEAST_SCORES, float(given))


def leg_weights(given: Mapping[str, float] | None, legs: Sequence[str]) -> list[float]:
    """The legs' weights, divided by their sum."""
    chosen = [float((given or WEIGHTS[len(legs)]).get(leg, 0.0)) for leg in legs]
    total = sum(chosen)
    if total <= 0:
        raise ValueError("the weights of a search must not all be zero")
    return [w / total for w in chosen]


def hybrid_search(
    docs: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: list[float],
    key: str,
    vector_key: str,
    filter_expr: Column | str | None = None,
    tags: Sequence[str] = (),
    require_all: bool = False,
    min_score: float | Mapping[str, float] | None = None,
    weights: Mapping[str, float] | None = None,
    top_n: int = 10,
    initial_k: int = 20,
    rrf_k: int = 60,
    index: TextIndex | None = None,
    edges: DataFrame | None = None,
    types: Sequence[str] | None = None,
    min_depth: int = 1,
    max_depth: int = 1,
    direction: str = "ANY",
) -> DataFrame:
    """The best documents of the text, the vector and (with edges) the graph ranking, by weighted reciprocal rank.

    key, rank_i, score_i, score, and total (of all fused documents). Filter and tags restrict the first two rankings
    before they are cut to initial_k. The graph ranks what can be reached from the text's hits (see `expand_graph`),
    the hits among it. A document is ranked once, and those that the documents lack are left out.
    """
    query, top_n, initial_k = search_options(query, top_n, initial_k)
    least = least_scores(min_score)
    wanted = None if filter_expr is None and not tags else condition(filter_expr) & (has_tags(tags, require_all) if tags else F.lit(True))
    text_hits = bm25.bm25_search(docs, query, filter_expr=wanted, min_score=least["bm25"], top_n=initial_k, key=key, index=index).select(key, "score")
    pool = vectors if wanted is None else vectors.join(docs.filter(wanted).select(F.col(key).alias(vector_key)), vector_key, "left_semi")
    near = vector.search(pool, query_vector, vector_key, min_score=least["semantic"], top_n=initial_k).select(F.col(vector_key).alias(key), "score")
    lists, legs = [text_hits, near], ["bm25", "semantic"]
    if edges is not None:
        related = graph.traverse(edges, text_hits.select(F.col(key).cast("string").alias("start")), min_depth, max_depth, direction, types)
        related = related.select(F.col("start").cast(docs.schema[key].dataType).alias(key), F.col("vertex").cast(docs.schema[key].dataType).alias("vertex"))
        known = expand_graph(text_hits, related, key).filter(F.col("score") >= least["graph"]).join(docs.select(key), key, "left_semi")
        lists, legs = [*lists, known], [*legs, "graph"]
    fused = reciprocal_rank_fusion(lists, leg_weights(weights, legs), key, rrf_k)
    fused = fused.withColumn("total", F.count("*").over(Window.partitionBy()))  # a few rows for each leg
    return fused.orderBy(F.desc("score"), F.col(key)).limit(top_n)


def merge_max(lists: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """key and each list's best score (0 where it lacks the key) under the list's name."""
    merged = None
    for name, hits in lists:
        part = hits.select(key, *[(F.col("score") if n == name else F.lit(0.0)).alias(n) for n, _ in lists])
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy(key).agg(*[F.max(n).alias(n) for n, _ in lists])


def unified(collections: Mapping[str, Callable[[], DataFrame]], key: str, top_n: int = 10, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """collection, key, score of the best hits of several collections' searches, with `total` of all hits.

    include: the collections that are searched (None: all); exclude: those that are not.
    """
    names = [n for n in collections if (include is None or n in include) and n not in exclude]
    if not names:
        raise ValueError("no collection to search")
    merged = reduce(DataFrame.unionByName, [collections[n]().select(F.lit(n).alias("collection"), key, "score") for n in names])
    # Each collection's best hits with the number of all, then the best of them.
    counts = F.broadcast(merged.groupBy("collection").agg(F.count("*").alias("n")))
    best = bm25.top_per_group(merged, "collection", F.col("score"), key, top_n).join(counts, "collection")
    total = F.sum(F.when(F.col("rank") == 1, F.col("n"))).over(Window.partitionBy())
    return best.withColumn("total", total).drop("rank", "n").orderBy(F.desc("score"), "collection", F.col(key)).limit(top_n)


def expand_graph(hits: DataFrame, related: DataFrame, key: str, factor: float = 0.8) -> DataFrame:
    """hits and, for each related(key, vertex), the vertex with a part of the hit's score."""
    more = hits.select(key, "score").join(related, key).select(F.col("vertex").alias(key), (factor * F.col("score")).alias("score"))
    return hits.select(key, "score").unionByName(more)
