"""Vector search: exact top-k for one query or many, filtered and two-stage, similarity joins and classes, and IVF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions import vectors as V
from marlstone.operators.bm25 import top_per_group
from marlstone.operators.documents import condition
from marlstone.operators.graph import components
from marlstone.sources.shared import written

METRICS = {"cosine": V.cosine, "dot": V.dot, "l2": V.l2_score}
#: Query vectors that are broadcast at a time, those of them that a task scores at a time, and the rows that it scores against these.
QUERY_BLOCK, QUERY_PART, SCORE_ROWS = 4096, 512, 2048
#: Vectors of a block in a join of all with all, at most, and of a tile of it.
JOIN_BLOCK, TILE = 16_384, 2048


def vector_of(df: DataFrame, value, key: str, vector: str = "embedding") -> list[float]:
    """One row's vector."""
    row = df.filter(F.col(key) == value).select(vector).first()
    if row is None:
        raise KeyError(value)
    return [float(x) for x in row[0]]


def search(df: DataFrame, query: list[float], key: str, vector: str = "embedding", metric: str = "cosine", filter_expr: Column | str | None = None, min_score: float | None = None, top_n: int = 10) -> DataFrame:
    """The nearest rows that pass the filter, with score; the filter is applied before the ranking."""
    scored = df.filter(condition(filter_expr)).withColumn("score", METRICS[metric](F.col(vector), V.literal(query))).filter("score is not null")
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), F.col(key)).limit(top_n)


def embedded_query(spark: SparkSession, text: str, embed: Callable[[Column], Column] = X.hash_embedding) -> list[float]:
    """The vector of a query's text."""
    return [float(x) for x in spark.range(1).select(embed(F.lit(text)).alias("v")).first()["v"]]


def id_of_text(docs: DataFrame, text: str, key: str, field: str = "text") -> DataFrame:
    """The smallest key of the documents with exactly this text."""
    return docs.filter(F.col(field) == text).select(key).orderBy(key).limit(1)


def most_similar(df: DataFrame, query: list[float], key: str, vector: str = "embedding", least: float = 0.8) -> DataFrame:
    """The nearest row, if its cosine is above `least`."""
    return search(df, query, key, vector, top_n=1).filter(F.col("score") > least)


def two_stage_search(df: DataFrame, query: list[float], key: str, filter_expr: Column | str, vector: str = "embedding", top_n: int = 10, overfetch: int = 10) -> DataFrame:
    """The overfetch * top_n nearest of all rows, of which those that pass the filter stay: it may return fewer."""
    near = search(df, query, key, vector, top_n=overfetch * top_n)
    return near.filter(condition(filter_expr)).orderBy(F.desc("score"), F.col(key)).limit(top_n)


def _matrix(column: pa.Array, unit: bool) -> np.ndarray:
    """Rows of an array column in double precision; rows without a value are zero."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = int(lengths.max(initial=0))
    rows = np.zeros((len(column), size))
    values = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(np.float64)  # those of valid rows, one after the other
    if size:
        rows[lengths == size] = values[np.repeat(lengths == size, lengths)].reshape(-1, size)
    return _unit(rows) if unit and size else rows


class _Best:
    """The nearest rows of each query so far, scores being rounded to `digits` for ranking alone."""

    def __init__(self, queries: int, top_n: int, digits: int = 12):
        self.top_n, self.digits, self.cut = top_n, digits, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, value: np.ndarray, keys: np.ndarray, queries: np.ndarray | None = None) -> None:
        """value[query, row] of all queries, or of some of them."""
        keep = min(self.top_n, value.shape[1])
        if not keep:
            return
        cut = self.cut if queries is None else self.cut[queries]
        # Ties at the cut are kept, so that the key can break them.
        if keep == self.top_n and not np.isfinite(cut).all():
            cut = np.maximum(cut, np.partition(value, value.shape[1] - keep, axis=1)[:, -keep])
        q, r = np.nonzero((value >= (cut - 10.0**-self.digits)[:, None]) & np.isfinite(value))
        self.take(q if queries is None else queries[q], keys[r], value[q, r])

    def take(self, q: np.ndarray, keys: np.ndarray, score: np.ndarray) -> None:
        """Rows that were found, with the query of each."""
        self.parts.append((q, keys, score))
        self.held += len(q)
        if self.held > 4 * len(self.cut) * self.top_n + 100_000:
            self.prune()

    def prune(self) -> None:
        q, keys, score = (np.concatenate(x) for x in zip(*self.parts))
        # Scores are rounded, so that equal vectors tie whatever the order of summation.
        order = np.lexsort((keys, -np.round(score, self.digits), q))
        q, keys, score = q[order], keys[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        stay = place < self.top_n
        last = place == self.top_n - 1
        self.cut[q[last]] = score[last]
        self.parts, self.held = [(q[stay], keys[stay], score[stay])], int(stay.sum())


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _kept(best: _Best, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """q, k, score of what a task has kept."""
    if best.parts:
        best.prune()
        q, keys, score = best.parts[0]
        yield pa.RecordBatch.from_pydict({"q": pa.array(ids[q]), "k": pa.array(keys), "score": pa.array(score)})


def _by_query_blocks(queries: DataFrame, query_id: str, vector: str, scanned: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """What `scanned` finds for each broadcast block (ids, vectors) of the queries; with several blocks, written block by block."""
    spark = queries.sparkSession
    wanted = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")).filter("q is not null and v is not null")
    first = wanted.limit(QUERY_BLOCK + 1).collect()
    blocks = 1 if len(first) <= QUERY_BLOCK else -(-wanted.count() // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        held = first if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast((np.array([r.q for r in held], np.int64), np.array([r.v for r in held], np.float64)))
        part = scanned(shared)
        if blocks > 1:
            part = written(part, "nearest")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def batch_search(df: DataFrame, queries: DataFrame, query_id: str, key: str, vector: str = "embedding", metric: str = "cosine", top_n: int = 10, min_score: float | None = None, skip_same: bool = False) -> DataFrame:
    """query_id, key, score, rank: exact top_n of every query; skip_same leaves out rows whose key is the query's.

    Queries are broadcast a block of about QUERY_BLOCK at a time, the only ones that the driver holds; each task keeps
    top_n rows a query, and Spark merges them. With several blocks, each one's hits are written before the next one's
    scan. A task's scores at a time are QUERY_PART by SCORE_ROWS. Ids and keys are numbers.
    """
    base = df.select(F.col(key).cast("long"), vector).filter(F.col(vector).isNotNull())

    def scanned(shared):
        def run(batches):
            ids, wanted = shared.value
            if not len(ids):
                return
            if metric == "cosine":
                wanted = _unit(wanted)
            best = _Best(len(ids), top_n)
            for batch in batches:
                for at in range(0, batch.num_rows, SCORE_ROWS):
                    part = batch.slice(at, SCORE_ROWS)
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    rows = _matrix(part.column(1), metric == "cosine")
                    for first in range(0, len(ids), QUERY_PART):
                        own = np.arange(first, min(first + QUERY_PART, len(ids)))
                        value = wanted[own] @ rows.T
                        if metric == "l2":
                            value = 2 * value - (wanted[own] ** 2).sum(axis=1)[:, None] - (rows**2).sum(axis=1)[None, :]
                        if skip_same:
                            value[ids[own][:, None] == keys[None, :]] = -np.inf
                        best.add(value, keys, own)
            yield from _kept(best, ids)

        return base.mapInArrow(run, "q long, k long, score double")

    found = _by_query_blocks(queries, query_id, vector, scanned)
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    return top_per_group(found, "q", F.round("score", 12), "k", top_n).select(F.col("q").alias(query_id), F.col("k").alias(key), "score", "rank")


def _dealt(df: DataFrame, key: str, vector: str) -> DataFrame:
    """k, vector, at (its block), lo, hi: each row once for each pair of blocks that its own is of."""
    rows = df.select(F.col(key).cast("long").alias("k"), vector).filter(F.col(vector).isNotNull())
    n = rows.count()
    blocks = max(1, -(-n // min(max(n // 8, TILE // 2), JOIN_BLOCK)))
    at = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    return rows.withColumn("at", at).select("*", other).select("k", vector, "at", F.least("at", "o").alias("lo"), F.greatest("at", "o").alias("hi"))


def _tiles(table: pa.Table, vector: str, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The keys of two blocks' rows, then the places among them and the scores of pairs with at least the cosine, a tile at a time."""
    table = table.combine_chunks()
    at, lo, hi = (table.column(x).to_numpy() for x in ("at", "lo", "hi"))
    k = table.column("k").to_numpy()
    unit = _matrix(table.column(vector).chunk(0), True)
    left, right = np.flatnonzero(at == lo[0]), np.flatnonzero(at == hi[0])
    for x in range(0, len(left), TILE):
        for y in range(x if lo[0] == hi[0] else 0, len(right), TILE):
            i, j = left[x : x + TILE], right[y : y + TILE]
            score = unit[i] @ unit[j].T
            good = score >= threshold
            if lo[0] == hi[0]:
                good &= (x + np.arange(len(i)))[:, None] < (y + np.arange(len(j)))[None, :]
            p, q = np.nonzero(good)
            yield k, i[p], j[q], score[p, q]


def similar_pairs(df: DataFrame, threshold: float, key: str, vector: str = "embedding") -> DataFrame:
    """a, b, score of all pairs a < b with at least the cosine: blocks of rows against blocks, pairs only as results.

    A row is dealt to as many tasks as there are blocks; a task compares two blocks a tile at a time.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, i, j, score in _tiles(pa.Table.from_batches(batches), vector, threshold):
            a, b = k[i], k[j]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})

    return _dealt(df, key, vector).groupBy("lo", "hi").applyInArrow(compare, "a long, b long, score double").filter("a <> b")


def nearest_pairs(df: DataFrame, threshold: float, key: str, top_n: int, vector: str = "embedding") -> DataFrame:
    """a, b, score, rank: each row's top_n others with at least the cosine. A task keeps top_n a row, and never lists all pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = k = None
        for k, i, j, score in _tiles(pa.Table.from_batches(batches), vector, threshold):
            best = best or _Best(len(k), top_n)
            for a, b in ((i, j), (j, i)):
                new = (score >= best.cut[a] - 1e-12) & (k[a] != k[b])
                best.take(a[new], k[b[new]], score[new])
        if best:
            for batch in _kept(best, k):
                yield batch.rename_columns(["a", "b", "score"])

    found = _dealt(df, key, vector).groupBy("lo", "hi").applyInArrow(compare, "a long, b long, score double")
    return top_per_group(found, "a", F.round("score", 12), "b", top_n)


def similarity_classes(df: DataFrame, threshold: float, key: str, vector: str = "embedding") -> DataFrame:
    """key, n_links (rows with at least the cosine), class_id (the smallest key that links reach) of every row with a vector."""
    pairs = written(similar_pairs(df, threshold, key, vector).select("a", "b").distinct(), "similar")
    links = pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("n_links"))
    classes = components(pairs).toDF("k", "class_id")
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"))
    out = rows.join(links, "k", "left").join(classes, "k", "left")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "k").alias("class_id"))


def mean_recall(exact: DataFrame, found: DataFrame, query_id: str, key: str) -> DataFrame:
    """n_queries, recall: the share of each query's exact neighbours that were found, on average."""
    hits = exact.select(query_id, key).join(found.select(query_id, key).withColumn("_hit", F.lit(1)), [query_id, key], "left")
    per = hits.groupBy(query_id).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("r"))
    return per.agg(F.count("*").alias("n_queries"), F.avg("r").alias("recall"))


def list_count(n: int) -> int:
    """Lists for n rows: their square root, from 16 to 4096."""
    return int(min(max(round(n**0.5), 16), 4096))


def ivf_assign(df: DataFrame, key: str, vector: str = "embedding", lists: int | None = None, seed: int = 42, sample_rows: int = 100_000):
    """Centroids fitted on a sample of at most about sample_rows, and every row with the list of its nearest centroid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.filter(F.col(vector).isNotNull())
    n = rows.count()
    lists = lists or list_count(n)
    share = min(1.0, sample_rows / max(n, 1))
    fit = rows if share == 1.0 else rows.sample(share, seed)
    model = KMeans(k=lists, maxIter=10, seed=seed, featuresCol="_v", predictionCol="list").fit(fit.select(array_to_vector(V.normalised(F.col(vector))).alias("_v")))
    assigned = model.transform(rows.withColumn("_v", array_to_vector(V.normalised(F.col(vector))))).drop("_v")
    return [c.tolist() for c in model.clusterCenters()], assigned


def ivf_search(df: DataFrame, queries: DataFrame, query_id: str, key: str, vector: str = "embedding", lists: int | None = None, probes: int | float = 0.75, top_n: int = 10, skip_same: bool = False) -> DataFrame:
    """query_id, key, score, rank from the lists nearest to each query: so many, or such a share of all.

    Rows are dealt out in the order of their lists, a long list to several tasks; a task scores the rows of a list at once
    against the queries that probe it. Queries are broadcast as in `batch_search`. Ids and keys are numbers.
    """
    centres, assigned = ivf_assign(df, key, vector, lists)
    probes = max(1, round(probes * len(centres))) if isinstance(probes, float) else min(probes, len(centres))
    rows = assigned.select(F.col(key).cast("long").alias("k"), vector, "list").filter("k is not null")
    rows = written(rows.repartitionByRange("list", F.xxhash64("k")).sortWithinPartitions("list"), "lists")
    middles = np.array(centres)

    def scanned(shared):
        def run(batches):
            ids, wanted = shared.value
            if not len(ids):
                return
            wanted = _unit(wanted)
            order = np.argsort(-(wanted @ middles.T), axis=1, kind="stable")[:, :probes]
            probed = np.zeros((len(ids), len(middles)), bool)
            np.put_along_axis(probed, order, True, axis=1)
            best = _Best(len(ids), top_n)
            for batch in batches:
                keys, of = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
                for start, end in zip(cuts, cuts[1:]):
                    asking = np.flatnonzero(probed[:, of[start]]) if end > start else []
                    for at in range(start, end, SCORE_ROWS):
                        part = slice(at, min(at + SCORE_ROWS, end))
                        held = _matrix(batch.column(1).slice(at, part.stop - at), True)
                        for first in range(0, len(asking), QUERY_PART):
                            own = asking[first : first + QUERY_PART]
                            value = wanted[own] @ held.T
                            if skip_same:
                                value[ids[own][:, None] == keys[None, part]] = -np.inf
                            best.add(value, keys[part], own)
            yield from _kept(best, ids)

        return rows.mapInArrow(run, "q long, k long, score double")

    found = _by_query_blocks(queries, query_id, vector, scanned)
    return top_per_group(found, "q", F.round("score", 12), "k", top_n).select(F.col("q").alias(query_id), F.col("k").alias(key), "score", "rank")


def dimension_errors(df: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Rows without a vector of the dimension."""
    return df.filter(F.col(vector).isNull() | (F.size(vector) != dimension))
