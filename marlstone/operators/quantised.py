"""Approximate vector search by product quantisation: short codes are read, and the best of them are scored exactly.

A vector of unit length is cut into parts; each part becomes the number of the nearest of 256 centres that were fitted
for it on a bounded sample. A search looks up what each centre gives with each part of a query, adds these up along the
codes, and reads the vectors of its best candidates alone. Every row is coded; a code has a byte for each part, so that of a
table of 64 single-precision values a sixteenth is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.operators.bm25 import top_per_group
from marlstone.operators.vector import _Best, _matrix
from marlstone.sources.shared import written

#: Parts of a vector, centres of a part, rows that the centres are fitted on, and rounds of fitting.
PARTS, CENTRES, SAMPLE_ROWS, ROUNDS = 16, 256, 20_000, 10
#: Candidates of a query that are scored exactly.
RERANKED = 200
#: Queries of which lookup tables are broadcast at a time, and codes that a task adds up at a time.
QUERY_BLOCK, CODE_ROWS = 256, 4096


@dataclass(frozen=True)
class Quantiser:
    """centres[part, centre]: the values that stand for a part; the last part may be filled up with zeros."""

    centres: np.ndarray

    def parts_of(self, rows: np.ndarray) -> np.ndarray:
        """rows, part, value."""
        parts, _, width = self.centres.shape
        return np.pad(rows, ((0, 0), (0, parts * width - rows.shape[1]))).reshape(len(rows), parts, width)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The number of each part's nearest centre."""
        out = np.empty((len(rows), len(self.centres)), np.uint8)
        for i, centres in enumerate(self.centres):
            out[:, i] = np.argmax(self.parts_of(rows)[:, i] @ centres.T - (centres**2).sum(1) / 2, axis=1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """query, part, centre: what they give."""
        return np.einsum("qpw,pcw->qpc", self.parts_of(queries), self.centres).astype(np.float32)


def fit(df: DataFrame, key: str, vector: str = "embedding", parts: int = PARTS, centres: int = CENTRES, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> Quantiser:
    """Centres fitted on the first sample_rows rows in hashed order (k-means; a centre that loses all its rows gets one anew)."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    rows = df.filter(F.col(vector).isNotNull()).select(vector, order.alias("o")).orderBy("o").limit(sample_rows).select(vector).toArrow()
    held = _matrix(rows.column(0).combine_chunks(), True) if rows.num_rows else np.zeros((1, 1))
    width = -(-held.shape[1] // parts)
    held = np.pad(held, ((0, 0), (0, parts * width - held.shape[1]))).reshape(len(held), parts, width)
    rng = np.random.default_rng(seed)
    fitted = np.empty((parts, centres, width))
    for i in range(parts):
        own = held[:, i]
        found = own[rng.choice(len(own), centres, replace=len(own) < centres)]
        for _ in range(ROUNDS):
            nearest = np.argmax(own @ found.T - (found**2).sum(1) / 2, axis=1)
            n = np.bincount(nearest, minlength=centres)
            sums = np.stack([np.bincount(nearest, own[:, j], centres) for j in range(width)], axis=1)
            found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], own[rng.integers(0, len(own), centres)])
        fitted[i] = found
    return Quantiser(fitted)


def coded(df: DataFrame, quantiser: Quantiser, key: str, vector: str = "embedding") -> DataFrame:
    """key (long), code (a byte for each part) of every row with a vector, written. A zero vector has a code, too."""
    shared = df.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches):
        for batch in batches:
            codes = shared.value.codes(_matrix(batch.column(1), True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["key", "code"])

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), vector)
    return written(rows.mapInArrow(run, "key long, code binary"), "codes")


def search(df: DataFrame, codes: DataFrame, quantiser: Quantiser, queries: DataFrame, query_id: str, key: str, vector: str = "embedding", top_n: int = 10, reranked: int = RERANKED, skip_same: bool = False) -> DataFrame:
    """query_id, key, score (exact cosine), rank of each query's best rows among its `reranked` candidates.

    Queries go through the driver a block at a time; each task keeps `reranked` codes a query. Ids are numbers.
    """
    wanted = written(queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")).filter("q is not null and v is not null").withColumn("b", F.monotonically_increasing_id()), "queries")
    n = wanted.count()
    blocks = -(-n // QUERY_BLOCK)
    found = []
    for block in range(blocks):
        held = wanted.filter(F.pmod(F.xxhash64("b"), F.lit(blocks)) == block).select("q", "v").toArrow()
        ids = held.column(0).to_numpy()
        tables = quantiser.tables(_matrix(held.column(1).combine_chunks(), True)) if len(ids) else np.empty((0, 1, 1))
        shared = df.sparkSession.sparkContext.broadcast((ids, tables))

        def run(batches, shared=shared):
            ids, tables = shared.value
            if not len(ids):
                return
            best = _Best(len(ids), reranked)
            for batch in batches:
                for at in range(0, batch.num_rows, CODE_ROWS):
                    part = batch.slice(at, CODE_ROWS)
                    keys = part.column(0).to_numpy()
                    codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(keys), -1)
                    value = np.zeros((len(ids), len(keys)), np.float32)
                    for i in range(codes.shape[1]):
                        value += tables[:, i][:, codes[:, i]]
                    if skip_same:
                        value[ids[:, None] == keys[None, :]] = -np.inf
                    best.add(value, keys)
            if best.parts:
                best.prune()
                q, keys, score = best.parts[0]
                yield pa.RecordBatch.from_pydict({"q": pa.array(ids[q]), "k": pa.array(keys), "near": pa.array(score.astype(np.float64))})

        near = top_per_group(codes.mapInArrow(run, "q long, k long, near double"), "q", F.col("near"), "k", reranked)
        found.append(written(near.select("q", "k"), "candidates"))
    if not found:
        return df.sparkSession.createDataFrame([], f"{query_id} long, {key} long, score double, rank long")
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    # The candidates' vectors: each row of the table is read once, the queries' are few.
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("row")).join(candidates, "k")
    scored = rows.join(wanted.select("q", "v"), "q").select("q", "k", V.cosine(F.col("v"), F.col("row")).alias("score")).filter("score is not null")
    best = top_per_group(scored, "q", F.round("score", 12), "k", top_n)
    return best.select(F.col("q").alias(query_id), F.col("k").alias(key), "score", "rank")
