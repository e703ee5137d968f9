"""Collections as versioned Parquet snapshots: create, update, delete, upsert, and loading labelled data."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X


def latest(df: DataFrame, key: str, version: Sequence[Column]) -> DataFrame:
    """The row of each key with the greatest version."""
    rank = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(version)])
    best = df.groupBy(F.col(key).alias("_group")).agg(F.max_by(F.struct(*df.columns), rank).alias("best"))
    return best.select("best.*")


def upsert(base: DataFrame, added: DataFrame, key: str, version: Sequence[Column] = ()) -> DataFrame:
    """added rows replace rows of equal keys; columns that either lacks are null.

    Of several added rows with one key the one with the greatest version stays, ties going to the greatest row.
    """
    order = [*version, F.xxhash64(*added.columns)]
    added = latest(added, key, order)
    return base.join(added.select(key).distinct(), key, "left_anti").unionByName(added, allowMissingColumns=True)


def merge_update(base: DataFrame, updates: DataFrame, key: str, keep_nulls: bool = False) -> DataFrame:
    """Columns of updates replace those of the row with the key; no row is added.

    A null leaves the old value; with keep_nulls it replaces it, too.
    """
    fields = [c for c in updates.columns if c != key]
    renamed = updates.select(key, F.lit(True).alias("_updated"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = base.join(renamed, key, "left")

    def value(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        if c not in base.columns:
            return F.col(f"_new_{c}").alias(c)
        new = F.when(F.col("_updated"), F.col(f"_new_{c}")).otherwise(F.col(c)) if keep_nulls else F.coalesce(f"_new_{c}", c)
        return new.alias(c)

    return joined.select(*map(value, [*base.columns, *[c for c in fields if c not in base.columns]]))


def with_embedding(docs: DataFrame, embed: Callable[[Column], Column] = X.hash_embedding, field: str = "content", vector: str = "embedding") -> DataFrame:
    """docs with a vector for each text that is not empty; a vector that is there stays where the text has none.

    Each distinct text is embedded once. embed: any function of a text column.
    """
    keyed = docs.withColumn("_digest", text_digest(field))
    made = one_text_each(keyed, field).select("_digest", embed(F.col("_text")).alias("_vector"))
    return _filled(keyed, made, vector)


def text_digest(field: str) -> Column:
    """What an embedding is known by; a text without characters has one that is its row's alone, so that no key is shared by them."""
    return F.when(F.length(F.trim(field)) > 0, F.sha2(F.col(field), 256)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))


def one_text_each(keyed: DataFrame, field: str) -> DataFrame:
    """_digest, _text of the distinct texts."""
    return keyed.filter(F.length(F.trim(field)) > 0).groupBy("_digest").agg(F.first(field).alias("_text"))


def _filled(keyed: DataFrame, made: DataFrame, vector: str) -> DataFrame:
    """keyed with the vectors that were made for its digests; others stay."""
    old = F.col(vector).cast("array<float>") if vector in keyed.columns else F.lit(None).cast("array<float>")
    return keyed.join(made, "_digest", "left").withColumn(vector, F.coalesce("_vector", old)).drop("_vector", "_digest")


class EmbeddingStore:
    """Vectors by (digest of the text, model version), kept between runs in a folder: what is there is not embedded again.

    Each run adds a folder, renamed into place whole. If two runs embed one text at a time, both vectors are kept and the
    greater one is read.
    """

    def __init__(self, spark: SparkSession, path: str, version: str):
        if not re.fullmatch(r"[\w.@-]+", version):
            raise ValueError(f"no name for a version: {version!r}")
        self.spark, self.path, self.version = spark, f"{path.rstrip('/')}/version={version}", version
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._paths(self.path))

    def read(self) -> DataFrame:
        """_digest, _vector."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._paths(self.path))]
        parts = [f"{self.path}/{n}" for n in names if n.startswith("run-")]
        kind = "_digest string, _vector array<float>"
        stored = self.spark.read.schema(kind).parquet(*parts) if parts else self.spark.createDataFrame([], kind)
        return stored.groupBy("_digest").agg(F.max("_vector").alias("_vector"))

    def embed(self, docs: DataFrame, embed: Callable[[Column], Column] = X.hash_embedding, field: str = "content", vector: str = "embedding") -> tuple[DataFrame, int]:
        """docs as `with_embedding` has them, and how many texts had to be embedded."""
        keyed = docs.withColumn("_digest", text_digest(field))
        known = self.read().select("_digest")
        missing = one_text_each(keyed.join(known, "_digest", "left_anti"), field).select("_digest", embed(F.col("_text")).alias("_vector"))
        staged, name = f"{self.path}/.{uuid.uuid4().hex}", f"run-{uuid.uuid4().hex}"
        missing.write.parquet(staged)
        n = self.spark.read.schema("_digest string").parquet(staged).count()
        if n and not self._fs.rename(self._paths(staged), self._paths(f"{self.path}/{name}")):
            raise OSError(f"could not publish {name}")
        return _filled(keyed, self.read(), vector), n


def create_edges(edges: DataFrame, added: DataFrame) -> DataFrame:
    """The edges with added(src, dst, type, ...), each with the key of its ends and type; equal edges are one."""
    keyed = added.withColumn("_key", edge_key("src", "dst", "type"))
    return upsert(edges, keyed, "_key")


def edge_key(src: str, dst: str, kind: str) -> Column:
    return F.md5(F.concat_ws("\x1f", src, dst, kind))


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return delete(edges, keys, "_key")


def sample_collections(spark: SparkSession) -> dict[str, DataFrame]:
    """A small collection of documents and its edges, to try queries on."""
    docs = [
        ("d1", "Sorting a list in place", "Use the sort method", ["lists", "sorting"]),
        ("d2", "A loop runs out of memory", "Read the file in parts", ["memory", "files"]),
        ("d3", "Finding near vectors", "Build an index of centroids", ["vectors", "search"]),
        ("d4", "A query is slow", "Look at its plan first", ["search", "plans"]),
        ("d5", "Two writers of one file", "Rename a new file into place", ["files"]),
    ]
    edges = [("d2", "d5", "related_to", 0.6), ("d3", "d4", "related_to", 0.8), ("d4", "d2", "references", 0.5)]
    vertices = spark.createDataFrame(docs, "_key string, problem string, solution string, tags array<string>")
    return {"documents": vertices, "edges": create_edges(spark.createDataFrame([], "src string, dst string, type string, weight double, _key string"), spark.createDataFrame(edges, "src string, dst string, type string, weight double"))}


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


class Collection:
    """A folder of snapshots; a write makes the next one, and readers take the newest."""

    def __init__(self, spark: SparkSession, path: str, key: str = "_key"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._paths(path))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._paths(self.path))]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}")

    def replace(self, df: DataFrame) -> int:
        """Write a new snapshot beside the others and rename it into place; its number. A lost race is an error."""
        version = (self.versions() or [0])[-1] + 1
        staged = f"{self.path}/.{uuid.uuid4().hex}"
        df.write.parquet(staged)
        # The claim of a number is a file that only one writer can make; one that a writer left when it crashed is removed by hand.
        if not self._fs.createNewFile(self._paths(f"{self.path}/.claim-{version}")):
            raise RuntimeError(f"version {version} was written by another writer")
        if not self._fs.rename(self._paths(staged), self._paths(f"{self.path}/v{version}")):
            raise RuntimeError(f"version {version} could not be published")
        return version

    def create(self, docs: DataFrame, embed: Callable[[Column], Column] | None = None, field: str = "content") -> int:
        """Add documents; those without key get one, and all a timestamp where they have none. embed: makes their vectors."""
        docs = with_embedding(docs, embed, field) if embed else docs
        docs = docs if self.key in docs.columns else docs.withColumn(self.key, F.lit(None).cast("string"))
        docs = docs if "timestamp" in docs.columns else docs.withColumn("timestamp", F.lit(None).cast("timestamp"))
        docs = docs.withColumns({self.key: F.coalesce(F.col(self.key), F.expr("uuid()")), "timestamp": F.coalesce("timestamp", F.current_timestamp())})
        return self.replace(docs if not self.versions() else self.read().unionByName(docs, allowMissingColumns=True))

    def get(self, value) -> DataFrame:
        return self.read().filter(F.col(self.key) == value)

    def update(self, updates: DataFrame, embed: Callable[[Column], Column] | None = None, field: str = "content", keep_nulls: bool = False) -> int:
        """embed: makes new vectors for the updates that have a text."""
        updates = with_embedding(updates, embed, field) if embed else updates
        return self.replace(merge_update(self.read(), updates.withColumn("updated_at", F.current_timestamp()), self.key, keep_nulls))

    def upsert(self, docs: DataFrame) -> int:
        return self.replace(docs if not self.versions() else upsert(self.read(), docs, self.key))

    def delete(self, keys: DataFrame) -> int:
        """Keys that are absent are no error."""
        return self.replace(delete(self.read(), keys, self.key))

    def truncate(self) -> int:
        return self.replace(self.read().limit(0))


def labelled(rows: DataFrame, text: str = "question", rating: str = "rating", threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """text, rating, label, validated of rows with a text and a rating from 0 to 1."""
    value = F.expr(f"try_cast(`{rating}` as double)")
    kept = rows.select(F.col(text), value.alias(rating)).filter(F.col(text).isNotNull() & F.col(rating).between(0, 1))
    from marlstone.operators.classify import binary_label

    return kept.withColumns({"label": binary_label(F.col(rating), threshold, inclusive), "validated": F.lit(True)})


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Documents of JSON files, with or without a byte order mark; what is no object is an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def text_files(spark: SparkSession, folder: str, extensions: Sequence[str] = (), most_bytes: int | None = None) -> DataFrame:
    """path, content of text files below a folder, without a byte order mark. most_bytes: leaves out longer files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
    files = reader.load(folder)
    files = files if most_bytes is None else files.filter(F.col("length") <= most_bytes)
    return files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("content"))
