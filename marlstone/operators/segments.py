"""A text index that follows its collection, as tables that are added and never changed.

A commit adds one segment for the rows that were inserted, revised or deleted: its postings, with the places of every
term; a row for each document with its terms (by which the statistics of its old version are taken away again, when it
goes); signed counts of terms; and the (key, segment) of the versions that it replaces. A manifest lists the segments
and the sizes of fields; a search reads the newest once and stays with it, whatever is committed meanwhile. Counts are sums
over segments, so they are those of a full rebuild. Small segments are merged by size; what is not merged is not
rewritten.

Fed by `apply` (rows and keys), `refresh` (what differs from a table as it now stands) or `follow` (a stream); a batch
that comes again under its name changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.bm25 import ANALYZERS, TextIndex
from marlstone.sources.shared import put, short_batches, slices, written

#: Segments beyond which the smallest are merged, and how many of them at a time.
MOST_SEGMENTS, MERGED = 8, 6
#: A term's postings are spread over so many parts of the range that is dealt out, lest one task gets a frequent term whole.
SALTS = 16

_TERMS = "array<struct<term: string, places: array<int>>>"
#: The tables of a segment; KEY stands for the type of the collection's keys.
_TABLES = {
    "docs": f"key KEY, field string, length int, digest string, terms {_TERMS}",
    "postings": "field string, term string, key KEY, tf int, length int, places array<int>",
    "counts": "field string, term string, n_docs long, n_total long, most_tf int, least_length int",
    "dead": "key KEY, segment string",
}


def analysed(docs: DataFrame, fields: Sequence[str], key: str, analyzer: str) -> DataFrame:
    """key, field, length, digest, terms (each distinct term with its places, from 0) of every field of every document.

    A task holds the words of few rows at a time.
    """
    short_batches(docs.sparkSession)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    rows = docs.select(F.col(key).alias("key"), F.explode(each).alias("x"))
    rows = rows.select("key", "x.field", F.sha2(F.coalesce("x.text", F.lit("")), 256).alias("digest"), ANALYZERS[analyzer](F.col("x.text")).alias("t"))

    def grouped(batches):
        for batch in slices(batches):
            words = batch.column("t").cast(pa.list_(pa.string()))
            lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            size = max(len(coded.dictionary), 1)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keys = doc * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            ends = np.append(first, len(order)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
            entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(distinct % size)), places], names=["term", "places"])
            bounds = np.searchsorted(distinct, np.arange(len(lengths) + 1) * size).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(bounds), entries)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("field"), pa.array(lengths.astype(np.int32)), batch.column("digest"), terms], names=["key", "field", "length", "digest", "terms"])

    return rows.mapInArrow(grouped, _TABLES["docs"].replace("KEY", rows.schema["key"].dataType.simpleString()))


class SegmentedIndex:
    """The segments and manifests below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str] = ("text",), key: str = "_key", analyzer: str = "words"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._paths(f"{self.folder}/manifests"))
        found = self.manifest()
        self.fields, self.analyzer = (found["fields"], found["analyzer"]) if found["version"] else (list(fields), analyzer)
        self.key_type = found["key_type"] if found["version"] else None

    # Manifests: version, segments ([name, documents]), batches (names of those committed), sizes {field: [n, tokens]},
    # fields, analyzer, key_type.

    def manifest(self) -> dict:
        """The newest; of version 0 before the first commit."""
        versions = [int(s.getPath().getName()) for s in self._fs.listStatus(self._paths(f"{self.folder}/manifests")) if s.getPath().getName().isdigit()]
        if not versions:
            return {"version": 0, "segments": [], "batches": [], "sizes": {}}
        stream = self._fs.open(self._paths(f"{self.folder}/manifests/{max(versions)}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, base: dict, **changes) -> dict:
        """The manifest after `base`, which no other writer may have followed: a lost race is an error, and can be tried again."""
        made = base | changes | {"version": base["version"] + 1, "fields": self.fields, "analyzer": self.analyzer, "key_type": self.key_type}
        claim, place = self._paths(f"{self.folder}/manifests/.claim-{made['version']}"), self._paths(f"{self.folder}/manifests/{made['version']}")
        if self._fs.exists(place) or not self._fs.createNewFile(claim):
            raise RuntimeError(f"version {made['version']} was written by another writer")
        staged = self._paths(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if not self._fs.rename(staged, place):
            raise RuntimeError(f"version {made['version']} could not be published")
        return made

    def _schema(self, name: str) -> str:
        return _TABLES[name].replace("KEY", self.key_type or "string")

    def _stored(self, name: str, segment: str) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.folder}/segments/{segment}/{name}")

    def _table(self, name: str, segments: Sequence[str]) -> DataFrame:
        """A table of some segments, with the segment of each row."""
        parts = [self._stored(name, s).withColumn("segment", F.lit(s)) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{self._schema(name)}, segment string")

    def _dead(self, segments: Sequence[str]) -> DataFrame:
        """The (key, segment) of versions that later segments replaced."""
        parts = [self._stored("dead", s) for s in segments]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], self._schema("dead"))

    def _live(self, name: str, segments: Sequence[str]) -> DataFrame:
        rows = self._table(name, segments)
        # A segment that is alone replaces nothing.
        return rows.join(self._dead(segments), ["key", "segment"], "left_anti") if len(segments) > 1 else rows

    def _write(self, name: str, gone: DataFrame | None, dead: DataFrame | None) -> dict[str, list[int]]:
        """The other tables of a segment whose documents are stored, less the statistics of the old versions; the signed sizes of fields."""
        path = f"{self.folder}/segments/{name}"
        stored = self._stored("docs", name)
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
        put(_postings(stored).repartitionByRange("field", "term", salt).sortWithinPartitions("field", "term", "key"), f"{path}/postings")
        # What is added is counted from its postings, of which a task has a term's together.
        added = self._stored("postings", name).select("field", "term", "tf", "length")
        terms = [_counted(added, 1)] + ([_counted(_postings(gone), -1)] if gone is not None else [])
        put(_summed(reduce(DataFrame.unionByName, terms)).repartitionByRange("field", "term").sortWithinPartitions("field", "term"), f"{path}/counts")
        put(dead if dead is not None else self.spark.createDataFrame([], self._schema("dead")), f"{path}/dead")
        sizes = {f: [0, 0] for f in self.fields}
        for d, sign in [(stored, 1)] + ([(gone, -1)] if gone is not None else []):
            for row in d.groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect():  # a row for each field
                sizes[row.field] = [sizes[row.field][0] + sign * row.n, sizes[row.field][1] + sign * row.tokens]
        return sizes

    def apply(self, rows: DataFrame | None = None, deleted: DataFrame | None = None, batch: str | None = None) -> bool:
        """Commit rows (new, or revised if their key is there) and deleted keys; False if the batch was committed before.

        Of rows with one key, one stays: that with the greatest digest; a key both revised and deleted is revised. Null
        keys are an error.
        """
        base = self.manifest()
        if batch is not None and batch in base["batches"]:
            return False
        given = rows if rows is not None else deleted
        self.key_type = self.key_type or given.schema[self.key].dataType.simpleString()
        own = F.col(self.key).cast(self.key_type).alias(self.key)
        name = uuid.uuid4().hex
        if rows is not None:
            found = analysed(rows.select(own, *self.fields), self.fields, self.key, self.analyzer)
            found = found.withColumn("key", F.when(F.col("key").isNull(), F.raise_error(F.lit("null key"))).otherwise(F.col("key")))
            put(found, f"{self.folder}/segments/{name}/docs")
            found = self._stored("docs", name)
            if not found.groupBy("key", "field").count().filter("count > 1").isEmpty():
                best = found.groupBy("key", "field").agg(F.max_by(F.struct("length", "digest", "terms"), "digest").alias("x"))
                name = uuid.uuid4().hex
                put(best.select("key", "field", "x.length", "x.digest", "x.terms"), f"{self.folder}/segments/{name}/docs")
        else:
            put(self.spark.createDataFrame([], self._schema("docs")), f"{self.folder}/segments/{name}/docs")
        keys = self._stored("docs", name).select("key").distinct()
        if deleted is not None:
            keys = keys.union(deleted.select(own)).distinct()
        old = [s for s, _ in base["segments"]]
        gone = written(self._live("docs", old).join(keys, "key", "left_semi"), "replaced") if old else None
        sizes = self._write(name, gone, gone.select("key", "segment").distinct() if gone is not None else None)
        total = {f: [base["sizes"].get(f, [0, 0])[i] + sizes[f][i] for i in (0, 1)] for f in self.fields}
        self._publish(base, segments=[*base["segments"], [name, keys.count()]], batches=base["batches"] + ([batch] if batch else []), sizes=total)
        if len(base["segments"]) + 1 > MOST_SEGMENTS:
            self.merge()
        return True

    def merge(self, most: int = MERGED) -> None:
        """Make one segment of the smallest ones; their dead rows go, what they replaced elsewhere is kept."""
        base = self.manifest()
        chosen = {s for s, _ in sorted(base["segments"], key=lambda x: x[1])[:most]}
        if len(chosen) < 2:
            return
        every = [s for s, _ in base["segments"]]
        dead = self._dead(every)
        docs = self._table("docs", sorted(chosen)).join(dead, ["key", "segment"], "left_anti").drop("segment")
        # The merged counts are the sum of the segments' own, the versions that they replaced being taken away already.
        name = uuid.uuid4().hex
        path = f"{self.folder}/segments/{name}"
        put(docs, f"{path}/docs")
        postings = self._table("postings", sorted(chosen)).join(dead, ["key", "segment"], "left_anti").drop("segment")
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
        put(postings.repartitionByRange("field", "term", salt).sortWithinPartitions("field", "term", "key"), f"{path}/postings")
        put(_summed(self._table("counts", sorted(chosen))).repartitionByRange("field", "term").sortWithinPartitions("field", "term"), f"{path}/counts")
        put(self._dead(sorted(chosen)).filter(~F.col("segment").isin(*chosen)), f"{path}/dead")
        n = self._stored("docs", name).select("key").distinct().count()
        self._publish(base, segments=[x for x in base["segments"] if x[0] not in chosen] + [[name, n]])

    def refresh(self, table: DataFrame, batch: str | None = None) -> int:
        """Take over what differs from the table: new, revised and missing keys; how many. Only those are analysed anew."""
        base = self.manifest()
        if not base["version"]:
            self.apply(table, batch=batch)
            return sum(n for _, n in self.manifest()["segments"])
        each = F.array(*[F.sha2(F.coalesce(F.col(f).cast("string"), F.lit("")), 256) for f in self.fields])
        now = table.select(F.col(self.key).cast(self.key_type).alias("key"), each.alias("now"))
        # Of repeated keys the greatest row is the one that `apply` keeps, field by field.
        now = now.groupBy("key").agg(F.array(*[F.max(F.col("now")[i]) for i in range(len(self.fields))]).alias("now"))
        was = self._live("docs", [s for s, _ in base["segments"]]).groupBy("key")
        was = was.agg(F.array(*[F.max(F.when(F.col("field") == f, F.col("digest"))) for f in self.fields]).alias("was"))
        differs = written(now.join(was, "key", "full").filter("not (now <=> was)").select("key", F.isnull("now").alias("missing")), "differs")
        n = differs.count()
        if n:
            own = F.col(self.key).cast(self.key_type)
            changed = table.withColumn("_own", own).join(differs.filter("not missing").select(F.col("key").alias("_own")), "_own", "left_semi").drop("_own")
            self.apply(changed, differs.filter("missing").select(F.col("key").alias(self.key)), batch)
        return n

    def follow(self, stream: DataFrame, checkpoint: str, deleted: str | None = None) -> StreamingQuery:
        """Commit each micro-batch of a stream of rows under its number; rows where the column `deleted` is true are deletions."""
        name = f"stream-{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}"

        def write(rows: DataFrame, number: int) -> None:
            away = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
            self.apply(rows.filter(~away), rows.filter(away) if deleted else None, f"{name}-{number}")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def pinned(self, manifest: dict | None = None) -> TextIndex:
        """The index as of one manifest, for every search over a TextIndex."""
        found = manifest or self.manifest()
        names = [s for s, _ in found["segments"]]
        counts = self._table("counts", names).drop("segment")
        # A segment has one row for each term.
        counts = (_summed(counts) if len(names) > 1 else counts).filter("n_docs > 0")
        sizes = {f: tuple(found["sizes"].get(f, (0, 0))) for f in self.fields}
        docs = self._live("docs", names).select("field", "key", "length", F.col("terms.term").alias("terms"), F.transform("terms.places", F.size).alias("tfs"))
        return TextIndex(self._live("postings", names).drop("segment"), counts, sizes, self.analyzer, docs)


def _postings(docs: DataFrame) -> DataFrame:
    """The postings of stored documents."""
    return docs.select("field", "key", "length", F.explode("terms").alias("t")).select("field", "t.term", "key", F.size("t.places").alias("tf"), "length", "t.places")


def _counted(postings: DataFrame, sign: int) -> DataFrame:
    """The signed counts of terms, with the greatest tf and the least length: of what is added; what goes may leave them as they are."""
    tf, length = (F.col(c) if sign > 0 else F.lit(None).cast("int") for c in ("tf", "length"))
    return postings.groupBy("field", "term").agg((sign * F.count("*")).alias("n_docs"), (sign * F.sum("tf")).alias("n_total"), F.max(tf).alias("most_tf"), F.min(length).alias("least_length"))


def _summed(counts: DataFrame) -> DataFrame:
    sums = counts.groupBy("field", "term").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_total")], F.max("most_tf").alias("most_tf"), F.min("least_length").alias("least_length"))
    return sums.filter("n_docs <> 0 or n_total <> 0 or most_tf is not null")


def phrase_search(index: TextIndex, terms: Sequence[str], field: str = "text", slop: int = 0) -> DataFrame:
    """key, n: how often the terms stand in this order in a document, with at most `slop` other words among them.

    index: one with places. An occurrence is counted for each place of the first term, with the nearest next ones.
    """
    terms = list(terms)
    if not terms:
        raise ValueError("empty phrase")
    own = index.postings.filter((F.col("field") == field) & F.col("term").isin(terms)).select("key", "term", "places")
    lists = own.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at")).filter(F.size("at") == len(set(terms)))
    # The place where an occurrence that begins at p ends: the nearest next place of each term; null if there is none.
    ends = F.transform(F.col("at")[terms[0]], lambda p: F.struct(p.alias("first"), p.alias("last")))
    for term in terms[1:]:
        places = F.col("at")[term]
        ends = F.transform(ends, _next_near(places) if slop else _next(places))
    fits = F.filter(ends, lambda x: x["last"] - x["first"] - (len(terms) - 1) <= slop)
    return lists.select("key", F.size(fits).cast("long").alias("n")).filter("n > 0")


def _next(places: Column):
    """The same occurrence with the place after its last, if it is among the places."""
    return lambda x: F.struct(x["first"].alias("first"), F.when(F.array_contains(places, x["last"] + 1), x["last"] + 1).alias("last"))


def _next_near(places: Column):
    """The same occurrence with the nearest of the places after its last."""
    return lambda x: F.struct(x["first"].alias("first"), F.array_min(F.filter(places, lambda q: q > x["last"])).alias("last"))
