"""Token counts as delta-maintained rollups.

Changes to documents are signed rows: an insert adds its count, a delete takes its count away, a revision does
both. Each batch of changes is summed by source, language and tokenizer version and committed by renaming its folder
into place, under the batch's id and a name of its own, so that no two writers ever meet. Totals are the sum of the
last compacted base and of one folder for each later batch: the one whose name comes first, should a batch have been
sent more than once. A base lists the batches that it holds: those of the base that its totals start from, and those
of the listing that they go on with, whatever other bases are made meanwhile. So a batch can be sent again after any failure, by several writers, and while a base is made: it counts once. The ids of
the batches, a few bytes for each commit, are all that the driver holds.

Defined cases: null sources and languages are groups of their own; a null text has no tokens but is a document;
repeated rows count as often as they stand; groups whose documents and tokens are both zero are left out of the
totals; an empty batch is committed and changes nothing; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, common

GROUP = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions that are expressions: words; words and punctuation marks; a quarter of the bytes.
EXPRESSIONS: dict[str, str] = {
    "words@1": r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')",
    "words@2": r"regexp_count(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]')",
    "bytes4@1": "(octet_length(coalesce(text, '')) + 3) div 4",
}


#: Versions that are vocabularies of the BPE encoder, by name: the path of the file.
VOCABULARIES: dict[str, Callable[[], str]] = {"byte_bpe_50k@1": bpe.default_vocabulary}


def counts(docs: DataFrame, *tokenizers: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, source, lang, tokenizer, n_tokens of every row for each tokenizer version; docs has text, source and lang.

    Versions that are expressions take one scan together; each vocabulary takes a scan of its own.
    """
    plain = [t for t in tokenizers if t in EXPRESSIONS]
    keep = [id_col, F.col("source").cast("string"), F.col("lang").cast("string")]
    found = None
    if plain:
        each = F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.expr(EXPRESSIONS[t]).cast("long").alias("n_tokens")) for t in plain])
        found = docs.select(*keep, F.explode(each).alias("t")).select(id_col, "source", "lang", "t.tokenizer", "t.n_tokens")
    for name in tokenizers:
        if name not in EXPRESSIONS:
            whole = F.struct(F.col(id_col), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
            ids = bpe.encode(docs.select(whole.alias("_row"), "text"), VOCABULARIES[name](), id_col="_row")
            part = ids.select("_row.*", F.lit(name).alias("tokenizer"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))
            found = part if found is None else found.unionByName(part)
    return found


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * F.col("n_tokens")).cast("long").alias("n_tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    """rows carry the counts that were inserted."""
    return _signed(rows, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """Committed deltas and compacted bases below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for name in ("deltas", "bases", "staged"):
            self._fs.mkdirs(self._paths(f"{self.path}/{name}"))

    def _names(self, kind: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._paths(f"{self.path}/{kind}")))

    def _publish(self, staged: str, kind: str, name: str) -> None:
        if not self._fs.rename(self._paths(staged), self._paths(f"{self.path}/{kind}/{name}")):
            raise OSError(f"could not publish {kind}/{name}")

    def _batches(self) -> dict[str, str]:
        """The folder that counts for each batch id, from one listing."""
        found: dict[str, str] = {}
        for name in self._names("deltas"):
            found.setdefault(name.partition(".")[0], name)
        return found

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False if a batch of this id was committed before, or another writer's counts."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch_id):
            raise ValueError(f"no name for a batch: {batch_id!r}")
        if batch_id in self._batches():
            return False
        staged, name = f"{self.path}/staged/{uuid.uuid4().hex}", f"{batch_id}.{uuid.uuid4().hex}"
        delta = changes.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.filter("n_docs <> 0 or n_tokens <> 0").coalesce(8).write.parquet(staged)
        self._publish(staged, "deltas", name)
        return self._batches()[batch_id] == name

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)

    def _totals(self, batches: dict[str, str]) -> tuple[DataFrame, set[str]]:
        """The totals of the newest base and the later batches, and the ids of all batches in them."""
        bases = self._names("bases")[-1:]
        base = [f"{self.path}/bases/{b}/totals" for b in bases]
        done = {r[0] for b in bases for r in self.spark.read.schema("batch_id string").parquet(f"{self.path}/bases/{b}/batches").collect()}
        rows = self._read(base + [f"{self.path}/deltas/{name}" for batch, name in batches.items() if batch not in done])
        summed = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 or n_tokens <> 0"), done | set(batches)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        return self._totals(self._batches())[0]

    def compact(self) -> None:
        """Make a new base of the batches committed so far; their ids stay known. Of bases made at once, the last counts."""
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        totals, ids = self._totals(self._batches())
        totals.coalesce(8).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(ids)], "batch_id string").coalesce(1).write.parquet(f"{staged}/batches")
        self._publish(staged, "bases", f"{len(self._names('bases')):08d}.{uuid.uuid4().hex}")


def marked(labels: DataFrame, condition: Column) -> DataFrame:
    return labels.filter(condition).select("doc_id").distinct()


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A life of documents: all are loaded; good ones move to the next tokenizer version; toxic ones are deleted."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    measured = common.written(counts(docs, *EXPRESSIONS), "token-counts")
    v1, v2 = measured.filter("tokenizer = 'words@1'"), measured.filter("tokenizer = 'words@2'")
    rest = measured.filter("tokenizer = 'bytes4@1'")
    good, toxic = marked(labels, F.col("quality") == 1), marked(labels, F.col("toxic") == 1)

    store = TokenRollup(spark, common.shared_dir(spark, "token-rollup"))
    store.commit("load", inserts(v1.unionByName(rest)))
    upgrade = revisions(v1.join(good, "doc_id", "left_semi"), v2.join(good, "doc_id", "left_semi"))
    store.commit("upgrade", upgrade)
    store.compact()
    live = v1.join(good, "doc_id", "left_anti").unionByName(v2.join(good, "doc_id", "left_semi")).unionByName(rest)
    store.commit("remove-toxic", deletes(live.join(toxic, "doc_id", "left_semi")))
    store.commit("upgrade", upgrade)  # sent again: changes nothing
    return store.totals()
