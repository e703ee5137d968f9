"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import bm25
from marlstone.operators.segments import SegmentedIndex
from marlstone.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection of documents, its tags being language and source."""
    return table(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))


_INDEXES: dict[tuple, tuple[SegmentedIndex, str, bm25.TextIndex]] = {}


def state_of(spark: SparkSession, path: str) -> str:
    """Changes when a table's files do: their number and bytes, and when the path was last changed."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    whole = file_system.getContentSummary(hadoop_path)
    return f"{whole.getFileCount()} {whole.getLength()} {file_system.getFileStatus(hadoop_path).getModificationTime()}"


def index_of(spark: SparkSession, sf_dir: str, name: str, docs: DataFrame, fields: Sequence[str] = ("text",), key: str = "doc_id", analyzer: str = "words", source: str | None = None) -> bm25.TextIndex:
    """The stored index of a collection, made when it is first asked for in the application.

    When the files of its table (source, or the name) have changed, what differs in the collection is committed to it.
    """
    which = (spark.sparkContext.applicationId, sf_dir, name, tuple(fields), key, analyzer)
    state = state_of(spark, f"{sf_dir}/{source or name}.parquet")
    held, known, pinned = _INDEXES.get(which, (None, "", None))
    if known != state:
        held = held or SegmentedIndex(spark, shared_dir(spark, f"index-{name}"), fields, key, analyzer)
        held.refresh(docs)
        pinned = held.pinned()
        _INDEXES[which] = held, state, pinned
    return pinned


def doc_index(spark: SparkSession, sf_dir: str) -> bm25.TextIndex:
    return index_of(spark, sf_dir, "documents", documents(spark, sf_dir))


def rounded(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})
