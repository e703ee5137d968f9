"""Folders that the driver and all executors share, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that a Python helper holds as Python objects at a time.
SLICE_ROWS = 512
#: And the bytes of it.
SLICE_BYTES = 16 << 20


#: Rows of the Arrow batches between Spark and its Python workers.
ARROW_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ARROW_ROWS rows: texts are long, and batches lie outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, removed when the application ends.

    Where that is unset, a single machine uses a folder of its own, and a cluster gets an error: no folder of one
    machine is seen by the others.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "/tmp/checkpoints"
    path = f"{top.rstrip('/')}/marlstone/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(conf)
    file_system.mkdirs(hadoop_path)
    file_system.deleteOnExit(hadoop_path)
    return path


def put(df: DataFrame, path: str) -> None:
    """Write df as Parquet, compressed by Zstandard.

    Its buffers are given back when a file is closed; those of Snappy lie outside the heap until it is collected.
    """
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and it survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession, name)}/table"
    put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = SLICE_ROWS, text_bytes: int = SLICE_BYTES):
    """Arrow batches cut into ones of few rows and, but for single rows, few bytes.

    At its end the task gives back what memory it has freed: the Python worker goes on to other stages.
    """

    def cut(batch):
        if batch.num_rows > 1 and batch.nbytes > text_bytes:
            half = batch.num_rows // 2
            yield from cut(batch.slice(0, half))
            yield from cut(batch.slice(half))
        else:
            yield batch

    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from cut(batch.slice(at, rows))
            del batch
    finally:
        release_memory()


def release_memory() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
