"""What the operators of this subpackage share: reading tables and writing to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.shared import release_memory, shared_dir, short_batches, slices, written

__all__ = ["BROADCAST_KEYS", "release_memory", "shared_dir", "shared_file", "short_batches", "slices", "table", "without", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file to the shared folder and register it with Spark; the name for SparkFiles.get."""
    unique = f"{uuid.uuid4().hex}-{name}"
    path = f"{shared_dir(spark, 'file')}/{unique}"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop_path.getFileSystem(conf).create(hadoop_path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return unique


#: Keys up to which a set of them is broadcast; a larger set is joined by a shuffle.
BROADCAST_KEYS = 200_000


def without(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of df whose value of `name` is not among the keys (one column of that name)."""
    keys = written(keys.distinct(), "keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, name, "left_anti")
