"""Structured Streaming: documents into a collection's term statistics, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.functions import text as X


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total of events(ts, event_type, value) in windows, late rows being dropped."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    return counted.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def term_deltas(docs: DataFrame, field: str = "text") -> DataFrame:
    """term, n_docs, n_total that the documents add."""
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), X.tokens(field).alias("terms"))
    each = numbered.select("doc", F.explode("terms").alias("term"))
    per = each.groupBy("term", "doc").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_total"))


def maintain_terms(docs: DataFrame, folder: str, checkpoint: str, field: str = "text") -> StreamingQuery:
    """Write each micro-batch's term deltas into its own folder, so that a batch run twice counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        term_deltas(batch, field).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_totals(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_total").alias("n_total"))
