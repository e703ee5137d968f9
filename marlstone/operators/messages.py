"""Conversation history: messages and the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import bm25, fusion, vector
from marlstone.operators.bm25 import TextIndex


def messages(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_key, conversation_id, turn, message_type (USER, AGENT, SYSTEM), content."""
    kind = F.when(F.col(role) == "assistant", "AGENT").otherwise(F.upper(role))
    return turns.select(F.concat_ws("-", conversation, turn).alias("_key"), F.col(conversation).alias("conversation_id"), F.col(turn).alias("turn"), kind.alias("message_type"), F.col(text).alias("content"))


def next_edges(msgs: DataFrame) -> DataFrame:
    """src, dst, type NEXT from each message to the one after it.

    Turns without a gap are found by an equi-join, so a long conversation is dealt over tasks; only a conversation
    with gaps is ordered by a window.
    """
    per = msgs.groupBy("conversation_id").agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("d"))
    gaps = per.filter("hi - lo + 1 <> n or d <> n").select("conversation_id")
    after = msgs.select("conversation_id", (F.col("turn") - 1).alias("turn"), F.col("_key").alias("dst"))
    dense = msgs.join(gaps, "conversation_id", "left_anti").join(after, ["conversation_id", "turn"]).select(F.col("_key").alias("src"), "dst")
    order = Window.partitionBy("conversation_id").orderBy("turn", "_key")
    rest = msgs.join(gaps, "conversation_id", "left_semi").select(F.col("_key").alias("src"), F.lead("_key").over(order).alias("dst")).filter("dst is not null")
    return dense.unionByName(rest).withColumn("type", F.lit("NEXT"))


def conversation(msgs: DataFrame, conversation_id, limit: int = 100, offset: int = 0, descending: bool = False) -> DataFrame:
    order = F.col("turn").desc() if descending else F.col("turn").asc()
    out = msgs.filter(F.col("conversation_id") == conversation_id).orderBy(order, "_key")
    return (out.offset(offset) if offset else out).limit(limit)


def delete_messages(msgs: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and edges without those in gone(_key) and their edges in or out."""
    keys = gone.select("_key").distinct()
    left = edges.join(keys.withColumnRenamed("_key", "src"), "src", "left_anti").join(keys.withColumnRenamed("_key", "dst"), "dst", "left_anti")
    return msgs.join(keys, "_key", "left_anti"), left.select(*edges.columns)


def delete_conversation(msgs: DataFrame, edges: DataFrame, conversation_id) -> tuple[DataFrame, DataFrame]:
    return delete_messages(msgs, edges, msgs.filter(F.col("conversation_id") == conversation_id))


def document_links(msgs: DataFrame, docs: DataFrame, links: DataFrame, key: str = "_key") -> DataFrame:
    """src, dst, type REFERS_TO, rationale of links(message, document, rationale) between what is there; equal links are one."""
    there = links.join(msgs.select(F.col("_key").alias("message")), "message", "left_semi").join(docs.select(F.col(key).alias("document")).distinct(), "document", "left_semi")
    return there.groupBy(F.col("message").alias("src"), F.col("document").cast("string").alias("dst")).agg(F.min("rationale").alias("rationale")).select("src", "dst", F.lit("REFERS_TO").alias("type"), "rationale")


def wanted_messages(conversation_id=None, message_type: str | None = None, start=None, end=None, time: str = "timestamp") -> Column:
    """The messages of a conversation, of a kind, and from start to before end, as far as they are given."""
    found = F.lit(True)
    if conversation_id is not None:
        found &= F.col("conversation_id") == F.lit(conversation_id)
    if message_type is not None:
        found &= F.col("message_type") == message_type.upper()
    if start is not None:
        found &= F.col(time) >= F.lit(start)
    if end is not None:
        found &= F.col(time) < F.lit(end)
    return found


def search_messages(msgs: DataFrame, query: str, key: str = "_key", kind: str = "bm25", index: TextIndex | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, wanted: Column | None = None, top_n: int = 10, **options) -> DataFrame:
    """key, score of the best messages by text, by vector, or by both (`bm25`, `semantic`, `hybrid`); vectors has key and embedding."""
    if kind == "bm25":
        return bm25.bm25_search(msgs, query, ["content"], wanted, key=key, index=index, top_n=top_n).select(key, "score")
    if kind not in ("semantic", "hybrid"):
        raise ValueError(f"unknown kind of search: {kind}")
    if kind == "semantic":
        pool = vectors if wanted is None else vectors.join(msgs.filter(wanted).select(key), key, "left_semi")
        return vector.search(pool, query_vector, key, top_n=top_n, **options).select(key, "score")
    return fusion.hybrid_search(msgs, vectors, query, query_vector, key, key, filter_expr=wanted, index=index, top_n=top_n, **options)
