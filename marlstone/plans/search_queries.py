"""Queries over vectors: search, joins, fusion, hybrid search, classification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions import vectors as V
from marlstone.operators import bm25, classify, fusion, graph, quantised, relations, vector
from marlstone.operators import messages as msg
from marlstone.plans.document_queries import bm25_sql
from marlstone.plans.registry import doc_index, index_of, query, rounded, table
from marlstone.plans.registry import documents as docs_of
from marlstone.sources import store
from marlstone.sources.shared import written

_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_Q0 = f"(SELECT v AS q FROM {_E} WHERE vec_id = 0)"
_COS = "list_cosine_similarity(v, q)"


def vectors_of(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def first(spark, sf_dir):
    return vector.vector_of(vectors_of(spark, sf_dir), 0, "vec_id")


def top(df):
    return df.select("vec_id", rounded("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM {_E}, {_Q0} WHERE vec_id <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk_cosine(spark, sf_dir):
    return top(vector.search(vectors_of(spark, sf_dir), first(spark, sf_dir), "vec_id", filter_expr="vec_id <> 0"))


@query(f"SELECT vec_id, round(list_dot_product(v, q), 6) AS score FROM {_E}, {_Q0} WHERE vec_id <> 0 ORDER BY list_dot_product(v, q) DESC, vec_id LIMIT 10")
def vector_topk_dot(spark, sf_dir):
    return top(vector.search(vectors_of(spark, sf_dir), first(spark, sf_dir), "vec_id", metric="dot", filter_expr="vec_id <> 0"))


@query(f"SELECT vec_id, round(-(list_distance(v, q) ** 2), 6) AS score FROM {_E}, {_Q0} WHERE vec_id <> 0 ORDER BY list_distance(v, q), vec_id LIMIT 10")
def vector_topk_l2(spark, sf_dir):
    return top(vector.search(vectors_of(spark, sf_dir), first(spark, sf_dir), "vec_id", metric="l2", filter_expr="vec_id <> 0"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM {_E}, {_Q0} WHERE label IN (1, 2, 3) AND {_COS} >= 0.05 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return top(vector.search(vectors_of(spark, sf_dir), first(spark, sf_dir), "vec_id", filter_expr="label in (1, 2, 3)", min_score=0.05))


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, label, {_COS} AS s FROM {_E}, {_Q0} ORDER BY s DESC, vec_id LIMIT 100) WHERE label IN (1, 2) ORDER BY s DESC, vec_id LIMIT 10")
def vector_twostage_overfetch(spark, sf_dir):
    return top(vector.two_stage_search(vectors_of(spark, sf_dir), first(spark, sf_dir), "vec_id", "label in (1, 2)"))


@query(f"SELECT vec_id, round(greatest(0, least(1, {_COS})), 6) AS score FROM {_E}, {_Q0}")
def cosine_clamped(spark, sf_dir):
    q = V.literal(first(spark, sf_dir))
    return vectors_of(spark, sf_dir).select("vec_id", V.cosine_clamped(F.col("embedding"), q).alias("score")).select("vec_id", rounded("score"))


@query(f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, CAST(len(v) AS BIGINT) AS dim FROM {_E}")
def embedding_norms(spark, sf_dir):
    return vectors_of(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT count(*) AS bad FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64")
def embedding_dim_check(spark, sf_dir):
    return vector.dimension_errors(vectors_of(spark, sf_dir), 64).agg(F.count("*").alias("bad"))


_KNN = f"""SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS s, b.label,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank
  FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"""


def neighbours(spark, sf_dir, k=10):
    """query_id, vec_id, score, rank, label: the neighbours of each query vector, ids divisible by 50 being the queries."""
    base = vectors_of(spark, sf_dir)
    queries = base.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = vector.batch_search(base, queries, "query_id", "vec_id", top_n=k, skip_same=True)
    return found.join(base.select("vec_id", "label"), "vec_id")


@query(f"SELECT query_id, vec_id, round(s, 6) AS score, rank FROM ({_KNN}) WHERE rank <= 10")
def knn_batch_search(spark, sf_dir):
    return neighbours(spark, sf_dir).select("query_id", "vec_id", rounded("score"), "rank")


@query()
def quantised_topk(spark, sf_dir):
    """Neighbours by codes of a sixteenth of the vectors' size, the best of them scored exactly; with the recall of all queries."""
    base = vectors_of(spark, sf_dir)
    queries = base.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    quantiser = quantised.fit(base, "vec_id")
    found = written(quantised.search(base, quantised.coded(base, quantiser, "vec_id"), quantiser, queries, "query_id", "vec_id", skip_same=True), "quantised")
    exact = vector.batch_search(base, queries, "query_id", "vec_id", skip_same=True)
    recall = vector.mean_recall(exact, found, "query_id", "vec_id").first().recall  # one row
    return found.select("query_id", "vec_id", rounded("score"), "rank", F.round(F.lit(recall), 4).alias("recall"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM {_E} a JOIN {_E} b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4")
def pairs_over_threshold(spark, sf_dir):
    return vector.similar_pairs(vectors_of(spark, sf_dir), 0.4, "vec_id").select("a", "b", rounded("score"))


_EDGES = f"""SELECT src, dst, s FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank
  FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.35) WHERE rank <= 10"""


def edges_of(spark, sf_dir):
    return relations.similarity_edges(vectors_of(spark, sf_dir), "vec_id", 0.35)


@query(f"SELECT src, dst, 'semantic_similarity' AS type, round(s, 6) AS strength, true AS auto_generated, CASE WHEN s > 0.9 THEN 'very similar content' ELSE 'similar content' END AS rationale FROM ({_EDGES})")
def similarity_edges(spark, sf_dir):
    return edges_of(spark, sf_dir).withColumn("strength", F.round("strength", 6))


@query(f"SELECT e.src, e.dst FROM ({_EDGES}) e WHERE NOT EXISTS (SELECT 1 FROM ({_EDGES}) x WHERE x.src < 100 AND least(x.src, x.dst) = least(e.src, e.dst) AND greatest(x.src, x.dst) = greatest(e.src, e.dst))")
def new_edges_anti(spark, sf_dir):
    found = edges_of(spark, sf_dir)
    return relations.new_edges(found, found.filter("src < 100"), undirected=True).select("src", "dst")


@query(f"SELECT e.src, e.dst, round(s, 6) AS strength, a.label AS src_label, b.label AS dst_label FROM ({_EDGES}) e JOIN embeddings a ON a.vec_id = e.src JOIN embeddings b ON b.vec_id = e.dst WHERE s >= 0.4 ORDER BY round(s, 12) DESC, e.src, e.dst LIMIT 100")
def edge_endpoint_lookup(spark, sf_dir):
    out = relations.with_endpoints(edges_of(spark, sf_dir), vectors_of(spark, sf_dir), "vec_id", ["label"], 0.4)
    return out.select("src", "dst", rounded("strength"), "src_label", "dst_label")


@query("""WITH n AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
SELECT src, dst, round(least(1.0, 0.6 + 0.1 * (count(*) - 1)), 6) AS strength, count(*) AS count FROM n WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst""")
def sequence_edges(spark, sf_dir):
    out = relations.sequence_edges(table(spark, sf_dir, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")])
    return out.select("src", "dst", rounded("strength"), "count")


# Fusion and hybrid search.
_TEXT_HITS = bm25_sql(["the", "hehely"], "s >= 0.1", "ORDER BY s DESC, doc_id LIMIT 20", extra=", s")
_NEAR = f"SELECT vec_id AS doc_id, {_COS} AS s FROM {_E}, {_Q0} WHERE {_COS} >= 0.05 ORDER BY s DESC, vec_id LIMIT 20"


def _rrf_sql(left: str, right: str, weights: tuple[str, str], tail: str = "") -> str:
    return f"""
WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM ({left})),
m AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM ({right})),
f AS (SELECT coalesce(l.doc_id, m.doc_id) AS doc_id, coalesce(l.r, (SELECT count(*) + 1 FROM l)) AS rank_0, coalesce(m.r, (SELECT count(*) + 1 FROM m)) AS rank_1 FROM l FULL JOIN m ON l.doc_id = m.doc_id)
SELECT doc_id, rank_0, rank_1, round({weights[0]} / (60 + rank_0) + {weights[1]} / (60 + rank_1), 9) AS score FROM f {tail}"""


def text_hits(spark, sf_dir):
    return bm25.bm25_search(docs_of(spark, sf_dir), "the hehely", min_score=0.1, top_n=20, key="doc_id", index=doc_index(spark, sf_dir)).select("doc_id", "score")


def near_hits(spark, sf_dir):
    return vector.search(vectors_of(spark, sf_dir), first(spark, sf_dir), "vec_id", min_score=0.05, top_n=20).select(F.col("vec_id").alias("doc_id"), "score")


def fused(df):
    return df.select("doc_id", "rank_0", "rank_1", rounded("score", 9))


@query(_rrf_sql(_TEXT_HITS, _NEAR, ("0.3", "0.7")))
def rrf_two(spark, sf_dir):
    return fused(fusion.reciprocal_rank_fusion([text_hits(spark, sf_dir), near_hits(spark, sf_dir)], [0.3, 0.7], "doc_id"))


@query(_rrf_sql(_TEXT_HITS, _NEAR, ("1.0", "1.0")))
def rrf_unweighted(spark, sf_dir):
    return fused(fusion.reciprocal_rank_fusion([text_hits(spark, sf_dir), near_hits(spark, sf_dir)], [1.0, 1.0], "doc_id"))


_HYBRID = _rrf_sql(_TEXT_HITS, _NEAR, ("0.5", "0.5"), "ORDER BY score DESC, doc_id LIMIT 10").replace("rank_1, round", "rank_1, count(*) OVER () AS total, round")


@query(_HYBRID)
def hybrid_search(spark, sf_dir):
    found = fusion.hybrid_search(docs_of(spark, sf_dir), vectors_of(spark, sf_dir), "the hehely", first(spark, sf_dir), "doc_id", "vec_id", min_score={"semantic": 0.05}, index=doc_index(spark, sf_dir))
    return found.select("doc_id", "rank_0", "rank_1", "total", rounded("score", 9))


_NEXT_DOC = "(SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.lang = a.lang)"


@query(f"""WITH h AS ({_TEXT_HITS}), v AS ({_NEAR}), e AS {_NEXT_DOC},
x AS (SELECT doc_id, s FROM h UNION ALL SELECT e.dst, 0.8 * s FROM h JOIN e ON e.src = h.doc_id),
y AS (SELECT doc_id, s FROM x WHERE s >= 0.5),
g AS (SELECT doc_id, max(r) AS r FROM (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM y) GROUP BY doc_id),
l AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM h), m AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM v),
k AS (SELECT doc_id FROM l UNION SELECT doc_id FROM m UNION SELECT doc_id FROM g)
SELECT k.doc_id, count(*) OVER () AS total,
  round(0.3 / (60 + coalesce(l.r, (SELECT count(*) + 1 FROM l))) + 0.5 / (60 + coalesce(m.r, (SELECT count(*) + 1 FROM m))) + 0.2 / (60 + coalesce(g.r, (SELECT count(*) + 1 FROM y))), 9) AS score
FROM k LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_graph(spark, sf_dir):
    """Three legs: text, vectors, and what the edges between neighbouring documents of a language reach."""
    d = docs_of(spark, sf_dir)
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("doc_id").cast("string").alias("dst"))
    edges = d.select("doc_id", "lang").join(after, ["doc_id", "lang"]).select(F.col("doc_id").cast("string").alias("src"), "dst", F.lit("next").alias("type"))
    found = fusion.hybrid_search(d, vectors_of(spark, sf_dir), "the hehely", first(spark, sf_dir), "doc_id", "vec_id", min_score={"semantic": 0.05}, index=doc_index(spark, sf_dir), edges=edges, types=["next"], direction="OUTBOUND")
    return found.select("doc_id", "total", rounded("score", 9))


_TAGGED = bm25_sql(["the", "hehely"], "s >= 0.1 AND list_has_any([lang, source], ['en', 'src1'])", "ORDER BY s DESC, doc_id LIMIT 20", extra=", s")
_NEAR_TAGGED = f"SELECT vec_id AS doc_id, {_COS} AS s FROM {_E}, {_Q0} WHERE {_COS} >= 0.05 AND vec_id IN (SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['en', 'src1'])) ORDER BY s DESC, vec_id LIMIT 20"


@query(_rrf_sql(_TAGGED, _NEAR_TAGGED, ("0.5", "0.5"), "ORDER BY score DESC, doc_id LIMIT 10"))
def hybrid_tag_filtered(spark, sf_dir):
    found = fusion.hybrid_search(docs_of(spark, sf_dir), vectors_of(spark, sf_dir), "the hehely", first(spark, sf_dir), "doc_id", "vec_id", tags=["en", "src1"], min_score={"semantic": 0.05}, index=doc_index(spark, sf_dir))
    return fused(found)


@query(f"SELECT doc_id, round(max(t), 6) AS bm25, round(max(v), 6) AS similarity FROM (SELECT doc_id, s AS t, 0.0::DOUBLE AS v FROM ({_TEXT_HITS}) UNION ALL SELECT doc_id, 0.0::DOUBLE, s FROM ({_NEAR})) GROUP BY doc_id")
def hybrid_merge_max(spark, sf_dir):
    merged = fusion.merge_max([("bm25", text_hits(spark, sf_dir)), ("similarity", near_hits(spark, sf_dir))], "doc_id")
    return merged.select("doc_id", rounded("bm25"), rounded("similarity"))


@query(f"""WITH h AS ({_TEXT_HITS}), n AS ({_NEAR}),
e AS (SELECT doc_id, s FROM h UNION ALL SELECT doc_id + 1, 0.8 * s FROM h),
g AS (SELECT doc_id, max(r) AS r FROM (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM e) GROUP BY doc_id),
l AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM h), m AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM n),
k AS (SELECT doc_id FROM l UNION SELECT doc_id FROM m UNION SELECT doc_id FROM g)
SELECT k.doc_id, round(0.4 / (60 + coalesce(l.r, (SELECT count(*) + 1 FROM l))) + 0.4 / (60 + coalesce(m.r, (SELECT count(*) + 1 FROM m))) + 0.2 / (60 + coalesce(g.r, (SELECT count(*) + 1 FROM e))), 9) AS score
FROM k LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id)""")
def rrf_three_graph(spark, sf_dir):
    text = text_hits(spark, sf_dir)
    related = text.select("doc_id", (F.col("doc_id") + 1).alias("vertex"))
    out = fusion.reciprocal_rank_fusion([text, near_hits(spark, sf_dir), fusion.expand_graph(text, related, "doc_id")], [0.4, 0.4, 0.2], "doc_id")
    return out.select("doc_id", rounded("score", 9))


_MSG = "(SELECT conv_id * 1000000 + turn AS doc_id, text, role, conv_id FROM conversations)"


@query(f"""WITH h AS ({_TEXT_HITS.replace("LIMIT 20", "")}), m AS ({bm25_sql(["the", "hehely"], "true", "", _MSG, ", s")}),
u AS (SELECT 'documents' AS collection, doc_id AS id, s FROM h UNION ALL SELECT 'messages', doc_id, s FROM m)
SELECT collection, id, round(s, 6) AS score, (SELECT count(*) FROM u) AS total FROM u ORDER BY s DESC, collection, id LIMIT 10""")
def unified_search(spark, sf_dir):
    def documents():
        return bm25.bm25_search(docs_of(spark, sf_dir), "the hehely", min_score=0.1, top_n=None, key="doc_id", index=doc_index(spark, sf_dir)).select(F.col("doc_id").alias("id"), "score")

    def messages():
        return bm25.scores(message_index(spark, sf_dir), ["the", "hehely"]).withColumnRenamed("key", "id")

    found = fusion.unified({"documents": documents, "messages": messages, "glossary": documents}, "id", exclude=["glossary"])
    return found.select("collection", "id", rounded("score"), "total")


def messages_of(spark, sf_dir):
    return msg.messages(table(spark, sf_dir, "conversations")).withColumn("id", F.col("conversation_id") * 1000000 + F.col("turn"))


def message_index(spark, sf_dir):
    return index_of(spark, sf_dir, "messages", messages_of(spark, sf_dir), ["content"], "id", source="conversations")


@query(bm25_sql(["the", "hehely"], "role = 'user' AND conv_id BETWEEN 0 AND 1000000", source=_MSG).replace("SELECT doc_id, round", "SELECT doc_id AS id, round"))
def message_search(spark, sf_dir):
    wanted = msg.wanted_messages(message_type="user", start=0, end=1000001, time="conversation_id")
    found = msg.search_messages(messages_of(spark, sf_dir), "the hehely", "id", index=message_index(spark, sf_dir), wanted=wanted)
    return found.select("id", rounded("score"))


_MSG_TEXT = bm25_sql(["the", "hehely"], "role = 'user' AND s >= 0.1", "ORDER BY s DESC, doc_id LIMIT 20", _MSG, ", s")
_MSG_NEAR = f"SELECT c.doc_id, {_COS} AS s FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM {_MSG}) c JOIN {_E} ON vec_id = c.n % 100, {_Q0} WHERE role = 'user' AND {_COS} >= 0.05 ORDER BY s DESC, c.doc_id LIMIT 20"


@query(_rrf_sql(_MSG_TEXT, _MSG_NEAR, ("0.5", "0.5"), "ORDER BY score DESC, doc_id LIMIT 10").replace("SELECT doc_id, rank_0", "SELECT doc_id AS id, rank_0"))
def message_search_hybrid(spark, sf_dir):
    """Messages by text and by vector; a message's vector is one of the table's first hundred."""
    msgs = messages_of(spark, sf_dir)
    numbered = numbers(msgs, "id").withColumn("vec_id", F.col("n") % 100)
    vectors = numbered.join(vectors_of(spark, sf_dir).select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    found = msg.search_messages(msgs, "the hehely", "id", "hybrid", message_index(spark, sf_dir), vectors, first(spark, sf_dir), msg.wanted_messages(message_type="user"), min_score={"bm25": 0.1, "semantic": 0.05})
    return found.select("id", "rank_0", "rank_1", rounded("score", 9))


def numbers(df, key):
    """key, n: the keys numbered in their order, by counts of ranges."""
    ranges = written(df.select(key).repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()), "numbers")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranges.withColumn("_own", own).join(sizes, "_range").select(key, (F.col("_own") - 1 + F.col("_before")).alias("n"))


# Classification: labels of vectors by parity.
_BIN = f"SELECT query_id, vec_id, s, rank, label % 2 AS y FROM ({_KNN}) WHERE rank <= 25"


def binary_neighbours(spark, sf_dir):
    return neighbours(spark, sf_dir, 25).withColumn("label", (F.col("label") % 2).cast("long"))


def _vote_sql(power: int) -> str:
    return f"""WITH v AS (SELECT query_id, sum(CASE WHEN y = 1 AND s > 0 THEN s ** {power} ELSE 0 END) AS v1, sum(CASE WHEN y = 0 AND s > 0 THEN s ** {power} ELSE 0 END) AS v0, count(*) AS n FROM ({_BIN}) GROUP BY query_id)
SELECT query_id, CAST(CASE WHEN v1 > v0 THEN 1 ELSE 0 END AS BIGINT) AS prediction, round(CASE WHEN v1 + v0 > 0 THEN greatest(v0, v1) / (v1 + v0) ELSE 0 END, 6) AS confidence,
  v1 + v0 > 0 AND greatest(v0, v1) / (v1 + v0) >= 0.7 AND n >= 25 AS auto_accept FROM v"""


@query(_vote_sql(2))
def knn_classify_weighted(spark, sf_dir):
    out = classify.vote(binary_neighbours(spark, sf_dir), "query_id", k=25)
    return out.select("query_id", "prediction", rounded("confidence"), "auto_accept")


@query(_vote_sql(1))
def knn_classify_linear(spark, sf_dir):
    out = classify.vote(binary_neighbours(spark, sf_dir), "query_id", power=1, k=25)
    return out.select("query_id", "prediction", rounded("confidence"), "auto_accept")


@query(f"SELECT query_id, CAST(CASE WHEN 2 * sum(y) >= count(*) THEN 1 ELSE 0 END AS BIGINT) AS prediction FROM ({_BIN}) WHERE rank <= 3 GROUP BY query_id")
def knn_classify_majority(spark, sf_dir):
    return classify.majority(binary_neighbours(spark, sf_dir), "query_id")


_METRICS = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision",
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
_CELLS = """CAST(sum(CASE WHEN actual = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN actual = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN actual = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN actual = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn"""
_SCORES = ("accuracy", "precision", "recall", "f1")


@query(f"""WITH b AS ({_BIN}), ks(k) AS (VALUES (1), (5), (25)),
v AS (SELECT k, query_id, CASE WHEN round(sum(CASE WHEN s <= 0 THEN 0 WHEN y = 1 THEN s * s ELSE -s * s END), 12) > 0 THEN 1 ELSE 0 END AS p FROM b, ks WHERE rank <= k GROUP BY ALL),
c AS (SELECT k, {_CELLS} FROM (SELECT v.*, label % 2 AS actual FROM v JOIN embeddings ON vec_id = query_id) GROUP BY k),
d AS (SELECT k, avg(m) AS m FROM (SELECT k, query_id, CASE WHEN sum(CASE WHEN s > 0 THEN s * s ELSE 0 END) > 0
  THEN greatest(sum(CASE WHEN s > 0 AND y = 1 THEN s * s ELSE 0 END), sum(CASE WHEN s > 0 AND y = 0 THEN s * s ELSE 0 END)) / sum(CASE WHEN s > 0 THEN s * s ELSE 0 END) ELSE 0 END AS m FROM b, ks WHERE rank <= k GROUP BY ALL) GROUP BY k)
SELECT CAST(k AS BIGINT) AS k, tp, fp, fn, tn, {_METRICS}, round(m, 6) AS mean_confidence FROM c JOIN d USING (k)""")
def knn_eval_by_k(spark, sf_dir):
    truth = vectors_of(spark, sf_dir).select(F.col("vec_id").alias("query_id"), (F.col("label") % 2).alias("actual"))
    out = classify.evaluate_by_k(binary_neighbours(spark, sf_dir), truth, "query_id", [1, 5, 25])
    return out.select(F.col("k").cast("long").alias("k"), "tp", "fp", "fn", "tn", *[rounded(s) for s in _SCORES], rounded("mean_confidence"))


@query(f"WITH c AS (SELECT {_CELLS} FROM (SELECT quality AS actual, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))) SELECT tp, fp, fn, tn, {_METRICS} FROM c")
def confusion_matrix(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(docs_of(spark, sf_dir).select("doc_id", (F.length("text") > 1500).cast("int").alias("p")), "doc_id")
    return classify.metrics(both, "quality", "p").select("tp", "fp", "fn", "tn", *[rounded(s) for s in _SCORES])


@query(f"SELECT query_id, pos, round(avg(x), 6) AS mean FROM (SELECT k.query_id, unnest(e.v) AS x, unnest(range(64)) AS pos FROM ({_KNN}) k JOIN {_E} e ON e.vec_id = k.vec_id WHERE k.rank <= 5) GROUP BY ALL")
def neighbor_mean_embedding(spark, sf_dir):
    near = neighbours(spark, sf_dir, 5).join(vectors_of(spark, sf_dir).select("vec_id", "embedding"), "vec_id")
    return classify.mean_vectors(near, "query_id").select("query_id", F.col("at").cast("long").alias("pos"), rounded("mean"))


# Orders as edges between vectors: customer and order number, as far as there are such vectors.
_LINKS = "(SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_custkey IN (SELECT vec_id FROM embeddings) AND o_orderkey IN (SELECT vec_id FROM embeddings))"
_GRAPH_NEAR = f"""WITH RECURSIVE e AS (SELECT a, b FROM {_LINKS} UNION ALL SELECT b, a FROM {_LINKS}),
w AS (SELECT 0 AS v, 0 AS d UNION SELECT 1, 0 UNION SELECT e.b, w.d + 1 FROM w JOIN e ON e.a = w.v WHERE w.d < 2),
g AS (SELECT v AS vec_id, min(d) AS d FROM w GROUP BY v HAVING min(d) > 0),
n AS (SELECT vec_id, {_COS} AS sim FROM {_E}, {_Q0} WHERE vec_id <> 0 AND {_COS} > 0.1),
m AS (SELECT vec_id, max(sim) AS sim, min(d) AS d FROM (SELECT vec_id, sim, NULL AS d FROM n UNION ALL SELECT vec_id, 0, d FROM g) GROUP BY vec_id),
t AS (SELECT vec_id, 0.7 * sim + 0.3 * coalesce(1 - d / 3, 0) AS s FROM m ORDER BY round(0.7 * sim + 0.3 * coalesce(1 - d / 3, 0), 12) DESC, vec_id LIMIT 25),
r AS (SELECT t.vec_id, s, label % 2 AS y, row_number() OVER (ORDER BY round(s, 12) DESC, t.vec_id) AS rank FROM t JOIN embeddings USING (vec_id))"""


def graph_neighbours(spark, sf_dir):
    """vec_id, score: the neighbours of vector 0 by cosine, and those of vectors 0 and 1 by two steps over the orders' edges."""
    base = vectors_of(spark, sf_dir)
    ids = base.select("vec_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    links = orders.join(ids, orders.src == ids.vec_id, "left_semi").join(ids, orders.dst == ids.vec_id, "left_semi")
    edges = links.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit("order").alias("type"))
    starts = spark.createDataFrame([("0",), ("1",)], "start string")
    reached = graph.reachable(edges, starts, 2).groupBy(F.col("vertex").cast("long").alias("vec_id")).agg(F.min("depth").alias("depth")).filter("vec_id not in (0, 1)")
    scored = base.filter("vec_id <> 0").withColumn("score", V.cosine(F.col("embedding"), V.literal(first(spark, sf_dir)))).filter("score > 0.1")
    return classify.graph_scores(scored.select("vec_id", "score"), reached, "vec_id")


@query(f"{_GRAPH_NEAR} SELECT vec_id, round(s, 6) AS score, y AS label FROM r")
def graph_enhanced_classify(spark, sf_dir):
    """The merged neighbours that vote on vector 0."""
    best = graph_neighbours(spark, sf_dir).orderBy(F.desc(F.round("score", 12)), "vec_id").limit(25)
    return best.join(vectors_of(spark, sf_dir), "vec_id").select("vec_id", rounded("score"), (F.col("label") % 2).alias("label"))


@query(f"""{_GRAPH_NEAR}, v AS (SELECT sum(CASE WHEN y = 1 AND s > 0 THEN s * s ELSE 0 END) AS v1, sum(CASE WHEN y = 0 AND s > 0 THEN s * s ELSE 0 END) AS v0, count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS n_complex FROM r)
SELECT CAST(CASE WHEN v1 > v0 THEN 1 ELSE 0 END AS BIGINT) AS prediction, round(greatest(v0, v1) / (v0 + v1), 6) AS confidence, n, n_complex, n - n_complex AS n_simple,
  (SELECT string_agg(vec_id || ':' || y, ' ' ORDER BY rank) FROM r WHERE rank <= 3) AS nearest FROM v""")
def graph_enhanced_vote(spark, sf_dir):
    labels = vectors_of(spark, sf_dir).select("vec_id", (F.col("label") % 2).alias("label"))
    out = classify.graph_classify(graph_neighbours(spark, sf_dir), labels, "vec_id")
    nearest = F.array_join(F.transform("nearest", lambda x: F.concat_ws(":", x["vec_id"], x["label"])), " ")
    return out.select("prediction", rounded("confidence"), "n", "n_complex", "n_simple", nearest.alias("nearest"))


@query("""WITH c AS (SELECT label % 3 AS a, label % 2 AS p FROM embeddings), k(c) AS (VALUES (0), (1), (2)),
m AS (SELECT k.c, count(CASE WHEN a = k.c AND p = k.c THEN 1 END) AS tp, count(CASE WHEN a = k.c THEN 1 END) AS n, count(CASE WHEN p = k.c THEN 1 END) AS g FROM c, k GROUP BY k.c)
SELECT round(sum(n * CASE WHEN g > 0 THEN tp / g ELSE 0 END) / sum(n), 6) AS "precision", round(sum(n * CASE WHEN n > 0 THEN tp / n ELSE 0 END) / sum(n), 6) AS recall,
  round(sum(n * CASE WHEN n + g > 0 THEN 2 * tp / (n + g) ELSE 0 END) / sum(n), 6) AS f1, round(sum(tp) / sum(n), 6) AS accuracy FROM m""")
def weighted_metrics(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).select((F.col("label") % 3).alias("a"), (F.col("label") % 2).alias("p"))
    return classify.weighted_metrics(rows, "a", "p").select(*[rounded(s) for s in ("precision", "recall", "f1", "accuracy")])


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r, min(n) OVER () AS m FROM (SELECT *, count(*) OVER (PARTITION BY quality) AS n FROM labels)) WHERE r <= m")
def class_balance(spark, sf_dir):
    return classify.balanced(table(spark, sf_dir, "labels"), "quality", F.col("doc_id")).select("doc_id", "quality")


@query("SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS part FROM documents")
def split_80_10_10(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", classify.split(F.col("doc_id")).alias("part"))


@query("""SELECT doc_id, lang, CASE WHEN 10 * k <= 8 * n THEN 'train' WHEN 10 * k <= 9 * n THEN 'validation' ELSE 'test' END AS part
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def split_stratified(spark, sf_dir):
    return classify.stratified_split(docs_of(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "part")


@query("SELECT event_id, CAST(value / 100 >= 0.5 AS INTEGER) AS inclusive, CAST(value / 100 > 0.5 AS INTEGER) AS exclusive FROM events WHERE value / 100 BETWEEN 0 AND 1")
def label_binarize(spark, sf_dir):
    rating = F.col("value") / 100
    kept = table(spark, sf_dir, "events").filter(rating.between(0, 1))
    return kept.select("event_id", classify.binary_label(rating).alias("inclusive"), classify.binary_label(rating, inclusive=False).alias("exclusive"))


@query("""SELECT p_partkey, floor((10 + CASE WHEN m < 1e8 THEN 5 WHEN m < 3e8 THEN 10 ELSE 20 END) * d * b) AS epochs, floor((5 + CASE WHEN m < 1e8 THEN 5 WHEN m < 3e8 THEN 10 ELSE 15 END) * d * b) AS patience
FROM (SELECT p_partkey, p_size * 1e7 AS m, CASE WHEN p_retailprice * 500 < 50000 THEN 0.8 WHEN p_retailprice * 500 < 500000 THEN 1.0 ELSE 1.5 END::DOUBLE AS d, CASE WHEN p_size >= 32 THEN 1.0 ELSE 1.2 END::DOUBLE AS b FROM part)""")
def training_params(spark, sf_dir):
    epochs, patience = classify.training_params(F.col("p_size") * 1e7, F.col("p_retailprice") * 500, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", epochs.cast("double").alias("epochs"), patience.cast("double").alias("patience"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(64 AS BIGINT) AS dimension, true AS unit FROM documents WHERE text IS NOT NULL")
def hash_embed(spark, sf_dir):
    """Each distinct text is embedded once, and its vector joined back."""
    docs = docs_of(spark, sf_dir)
    made = docs.select("text").distinct().withColumn("embedding", X.hash_embedding("text"))
    out = docs.select("doc_id", "text").join(made, "text")
    return out.select("doc_id", F.size("embedding").cast("long").alias("dimension"), (F.abs(V.norm(F.col("embedding")) - 1) < 1e-5).alias("unit"))


@query(f"SELECT vec_id, pos, round(x / sqrt(list_dot_product(v, v)), 6) AS value FROM (SELECT vec_id, v, unnest(v) AS x, unnest(range(64)) AS pos FROM {_E} WHERE label <> 3)")
def normalised_embeddings(spark, sf_dir):
    """The embedding matrix: rows with a vector that pass a filter, of length one."""
    unit = vectors_of(spark, sf_dir).filter("embedding is not null and label <> 3").select("vec_id", V.normalised(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), rounded("value"))


@query("SELECT least(10, (SELECT count(*) FROM documents)) AS n, true AS found_first, true AS by_text")
def semantic_text_search(spark, sf_dir):
    """A text as query: it is embedded as the documents are, so that an equal text comes first."""
    docs = store.with_embedding(docs_of(spark, sf_dir).select("doc_id", "text"), field="text")
    text = docs.orderBy("doc_id").first()["text"]
    found = vector.search(docs, vector.embedded_query(spark, text), "doc_id")
    best = F.max(F.when(F.col("text") == text, F.col("score")))
    return found.agg(F.count("*").alias("n"), (best >= F.max("score") - 1e-9).alias("found_first"), (best > 0.999999).alias("by_text"))


@query("SELECT doc_id FROM documents WHERE text = (SELECT text FROM documents WHERE doc_id = 7) ORDER BY doc_id LIMIT 1")
def id_by_text(spark, sf_dir):
    text = docs_of(spark, sf_dir).filter("doc_id = 7").first()["text"]
    return vector.id_of_text(docs_of(spark, sf_dir), text, "doc_id")


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_COS} AS s FROM {_E}, {_Q0} WHERE vec_id <> 0) WHERE s > 0.2 ORDER BY s DESC, vec_id LIMIT 1")
def id_by_similarity(spark, sf_dir):
    return top(vector.most_similar(vectors_of(spark, sf_dir).filter("vec_id <> 0"), first(spark, sf_dir), "vec_id", least=0.2))


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS n_queries, true AS good")
def ivf_topk(spark, sf_dir):
    """The index's recall against the exact search of the same queries."""
    base = vectors_of(spark, sf_dir)
    queries = base.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector.ivf_search(base, queries, "query_id", "vec_id", skip_same=True)
    exact = vector.batch_search(base, queries, "query_id", "vec_id", skip_same=True)
    return vector.mean_recall(exact, found, "query_id", "vec_id").select("n_queries", (F.col("recall") >= 0.9).alias("good"))


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, (SELECT min(r.b) FROM r WHERE r.a = e.vec_id) AS class_id FROM embeddings e""")
def lsh_pairs(spark, sf_dir):
    """The similarity join as one row for each vector: at so low a cosine no hash tables reach all pairs, so all blocks are compared."""
    return vector.similarity_classes(vectors_of(spark, sf_dir), 0.4, "vec_id")


@query(f"SELECT src, dst, round(s, 6) AS strength FROM ({_EDGES.replace(_E, _E.replace('FROM embeddings', 'FROM embeddings WHERE label IN (1, 2, 3)'))})")
def filtered_similarity_edges(spark, sf_dir):
    return relations.filtered_similarity_edges(vectors_of(spark, sf_dir), "vec_id", "label in (1, 2, 3)", 0.35).select("src", "dst", rounded("strength"))


@query(f"""SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, 'semantic_similarity' AS type, round(s, 6) AS strength FROM ({_EDGES})
UNION ALL SELECT src, dst, 'user_sequence', strength FROM (
  WITH n AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
  SELECT src, dst, round(least(1.0, 0.6 + 0.1 * (count(*) - 1)), 6) AS strength FROM n WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)
UNION ALL SELECT CAST(CASE WHEN b.label > a.label THEN hi ELSE lo END AS VARCHAR), CAST(CASE WHEN b.label > a.label THEN lo ELSE hi END AS VARCHAR), 'prerequisite', 0.8
FROM (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, max(s) AS s FROM ({_EDGES}) WHERE s >= 0.4 GROUP BY ALL ORDER BY round(max(s), 12) DESC, lo, hi LIMIT 100) e
JOIN embeddings a ON a.vec_id = lo JOIN embeddings b ON b.vec_id = hi WHERE a.label <> b.label""")
def all_relationships(spark, sf_dir):
    """Similarity, sequences of use, and prerequisites by a judge that takes the higher label as the earlier one."""

    def judge(pairs):
        before = F.when(F.col("src_label") > F.col("dst_label"), 1).when(F.col("src_label") < F.col("dst_label"), -1)
        return pairs.withColumns({"direction": before, "rationale": F.lit("label")})

    out = relations.all_relationships(vectors_of(spark, sf_dir), "vec_id", table(spark, sf_dir, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")], judge, ["label"], threshold=0.35, min_strength=0.4)
    return out.select("src", "dst", "type", rounded("strength"))


@query()
def logreg_baseline(spark, sf_dir):
    """The held-out part's predictions."""
    data = vectors_of(spark, sf_dir).withColumn("y", (F.col("label") % 2).cast("double"))
    _, out = classify.logistic_baseline(data, "y", "vec_id")
    return out.select("vec_id", "y", "prediction")


@query()
def neighbour_logreg(spark, sf_dir):
    near = neighbours(spark, sf_dir, 5).join(vectors_of(spark, sf_dir).select("vec_id", "embedding"), "vec_id")
    labels = vectors_of(spark, sf_dir).select(F.col("vec_id").alias("query_id"), (F.col("label") % 2).cast("double").alias("y"))
    _, out = classify.neighbour_baseline(near.withColumn("query_id", F.col("query_id").cast("long")), labels, "query_id", "y")
    return out.select("query_id", "y", "prediction")
