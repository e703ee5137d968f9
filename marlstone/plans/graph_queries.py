"""Queries over graphs, conversations, changed collections and text processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import bm25, classify, graph, messages, textproc
from marlstone.operators import documents as D
from marlstone.plans.document_queries import bm25_sql
from marlstone.plans.registry import doc_index, query, rounded, table
from marlstone.plans.registry import documents as docs_of
from marlstone.sources import store
from marlstone.sources.shared import shared_dir
from marlstone.streaming import index

# The foreign-key graph: orders to customers, customers to nations, nations to regions.
_EDGES = """(SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'placed_by' AS type FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives_in' FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation)"""


def edges_of(spark, sf_dir):
    def part(name, a, b, x, y, kind):
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit(kind).alias("type"))

    orders = part("orders", "o", "c", "o_orderkey", "o_custkey", "placed_by")
    customers = part("customer", "c", "n", "c_custkey", "c_nationkey", "lives_in")
    return orders.unionByName(customers).unionByName(part("nation", "n", "r", "n_nationkey", "n_regionkey", "part_of"))


def walk_sql(start: str, low: int, high: int, step: str = "e.src = w.vertex", to: str = "e.dst", edges: str = _EDGES) -> str:
    return f"""WITH RECURSIVE e AS {edges}, w AS (
  SELECT start, start AS vertex, 0 AS depth, [start] AS path FROM ({start})
  UNION ALL SELECT w.start, {to}, w.depth + 1, list_append(w.path, {to}) FROM w JOIN e ON {step} WHERE w.depth < {high} AND NOT list_contains(w.path, {to}))
SELECT start, vertex, CAST(depth AS BIGINT) AS depth, array_to_string(path, '/') AS path FROM w WHERE depth >= {low}"""


def paths(df):
    return df.select("start", "vertex", "depth", F.array_join("path", "/").alias("path"))


@query(walk_sql("SELECT 'c' || c_custkey AS start FROM customer", 1, 2))
def graph_outbound(spark, sf_dir):
    starts = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return paths(graph.traverse(edges_of(spark, sf_dir), starts, 1, 2, "OUTBOUND"))


@query(walk_sql("SELECT 'r' || r_regionkey AS start FROM region", 1, 3, "e.dst = w.vertex", "e.src"))
def graph_inbound(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))
    return paths(graph.traverse(edges_of(spark, sf_dir), starts, 1, 3, "INBOUND"))


_BOTH = f"(SELECT src, dst, type FROM {_EDGES} UNION ALL SELECT dst, src, type FROM {_EDGES})"


@query("SELECT vertex, min(depth) AS depth FROM (" + walk_sql("SELECT 'c1' AS start", 1, 3, edges=_BOTH) + ") GROUP BY vertex")
def graph_any_distinct(spark, sf_dir):
    starts = spark.createDataFrame([("c1",)], "start string")
    return graph.reachable(edges_of(spark, sf_dir), starts, 3, "ANY").select("vertex", "depth")


@query(walk_sql("SELECT 'o' || o_orderkey AS start FROM orders", 2, 2, edges=f"(SELECT * FROM {_EDGES} WHERE type IN ('placed_by', 'lives_in'))"))
def graph_type_filtered(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("start"))
    return paths(graph.traverse(edges_of(spark, sf_dir), starts, 2, 2, "OUTBOUND", ["placed_by", "lives_in"]))


@query("SELECT start, count(*) AS n, max(depth) AS deepest FROM (" + walk_sql("SELECT 'n' || n_nationkey AS start FROM nation", 1, 2, edges=_BOTH) + ") GROUP BY start")
def related_counts(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start"))
    return graph.traverse(edges_of(spark, sf_dir), starts, 1, 2, "ANY").groupBy("start").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


_STRONG = f"(SELECT *, CASE type WHEN 'part_of' THEN 0.9 WHEN 'lives_in' THEN 0.7 ELSE 0.5 END::DOUBLE AS strength FROM {_EDGES})"


@query(f"""WITH RECURSIVE e AS (SELECT src, dst, type, strength FROM {_STRONG} UNION ALL SELECT dst, src, type, strength FROM {_STRONG}),
w AS (SELECT 'r0' AS vertex, 0 AS depth, ['r0'] AS path, '' AS type, 0.0::DOUBLE AS strength
  UNION ALL SELECT e.dst, w.depth + 1, list_append(w.path, e.dst), e.type, e.strength FROM w JOIN e ON e.src = w.vertex WHERE w.depth < 2 AND NOT list_contains(w.path, e.dst))
SELECT vertex, CAST(depth AS BIGINT) AS depth, type, strength FROM w WHERE depth > 0""")
def related_topics(spark, sf_dir):
    """What is related to a region in two steps, with the last edge's type and strength."""
    strength = F.when(F.col("type") == "part_of", 0.9).when(F.col("type") == "lives_in", 0.7).otherwise(0.5)
    edges = edges_of(spark, sf_dir).withColumn("strength", strength)
    found = graph.traverse(edges, spark.createDataFrame([("r0",)], "start string"), 1, 2, "ANY", strength="strength")
    return found.select("vertex", "depth", F.element_at("edge_types", -1).alias("type"), F.element_at("strengths", -1).alias("strength"))


_DOC_EDGES = "(SELECT CAST(a.doc_id AS VARCHAR) AS src, CAST(b.doc_id AS VARCHAR) AS dst, 'next' AS type FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.lang = a.lang)"


def doc_edges(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("doc_id").cast("string").alias("dst"))
    return d.select("doc_id", "lang").join(after, ["doc_id", "lang"]).select(F.col("doc_id").cast("string").alias("src"), "dst", F.lit("next").alias("type"))


@query(f"WITH h AS ({bm25_sql(['the', 'hehely'])}) SELECT w.start AS doc_id, h.score, w.vertex, w.depth FROM ({walk_sql('SELECT CAST(doc_id AS VARCHAR) AS start FROM (' + bm25_sql(['the', 'hehely']) + ')', 1, 2, edges=_DOC_EDGES)}) w JOIN h ON CAST(h.doc_id AS VARCHAR) = w.start")
def graph_rag(spark, sf_dir):
    found = bm25.bm25_search(docs_of(spark, sf_dir), "the hehely", key="doc_id", index=doc_index(spark, sf_dir)).select("doc_id", "score")
    out = graph.graph_rag(found, doc_edges(spark, sf_dir), "doc_id", min_depth=1, max_depth=2, direction="OUTBOUND")
    return out.select(F.col("doc_id").cast("string").alias("doc_id"), rounded("score"), F.explode("related").alias("r")).select("doc_id", "score", "r.vertex", "r.depth")


@query("SELECT vertex, depth, path FROM (" + walk_sql("SELECT 'o' || o_orderkey AS start FROM orders", 1, 3) + ") WHERE vertex LIKE 'r%'")
def prerequisite_paths(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("start"))
    found = graph.traverse(edges_of(spark, sf_dir), starts, 1, 3, "OUTBOUND").filter(F.col("vertex").startswith("r"))
    return paths(found).select("vertex", "depth", "path")


@query(f"""WITH e AS {_DOC_EDGES}, ends AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e),
r AS (SELECT a, sum(CASE WHEN l.quality = 0 THEN 0 ELSE 1 END) AS cx, sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS sm FROM ends LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = b GROUP BY a),
p AS (SELECT src AS a, count(*) AS n FROM e GROUP BY src)
SELECT l.doc_id, CASE WHEN quality = 1 AND coalesce(n, 0) > 0 THEN 'has_prerequisites' WHEN quality = 1 AND coalesce(cx, 0) > coalesce(sm, 0) THEN 'related_to_complex'
  WHEN quality = 0 AND coalesce(sm, 0) > coalesce(cx, 0) THEN 'related_to_simple' ELSE 'primarily_semantic' END AS factor
FROM labels l LEFT JOIN r ON r.a = CAST(l.doc_id AS VARCHAR) LEFT JOIN p ON p.a = CAST(l.doc_id AS VARCHAR)""")
def explain_factor(spark, sf_dir):
    labels, edges = table(spark, sf_dir, "labels"), doc_edges(spark, sf_dir)
    quality = labels.select(F.col("doc_id").cast("string").alias("to"), "quality")
    near = graph.directed(edges, "ANY").join(quality, "to", "left").groupBy(F.col("from").alias("id"))
    near = near.agg(F.sum(F.when(F.col("quality") == 0, 0).otherwise(1)).alias("cx"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("sm"))
    before = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    joined = labels.withColumn("id", F.col("doc_id").cast("string")).join(near, "id", "left").join(before, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("doc_id", graph.explain(F.col("quality"), zero("n"), zero("cx"), zero("sm")).alias("factor"))


@query("SELECT dst, count(*) AS n FROM " + _EDGES + " GROUP BY dst")
def edge_lookup_counts(spark, sf_dir):
    return edges_of(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("n"))


# Conversations and changes to collections.
_MSGS = "(SELECT conv_id || '-' || turn AS _key, conv_id, turn, CASE WHEN role = 'assistant' THEN 'AGENT' ELSE upper(role) END AS message_type, text AS content FROM conversations)"
_NEXT = f"(SELECT _key AS src, lead(_key) OVER (PARTITION BY conv_id ORDER BY turn, _key) AS dst FROM {_MSGS})"


def messages_of(spark, sf_dir):
    return messages.messages(table(spark, sf_dir, "conversations"))


@query(f"SELECT _key, message_type, content FROM {_MSGS} WHERE conv_id = 3 ORDER BY turn DESC LIMIT 100")
def conversation_messages(spark, sf_dir):
    return messages.conversation(messages_of(spark, sf_dir), 3, descending=True).select("_key", "message_type", "content")


@query(f"SELECT src, dst, 'NEXT' AS type FROM {_NEXT} WHERE dst IS NOT NULL")
def next_message_edges(spark, sf_dir):
    return messages.next_edges(messages_of(spark, sf_dir))


@query(f"SELECT _key FROM {_MSGS} WHERE conv_id <> 3")
def delete_conversation(spark, sf_dir):
    msgs = messages_of(spark, sf_dir)
    return messages.delete_conversation(msgs, messages.next_edges(msgs), 3)[0].select("_key")


@query(f"SELECT src, dst FROM {_NEXT} WHERE dst IS NOT NULL AND src NOT IN (SELECT _key FROM {_MSGS} WHERE message_type = 'SYSTEM') AND dst NOT IN (SELECT _key FROM {_MSGS} WHERE message_type = 'SYSTEM')")
def cascade_delete(spark, sf_dir):
    msgs = messages_of(spark, sf_dir)
    return messages.delete_messages(msgs, messages.next_edges(msgs), msgs.filter("message_type = 'SYSTEM'"))[1].select("src", "dst")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, c_name, CASE WHEN o.n IS NULL THEN c_acctbal ELSE o.total END AS c_acctbal, o.n AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def merge_update(spark, sf_dir):
    updates = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.count("*").alias("n_orders"))
    return store.merge_update(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), updates, "c_custkey")


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def dedup_keep_first(spark, sf_dir):
    return D.keep_first(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", [F.col("event_id")])


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def append_union_all(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.filter("lang = 'fr'").drop("source").unionByName(d.filter("source = 'src1'").drop("source"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' UNION SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def union_distinct(spark, sf_dir):
    return append_union_all(spark, sf_dir).distinct()


@query("SELECT item_id AS question_id, CAST(length(text) > 200 AS INTEGER) AS label FROM benchmark WHERE length(text) / 400.0 BETWEEN 0 AND 1")
def labelled_dataset(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", (F.length("text") / 400.0).alias("rating"))
    out = store.labelled(rows.withColumn("question", F.col("item_id").cast("string")), inclusive=False)
    return out.select(F.col("question").cast("long").alias("question_id"), "label")


# Text processing.
@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.token_estimate("text").alias("n_tokens"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 50) || '...' || right(text, 50) ELSE text END AS preview FROM documents")
def truncate_preview(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.truncated("text").alias("preview"))


@query(r"""SELECT doc_id, CASE WHEN len(w) > 20 THEN array_to_string(w[1:10], ' ') || ' ... ' || array_to_string(w[-10:], ' ') ELSE array_to_string(w, ' ') END AS cut
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents)""")
def truncate_tokens(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.truncated_tokens("text", 20).alias("cut"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)) AS BIGINT) AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.size(X.sentences("text")).cast("long").alias("n_sentences"))


@query("SELECT doc_id, floor(CAST(least(greatest(100, 0.6 * (length(text) // 4)), 500) AS DOUBLE)) AS budget FROM documents")
def summary_budget(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", textproc.summary_budget(X.token_estimate("text")).cast("double").alias("budget"))


@query("SELECT conv_id, turn, running FROM (SELECT conv_id, turn, CAST(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM conversations) WHERE running <= 200")
def greedy_prefix(spark, sf_dir):
    return textproc.greedy_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn", X.token_estimate("text"), 200).select("conv_id", "turn", "running")


@query("SELECT count(*) AS n_files, CAST(sum(length(html)) AS BIGINT) AS n_chars, CAST(sum(length(html) // 4) AS BIGINT) AS n_tokens FROM pages")
def digest_summary(spark, sf_dir):
    return textproc.digest_by_extension(table(spark, sf_dir, "pages"), "url", "html").agg(F.sum("n_files").alias("n_files"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))


@query("SELECT regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1) AS extension, count(*) AS n_files, CAST(sum(length(html)) AS BIGINT) AS n_chars, CAST(sum(length(html) // 4) AS BIGINT) AS n_tokens FROM pages GROUP BY 1")
def digest_by_extension(spark, sf_dir):
    return textproc.digest_by_extension(table(spark, sf_dir, "pages"), "url", "html")


@query("SELECT url AS path, repeat('=', 48) || chr(10) || 'File: ' || url || chr(10) || repeat('=', 48) || chr(10) || html || chr(10) AS entry FROM pages")
def digest_entries(spark, sf_dir):
    return textproc.digest_entries(table(spark, sf_dir, "pages"), "url", "html")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props_extract(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair(spark, sf_dir):
    broken = F.concat(F.lit("noise: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" more"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(textproc.clean_json(broken), "k bigint")["k"].alias("k"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_window_counts(spark, sf_dir):
    return index.event_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query()
def chunk_overlap(spark, sf_dir):
    return textproc.chunks(docs_of(spark, sf_dir), 100, key="doc_id")


@query()
def summarize_hierarchical(spark, sf_dir):
    return textproc.summarise(docs_of(spark, sf_dir), direct_tokens=500, chunk_words=100, key="doc_id")


_FUNCTION = r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"


@query(f"""WITH f AS (SELECT page_id AS path, regexp_extract_all(html, '{_FUNCTION}', 1) AS names, regexp_extract_all(html, '{_FUNCTION}', 2) AS sources FROM pages),
e AS (SELECT path, unnest(range(len(names))) AS place, names, sources FROM f)
SELECT path, place, names[place + 1] AS name, array_to_string(list_filter(list_transform(string_split(sources[place + 1], ','), lambda p: regexp_extract(p, '^[^A-Za-z_$=:]*([A-Za-z_$][A-Za-z0-9_$]*)', 1)), lambda n: n <> ''), ' ') AS parameters FROM e""")
def code_functions(spark, sf_dir):
    found = textproc.code_functions(table(spark, sf_dir, "pages"), "javascript", "html", "page_id")
    return found.select(F.col("page_id").alias("path"), F.col("place").cast("long").alias("place"), "name", F.array_join("parameters", " ").alias("parameters"))


@query("""WITH r AS (SELECT count(*) AS original, count(CASE WHEN quality IN (0, 1) THEN 1 END) AS valid, count(CASE WHEN quality = 1 THEN 1 END) AS complex, count(CASE WHEN quality = 0 THEN 1 END) AS simple FROM labels)
SELECT original, valid, original - valid AS invalid, complex, simple, 2 * least(complex, simple) AS balanced FROM r""")
def collection_stats(spark, sf_dir):
    return classify.dataset_stats(table(spark, sf_dir, "labels"), "quality")


# Edges by key, links and vectors of documents.
_KEY = "md5(src || chr(31) || dst || chr(31) || type)"


@query(f"SELECT {_KEY} AS _key, src, dst, type FROM {_EDGES} WHERE type <> 'part_of' UNION ALL SELECT DISTINCT {_KEY}, src, dst, type FROM (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey + 1) % 25 AS dst, 'near' AS type FROM nation)")
def edges_created_and_deleted(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    edges = edges.withColumn("_key", store.edge_key("src", "dst", "type"))
    near = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"), F.lit("near").alias("type"))
    made = store.create_edges(edges, near.unionByName(near))
    return store.delete_edges(made, edges.filter("type = 'part_of'")).select("_key", "src", "dst", "type")


@query(f"SELECT src, dst, type, CASE WHEN src = 'n1' THEN dst ELSE src END AS other FROM {_EDGES} WHERE src = 'n1' OR dst = 'n1'")
def edge_lookup(spark, sf_dir):
    return graph.edge_lookup(edges_of(spark, sf_dir), "n1", "ANY").select("src", "dst", "type", "other")


@query(f"SELECT DISTINCT m._key AS src, CAST(d.doc_id AS VARCHAR) AS dst, 'REFERS_TO' AS type, 'same number' AS rationale FROM {_MSGS} m JOIN documents d ON d.doc_id = m.conv_id WHERE m.turn = 0")
def message_document_links(spark, sf_dir):
    msgs = messages_of(spark, sf_dir)
    links = msgs.filter("turn = 0").select(F.col("_key").alias("message"), F.col("conversation_id").alias("document"), F.lit("same number").alias("rationale"))
    return messages.document_links(msgs, docs_of(spark, sf_dir), links.unionByName(links), "doc_id")


@query("SELECT doc_id, CAST(CASE WHEN length(trim(text)) > 0 THEN 64 END AS BIGINT) AS dimension, count(*) OVER (PARTITION BY CASE WHEN length(trim(text)) > 0 THEN text END) AS n_same FROM documents")
def embedded_documents(spark, sf_dir):
    """Every document with a text gets a vector, equal texts the same one."""
    docs = store.with_embedding(docs_of(spark, sf_dir).select("doc_id", F.col("text").alias("content")))
    counts = docs.groupBy("embedding").agg(F.count("*").alias("n_same"))
    joined = docs.join(counts, docs.embedding.eqNullSafe(counts.embedding)).drop(counts.embedding)
    return joined.select("doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dimension"), "n_same")


_TEXTS = "(SELECT lang, text FROM documents WHERE length(trim(text)) > 0)"


@query(f"""SELECT 1 AS run, count(DISTINCT text) AS embedded, count(*) AS with_vector FROM {_TEXTS} WHERE lang = 'en'
UNION ALL SELECT 2, (SELECT count(*) FROM (SELECT text FROM {_TEXTS} EXCEPT SELECT text FROM {_TEXTS} WHERE lang = 'en')), (SELECT count(*) FROM {_TEXTS})
UNION ALL SELECT 3, 0, (SELECT count(*) FROM {_TEXTS})""")
def embedding_store_runs(spark, sf_dir):
    """Three runs over documents: English ones; all, of which only new texts are embedded; all again, of which none is."""
    docs = docs_of(spark, sf_dir).select("doc_id", "lang", F.col("text").alias("content"))
    path, out = shared_dir(spark, "embeddings"), None
    for run, part in enumerate((docs.filter("lang = 'en'"), docs, docs), 1):
        found, n = store.EmbeddingStore(spark, path, "hash@1").embed(part)
        row = found.agg(F.lit(run).cast("long").alias("run"), F.lit(n).cast("long").alias("embedded"), F.count("embedding").alias("with_vector"))
        out = row if out is None else out.unionByName(row)
    return out
