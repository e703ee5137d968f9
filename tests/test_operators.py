"""Hand-computed cases of the operators."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions import vectors as V
from marlstone.operators import bm25, classify, fusion, graph, keyword, relations, textproc, vector
from marlstone.operators import documents as D
from marlstone.operators import messages as M
from marlstone.plans.catalogue import QUERIES
from marlstone.sources import store
from marlstone.streaming import index
from tests.conftest import DATA

SIX = [("0", "1", "related_to"), ("0", "3", "related_to"), ("1", "2", "references"), ("4", "0", "related_to"), ("5", "0", "references"), ("3", "2", "mentions")]


def edges(spark):
    return spark.createDataFrame(SIX, "src string, dst string, type string")


@pytest.mark.parametrize(
    ("low", "high", "direction", "want"),
    [(1, 2, "OUTBOUND", [("1", 1), ("2", 2), ("2", 2), ("3", 1)]), (1, 1, "INBOUND", [("4", 1), ("5", 1)]), (1, 1, "ANY", [("1", 1), ("3", 1), ("4", 1), ("5", 1)]), (0, 0, "ANY", [("0", 0)])],
)
def test_traversal(spark, low, high, direction, want):
    found = graph.graph_traverse(edges(spark), "0", min_depth=low, max_depth=high, direction=direction)
    assert sorted((r.vertex, r.depth) for r in found.collect()) == want


def test_traversal_checks(spark):
    with pytest.raises(ValueError):
        graph.directed(edges(spark), "SIDEWAYS")
    with pytest.raises(ValueError):
        graph.graph_traverse(edges(spark), "0", min_depth=2, max_depth=1)
    reach = graph.reachable(edges(spark), spark.createDataFrame([("0",)], "start string"), 2, "OUTBOUND")
    assert {(r.vertex, r.depth) for r in reach.collect()} == {("1", 1), ("3", 1), ("2", 2)}


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([("A", 2.0), ("B", 1.0)], "k string, score double")
    b = spark.createDataFrame([("B", 2.0), ("C", 1.0)], "k string, score double")
    out = {r.k: r.score for r in fusion.reciprocal_rank_fusion([a, b], [0.5, 0.5], "k").collect()}
    assert out == pytest.approx({"A": 0.5 / 61 + 0.5 / 63, "B": 0.5 / 62 + 0.5 / 61, "C": 0.5 / 63 + 0.5 / 62})
    swapped = {r.k: r.score for r in fusion.reciprocal_rank_fusion([b, a], [0.5, 0.5], "k").collect()}
    assert swapped == pytest.approx(out)


def test_bm25_by_hand(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, None)], "_key int, text string")
    index = bm25.build_index(docs, f"{tmp_path}/index")
    idf, average = math.log(1 + (3 - 1 + 0.5) / 1.5), 4 / 3
    want = {1: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / average))}
    for own in (None, index, bm25.open_index(spark, f"{tmp_path}/index")):
        assert {r._key: r.score for r in bm25.bm25_search(docs, "Red", index=own).collect()} == pytest.approx(want)
        assert bm25.bm25_search(docs, "Red", index=own, filter_expr="_key > 1").count() == 0
        assert bm25.bm25_search(docs, "green", index=own).count() == 0
        with pytest.raises(ValueError):
            bm25.bm25_search(docs, " ", index=own)
    assert {r.term: (r.n_docs, r.n_total) for r in bm25.term_stats(index).collect()} == {"red": (1, 2), "blue": (2, 2)}
    empty = bm25.build_index(docs.limit(0), f"{tmp_path}/empty")
    assert bm25.bm25_search(docs.limit(0), "red", index=empty).count() == 0


def test_index_of_stems_and_fields(spark, tmp_path):
    docs = spark.createDataFrame([(1, "running cats", "a"), (2, "a cat ran", "cats"), (3, "dogs", "run")], "_key int, text string, title string")
    index = bm25.build_index(docs, f"{tmp_path}/stems", ["text", "title"], analyzer="stems")
    assert {r._key for r in bm25.bm25_search(docs, "Cats", index=index).collect()} == {1, 2}
    assert {r._key for r in bm25.bm25_search(docs, "runs", index=index).collect()} == {1, 3}
    assert {r._key for r in bm25.bm25_search(docs, "cat", ["title"], index=index).collect()} == {2}


def test_a_search_reads_no_text(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = bm25.build_index(docs, f"{tmp_path}/index", key="doc_id")
    plan = bm25.scores(index, ["the", "hehely"])._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "documents.parquet" not in plan and "PushedFilters: [In(field" in plan.replace("field, [text]", "field") or "PushedFilters" in plan


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "k long, embedding array<float>")
    assert [r.k for r in vector.search(df, [1.0, 0.1], "k", top_n=2).collect()] == [1, 3]
    assert [r.k for r in vector.search(df, [0.0, 2.0], "k", metric="l2", top_n=1).collect()] == [2]
    pairs = {(r.a, r.b): round(r.score, 4) for r in vector.similar_pairs(df, 0.5, "k").collect()}
    assert pairs == {(1, 3): 0.7071, (2, 3): 0.7071}
    found = vector.batch_search(df, df.withColumnRenamed("k", "q"), "q", "k", top_n=1, skip_same=True)
    assert {(r.q, r.k) for r in found.collect() if r.q in (1, 2)} == {(1, 3), (2, 3)}
    assert {(r.k, r.n_links, r.class_id) for r in vector.similarity_classes(df, 0.5, "k").collect()} == {(1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 0, 4)}
    clamped = df.filter("k <= 4").select(V.cosine_clamped(F.col("embedding"), V.literal([-1.0, 0.0])).alias("c")).collect()
    assert [r.c for r in clamped] == [0.0, 0.0, 0.0, 0.0]


def test_batches_of_queries_in_blocks(spark, monkeypatch):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    base = base.unionByName(base.withColumn("vec_id", F.col("vec_id") + 10_000))  # every vector twice: ties
    queries = base.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("q"), "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in base.collect()}
    names, matrix = list(rows), np.array(list(rows.values()))
    for metric in ("cosine", "l2"):
        want = {}
        for q in names:
            if q % 7 == 0:
                score = matrix @ rows[q]
                best = sorted((-round(s, 12), k) for s, k in zip(score, names) if k != q)[:5]
                want[q] = [k for _, k in best]
        for block, tile in ((4096, 2048), (40, 64)):
            monkeypatch.setattr(vector, "QUERY_BLOCK", block)
            monkeypatch.setattr(vector, "SCORE_ROWS", tile)
            found = vector.batch_search(base, queries, "q", "vec_id", metric=metric, top_n=5, skip_same=True)
            got = {}
            for r in sorted(found.collect(), key=lambda r: (r.q, r.rank)):
                got.setdefault(r.q, []).append(r.vec_id)
            assert got == want if metric == "cosine" else got.keys() == want.keys()


def test_pairs_in_tiles(spark, monkeypatch):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = {(r.a, r.b) for r in vector.similar_pairs(base, 0.3, "vec_id").collect()}
    monkeypatch.setattr(vector, "TILE", 30)
    monkeypatch.setattr(vector, "JOIN_BLOCK", 170)
    assert {(r.a, r.b) for r in vector.similar_pairs(base, 0.3, "vec_id").collect()} == whole and whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (7, 7), (60, 60)]
    out = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(31)} | {40: 40, 45: 40, 50: 40}


def test_ivf_recall(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = base.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    exact = {(r.q, r.vec_id) for r in vector.batch_search(base, queries, "q", "vec_id", skip_same=True).collect()}
    near = {(r.q, r.vec_id) for r in vector.ivf_search(base, queries, "q", "vec_id", skip_same=True).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_tags(spark):
    docs = spark.createDataFrame([("a", ["Python", "tutorial"]), ("b", ["python"]), ("c", []), ("d", None)], "_key string, tags array<string>")
    out = {r._key: r.tag_match_score for r in D.tag_search(docs, ["python", "tutorial"]).collect()}
    assert out == {"a": 1.0, "b": 0.5}
    assert [r._key for r in docs.filter(D.tags_within(["python"])).collect()] == ["b", "c"]
    assert D.tag_search(docs, []).count() == 0 and [r.tag_match_score for r in D.tag_search(docs, [], require_all=True).collect()] == [0.0] * 4


def test_votes(spark):
    rows = [(1, 1, 0.9, 1), (1, 0, 0.8, 2), (1, 0, 0.7, 3), (2, 1, 0.5, 1), (2, 0, 0.5, 2), (3, 1, -1.0, 1)]
    df = spark.createDataFrame(rows, "q int, label int, score double, rank int")
    out = {r.q: (r.prediction, round(r.confidence, 4)) for r in classify.vote(df, "q").collect()}
    assert out == {1: (0, round((0.64 + 0.49) / (0.81 + 0.64 + 0.49), 4)), 2: (0, 0.5), 3: (0, 0.0)}
    assert {r.q: r.prediction for r in classify.majority(df, "q").collect()} == {1: 0, 2: 1, 3: 1}


def test_sequences(spark):
    steps = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "b")], "u int, t int, x string")
    out = {(r.src, r.dst): (round(r.strength, 6), r["count"]) for r in relations.sequence_edges(steps, "u", "x", [F.col("t")]).collect()}
    assert out == {("a", "b"): (0.7, 2), ("b", "a"): (0.6, 1)}
    old = spark.createDataFrame([("a", "b", 0.95, 3), ("x", "y", 0.5, 1)], "src string, dst string, strength double, count long")
    more = {(r.src, r.dst): (round(r.strength, 6), r["count"]) for r in relations.sequence_edges(steps, "u", "x", [F.col("t")], old).collect()}
    assert more == {("a", "b"): (1.0, 5), ("b", "a"): (0.6, 1), ("x", "y"): (0.5, 1)}


def test_messages_with_gaps(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y"), (2, 0, "user", "x"), (2, 5, "system", "z")], "conv_id int, turn int, role string, text string")
    msgs = M.messages(turns)
    assert {(r.src, r.dst) for r in M.next_edges(msgs).collect()} == {("1-0", "1-1"), ("2-0", "2-5")}
    left, links = M.delete_conversation(msgs, M.next_edges(msgs), 2)
    assert (left.count(), links.count()) == (2, 1)


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_ratio(a, b):
    def subsequence(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y, 1):
                row[j], last = (last + 1 if c == d else max(row[j], row[j - 1])), row[j]
        return row[-1]

    want = 100.0 if not a and not b else 200 * subsequence(a, b) / (len(a) + len(b))
    assert X.ratio(a, b) == pytest.approx(want)
    assert X.ratio(a, a) == 100.0


@given(st.lists(st.text("ab ", min_size=1, max_size=9), max_size=12), st.integers(1, 4))
def test_chunks_hold_all_sentences(sentences, size):
    chunks = textproc.chunk_sentences(sentences, size, 0)
    assert [s for c in chunks for s in c] == sentences


@given(st.lists(st.integers(0, 9), max_size=25), st.integers(1, 8), st.integers(0, 3))
def test_chunk_bounds(costs, size, overlap):
    bounds = textproc.chunk_bounds(costs, size, overlap)
    done = 0
    for i, (a, b) in enumerate(bounds):
        assert a <= done < b or (not i and a == 0)  # something new, without a gap
        fits = sum(costs[a:b]) <= size
        assert fits or b - max(a, done) == 1  # beyond the size by its one new member alone
        assert costs[b - 1] <= size or (a, b) == (done, done + 1)
        if i and a < done:
            assert a >= max(bounds[i - 1][0], done - overlap)
        if b < len(costs) and costs[b] <= size and fits:
            assert sum(costs[a : b + 1]) > size or costs[b - 1] > size  # as long as possible
        done = b
    assert done == len(costs)


def test_chunk_overlap_by_hand():
    cost = len
    assert textproc.chunk_sentences(["aa", "bb", "cccccc", "dd", "ee", "ff"], 4, 1, cost) == [["aa", "bb"], ["cccccc"], ["dd", "ee"], ["ee", "ff"]]


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "adjustment": "adjust", "probate": "probat", "controll": "control"}
    assert {w: X.porter_stem(w) for w in words} == words


def test_glossary_longest_first(spark):
    docs = spark.createDataFrame([(1, "A primary color is a Color."), (2, None)], "_key int, text string")
    found = keyword.find_terms(docs, ["color", "primary color"]).collect()
    assert {(r.term, r.start) for r in found} == {("primary color", 2), ("color", 21)}


def test_json(spark):
    assert textproc.repair_json('x {"a": 1,} y') == '{"a": 1}'
    assert textproc.repair_json("[1, {'b': 2}] and more") == '[1, {"b": 2}]'
    assert textproc.repair_json('[not json] {"a": "x,]"}') == '{"a": "x,]"}'
    assert textproc.repair_json("none") is None and textproc.repair_json(None) is None
    assert textproc.json_to_markdown({"a": {"b": 1}}) == "- **a**:\n  - **b**: 1"


def test_truncation(spark):
    df = spark.createDataFrame([("a" * 60 + "b" * 60,), ("short",), (None,)], "t string")
    assert [r[0] for r in df.select(X.truncated("t", 10)).collect()] == ["aaaaa...bbbbb", "short", None]
    image = "data:image/png;base64," + "A" * 30
    rows = spark.createDataFrame([(image, list(range(12)), {"k": "v" * 20}, ("x" * 20, 5), 7)], "s string, l array<int>, m map<string,string>, t struct<a:string,b:int>, n int")
    safe = X.log_safe(rows, 4).first()
    assert (safe.s, safe.l, safe.m, tuple(safe.t), safe.n) == ("data:image/png;base64,AA...AA", ["[<12 int elements>]"], {"k": "vv...vv"}, ("xx...xx", 5), 7)


def test_collection(spark, tmp_path):
    c = store.Collection(spark, f"file://{tmp_path}/c")
    c.create(spark.createDataFrame([("a", 1), (None, 2)], "_key string, x int"))
    c.update(spark.createDataFrame([("a", 5), ("zz", 9)], "_key string, x int"))
    assert c.get("a").first()["x"] == 5 and c.read().count() == 2
    c.upsert(spark.createDataFrame([("b", 7)], "_key string, x int"))
    c.delete(spark.createDataFrame([("a",), ("not there",)], "_key string"))
    assert sorted(r.x for r in c.read().collect()) == [2, 7]
    c.update(spark.createDataFrame([("b", None)], "_key string, x int"))
    assert c.get("b").first()["x"] == 7
    c.update(spark.createDataFrame([("b", None)], "_key string, x int"), keep_nulls=True)
    assert c.get("b").first()["x"] is None
    c.upsert(spark.createDataFrame([("d", 1), ("d", 2)], "_key string, x int"))
    assert c.get("d").count() == 1
    c.truncate()
    assert c.read().count() == 0 and len(c.versions()) == 8


def test_documents_are_embedded(spark, tmp_path):
    c = store.Collection(spark, f"file://{tmp_path}/e")
    c.create(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", " "), ("d", None)], "_key string, content string"), embed=X.hash_embedding)
    rows = {r._key: r.embedding for r in c.read().collect()}
    assert rows["a"] == rows["b"] and len(rows["a"]) == 64 and rows["c"] is None and rows["d"] is None
    c.update(spark.createDataFrame([("a", "y"), ("b", None)], "_key string, content string"), embed=X.hash_embedding)
    after = {r._key: r.embedding for r in c.read().collect()}
    assert after["a"] != rows["a"] and after["b"] == rows["b"]


def test_texts_do_not_share_vectors(spark):
    texts = ["86786", "88266"]  # the last 32 bits of their digests are equal
    a, b = (r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.hash_embedding("t")).collect())
    assert a != b


def test_edges_and_samples(spark):
    both = store.sample_collections(spark)
    edges = both["edges"]
    assert both["documents"].count() == 5 and edges.count() == 3
    again = store.create_edges(edges, edges.drop("_key").withColumn("weight", F.lit(0.1)).limit(1))
    assert again.count() == 3 and again.filter("weight = 0.1").count() == 1
    assert store.delete_edges(again, again.filter("type = 'references'")).count() == 2
    assert D.sample(both["documents"], 2).collect() == D.sample(both["documents"].repartition(3), 2).collect()
    assert [r._key for r in D.first_documents(both["documents"], 2).collect()] == ["d1", "d2"]
    assert {r.other for r in graph.edge_lookup(edges, "d4").collect()} == {"d3", "d2"}
    assert [r.dst for r in graph.edge_lookup(edges, "d4", "OUTBOUND").collect()] == ["d2"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_bytes(b"\xef\xbb\xbf" + b'{"_key": "k", "content": "c"}')
    (tmp_path / "a/y.md").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "a/z.txt").write_text("long " * 1000)
    assert [tuple(r) for r in store.json_documents(spark, f"{tmp_path}/a/x.json", "_key string, content string").collect()] == [("k", "c")]
    assert [r.content for r in store.text_files(spark, f"{tmp_path}/a", ["md"]).collect()] == ["hello"]
    assert store.text_files(spark, f"{tmp_path}/a", ["md", "txt"]).count() == 2
    assert store.text_files(spark, f"{tmp_path}/a", ["md", "txt"], most_bytes=100).count() == 1
    files = spark.createDataFrame([("b.py", "x" * 8), ("a.md", None)], "path string, content string")
    textproc.write_digest(files, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/TREE").collect()] == ["a.md", "b.py"]
    assert spark.read.text(f"{tmp_path}/out/SUMMARY").first()[0] == "files: 2, characters: 8, estimated tokens: 2"
    assert "File: a.md" in spark.read.text(f"{tmp_path}/out/DIGEST", wholetext=True).first()[0]


def test_hybrid_options(spark):
    assert fusion.search_options(" q ", 0, -1) == ("q", 5, 20) and fusion.search_options(None, 3, 4) == ("", 3, 4)
    assert fusion.least_scores(0.3) == {"bm25": 0.3, "semantic": 0.3, "graph": 0.3} and fusion.least_scores({"graph": 0.0})["semantic"] == 0.7
    assert fusion.leg_weights({"bm25": 1, "semantic": 3}, ["bm25", "semantic"]) == [0.25, 0.75]
    with pytest.raises(ValueError):
        fusion.leg_weights({"other": 1.0}, ["bm25"])
    with pytest.raises(ValueError):
        fusion.unified({"a": lambda: None}, "k", exclude=["a"])
    lists = {n: (lambda n=n: spark.createDataFrame([(f"{n}{i}", float(i)) for i in range(5)], "k string, score double")) for n in "abc"}
    out = fusion.unified(lists, "k", 3, include=["a", "b"], exclude=["b"]).collect()
    assert [(r.collection, r.k, r.total) for r in out] == [("a", "a4", 5), ("a", "a3", 5), ("a", "a2", 5)]


def test_summaries_and_sections(spark):
    df = spark.createDataFrame([(0.9, "a b c d e f g h i j", "a b c d e")], "s double, o string, t string")
    check = lambda **o: df.select(textproc.summary_check(F.col("s"), F.col("o"), F.col("t"), **o)).first()[0]
    assert check(expected=0.5, concepts=["B"]) and not check(expected=0.95, concepts=[]) and not check(expected=0.5, concepts=["z"]) and not check(expected=0.5, concepts=[], least=0.95)
    nodes = spark.createDataFrame([(0, "text", "x", None, None), (1, "table", None, "1,2", None), (2, "image", None, None, "d"), (3, "other", "y", None, None)], "at int, type string, line_text string, table_data string, description string")
    assert [(r.at, r.content) for r in textproc.flatten_nodes(nodes).orderBy("at").collect()] == [(0, "x"), (1, "Table:\n1,2"), (2, "Image: d")]


def test_balanced_over_ranges(spark):
    rows = [(i, i % 7 != 0) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, y boolean").unionByName(spark.createDataFrame([(999, None)], "k long, y boolean"))
    out = [(r.k, r.y) for r in classify.balanced(df, "y", F.col("k")).collect()]
    fewest = sum(not y for _, y in rows)
    assert sorted(out) == sorted([x for x in rows if not x[1]] + [x for x in rows if x[1]][:fewest])
    assert classify.balanced(df.filter("y"), "y", F.col("k")).count() == 0


def test_partial_ratio_of_several_terms(spark):
    docs = spark.createDataFrame([(1, "red green"), (2, "red"), (3, "none")], "_key int, text string")
    rank = lambda **o: {r._key: r.score for r in keyword.partial_ratio_rank(docs, ["red", "green"], "text", threshold=90.0, **o).collect()}
    assert rank() == {1: 200.0, 2: 100.0} and rank(require_all=True) == {1: 200.0}


def test_majority_without_neighbours(spark):
    near = spark.createDataFrame([(1, 1, 0.5, 1)], "q int, label int, score double, rank int")
    out = classify.majority(near, "q", queries=spark.createDataFrame([(1,), (2,)], "q int")).select("q", classify.label_name(F.col("prediction")).alias("p")).collect()
    assert {(r.q, r.p) for r in out} == {(1, "Complex"), (2, "Unknown")}


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, "b")], "id int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, text string").parquet(f"{tmp_path}/in")
    index.maintain_terms(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {(r.term, r.n_docs, r.n_total) for r in index.term_totals(spark, f"{tmp_path}/out").collect()} == {("a", 1, 2), ("b", 2, 2)}
    rows = [("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:20:00", "x", 2.0), ("2024-01-01 02:00:00", "x", 4.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").write.parquet(f"{tmp_path}/ev")
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/ev")
    q = index.event_counts(events).writeStream.format("memory").queryName("ev").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("ev").collect()) == [(1, 4.0), (2, 3.0)]


def longest_common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def best_part(a, b):
    short, long = sorted((a, b), key=len)
    return max((100 * longest_common(short, long[i : i + len(short)]) / len(short) for i in range(len(long) - len(short) + 1)), default=0.0) if short else 0.0 if long else 100.0


@given(st.text("abé😀", max_size=7), st.text("abé😀", max_size=30), st.sampled_from([1, 3, 1 << 18]))
def test_partial_ratio(a, b, windows):
    kept, X.WINDOWS = X.WINDOWS, windows
    try:
        assert X.partial_ratio(a, b) == pytest.approx(best_part(a, b))
        assert X.partial_ratio(a * 12, b * 4) == pytest.approx(best_part(a * 12, b * 4))
    finally:
        X.WINDOWS = kept


def test_partial_ratio_rank_rates_whole_texts(spark, tmp_path):
    texts = ["A first sentence. Then hehely.", "Nothing here! " * 40 + "a HEHELY b", "One. Two. heXhely", "zzz. zzz.", "hehely first.", "heh", "", None, "Éa. " * 9 + "hxehly"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.score for r in QUERIES["partial_ratio_rank"](spark, str(tmp_path)).collect()}
    want = {i: best_part("hehely", t.lower()) for i, t in enumerate(texts) if t is not None}
    assert found == pytest.approx({i: s for i, s in want.items() if s >= 60}) and found[0] == found[1] == found[4] == 100


def test_similarity_classes_lose_no_link(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((700, 12)).astype("float32")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.4
    np.fill_diagonal(linked, False)
    names = np.arange(700)
    for _ in range(700):
        after = np.minimum(names, np.where(linked, names[None, :], 700).min(axis=1))
        if np.array_equal(after, names):
            break
        names = after
    found = {r.vec_id: (r.n_links, r.class_id) for r in QUERIES["lsh_pairs"](spark, str(tmp_path)).collect()}
    assert found == {i: (int(linked[i].sum()), int(names[i])) for i in range(700)}


def test_split_has_exact_shares_of_each_label(spark):
    rows = [(i, i % 3 if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(5)
    from collections import Counter

    found = {r.id: r.part for r in classify.stratified_split(df, "label", "id").collect()}
    assert len(found) == 500
    for label in (0, 1, 2, None):
        own = [i for i, y in rows if y == label]
        order = sorted(own, key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
        want = {i: "train" if 10 * at <= 8 * len(own) else "validation" if 10 * at <= 9 * len(own) else "test" for at, i in enumerate(order, 1)}
        assert {i: found[i] for i in own} == want and abs(Counter(want.values())["test"] - len(own) / 10) <= 1
    # Any subset of ids has these shares, and another seed another order.
    few = spark.createDataFrame([(50 * i, 1) for i in range(20)], "id long, label int")
    assert Counter(r.part for r in classify.stratified_split(few, "label", "id").collect()) == {"train": 16, "validation": 2, "test": 2}
    assert {r.id: r.part for r in classify.stratified_split(df, "label", "id", seed=7).collect()} != found
    assert classify.stratified_split(df.limit(0), "label", "id").collect() == []


@pytest.mark.parametrize("name", ["logreg_baseline", "neighbour_logreg"])
def test_regressions_are_those_of_a_plain_fit(spark, name):
    """Newton's method on the same parts, in numpy, gives the same predictions."""
    from marlstone.plans.catalogue import QUERIES

    out = {r[0]: (r.y, r.prediction) for r in QUERIES[name](spark, f"{DATA}/sf0.001").collect()}
    rows = {r.vec_id: (np.array(r.embedding, float), r.label % 2) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()}
    if name == "neighbour_logreg":
        unit = {i: v / np.linalg.norm(v) for i, (v, _) in rows.items()}
        near = lambda q: sorted((i for i in rows if i != q), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:5]
        rows = {q: (np.mean([rows[i][0] for i in near(q)], axis=0), y) for q, (_, y) in rows.items() if q % 50 == 0}
    test = set()
    for y in (0, 1):
        own = sorted((i for i, r in rows.items() if r[1] == y), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
        test |= {i for at, i in enumerate(own, 1) if 10 * at > 9 * len(own)}
    assert set(out) == test and len(out) > 0 and all(out[i][0] == rows[i][1] for i in out)
    if len(rows) > 200:  # else the classes can be told apart in full, and the fit has no end
        x = np.array([np.append(r[0], 1) for i, r in rows.items() if i not in test])
        y, w = np.array([r[1] for i, r in rows.items() if i not in test]), np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-10 * np.eye(len(w)), x.T @ (y - p))
        margin = {i: float(np.append(rows[i][0], 1) @ w) for i in test}
        assert all(out[i][1] == (margin[i] > 0) for i in test if abs(margin[i]) > 1e-2)


@pytest.mark.parametrize("most", [3, 100, keyword.MOST_TERMS])
def test_glossary_of_a_table(spark, most):
    """The matches are those of one pattern of all terms, longest first, whatever the parts."""
    import random
    import re

    rng = random.Random(8)
    letters = ["a", "b", "ab", "é", " ", "-", "_", "İ", "ß", "A"]
    terms = ["a b", "ab", "a", "a-b", "é", "b é", "aa", "a b a", "ß", "not there", "AB B", "a"]
    texts = [(i, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(80)] + [(90, None), (91, ""), (None, "ab ab"), (92, "ab ab"), (92, "ab ab")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = keyword.find_glossary(docs, spark.createDataFrame([(t,) for t in [*terms, "", None]], "term string"), key="doc_id", most=most)
    ordered = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    pattern = re.compile(rf"(?<!{X.WORD})(?:{'|'.join(map(re.escape, ordered))})(?!{X.WORD})")
    want = [(i, m[0], m.start(), m.end()) for i, t in texts for m in pattern.finditer(keyword._folded(t or ""))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert keyword.find_glossary(docs, spark.createDataFrame([], "term string"), key="doc_id").collect() == []


def test_glossary_of_many_terms(spark):
    terms = spark.range(100_000).selectExpr("concat('term', id, ' of') as term")
    docs = spark.createDataFrame([(1, "term99 of term100000 of Term5 of xterm7 of")], "doc_id long, text string")
    assert [r.term for r in keyword.find_glossary(docs, terms, key="doc_id").orderBy("start").collect()] == ["term99 of", "term5 of"]


def test_embedding_store_embeds_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def embed(text):
        @F.pandas_udf("array<float>")
        def count(texts):
            seen.add(len(texts))
            return texts.map(lambda t: [float(len(t)), 1.0])

        return count(text)

    kept = store.EmbeddingStore(spark, str(tmp_path), "m@1")
    first = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, ""), (4, None), (5, "c"), (None, " ")], "id long, content string")
    found, n = kept.embed(first, embed)
    assert n == 2 and seen.value == 2
    rows = [(1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, None), (5, [1.0, 1.0]), (None, None)]
    assert sorted(((r.id, r.embedding) for r in found.collect()), key=repr) == sorted(rows, key=repr)
    more = spark.createDataFrame([(1, "ab", None), (6, "new", None), (7, "", [5.0])], "id long, content string, embedding array<float>")
    found, n = store.EmbeddingStore(spark, str(tmp_path), "m@1").embed(more, embed)
    assert n == 1 and seen.value == 3 and {r.id: r.embedding for r in found.collect()} == {1: [2.0, 1.0], 6: [3.0, 1.0], 7: [5.0]}
    assert kept.embed(more, embed)[1] == 0 and kept.embed(first.limit(0), embed)[0].collect() == []
    # Another version has vectors of its own; a run that never ended is not read.
    assert store.EmbeddingStore(spark, str(tmp_path), "m@2").embed(first, embed)[1] == 2
    (tmp_path / "version=m@1" / ".staged").mkdir()
    assert kept.read().count() == 3


def test_matrix_of_odd_rows():
    column = pa.array([[1.0, 2.0], None, [3.0], [], [0.0, 0.0], [5.0, 12.0]], pa.list_(pa.float32()))
    assert vector._matrix(column, False).tolist() == [[1, 2], [0, 0], [0, 0], [0, 0], [0, 0], [5, 12]]
    assert np.allclose(vector._matrix(column.slice(4), True), [[0, 0], [5 / 13, 12 / 13]])
    assert vector._matrix(pa.array([None, []], pa.list_(pa.float32())), True).shape == (2, 0)


def test_quantised_search_finds_the_neighbours(spark):
    from marlstone.operators import quantised

    out = QUERIES["quantised_topk"](spark, f"{DATA}/sf0.1").collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").collect()}
    ids, unit = list(rows), np.array([v / np.linalg.norm(v) for v in rows.values()])
    found = {(r.query_id, r.vec_id): r for r in out}
    hits = total = 0
    for i, q in enumerate(ids):
        if q % 50 == 0:
            near = unit @ unit[i]
            near[i] = -2
            best = [ids[j] for j in np.argsort(-near)[:10]]
            hits, total = hits + sum((q, x) in found for x in best), total + 10
            assert all(abs(r.score - near[ids.index(k)]) < 1e-5 for (p, k), r in found.items() if p == q)
    assert len(out) == total and hits / total >= 0.9 and all(abs(r.recall - hits / total) < 0.01 for r in out)
    # Nulls, zero vectors, repeated ids and few rows.
    odd = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None)], "id long, embedding array<float>")
    quantiser = quantised.fit(odd, "id", parts=2)
    codes = quantised.coded(odd, quantiser, "id")
    assert sorted(r.key for r in codes.collect()) == [1, 2, 2, 3]
    got = quantised.search(odd, codes, quantiser, odd.filter("id in (1, 4)").withColumnRenamed("id", "q"), "q", "id", skip_same=True, top_n=2).orderBy("rank").collect()
    assert [(r.q, r.id) for r in got][:1] == [(1, 2)]
    assert quantised.search(odd, codes, quantiser, odd.limit(0).withColumnRenamed("id", "q"), "q", "id").collect() == []


def test_fuzzy_words_by_the_index_and_by_the_texts(spark, tmp_path):
    """The same scores with and without an index, and as every word's ratio has them; the bound never lies below a ratio."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(900, None)]
    docs = spark.createDataFrame(rows, "_key long, text string")
    index = bm25.build_index(docs, f"{tmp_path}/index")
    for term, threshold in (("abcab", 70.0), ("Éab", 60.0), ("a", 100.0), ("xyz", 50.0)):
        want = {k: best / 100 for k, t in rows if t and (best := max((X.ratio(w, term.lower()) for w in t.split()), default=0)) >= threshold}
        for held in (None, index):
            assert {r[0]: round(r.score, 9) for r in keyword.fuzzy_keyword(docs, term, threshold, index=held).collect()} == {k: round(v, 9) for k, v in want.items()}
        bounds = spark.createDataFrame([(word(),) for _ in range(100)], "w string").distinct().select("w", keyword.letters_bound(F.col("w"), term.lower()).alias("b")).collect()
        assert all(r.b >= X.ratio(r.w, term.lower()) - 1e-9 for r in bounds)


def test_a_task_scores_few_queries_at_a_time(spark, monkeypatch):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").coalesce(1)
    queries = base.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("q"), "embedding")
    want = sorted(vector.batch_search(base, queries, "q", "vec_id", top_n=4, skip_same=True).select("q", "vec_id", "rank").collect())
    monkeypatch.setattr(vector, "QUERY_PART", 7)
    monkeypatch.setattr(vector, "SCORE_ROWS", 50)
    plain = vector._Best.add

    def few(self, value, *rest):
        assert value.shape[0] <= 7 and value.shape[1] <= 50
        plain(self, value, *rest)

    monkeypatch.setattr(vector._Best, "add", few)
    # The operator's own function over the table's batches, where the patch holds.
    ran = []
    monkeypatch.setattr(vector, "_by_query_blocks", lambda q, name, v, scanned: scanned(type("Held", (), {"value": (np.array([r.q for r in q.collect()]), np.array([r.embedding for r in q.collect()], float))})))
    monkeypatch.setattr(type(base), "mapInArrow", lambda self, run, schema: ran.append(pa.Table.from_batches(list(run(self.toArrow().combine_chunks().to_batches())))) or spark.createDataFrame(ran[-1]))
    got = sorted(vector.batch_search(base, queries, "q", "vec_id", top_n=4, skip_same=True).select("q", "vec_id", "rank").collect())
    assert got == want and ran


def test_ivf_scores_by_matrices(spark, monkeypatch):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = base.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    monkeypatch.setattr(vector, "SCORE_ROWS", 9)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 5)
    # All lists probed, the search is exact; rows are scored by lists and not as joined pairs.
    found = vector.ivf_search(base, queries, "q", "vec_id", lists=8, probes=1.0, top_n=6, skip_same=True)
    assert "Join" not in found._jdf.queryExecution().toString()
    exact = vector.batch_search(base, queries, "q", "vec_id", top_n=6, skip_same=True)
    rows = [sorted((r.q, r["rank"], r.vec_id, round(r.score, 9)) for r in x.collect()) for x in (found, exact)]
    assert rows[0] == rows[1] and rows[0]
    few = vector.ivf_search(base, queries, "q", "vec_id", lists=8, probes=2, top_n=500, skip_same=True)
    assert 0 < few.count() < base.count() * queries.count()


def test_chunks_come_in_short_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([("a", "One two three. Four five six? Seven! Eight nine."), ("b", None), ("c", ""), ("d", "Alone.")], "_key string, text string")
    made = textproc.chunks(docs, 5, 1)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    got = sorted((r._key, r.chunk_index, r.chunk, r.n_sentences) for r in made.collect())
    want = []
    for r in docs.select("_key", X.sentences("text").alias("s")).collect():
        want += [(r._key, i, " ".join(c), len(c)) for i, c in enumerate(textproc.chunk_sentences(r.s or [], 5, 1))]
    assert got == sorted(want) and got
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_pairs_list_few_pairs_of_a_task(spark, monkeypatch):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    copies = base.unionByName(base.filter("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 100_000))
    monkeypatch.setattr(vector, "TILE", 30)
    monkeypatch.setattr(vector, "JOIN_BLOCK", 70)
    want = {}
    for r in vector.similar_pairs(copies, 0.1, "vec_id").collect():
        for a, b in ((r.a, r.b), (r.b, r.a)):
            want.setdefault(a, []).append((-round(r.score, 12), b))
    want = {(a, b, i + 1) for a, found in want.items() for i, (_, b) in enumerate(sorted(found)[:3])}
    made = vector.nearest_pairs(copies, 0.1, "vec_id", 3)
    assert {(r.a, r.b, r["rank"]) for r in made.collect()} == want and want
