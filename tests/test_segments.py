"""A text index in segments against a full rebuild, and phrases against brute force."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import bm25, segments
from marlstone.plans import registry

WORDS = ["red", "green", "blue", "one", "two", "Über", "x_1", "the"]
SCHEMA = "_key string, text string, title string"


def rows_of(rng, keys):
    return [(k, rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))]), rng.choice(WORDS)) for k in keys]


def same_as_rebuilt(spark, index, rows, folder):
    """Statistics and scores are those of an index that is built at once."""
    pinned, want = index.pinned(), bm25.build_index(spark.createDataFrame(rows, SCHEMA), folder, ["text", "title"])
    assert pinned.sizes == want.sizes
    stats = lambda i: sorted(tuple(r) for r in i.terms.select("field", "term", "n_docs", "n_total").collect())
    assert stats(pinned) == stats(want)
    scores = lambda i: {r.key: round(r.score, 9) for r in bm25.scores(i, ["red", "the", "über", "none"]).collect()}
    assert scores(pinned) == scores(want)


def files(folder):
    return {f"{at}/{n}": os.stat(f"{at}/{n}").st_mtime_ns for at, _, names in os.walk(folder) for n in names}


def test_commits_are_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index", ["text", "title"])
    held = {r[0]: r for r in rows_of(rng, map(str, range(30)))}
    assert index.apply(spark.createDataFrame(list(held.values()), SCHEMA), batch="a")
    before = index.pinned()
    first = {r.key: r.score for r in bm25.scores(before, ["red"]).collect()}
    for i in range(3):
        changed = rows_of(rng, map(str, rng.sample(range(40), 8)))
        gone = rng.sample(sorted(set(held) - {r[0] for r in changed}), 4) + ["absent"]
        assert index.apply(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(k,) for k in gone], "_key string"), batch=f"b{i}")
        held |= {r[0]: r for r in changed}
        held = {k: r for k, r in held.items() if k not in gone}
        same_as_rebuilt(spark, index, list(held.values()), f"{tmp_path}/built{i}")
        # The batch again, and as another index object: nothing changes.
        assert not segments.SegmentedIndex(spark, f"{tmp_path}/index").apply(spark.createDataFrame(changed, SCHEMA), batch=f"b{i}")
    assert {r.key: r.score for r in bm25.scores(before, ["red"]).collect()} == first
    largest = max(index.manifest()["segments"], key=lambda x: x[1])[0]
    kept = files(f"{tmp_path}/index/segments/{largest}")
    index.merge(3)
    same_as_rebuilt(spark, index, list(held.values()), f"{tmp_path}/merged")
    assert len(index.manifest()["segments"]) == 2 and files(f"{tmp_path}/index/segments/{largest}") == kept
    index.apply(deleted=spark.createDataFrame([(k,) for k in held], "_key string"))
    assert index.pinned().terms.isEmpty() and bm25.scores(index.pinned(), ["red"]).isEmpty()


def test_many_commits_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 2)
    monkeypatch.setattr(segments, "MERGED", 2)
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index", ["text", "title"])
    rows = [(str(i), f"red the {i}", "one") for i in range(4)]
    for r in rows:
        index.apply(spark.createDataFrame([r], SCHEMA))
    assert len(index.manifest()["segments"]) == 2
    same_as_rebuilt(spark, index, rows, f"{tmp_path}/built")


def test_odd_rows(spark, tmp_path):
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index", ["text", "title"])
    index.apply(spark.createDataFrame([], SCHEMA))
    assert index.pinned().sizes == {"text": (0, 0), "title": (0, 0)} and index.pinned().postings.isEmpty()
    index.apply(spark.createDataFrame([("1", "red", "a"), ("1", "red", "a"), ("2", "the " * 50_000, None)], SCHEMA))
    same_as_rebuilt(spark, index, [("1", "red", "a"), ("2", "the " * 50_000, None)], f"{tmp_path}/built")
    with pytest.raises(Exception, match="null key"):
        index.apply(spark.createDataFrame([(None, "red", "a")], SCHEMA))
    assert index.manifest()["version"] == 2


def test_a_lost_race_is_an_error(spark, tmp_path):
    a, b = (segments.SegmentedIndex(spark, f"{tmp_path}/index", ["text", "title"]) for _ in range(2))
    a.apply(spark.createDataFrame([("1", "red", "a")], SCHEMA))
    stale = a.manifest()
    b.apply(spark.createDataFrame([("2", "red", "a")], SCHEMA))
    with pytest.raises(RuntimeError):
        a._publish(stale)
    a.apply(spark.createDataFrame([("3", "red", "a")], SCHEMA))
    same_as_rebuilt(spark, a, [(k, "red", "a") for k in "123"], f"{tmp_path}/built")


def test_refresh_takes_what_differs(spark, tmp_path):
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index", ["text", "title"])
    rows = [(str(i), f"red {i}", "one") for i in range(6)]
    assert index.refresh(spark.createDataFrame(rows, SCHEMA)) == 6
    assert index.refresh(spark.createDataFrame(rows, SCHEMA)) == 0
    rows = [*rows[1:5], ("5", "blue", "one"), ("9", None, "red")]
    assert index.refresh(spark.createDataFrame(rows, SCHEMA)) == 3
    same_as_rebuilt(spark, index, rows, f"{tmp_path}/built")


def test_a_stream_is_followed_over_restarts(spark, tmp_path):
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index", ["text", "title"])
    kind = f"{SCHEMA}, gone boolean"
    batches = [[("1", "red the", "a", False), ("2", "the", "b", None)], [("1", "blue", "a", False), ("2", None, None, True), ("3", "red", "c", False)]]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        index.follow(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint", "gone").awaitTermination()
    same_as_rebuilt(spark, index, [("1", "blue", "a"), ("3", "red", "c")], f"{tmp_path}/built")
    assert len(index.manifest()["batches"]) == 2


def test_searches_follow_the_table(spark, tmp_path):
    """A registered search sees what was written to its table since the last one."""
    for texts in (["hehely one"], ["the hehely", "hehely"], ["none"]):
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        found = bm25.scores(registry.doc_index(spark, str(tmp_path)), ["hehely"])
        assert found.count() == sum("hehely" in t for t in texts)


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_phrases_are_those_of_the_texts(spark, tmp_path, slop):
    rng = random.Random(slop)
    rows = [(str(i), " ".join(rng.choices(["a", "b", "c"], k=rng.randint(0, 12))), None) for i in range(60)]
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index")
    index.apply(spark.createDataFrame(rows, SCHEMA))

    def by_hand(words, terms):
        n = 0
        for p in [i for i, w in enumerate(words) if w == terms[0]]:
            at = p
            for t in terms[1:]:
                if slop:
                    at = next((i for i in range(at + 1, len(words)) if words[i] == t), 10**9)
                else:
                    at = at + 1 if words[at + 1 : at + 2] == [t] else 10**9
            n += at - p - (len(terms) - 1) <= slop
        return n

    for terms in (["a"], ["a", "b"], ["a", "a"], ["a", "b", "a", "c"], ["z", "a"]):
        want = {k: n for k, t, _ in rows if (n := by_hand(t.split(), terms))}
        assert {r.key: r.n for r in segments.phrase_search(index.pinned(), terms, slop=slop).collect()} == want


def test_bounds_lose_no_hit(spark, tmp_path):
    """Searches by bounds give the rows of scoring everything, ties included, and read less where a term is rare."""
    rng = random.Random(5)
    rows = [(f"{i:03}", " ".join(rng.choices(["the", "of", "red", "rare"], [60, 30, 9, 0.4], k=rng.randint(1, 40))), None) for i in range(400)]
    rows += [(f"x{i}", "rare the", None) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index")
    index.apply(docs)
    index.apply(deleted=spark.createDataFrame([(f"{i:03}",) for i in range(0, 400, 7)], "_key string"))
    pinned = index.pinned()
    live = docs.filter(~docs._key.isin([f"{i:03}" for i in range(0, 400, 7)]))
    pruned = 0
    for terms in (["the"], ["rare", "the"], ["rare", "the", "of"], ["red", "the", "none"], ["none"]):
        for k in (1, 5, 20, 1000):
            got = bm25.bm25_search(live, " ".join(terms), top_n=k, index=pinned).collect()
            want = live.join(bm25.scores(pinned, terms).withColumnRenamed("key", "_key"), "_key").orderBy(F.desc("score"), "_key").limit(k).collect()
            assert [(r._key, r.score) for r in got] == [(r._key, r.score) for r in want]
            reach = bm25.candidates(pinned, terms, k)[1]
            assert reach.scored <= reach.postings
            pruned += reach.pruned and reach.scored < reach.postings / 3
    assert pruned >= 3


def test_texts_are_analysed_in_short_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(1, "Cats cat hopping ponies"), (2, None), (3, "")], "k long, text string")
    found = segments.analysed(docs, ["text"], "k", "stems")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert {r.key: {t.term: list(t.places) for t in r.terms} for r in found.collect()} == {1: {"cat": [0, 1], "hop": [2], "poni": [3]}, 2: {}, 3: {}}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def best_by_hand(docs, queries, n):
    """query, key, score (9 digits), rank; of documents and queries as words."""
    docs = {k: text.lower().split() for k, text in docs.items()}
    average = sum(map(len, docs.values())) / len(docs)
    found = {}
    for q, terms in queries.items():
        for k, words in docs.items():
            for term in set(terms.lower().split()) & set(words):
                df, f = sum(term in w for w in docs.values()), words.count(term)
                part = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / average))
                found[q, k] = found.get((q, k), 0.0) + part
    out = []
    for q in queries:
        best = sorted((-round(s, 9), k) for (p, k), s in found.items() if p == q)[:n]
        out += [(q, k, -s, i + 1) for i, (s, k) in enumerate(best)]
    return sorted(out)


def test_best_of_a_batch(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    words = [w.lower() for w in WORDS] + [f"w{i}" for i in range(40)]
    docs = {f"k{i:03}": " ".join(rng.choices(words, k=rng.randint(0, 25))) for i in range(300)}
    docs |= {f"c{i:03}": "red w1 w2 the" for i in range(60)}  # copies tie, and the key decides
    queries = {i: " ".join(rng.choices(words, k=rng.randint(1, 12))) for i in range(30)} | {30: "red w1 w2 the", 31: "absent", 32: ""}
    frame = lambda held: spark.createDataFrame([(k, t) for k, t in held.items()], "_key string, text string")
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index")
    # One that has been in two segments, with revised and deleted documents.
    index.apply(frame(docs | {"k001": "red", "gone": "red w1"}))
    index.apply(frame({"k001": docs["k001"]}), spark.createDataFrame([("gone",)], "_key string"))
    asked = spark.createDataFrame([*queries.items(), (30, "the red")], "id long, text string")  # a row of an id again adds nothing
    want = best_by_hand(docs, queries, 4)
    assert [r[1] for r in want if r[0] == 30] == ["c000", "c001", "c002", "c003"]
    alone = segments.SegmentedIndex(spark, f"{tmp_path}/alone")
    alone.apply(frame(docs))
    kinds = {"segments": index.pinned(), "one": alone.pinned(), "built": bm25.build_index(frame(docs), f"{tmp_path}/built"), "texts": None}
    for held in kinds.values():
        for most in (100_000, 40):  # in one block, and in several
            monkeypatch.setattr(bm25, "BROADCAST_TERMS", most)
            own = held or bm25.for_batch(frame(docs), asked, "text")
            got = bm25.bm25_batch(own, asked, "id", "text", top_n=4)
            assert got.columns == ["id", "key", "score", "rank"]
            assert sorted((r.id, r.key, round(r.score, 9), r["rank"]) for r in got.collect()) == want
    assert bm25.bm25_batch(alone.pinned(), asked.filter("id = 32"), "id", "text").isEmpty()
    # From the texts, with statistics of all documents and the terms that are asked for alone.
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 100_000)
    few = bm25.for_batch(frame(docs), asked.filter("id = 30"), "text")
    assert few.sizes == kinds["built"].sizes and few.documents.count() == len(docs)
    assert sorted(few.terms.collect()) == sorted(kinds["built"].terms.filter("term in ('red', 'w1', 'w2', 'the')").collect())
    assert sorted(few.postings.collect()) == sorted(kinds["built"].postings.filter("term in ('red', 'w1', 'w2', 'the')").select(few.postings.columns).collect())
    assert bm25.bm25_batch(bm25.for_batch(frame(docs).limit(0), asked, "text"), asked, "id", "text").isEmpty()


def test_a_batch_shuffles_the_best_alone(spark, tmp_path, monkeypatch):
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index")
    index.apply(spark.range(400).select(F.col("id").alias("_key"), F.concat(F.lit("red one w"), F.col("id") % 50).alias("text")))
    asked = spark.range(20).select("id", F.concat(F.lit("red one w"), F.col("id")).alias("text"))
    # 400 documents match each of 20 queries: no score of each pair is grouped, and a task hands on 3 for each query.
    got = bm25.bm25_batch(index.pinned(), asked, "id", "text", top_n=3)
    assert not re.search(r"keys=\[_q#\d+L?, key#", got._jdf.queryExecution().executedPlan().toString())
    want = sorted(got.collect())
    assert [r.key for r in want[:3]] == [0, 50, 100]
    # The operator's own function, with few scores at a time.
    monkeypatch.setattr(bm25, "SCORE_CELLS", 100)
    rows = bm25._by_document(index.pinned(), "text").toArrow()
    pairs = asked.select(F.col("id").alias("_q"), F.explode(F.split("text", " ")).alias("term"), F.lit(1.0).alias("w")).toArrow()
    out = list(bm25._best_of_batch(type("Held", (), {"value": bm25._asked(pairs)}), 3.0, 3, 9)(rows.combine_chunks().to_batches()))
    assert sum(b.num_rows for b in out) == 60
    assert sorted((r["_q"], r["key"]) for b in out for r in b.to_pylist()) == sorted((r.id, r.key) for r in want)
