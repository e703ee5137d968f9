"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, common, decontaminate, html_text, language, license, near_dup, quality, substring_dedup, token_rollup, warc

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "a", 3),
    (4, "one", "en", "a", 3),
    (5, "the cat sat on the mat and the dog sat on the log by the door", "en", "a", 1),
    (5, "the cat sat on the mat and the dog sat on the log by the door", "en", "a", 1),
    (6, "The Cat sat on the mat and the dog sat on the log by the door", "en", "a", 1),
    (None, "the cat sat on the mat and the dog sat on the log by the door", "en", "a", 1),
    (7, LONG, "en", "a", 1),
    (8, "Ünïcödé 日本語 \x1c <|endoftext|> 😀", "de", "b", 1),
]
#: Names that the operators use for columns of their own.
CLASHES = ["id", "n", "cid", "sketch", "ids", "n_tokens", "digest", "_digest", "spans", "kept_words", "n_words", "word", "score", "label", "item", "item_id", "start", "region", "comp", "component_id", "kept", "value", "path", "payload", "held_out", "lang_pred"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_bpe(docs, none):
    out = bpe.round_trip(docs).collect()
    assert len(out) == len(ROWS)
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
    assert sorted(r.decoded_sha256 for r in out) == texts
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (1, 2))
    assert bpe.round_trip(none).collect() == []


def test_near_dup(docs, none):
    out = [r for r in near_dup.near_duplicates(docs, size=4).collect()]
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 5, 5, 7]
    assert by[1].n_shingles == 0 and by[4].n_shingles == 1 and by[5].kept and not by[6].kept
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert near_dup.near_duplicates(none).collect() == []


def test_one_row_of_each_group_survives(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = words("near").replace("near59", "other")
    rows = [(1, words("twice")), (1, words("twice")), (None, words("nameless")), (None, words("nameless")), (3, words("near")), (4, near), (4, words("clean")), (None, near), (5, ""), (5, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    unique = corpus_pipeline.near_dedup(spark, df, "")
    want = [(1, words("twice")), (None, words("nameless")), (3, words("near")), (4, words("clean")), (5, ""), (5, ""), (None, None)]
    assert unique.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in unique.collect()), key=str) == sorted(want, key=str)
    left = corpus_pipeline.substring_dedup_stage(spark, unique, "")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").collect() == []


def test_substrings(docs, none):
    out = substring_dedup.remove_repeats(docs, window=10)
    assert set(CLASHES) - {"_digest"} <= set(out.columns)
    rows = out.select("doc_id", "text", "n_words", "n_removed", "kept_words").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id == 5:
            assert (r.n_words, r.n_removed, r.kept_words, r.text) == (16, 16, "", "")
        if r.doc_id == 6:
            assert (r.n_removed, r.kept_words, r.text) == (14, "The Cat", "The Cat ")
        if r.doc_id == 7:
            assert (r.n_words, r.n_removed, r.text) == (60_000, 0, LONG)
        if r.doc_id == 1:
            assert r.text is None and r.n_words == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeats_within_a_text(spark):
    part = " ".join(f"a{i}" for i in range(12))
    cases = [(1, f"{part} x {part}"), (2, "z " * 40), (3, "only once " * 1)]
    out = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(cases, "doc_id int, text string"), window=10).collect()}
    assert out == {1: 24, 2: 40, 3: 0}


def test_language(docs, none):
    langs, log_p = language.learn(docs, "lang", "text")
    assert langs == ["de", "en"]
    out = language.predict(docs, langs, log_p).collect()
    assert len(out) == len(ROWS)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in out) and all(r.score == 0 for r in out if r.lang_pred == "und")
    empty, table = language.learn(none, "lang", "text")
    assert empty == [] and {r.lang_pred for r in language.predict(docs, empty, table).collect()} == {"und"}
    assert language.predict(none, langs, log_p).collect() == []


def test_license(docs, none):
    out = {r.doc_id: r for r in license.scan(docs).collect()}
    assert out[1].n_words == 0 and out[1].phrase_places == [] and out[5].blocks == []
    assert license.scan(none).collect() == []
    assert all(r.blocks == [] for r in license.scan(docs, templates=[]).collect())
    many = docs.sparkSession.createDataFrame([(1, "cc by nc " * 100_000)], "doc_id long, text string")
    assert len(license.scan(many).first().phrase_places) == 100_000


def test_quality(docs, none):
    out = {r.doc_id: r for r in quality.ledger(docs).collect()}
    assert out[1].n_words == 0 and out[1].fail_bits & 1 and not out[7].fail_bits & 1
    assert quality.ledger(none).collect() == []


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "cat sat on the mat and the dog sat on the log"), (2, None), (3, ""), (4, "one"), (4, "one")], "item_id long, text string")
    out = decontaminate.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(4, 4), (5, 1), (6, 1), (None, 1)}
    assert decontaminate.matches(none, items).collect() == []
    assert decontaminate.matches(docs, items.limit(0)).collect() == []


def test_token_rollup(spark, docs, none):
    store = token_rollup.TokenRollup(spark, common.shared_dir(spark, "rollup-test"))
    rows = token_rollup.counts(docs, "words@1")
    assert store.commit("a", token_rollup.inserts(rows)) and not store.commit("a", token_rollup.inserts(rows))
    assert store.commit("empty", token_rollup.inserts(token_rollup.counts(none, "words@1")))
    before = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert before[None, None] == (1, 0) and before["a", None] == (1, 0) and before["b", "de"] == (1, 5)
    store.compact()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()} == before
    store.commit("b", token_rollup.revisions(rows.filter("lang = 'de'"), token_rollup.counts(docs, "words@2").filter("lang = 'de'")))
    store.commit("c", token_rollup.deletes(rows.filter("lang = 'en'")))
    store.commit("c", token_rollup.deletes(rows.filter("lang = 'en'")))
    assert not store.commit("a", token_rollup.inserts(rows))
    after = {(r.source, r.lang, r.tokenizer): r.n_docs for r in store.totals().collect()}
    assert after == {(None, None, "words@1"): 1, ("a", None, "words@1"): 1, ("b", "de", "words@2"): 1}
    with pytest.raises(ValueError):
        store.commit("../x", token_rollup.inserts(rows))


def test_rollup_with_two_writers_and_a_commit_during_compaction(spark, monkeypatch):
    store = token_rollup.TokenRollup(spark, common.shared_dir(spark, "rollup-test"))
    rows = spark.createDataFrame([("s", "en", "t", 1, 5)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    total = lambda: [(r.n_docs, r.n_tokens) for r in store.totals().collect()]
    other = token_rollup.TokenRollup(spark, store.path)
    publish = token_rollup.TokenRollup._publish

    def late(self, staged, kind, name):
        # Another writer commits the same batch, and a new one, just before.
        monkeypatch.setattr(token_rollup.TokenRollup, "_publish", publish)
        other.commit("a", rows)
        other.commit("b", rows)
        publish(self, staged, kind, name)

    monkeypatch.setattr(token_rollup.TokenRollup, "_publish", late)
    store.commit("a", rows)
    assert len(store._names("deltas")) == 3 and total() == [(2, 10)]
    monkeypatch.setattr(token_rollup.TokenRollup, "_publish", lambda self, staged, kind, name: (monkeypatch.setattr(token_rollup.TokenRollup, "_publish", publish), other.commit("c", rows), publish(self, staged, kind, name)))
    store.compact()
    assert total() == [(3, 15)]
    store.compact()
    assert total() == [(3, 15)] and not store.commit("b", rows)


def test_rollup_with_two_compactions_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([("s", "en", "t", 1, 10)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    store, other = (token_rollup.TokenRollup(spark, path) for path in [common.shared_dir(spark, "rollup-test")] * 2)
    store.commit("one", rows)
    listed = store._batches

    def late():
        found = listed()
        other.commit("two", rows)
        other.compact()
        return found

    monkeypatch.setattr(store, "_batches", late)
    store.compact()
    monkeypatch.undo()
    for _ in range(2):
        assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "t", 2, 20)]
        store.compact()
    assert not store.commit("two", rows)


def test_rollup_counts_real_tokens(spark):
    docs = spark.createDataFrame([(1, "Hello, world!", "s", "en"), (2, None, "s", None)], "doc_id long, text string, source string, lang string")
    out = {(r.doc_id, r.tokenizer): r.n_tokens for r in token_rollup.counts(docs, "words@1", "byte_bpe_50k@1").collect()}
    assert out == {(1, "words@1"): 2, (2, "words@1"): 0, (1, "byte_bpe_50k@1"): 4, (2, "byte_bpe_50k@1"): 0}


PAGES = [(1, "http://a", "<p>x"), (2, None, None), (3, "http://b\n", ""), (None, "http://c", "<p>x"), (4, "http://d", "<p>x"), (4, "http://d", "<p>x"), (5, "u", "é" * 50_000)]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHES})
    folder = f"{common.shared_dir(spark, 'warc-test')}/a"
    warc.write_archives(pages, folder)
    out = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect()]
    assert sorted(out, key=str) == sorted([(1, 4, "revisit", 4), (2, 0, "revisit", 3), (3, 0, "response", None), (None, 4, "response", None), (4, 4, "response", None), (4, 4, "response", None), (5, 100_000, "response", None)], key=str)
    warc.write_archives(pages.limit(0), folder + "0")
    assert warc.read_archives(spark, folder + "0").collect() == []


def test_html(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(pages).collect()
    assert len(out) == len(PAGES) and {r.text for r in out if r.page_id in (1, 2, 3)} == {"x", ""}
    assert html_text.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>See <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here", "See x=1 here"),
        ("<p><math><semantics><mi>y</mi><annotation encoding='tex'>\\y</annotation><annotation-xml>z</annotation-xml></semantics></math> end", "y end"),
        ("<p>a</p><math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd><mtd>4</mtd></mtr></mtable></math>", "a\n\n1 2\n3 4"),
        ("<div>a<svg><text>One</text><g><text>Two <tspan>parts</tspan></text></g></svg>b</div>", "a\nOne\nTwo parts\nb"),
        ("<p>a <svg><title>t</title><path d='M0'/></svg>b", "a b"),
        ("<p>a <svg><desc>d</desc></svg>b", "a b"),
        ("<p>a <svg><defs><text>d</text></defs></svg>b", "a b"),
        ("<p>a <svg><metadata>m</metadata></svg>b", "a b"),
        ("<p>a <svg><style>s{}</style><script>x</script></svg>b", "a b"),
        ("<svg><foreignObject><desc>shown</desc></foreignObject></svg>", "shown"),
        ("<p>a <desc>d</desc> <metadata>m</metadata> <annotation>n</annotation>", "a d m n"),
        ("<p>a <object data='x.swf'><param name='p'>no <b>player</b></object> b", "a no player b"),
        ("<p>a <svg hidden><text>t</text></svg><object style='display:none'>o</object>b", "a b"),
    ],
)
def test_html_of_drawings_formulas_and_objects(html, want):
    assert html_text.page_text(html)[0] == want


def test_every_single_letter_has_a_trigram():
    letters = [chr(c) for c in range(0x3000) if chr(c).isalpha()]
    assert all(sum(map(len, language.trigrams(x))) for x in letters)


def test_pipeline_over_odd_tables(spark, tmp_path):
    words = lambda name, n=80: " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    item = "a benchmark question of some length that stands in a text as it is"
    rows = [
        (1, words("twice"), "en"), (1, words("twice"), "en"), (None, words("nameless"), None), (None, None, "en"), (2, "", "en"), (3, "123 456", "en"),
        (4, f"{words('x', 30)} {item} {words('y', 30)}", "en"), (5, words("clean"), None), (6, f"{words('head', 40)} {words('shared', 70)}", "en"), (7, f"{words('shared', 70)} {words('tail', 40)}", "en"),
    ]
    clashes = {c: F.lit("clash") for c in [*CLASHES, "_row", "_lang", "_spans", "proportions"] if c != "text"}
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns(clashes)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    # Without letters: rejected; of the equal rows one stays; the item's document goes; the shared passage goes from both.
    assert sorted(((r.doc_id, r.n_tokens > 0) for r in out), key=str) == sorted([(1, True), (None, True), (5, True), (6, True), (7, True)], key=str)
    left = {r.doc_id: len(r.ids) for r in out}
    assert left[6] < left[5] and left[7] < left[5]
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    items.write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
    docs.write.parquet(f"{tmp_path}/c/documents.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/c/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/c").collect()} == {1, None, 4, 5, 6, 7}
