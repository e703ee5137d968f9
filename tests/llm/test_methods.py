"""The operators against brute force, the installed library, SQL and held-out labels."""

import gzip
import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import bpe, decontaminate, graph, html_text, language, license, near_dup, quality, queries, substring_dedup, warc, words
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(name, agrees):
    agrees(queries.queries()[name], queries.oracle_sql()[name], f"{DATA}/sf0.001")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary()))


PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "<|endoftext|>", "!", "日", "　", "ll", "\r\n", "\x1c", "\x01", ".", ",", "_", "😀", "क़", "꟎"]


def numbers(ids: bytes) -> list[int]:
    return list(memoryview(ids).cast("I"))


@settings(max_examples=300, deadline=None)
@given(batch=st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=5))
def test_ids_are_the_librarys(batch, encoder, tokenizer):
    ids = encoder.encode(pa.array(batch, pa.string()))
    assert [numbers(x) for x in ids.to_pylist()] == [tokenizer.encode(t, add_special_tokens=False).ids for t in batch]
    assert [bpe.as_utf8(x).decode() for x in bpe.decoded(encoder.vocabulary.tokens, ids).to_pylist()] == batch


def test_unbroken_words(encoder, tokenizer):
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 63, 64, 65, 300, 60_000) for letters in ("ab", "etaoinshr", "QmFzZTY0+/=", "日本語")]
    ids = encoder.encode(pa.array(texts, pa.string())).to_pylist()
    assert [numbers(x) for x in ids] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_wrong_ids_and_bytes_decode(encoder):
    ids = np.array([10**9, int(encoder.vocabulary.byte_ids[0xE9])], "<u4").tobytes()
    found = bpe.decoded(encoder.vocabulary.tokens, pa.array([ids, b""], pa.large_binary())).to_pylist()
    assert found == [b"\xe9", b""] and bpe.as_utf8(found[0]).decode() == "\ufffd"


def test_round_trip_of_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, bpe.default_vocabulary(), most_words=500), bpe.default_vocabulary()).collect()}
    for row in docs.collect():
        ids = tokenizer.encode(row.text, add_special_tokens=False).ids
        assert list(memoryview(out[row.doc_id].ids).cast("I")) == ids and out[row.doc_id].text == tokenizer.decode(ids, skip_special_tokens=False)


def test_lexicon_is_exact_and_shares_suffixes(tmp_path):
    lexicon_words = {f"{a}{b}ation".encode(): (i, j) for i, a in enumerate("bcdfg") for j, b in enumerate("aeiou")}
    (tmp_path / "x.fst").write_bytes(bpe.compile_lexicon(lexicon_words))
    lexicon = bpe.Lexicon(str(tmp_path / "x.fst"))
    asked = [*lexicon_words, b"ba", b"bationx", b"", b"b" * 1000]
    found, ids = lexicon.lookup(pa.array(asked, pa.large_binary()))
    assert found.tolist() == [True] * 25 + [False] * 4
    assert dict(zip(asked, (tuple(numbers(x)) for x in ids.to_pylist()))) == lexicon_words
    assert len(lexicon.ends) < 12
    (tmp_path / "e.fst").write_bytes(bpe.compile_lexicon({}))
    assert not bpe.Lexicon(str(tmp_path / "e.fst")).lookup(pa.array([b"a"], pa.large_binary()))[0].any()


def test_lexicon_changes_no_id(tmp_path, encoder, tokenizer):
    tokens = sorted({x.encode() for x in (" the", " them", "the", " 日本", "!!", " a" * 40, " déjà")})
    ids = encoder.vocabulary.merge_all(pa.array(tokens, pa.large_binary())).to_pylist()
    (tmp_path / "x.fst").write_bytes(bpe.compile_lexicon({t: tuple(numbers(i)) for t, i in zip(tokens, ids)}))
    texts = ["the them there 日本 日本語!! déjà vu", " the", ""]
    found = bpe.Encoder(encoder.vocabulary, bpe.Lexicon(str(tmp_path / "x.fst"))).encode(pa.array(texts)).to_pylist()
    assert [numbers(x) for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_language_held_out(spark):
    out = language.op4_mixture_language_id(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() >= 0.98 * out.count()


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    langs, log_p = language.learn(docs, "lang", "text")
    en, fr = (docs.filter(f"lang = '{x}' and n_chars between 2000 and 3000").orderBy("doc_id").first().text[:1500] for x in ("en", "fr"))
    out = language.predict(spark.createDataFrame([(1, en + " " + fr)], "doc_id int, text string"), langs, log_p).first()
    assert set(out.proportions) == {"en", "fr"} and all(0.3 < v < 0.7 for v in out.proportions.values())


def plain_mixture(log_p, counts):
    """Proportions by the definition: expectation-maximisation with sums over trigrams, one language added at a time."""
    total = sum(counts.values())

    def fit(allowed):
        w = {j: 1 / len(allowed) for j in allowed}
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(allowed, 0.0)
            for g, n in counts.items():
                joint = {j: w[j] * np.exp(float(log_p[j][g])) for j in allowed}
                for j in allowed:
                    new[j] += n * joint[j] / sum(joint.values()) / total
            w = new
        return w, sum(n * np.log(sum(w[j] * np.exp(float(log_p[j][g])) for j in allowed)) for g, n in counts.items())

    full, _ = fit(range(len(log_p)))
    alone = {j: sum(n * float(log_p[j][g]) for g, n in counts.items()) for j in range(len(log_p))}
    chosen = [max(alone, key=alone.get)]
    weights, value = {chosen[0]: 1.0}, alone[chosen[0]]
    for j in sorted(full, key=lambda j: -full[j]):
        if full[j] > language.LEAST_WEIGHT and j not in chosen:
            more, better = fit([*chosen, j])
            if better - value <= language.PENALTY * np.log(total + 1):
                break
            chosen, weights, value = [*chosen, j], more, better
    return weights


def test_mixtures_by_the_definition():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(40, 0.3), 5)
    log_p = np.log(p).astype(np.float32)
    docs = []
    for _ in range(30):
        weights = rng.dirichlet(np.full(5, 0.25))
        drawn, n = np.unique(rng.choice(40, rng.integers(3, 400), p=weights @ p), return_counts=True)
        docs.append(dict(zip(drawn.tolist(), n.tolist())))
    doc = np.repeat(np.arange(30), [len(d) for d in docs])
    gram, n = np.array([g for d in docs for g in d]), np.array([n for d in docs for n in d.values()], float)
    found = language.Mixture(log_p).infer(doc, gram, n, 30)
    for i, d in enumerate(docs):
        want = plain_mixture(log_p, d)
        assert np.allclose(found[i], [want.get(j, 0) for j in range(5)], atol=1e-4)


def test_trigrams_of_parts(monkeypatch):
    text = "Über 12 die... Länder\n\nund  Meere! "
    whole = np.concatenate(list(language.trigrams(text)))
    clean = " über die länder und meere "
    assert len(whole) == len(clean) - 2 and np.array_equal(whole, np.concatenate(list(language.trigrams(clean))))
    for size in range(1, 12):
        monkeypatch.setattr(language, "GROUP_CHARS", size)
        assert np.array_equal(np.concatenate(list(language.trigrams(text))), whole)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.learn(spark.createDataFrame([("en", "a b"), ("de", "c d")], "lang string, text string"), "lang", "text")


def brute_components(sets, similarity=80):
    """Smallest id reachable over all pairs of sets."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def family(seed=5):
    """Documents: a large family of near copies, a passage that many share, and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100_000)}"
    base, passage, out = [word() for _ in range(130)], [word() for _ in range(60)], []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(len(copy))] = word()
        out.append(copy)
    out += [[word() for _ in range(30)] + passage + [word() for _ in range(20)] for _ in range(90)]
    out += [[word() for _ in range(rng.randrange(1, 300))] for _ in range(60)]
    rng.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("short", [near_dup.SHORT_LIST, 4])
def test_near_duplicates_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(near_dup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    rows = family()
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} or {tuple(t.split())} for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dup.near_duplicates(df, size=4).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(sets)


def test_a_large_family_whose_smallest_member_links_to_none(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base[:120] + [f"x{i}" for i in range(80)]))]
    for i in range(1, 1200):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"own{i}x{at}"
        rows.append((i, " ".join(copy)))
    out = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(197)} for i, t in rows}
    assert not any(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for i, s in sets.items() if i)
    assert out == brute_components({i: sets[i] for i in range(1, 200)}) | {i: 1 for i in range(200, 1200)} | {0: 0}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(1, 6), st.integers(0, 2**32))
def test_block_links_are_a_forest(rows, names, seed):
    rng = np.random.default_rng(seed)
    comp = rng.integers(0, names, rows)
    linked = rng.random((rows, rows)) < 0.2
    linked = (linked | linked.T) & (comp[:, None] != comp[None, :])
    links = near_dup.spanning(linked, comp)
    assert all(linked[i, j] for i, j in links)

    def joined(pairs):
        root = list(range(names))
        for i, j in pairs:
            a, b = root[comp[i]], root[comp[j]]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    assert joined(links) == joined(zip(*np.nonzero(linked)))
    assert len(links) == names - len(set(joined(links)))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    out = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=0, max_size=60), st.integers(2, 9))
def test_anchors_count_at_least_as_often_as_windows(letters, window):
    hashes = words.hashes([x.encode() for x in letters])
    if len(hashes) < window:
        return
    by_window = substring_dedup.anchors(hashes, window, places=False)
    whole = words.sequence_hashes(hashes, window)
    values, counts = np.unique(substring_dedup.anchors(hashes, window, places=True), return_counts=True)
    places = dict(zip(values.tolist(), counts.tolist()))
    for h in np.unique(whole):
        anchor = by_window[whole == h]
        assert len(set(anchor.tolist())) == 1 and places[anchor[0].item()] >= (whole == h).sum()


def repeating_texts(seed=6):
    rng = random.Random(seed)
    passages = [[f"p{i}w{j}" for j in range(rng.randrange(9, 40))] for i in range(6)]
    rows = []
    for i in range(60):
        parts = [f"u{i}x{j}" for j in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(passages)[rng.randrange(4) :]
        rows.append((i % 50, " ".join(parts)))
    return rows + [rows[0], rows[0], (None, None), (70, "")]


@pytest.mark.parametrize("most_bits", [30, 0])
def test_repeats_brute_force(spark, monkeypatch, most_bits):
    monkeypatch.setattr(substring_dedup, "MOST_BITS", most_bits)
    rows = repeating_texts()
    words_of = [(t or "").split() for _, t in rows]
    count: dict = {}
    for parts in words_of:
        for j in range(len(parts) - 9):
            count[tuple(parts[j : j + 10])] = count.get(tuple(parts[j : j + 10]), 0) + 1
    want = []
    for (i, _), parts in zip(rows, words_of):
        gone = {j + k for j in range(len(parts) - 9) if count[tuple(parts[j : j + 10])] > 1 for k in range(10)}
        want.append((i, " ".join(w for j, w in enumerate(parts) if j not in gone)))
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=10).collect()
    assert sorted(((r.doc_id, r.kept_words) for r in out), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("shards", [1, 64, 1000])
def test_few_unique_anchors_pass_at_any_load(spark, monkeypatch, shards):
    monkeypatch.setattr(substring_dedup, "TASK_ANCHORS", 3000)
    rng = np.random.default_rng(1)
    unique, twice = (" ".join(f"{a}{x}" for x in rng.permutation(20_000)) for a in ("u", "t"))
    texts = spark.createDataFrame([(unique,), (twice,), (twice,)], "text string").repartition(3)
    repeated = substring_dedup.sketch(texts, 35, shards)
    anchor = lambda t: np.unique(substring_dedup.anchors(words.hashes(words.split(t)), 35, places=True))
    n = sum(len(r.cells) // 4 for r in repeated.collect())
    assert len(anchor(twice)) <= n <= 1.01 * len(anchor(twice))
    bits = substring_dedup.bit_map(repeated, (n * substring_dedup.CELL_BITS).bit_length())
    passed = [substring_dedup.estimated_repeated(bits, substring_dedup.cells(anchor(t), shards)) for t in (unique, twice)]
    assert passed[1].all() and passed[0].mean() < 0.01


def test_long_windows_hash_by_content():
    parts = words.hashes([f"{i % 50}".encode() for i in range(200)])
    h = words.sequence_hashes(parts, 35)
    assert (h[:50] == h[50:100]).all() and len(np.unique(h)) == 50


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_decontamination_brute_force(data):
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    letters = "abcdefgh "
    item = decontaminate.normal("".join(rng.choice(letters) for _ in range(rng.randint(10, 90))))
    edited = list(item)
    for _ in range(rng.randint(0, len(item) // 10 + 2)):
        at = rng.randrange(len(edited))
        edited[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
    text = decontaminate.normal("".join(rng.choice(letters) for _ in range(80)) + "".join(edited) + "".join(rng.choice(letters) for _ in range(80)))
    items = decontaminate.Items([(0, item)], 10)
    most = int(items.edits[0])
    assert most == len(item) // 10
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    found = [decontaminate.banded_edits(item, text[max(0, lo - most) : hi + len(item) + most], most) for _, lo, hi in items.regions(text)]
    found = [f for f in found if f is not None]
    assert (min(found) if found else None) == (min(row) if min(row) <= most else None)


def test_a_tenth_of_every_length_has_a_bound():
    for n in range(10, 2000):
        q = decontaminate.gram_length(n, n // 10)
        assert q <= n and decontaminate.bound(n, n // 10, q) >= 1
    assert decontaminate.gram_length(200, 20) == 8


def test_long_texts_are_looked_up_in_parts(monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60))
    found = [decontaminate.normal(word()) for _ in range(3)]
    text = decontaminate.normal("".join(word() + " " + found[i % 3] for i in range(40)))
    items = decontaminate.Items(list(enumerate(found)), 10)
    at = [(k, m.start()) for k, item in enumerate(found) for m in re.finditer(re.escape(item), text)]
    assert len(at) >= 40
    for size in (1 << 20, 50):
        monkeypatch.setattr(decontaminate, "PART_CHARS", size)
        regions = items.regions(text)
        assert all(any(r[0] == k and r[1] <= p <= r[2] for r in regions) for k, p in at)


def test_equal_edits_at_two_places(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown foxes yy the quick brown foxes zz")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the quick brown fox"), (7, "the quick brown fox")], "item_id long, text string")
    (row,) = decontaminate.matches(docs, items).collect()
    assert (row.doc_id, row.item_id, row.edits) == (1, 7, 0) and row.start <= 3


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, items).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    assert exact and exact <= {(d, i) for d, i, _ in whole}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, items).collect()} == whole


def test_license_join_brute_force():
    index = license.Templates(license.TEMPLATES, 80).order({b"the": 1000, b"license": 50})
    rng = random.Random(3)
    vocabulary = [*sorted(index.vocabulary), b"other", b"words"]
    hits = 0
    for _ in range(400):
        parts = license.normal(rng.choice(license.TEMPLATES)[1]).split()
        parts = [w for w in parts if rng.random() < 0.93]
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(vocabulary))
        text = rng.choices(vocabulary, k=rng.randrange(20)) + parts + rng.choices(vocabulary, k=rng.randrange(20))
        text += rng.choice([[], parts, [b"other"] * 30 + parts])
        want = {}
        for t, words in enumerate(index.sets):
            blocks = [frozenset(text[i : i + index.block[t]]) for i in range(len(text))]
            best = max((len(words & x) for x in blocks if index.must[t] <= x), default=0)
            if 100 * best >= 80 * len(words):
                want[t] = best
        found = index.matches(text)
        best = {}
        for t, _, n, named in found:
            best[t] = max(best.get(t, 0), n * named)
        assert {t: n for t, n in best.items() if n} == want
        for t, words in enumerate(index.sets):
            size, own = index.block[t], [x for x in found if x[0] == t]
            for _, w, n, named in own:
                block = frozenset(text[w : w + size])
                assert len(words & block) == n and named == (index.must[t] <= block)
            # Reported blocks do not overlap; every other one overlaps one that is at least as good.
            assert all(x[1] + size <= y[1] for x, y in zip(own, own[1:]))
            for i in range(len(text)):
                block = frozenset(text[i : i + size])
                if text[i] in words and 100 * len(words & block) >= 80 * len(words):
                    assert any(abs(w - i) < size and (named, n) >= (index.must[t] <= block, len(words & block)) for _, w, n, named in own)
        hits += len(want)
    assert hits > 200


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


@pytest.mark.parametrize(
    "text, labels",
    [
        (MIT, ["mit"]),
        (f"# {MIT}".replace("\n", "\n# "), ["mit"]),
        ("Licensed under CC BY 4.0", []),
        ("Licensed under CC\nBY-NC 4.0", ["cc-by-nc"]),
        ("the GNU General Public License, version 2", []),
        ("Released under the Apache License", []),
        (" ".join(f"{a} some filler words" for a in MIT.split()), []),
        ("", []),
    ],
)
def test_notices(text, labels):
    index = license.Templates(license.TEMPLATES, 80).order({})
    assert sorted({index.labels[t] for t, _, _, named in index.matches(license.normal(text).split()) if named}) == labels


def test_every_block_of_a_text(spark):
    text = f"{MIT} {'word ' * 60} {MIT} the GNU General Public License, version"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    blocks = license.scan(docs).first().blocks
    assert [(b.label, b.word) for b in blocks if b.named] == [("mit", 0), ("mit", len(license.normal(MIT).split()) + 60)]
    gpl = "This work is licensed under the GNU General Public License, version 2."
    near = license.scan(docs.selectExpr("doc_id", f"'{gpl}' AS text")).first().blocks
    assert ("gpl-3", 0, False) in [(b.label, b.word, b.named) for b in near]


def test_templates_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, MIT + " Licensed under CC BY-NC 4.0. under the mit license x under the mit license")], "doc_id long, text string")
    whole = license.scan(docs).first()
    assert [p.word for p in whole.phrase_places if p.label == "mit"] == [i for i in range(whole.n_words) if license.normal(docs.first().text).split()[i : i + 4] == b"under the mit license".split()]
    monkeypatch.setattr(license, "PART_TEMPLATES", 3)
    parts = license.scan(docs).first()
    assert {tuple(b) for b in parts.blocks} == {tuple(b) for b in whole.blocks} and parts.phrase_places == whole.phrase_places


def record(n, body=b"x"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (n, len(block)) + block + b"\r\n\r\n"


def salvaged(data):
    found = list(warc.salvage(data))
    return [r["page_id"] for r, _ in found if r], [g for _, g in found if g]


def test_salvage():
    good = [record(i, b"body %d" % i) for i in range(4)]
    broken = good[1].replace(b"Content-Length: ", b"Content-Length: 9")
    pages, gaps = salvaged(good[0] + broken + b"junk" + good[2] + good[3][:-6])
    assert pages == [0, 2]
    assert [(a, b) for a, b, _ in gaps] == [(len(good[0]), len(good[0]) + len(broken) + 4), (len(good[0] + broken) + 4 + len(good[2]), len(good[0] + broken) + 4 + len(good[2]) + len(good[3]) - 6)]
    members = [gzip.compress(g) for g in good]
    damaged = bytearray(members[1])
    damaged[len(damaged) // 2] ^= 0xFF
    pages, gaps = salvaged(members[0] + bytes(damaged) + members[2] + members[3])
    assert [p for p in pages if p != 1] == [0, 2, 3] and gaps
    assert salvaged(members[0] + b"garbage" + members[1])[0] == [0, 1]
    wrong = good[0].replace(b"Content-Type", b"WARC-Payload-Digest: sha1:AAAA\r\nContent-Type")
    assert salvaged(wrong + good[1])[0] == [1]
    assert salvaged(good[0].replace(b"WARC-Type: response\r\n", b"") + good[1])[0] == [1]
    assert salvaged(b"") == ([], [])


def test_a_version_line_over_the_ends_of_members():
    """A damaged version line costs its own record alone, wherever members are cut."""
    good = [record(i, b"body %d" % i) for i in range(4)]
    data = b"".join(good[:1]) + b"WARD" + good[1][4:] + b"".join(good[2:])
    for size in range(1, 30):
        assert salvaged(b"".join(gzip.compress(data[i : i + size]) for i in range(0, len(data), size)))[0] == [0, 2, 3]


@settings(max_examples=150, deadline=None)
@example(1, 21990, True)
@given(st.integers(1, 400), st.integers(0, 10**6), st.booleans())
def test_archives_of_any_members(size, seed, damage):
    """Members cut anywhere hold the same records; bytes are in records or in gaps."""
    rng = random.Random(seed)
    bodies = [bytes(rng.choices(b"ab WARC/1.0\r\n", k=rng.randrange(60))) for _ in range(5)]
    data = b"".join(record(i, x) for i, x in enumerate(bodies))
    if damage:
        at = rng.randrange(len(data))
        data = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    plain = salvaged(data)
    assert len(plain[0]) >= 4 if damage else plain == (list(range(5)), [])
    assert salvaged(gzip.compress(data)) == plain
    pages, gaps = salvaged(b"".join(gzip.compress(data[i : i + size]) for i in range(0, len(data), size)))
    assert set(pages) >= set(plain[0]) if not damage else len(pages) >= 3


def test_one_damaged_member_costs_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{i}", f"<p>{i} {'x' * i}") for i in range(250)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("part-*")
    data = bytearray(file.read_bytes())
    assert gzip.decompress(bytes(data)).count(b"WARC/1.1") == 250
    starts = [i for i in range(len(data)) if data[i : i + 3] == b"\x1f\x8b\x08"]
    data[starts[25] + 40] ^= 0xFF
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.gz").write_bytes(bytes(data))
    out = warc.read_archives(spark, str(tmp_path / "b")).collect()
    assert len({r.page_id for r in out if r.record_type != "gap"}) == 249
    assert 1 <= sum(r.record_type == "gap" for r in out) <= 2


def test_layout():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>Hello <b>wor</b>ld &amp; co
<p>one<p>two <span style="display:none">no</span> x<br>y<ul><li>a<li>b<ol><li>c<li>d</ol></ul><table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table><pre>
 a
   b</pre><div hidden>z</div>end<!-- c --></body></html>"""
    text, stats = html_text.page_text(page)
    assert text == "Hello world & co\n\none\n\ntwo x\ny\n\n- a\n- b\n  1. c\n  2. d\n\nName      | N\nlong name | 1\nx         | 22\n\n a\n   b\n\nend"
    assert stats == {"n_tables": 1, "n_items": 4}
    assert html_text.page_text("<div>" * 5000 + "deep" + "</div>" * 5000)[0] == "deep"
    assert html_text.page_text("a < b <i>c</i")[0] == "a < b c"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>x<tr><td>c<td>y</table>", "a | b |  | x\nc |   |  | y"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a |   | b\nc | d | e"),
        ("<table><tr><td rowspan=9>a<td>b</table><p>c", "a | b\n\nc"),
        ("x <input type=submit value='Send it'> <button>Go</button> <input value=no>", "x Send it Go"),
        ("<a href='x>y'>k</a><a title=\"q>\" b>l</a><a =x>m</a>", "klm"),
        ("<script src=x />var a</script>b<textarea>c &lt;p></textarea>", "bc <p>"),
        ("a<b", "a"),
        ("a<!-- b", "a"),
    ],
)
def test_markup(html, want):
    assert html_text.page_text(html)[0] == want


def plain_layout(blocks):
    """A page of paragraphs, lists and tables, rendered from its description instead of its markup."""
    out = []
    for kind, content in blocks:
        if kind == "p":
            lines = [" ".join(content)]
        elif kind == "ul":
            lines = [f"- {x}" for x in content]
        elif kind == "ol":
            lines = [f"{i}. {x}" for i, x in enumerate(content, 1)]
        else:
            columns = max(map(len, content))
            widest = [max((len(r[i]) for r in content if i < len(r)), default=0) for i in range(columns)]
            lines = [" | ".join(x.ljust(widest[i]) if i + 1 < len(r) else x for i, x in enumerate(r)) for r in content]
        out.append("\n".join(lines))
    return "\n\n".join(out)


_ITEM = st.text("abcdé", min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.tuples(st.sampled_from(["p", "ul", "ol"]), st.lists(_ITEM, min_size=1, max_size=4)),
            st.tuples(st.just("table"), st.lists(st.lists(_ITEM, min_size=1, max_size=3), min_size=1, max_size=3)),
        ),
        max_size=4,
    ),
    st.booleans(),
    st.sampled_from([" ", "\n", "  \n "]),
)
def test_layout_of_described_pages(blocks, closed, space):
    def tag(name, content):
        return f"<{name}>{space}{content}{space}" + (f"</{name}>" if closed or name in ("ul", "ol", "table") else "")

    page = ""
    for kind, content in blocks:
        if kind == "p":
            page += tag("p", space.join(content))
        elif kind == "table":
            page += tag("table", "".join(tag("tr", "".join(tag("td", x) for x in row)) for row in content))
        else:
            page += tag(kind, "".join(tag("li", x) for x in content))
    assert html_text.page_text(page)[0] == plain_layout(blocks)


@pytest.mark.parametrize("depth", [10, 200, 1000])
def test_hidden_text_stays_hidden_at_any_depth(depth):
    inside = "<div>" * depth + "</div>" * depth
    assert html_text.page_text(f"<div hidden>secretA{inside}SECRET</div>after")[0] == "after"
    assert html_text.page_text(f"{'<div>' * depth}<section hidden>SECRET<b>{inside}</b>SECRET</section>seen{'</div>' * depth}<i>end</i>")[0] == "seen\nend"
    assert html_text.page_text(f"{'<div>' * depth}<script>if (a</div>b) x</script>seen<!-- x -->{'</div>' * depth}")[0] == "seen"


def test_spans_take_no_more_than_their_text():
    began = time.time()
    cells = "<td colspan=1000 rowspan=60000>x</td>" * 20
    text = html_text.page_text(f"<table><tr>{cells}</tr>{'<tr><td>y</td></tr>' * 2000}</table>")[0]
    assert len(text) < 400_000 and text.count("y") == 2000 and text.split("\n")[0] == " | ".join("x" * 20)
    html_text.page_text("<canvas></x>" * 8000)
    assert time.time() - began < 10
    assert html_text.page_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>")[0] == "a | b\n  | c"
    assert html_text.page_text("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>")[0] == "a |   | b\nc | d | e"
    assert html_text.page_text("<table><tr><td colspan=3>a<td>b<tr><td>c<td><td><td>e</table>")[0] == "a | b\nc | e"


def test_time_grows_with_the_page():
    import time

    for part in ("<a \"", "<a x ", "<!-", "<a b='", "<table><tr><td rowspan=3>", "<textarea>", "<", "</", "&lt"):
        began = time.time()
        html_text.page_text(part * (400_000 // len(part)))
        assert time.time() - began < 8, part


def test_all_visible_words_are_kept(spark):
    """Against a plain removal of hidden parts and tags: the same words in the same order."""
    from html import unescape

    for row in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect():
        plain = re.sub(r"(?s)<!--.*?-->|<(head|script|style|noscript|template)\b.*?</\1>|<![^>]*>", " ", row.html)
        plain = re.sub(r"</?(?:b|i|em|strong|a|span|u)\b[^>]*>", "", plain)
        want = unescape(re.sub(r"<[^>]+>", " ", plain)).split()
        got = [w for w in html_text.page_text(row.html)[0].split()]
        drop = {"-", "|"}
        assert [w for w in got if w not in drop and not re.fullmatch(r"\d+\.", w)] == [w for w in want if w not in drop and not re.fullmatch(r"\d+\.", w)]


def test_ablations(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1 | 2,), (2,), (8 | 64,)], "fail_bits long")
    out = {r.rule: (r.failed, r.removed_alone) for r in quality.ablations(ledger, "web-1").collect()}
    assert out == {"few_words": (2, 1), "repeated_words": (2, 1), "mean_word_length": (0, 0), "symbols": (1, 1)}
    assert ledger.filter(quality.passes("base-1")).count() == 2


def test_pipeline_stages(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() >= 0.98 * len(rows)
    unique = corpus_pipeline.near_dedup(spark, kept, folder)
    texts = {r.doc_id: r.text for r in kept.collect()}
    shingle = lambda t: {tuple(t.encode().lower().split()[j : j + 5]) for j in range(len(t.encode().split()) - 4)} or {tuple(t.encode().lower().split())}
    want = {i for i, c in brute_components({i: shingle(t) for i, t in texts.items()}).items() if i == c}
    assert {r.doc_id for r in unique.collect()} == want
    cut = corpus_pipeline.substring_dedup_stage(spark, unique, folder)
    after = {r.doc_id: r.text for r in cut.collect()}
    windows: dict = {}
    for i in want:
        parts = texts[i].split()
        for j in range(len(parts) - 49):
            windows.setdefault(tuple(parts[j : j + 50]), []).append((i, j))
    gone = {(i, j + k) for places in windows.values() if len(places) > 1 for i, j in places for k in range(50)}
    assert {i: after[i].split() for i in after} == {i: [w for j, w in enumerate(texts[i].split()) if (i, j) not in gone] for i in want}
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, cut, folder).collect()}
    assert not any(t in after[i] for i in clean for t in items) and len(clean) >= 0.8 * len(after)
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in final} == clean
