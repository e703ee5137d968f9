"""Sentence pieces, the alignment of two tokenizers and the divergence of sources, against libraries, SQL and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marlstone.llm import alignment, bpe, divergence, sentence_piece
from tests.conftest import DATA

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
ROWS = [
    (None, None, None, None),
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \n\t ", None, "a"),
    (4, "one", "en", "a"),
    (5, "the cat sat on the mat", "en", "a"),
    (5, "the cat sat on the mat", "en", "a"),
    (None, "the cat sat on the mat", "en", "b"),
    (7, LONG, "en", "a"),
    (8, "Ünïcödé 日本語 \x1c <|endoftext|> <s> 😀", "de", "b"),
    (9, "a ▁ b", "de", "b"),
    (10, "  two  blanks \n\n and \x01 marks ", "fr", "c"),
]
CLASHES = ["id", "row", "n", "n_a", "ids", "key", "links", "times", "best", "term", "item", "value", "rank", "p", "q", "z", "v", "docs", "part", "total", "more_sum"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=sentence_piece.default_model())


@pytest.fixture(scope="module")
def encoder():
    return sentence_piece.PieceEncoder(sentence_piece.prepared(sentence_piece.default_model()))


PARTS = ["a", "b", " ", "  ", "\n", "\t", "the", " the", "ing", "<s>", "<0x0A>", "▁", "\x00", "\x01", "é", "日", "语", ".", ",", "...", "__", "　", "😀", "�", "क़", "▁▁▁", "    ", "⁇", "1", "1."]


def numbers(ids: bytes) -> list[int]:
    return list(memoryview(ids).cast("I"))


@settings(max_examples=200, deadline=None)
@given(batch=st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=6))
def test_pieces_are_the_librarys(batch, encoder, library):
    ids = encoder.encode(pa.array(batch, pa.string()))
    assert [numbers(x) for x in ids.to_pylist()] == [library.encode(t) for t in batch]
    framed = sentence_piece.framed(encoder.pieces, ids)
    assert [x.decode() for x in sentence_piece.texts_of(encoder.pieces, framed)] == [library.decode(numbers(x)) for x in framed.to_pylist()]


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.sampled_from([0, 1, 2, 259, 264, 28705, 3, 13, 0xE3 + 3, 0x81 + 3, 0x82 + 3, 31999]), max_size=7))
def test_any_ids_decode_as_the_librarys(ids, encoder, library):
    value = pa.array([np.array(ids, "<u4").tobytes()], pa.large_binary())
    assert sentence_piece.texts_of(encoder.pieces, value)[0].decode() == library.decode(ids)


def test_unbroken_words(encoder, library):
    rng = random.Random(4)
    for n in (1, 16, 17, 300, 60_000):
        for letters in ("ab", "a", "etaoinshr", "QmFzZTY0+/=", "日本語", "=", "_"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert encoder.word(" " + text) == library.encode(text)


def test_blank_runs(encoder, library):
    texts = [" " * n for n in range(70)] + [" " * n + "the" for n in range(40)]
    assert [numbers(x) for x in encoder.encode(pa.array(texts)).to_pylist()] == [library.encode(t) for t in texts]


def test_backtracking_leaves_failed_positions(encoder):
    """Neighbours are compatible everywhere, and merging by definition gives the same pieces."""
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("aeinrst") for _ in range(24))
        got = [encoder.pieces.tokens[i].as_py().decode() for i in encoder.word(text)]
        assert got == encoder.pieces.merged(text)


def test_round_trip_of_documents(spark, library, docs):
    path = sentence_piece.default_model()
    given = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    want = Counter()
    for row in given.collect():
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        want[row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, sentence_piece.round_trip(given).collect())) == want
    kept = sentence_piece.decode(sentence_piece.encode(given, path), path)
    assert sorted(r.text for r in kept.collect()) == sorted(library.decode(library.encode(r.text or "")) for r in given.collect())
    assert sentence_piece.round_trip(docs.limit(0)).collect() == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        sentence_piece.Pieces(public_tokenizers.path("byte_bpe_50k.json"))


def test_spans_of_labels(monkeypatch):
    labels = alignment.label_string(9, np.array([2, 3, 6, 9]), np.array([3, 4, 5, 6, 9]))
    assert labels == b".axbbx..x".replace(b"bbx", b"bbx")
    for size in (1, 4, 1 << 20):
        monkeypatch.setattr(alignment, "SCAN_BYTES", size)
        assert [x.tolist() for x in alignment.spans(labels)] == [[3, 3, 3], [2, 1, 1], [1, 3, 1]]


def alignment_by_hand(texts):
    """The contract in plain Python."""
    a, b = Tokenizer.from_file(bpe.default_vocabulary()), SentencePieceProcessor(model_file=sentence_piece.default_model())
    a.encode_special_tokens = True
    letters = {c: i for i, c in bpe.byte_letters().items()}
    rows, counts = [], Counter()
    for text in texts:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        want = (" " + text).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, begin = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if begin < e <= cut) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if begin < e <= cut))
            begin = cut
        links = []
        for i, x, end_x in zip(range(len(ids_a)), ids_a, ends_a):
            for j, y, end_y in zip(range(len(ids_b)), ids_b, ends_b):
                if max(end_x - len(bytes_a[i]), end_y - len(bytes_b[j])) < min(end_x, end_y):
                    links.append((x, y))
        counts.update(links)
        rows.append((ids_a, ids_b, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (len(a), len(b), len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, k in rows
    ]


@pytest.mark.parametrize("head", [0, 50, alignment.HEAD_PAIRS])
def test_alignment_is_the_contracts(spark, docs, head):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 1500]
    texts += [(r[0], r[1]) for r in ROWS if r[1] != LONG] + [(11, "".join(random.Random(2).choice(PARTS) for _ in range(300)))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in CLASHES})
    out = alignment.link_statistics(df, bpe.default_vocabulary(), sentence_piece.default_model(), head_pairs=head)
    want = Counter((i, *row) for (i, _), row in zip(texts, alignment_by_hand([t for _, t in texts])))
    assert Counter(map(tuple, out.collect())) == want


def test_alignment_of_long_and_no_texts(spark, docs):
    out = alignment.link_statistics(docs, bpe.default_vocabulary(), sentence_piece.default_model()).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[7].n_links >= max(by[7].n_a, by[7].n_b) and by[7].n_groups <= min(by[7].n_a, by[7].n_b)
    assert (by[9].n_a, by[9].n_links, by[9].groups_sha256) == (0, 0, "")
    assert alignment.link_statistics(docs.limit(0), bpe.default_vocabulary(), sentence_piece.default_model()).collect() == []


def divergence_by_hand(rows, least=3, most=200):
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or "a" <= c <= "z" else " " for c in t or "").split(" ")
    rows = [(lang or "", source or "", [w for w in split(text) if w]) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(w for r in own for w in set(r[2]))
        kept = [w for w, n in docs.items() if n >= least]
        v, sources = len(kept), sorted({r[1] for r in own})
        counts = {s: Counter(w for r in own if r[1] == s for w in r[2]) for s in sources}
        whole = Counter(w for r in own for w in r[2])

        def shares(c, kept=kept, v=v):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (total + v) for w in kept}

        p, q = {s: shares(counts[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(h, sum((p[s][w] - p[h][w]) ** 2 // p[h][w] for w in kept)) for h in sources if h != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])]
    return out


def test_divergence_of_odd_rows(docs):
    assert sorted(map(tuple, divergence.audit(docs).collect())) == sorted(divergence_by_hand(ROWS))
    assert divergence.audit(docs.limit(0)).collect() == []


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(st.tuples(st.just(1), st.text("aAéß日 1.", max_size=12) | st.none(), st.sampled_from(["x", "y", "", None]), st.sampled_from(["s", "t", "u", "", None])), min_size=1, max_size=40))
def test_divergence_is_the_contracts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df, most_terms=2).collect())) == sorted(divergence_by_hand(rows, most=2))
