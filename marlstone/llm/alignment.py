"""Alignment of two tokenizers over the same bytes.

Each byte of a text gets a label: no token ends there (.), one of A (a), one of B (b), or one of both (x). A regular
expression scans the labels for spans up to each x; the labels of a span count the tokens of its group. A link is a
token of A and one of B whose bytes overlap: each label but . is the end of exactly one.

The labels, groups and links of a text are written once. The corpus-wide count of each pair of ids is summed from
them; a second reading gives each text the counts of its links. The most frequent pairs lie in one file of bounded size
that every executor maps into memory; links of the rarer ones, which by that are of no frequent key, are joined with
their counts by a shuffle. Both ways give the same result.

Defined cases: a null or empty text, and one whose bytes by A or B are not a blank and the text, has no tokens: all
numbers are 0 and its digest is empty; special tokens' names in a text are plain text; rows are told apart by
themselves, so null and repeated ids get a row each and count each time; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import mmap
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, common, sentence_piece
from marlstone.llm.bpe import BATCH_ROWS, after, as_binary, decoded, raw, regrouped

#: Most pairs of the mapped file.
HEAD_PAIRS = 1_000_000
#: Most distinct pairs that a task holds before it emits their counts.
TASK_PAIRS = 500_000
#: Bytes of labels that are scanned at a time.
SCAN_BYTES = 1 << 20
#: Bytes of a batch that is aligned at a time: a dozen numbers of 64 bits are held for each token.
ALIGN_BYTES = 2 << 20

LETTERS = np.frombuffer(b".abx", np.uint8)
SPAN = re.compile(rb"[.ab]*x")
TEXT_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def label_string(total: int, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """A letter for each of `total` bytes; ends: the places after the last bytes of tokens."""
    marks = np.zeros(total, np.uint8)
    marks[ends_a - 1] |= 1
    marks[ends_b - 1] |= 2
    return LETTERS[marks].tobytes()


def spans(labels: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each span up to an x: its bytes, its tokens of A and those of B. The labels end with x."""
    parts, at = [], 0
    while at < len(labels):
        stop = labels.rfind(b"x", at, at + SCAN_BYTES) + 1 or labels.index(b"x", at) + 1
        coded = pa.array(SPAN.findall(labels, at, stop), pa.large_binary()).dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        kinds = np.array([(len(k), k.count(b"a") + 1, k.count(b"b") + 1) for k in kinds], np.int64)
        parts.append(kinds[coded.indices.to_numpy()])
        at = stop
    found = np.concatenate([np.empty((0, 3), np.int64), *parts])
    return found[:, 0], found[:, 1], found[:, 2]


def rendering(size_a: int, size_b: int) -> pa.Array:
    """Each id in decimal with what follows it: of A with a comma, with a bar; of B with a comma, with a semicolon."""
    names_a, names_b = [str(i).encode() for i in range(size_a)], [str(i).encode() for i in range(size_b)]
    return pa.array([n + c for names, c in ((names_a, b","), (names_a, b"|"), (names_b, b","), (names_b, b";")) for n in names], pa.large_binary())


class Aligner:
    """The labels' groups and links of texts that both encoders spell alike."""

    def __init__(self, encode_a: bpe.Encoder, encode_b: sentence_piece.PieceEncoder):
        self.a, self.b = encode_a, encode_b
        self.tokens_a, self.tokens_b = encode_a.vocabulary.tokens, encode_b.pieces.tokens
        self.size_a, self.size_b = len(self.tokens_a), len(self.tokens_b)
        self.bytes_a, self.bytes_b = (pc.binary_length(t).to_numpy() for t in (self.tokens_a, self.tokens_b))
        self.rendered = rendering(self.size_a, self.size_b)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Which texts have tokens, and those texts' ids by A and by B."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = after(" ", texts)
        ids_a, ids_b = self.a.plain(spaced), self.b.encode(texts)
        want = spaced.cast(pa.large_binary())
        same = pc.and_(pc.equal(decoded(self.tokens_a, ids_a), want), pc.equal(decoded(self.tokens_b, ids_b), want))
        has = pc.and_(same, pc.not_equal(texts, ""))
        return np.array(has, bool), _filtered(ids_a, has), _filtered(ids_b, has)

    def align(self, ids_a: pa.Array, ids_b: pa.Array) -> dict[str, np.ndarray | list]:
        """For each text: n_a, n_b, n_groups, n_links, groups (the rendered groups), pairs (distinct keys), times."""
        (a, bounds_a), (b, bounds_b) = map(_numbers, (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        total = int(ends_a[-1]) if len(a) else 0
        labels = label_string(total, ends_a, ends_b)
        widths, group_a, group_b = spans(labels)
        # A text ends where a group does.
        text_ends = np.concatenate(([0], ends_a))[bounds_a[1:]]
        group_bounds = np.concatenate(([0], np.searchsorted(np.cumsum(widths), text_ends, "right")))
        # Links: at each label the tokens of A and B that cover the byte.
        marks = np.frombuffer(labels, np.uint8)
        places = np.flatnonzero(marks != ord("."))
        marks = marks[places]
        is_a, is_b = marks != ord("b"), marks != ord("a")
        keys = a[np.cumsum(is_a) - is_a].astype(np.int64) * self.size_b + b[np.cumsum(is_b) - is_b]
        link_bounds = np.concatenate(([0], np.searchsorted(places, text_ends, "left")))
        text_of = np.repeat(np.arange(len(ids_a)), np.diff(link_bounds))
        # Sorted together by text and key: the product of both sizes is far below 64 bits.
        every = self.size_a * self.size_b
        both = np.sort(text_of * every + keys)
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        firsts = np.flatnonzero(new)
        return {
            "n_a": np.diff(bounds_a),
            "n_b": np.diff(bounds_b),
            "n_groups": np.diff(group_bounds),
            "n_links": np.diff(link_bounds),
            "groups": self._render(a, b, group_a, group_b, group_bounds),
            "keys": both[firsts] % every,
            "times": np.diff(np.append(firsts, len(both))),
            "n_pairs": np.bincount(both[firsts] // every, minlength=len(ids_a)),
        }

    def _render(self, a, b, group_a, group_b, group_bounds) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[np.cumsum(group_a) - 1] = 1
        last_b[np.cumsum(group_b) - 1] = 1
        of = np.concatenate((a + self.size_a * last_a, 2 * self.size_a + b + self.size_b * last_b))
        group = np.concatenate((2 * np.repeat(np.arange(len(group_a)), group_a), 2 * np.repeat(np.arange(len(group_b)), group_b) + 1))
        of = of[np.argsort(group, kind="stable")]
        tokens = np.concatenate(([0], np.cumsum(group_a + group_b)))[group_bounds]
        whole = regrouped(self.rendered.take(pa.array(of)), np.diff(tokens))
        return [x[:-1] for x in whole.to_pylist()]


def _filtered(ids: pa.Array, mask: pa.Array) -> pa.Array:
    return pa.concat_arrays([ids.filter(mask)])


def _numbers(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and where each value's begin and end."""
    data, offsets = raw(ids)
    return data[offsets[0] : offsets[-1]].view("<u4").astype(np.int64), (offsets - offsets[0]) // 4


def aligned(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, row (long, unique), the numbers and digest of TEXT_COLUMNS, and its distinct links.

    links: 64-bit keys a * (size of B + 1) + b, in order; times: 32-bit counts; both little-endian. A written table.
    """
    spark = df.sparkSession
    lexicon, shared_a = bpe._prepared(df, path_a, text_col, bpe.LEXICON_WORDS)
    shared_b = spark.sparkContext.broadcast(sentence_piece.prepared(path_b))
    held: list[Aligner] = []

    def run(batches):
        for batch in common.slices(batches, BATCH_ROWS, ALIGN_BYTES):
            a, b = bpe.worker_encoder(lexicon, shared_a), sentence_piece.worker_encoder(shared_b)
            if not held or held[0].a is not a or held[0].b is not b:
                held[:] = [Aligner(a, b)]
            has, ids_a, ids_b = held[0].encode(batch.column(2))
            found = held[0].align(ids_a, ids_b)
            columns = [batch.column(0), batch.column(1)]
            for name in ("n_a", "n_b", "n_groups", "n_links", "n_pairs"):
                all_rows = np.zeros(len(has), np.int64)
                all_rows[has] = found[name]
                columns.append(all_rows)
            digests = np.full(len(has), "", object)
            digests[has] = [hashlib.sha256(x).hexdigest() for x in found["groups"]]
            n_pairs = columns.pop()
            ends = np.concatenate(([0], np.cumsum(n_pairs)))
            links = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(has), [None, pa.py_buffer(8 * ends), pa.py_buffer(found["keys"].astype("<i8"))])
            columns = [*columns[:2], *map(pa.array, columns[2:]), pa.array(digests, pa.string()), links.cast(pa.binary()), as_binary(found["times"], n_pairs).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"])

    plain = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return common.written(plain.mapInArrow(run, f"id {kind}, row long, {TEXT_COLUMNS}, links binary, times binary"), "aligned").withColumnRenamed("id", id_col)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """key (long), n (long): its links in the corpus; best (int): 1 if no pair of the same B id has more. Written."""

    def partial(batches):
        keys, times = [], []

        def summed():
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.zeros(len(distinct), np.int64)
            np.add.at(totals, place, np.concatenate(times))
            keys[:], times[:] = [distinct], [totals]
            return distinct, totals

        for batch in common.slices(batches):
            links, n = (c.cast(pa.large_binary()) for c in batch.columns)
            keys.append(_flat(links, "<i8"))
            times.append(_flat(n, "<u4").astype(np.int64))
            if sum(map(len, keys)) > 4 * TASK_PAIRS and len((out := summed())[0]) > TASK_PAIRS:
                keys.clear(), times.clear()
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["key", "n"])
        if keys:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed())), names=["key", "n"])

    counts = found.select("links", "times").mapInArrow(partial, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = common.written(counts, "pair-counts").withColumn("b", F.expr(f"key % {size_b}"))
    # A row for each id of B: the vocabulary bounds what is broadcast.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return common.written(counts.join(F.broadcast(most), "b").selectExpr("key", "n", "int(n = most) as best"), "pairs")


def _flat(values: pa.Array, kind: str) -> np.ndarray:
    data, offsets = raw(values)
    return data[offsets[0] : offsets[-1]].view(kind)


def head_file(pairs: DataFrame, most: int) -> tuple[str, int, bool]:
    """The frequent pairs as a file for all executors: its name, their least count, and whether rarer ones are left."""
    # Counts in steps of a sixteenth of their power of two: a bounded histogram.
    step = F.expr("int(floor(16 * log2(n)))")
    total, least, rest = 0, None, False
    for row in sorted(pairs.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r.step):
        total += row.c
        if total > most:
            rest = True
            break
        least = row.n
    head = pairs.filter(F.lit(False) if least is None else F.col("n") >= least).toArrow().sort_by("key") if least is not None else None
    columns = [head.column(c).to_numpy().astype("<i8") for c in ("key", "n", "best")] if head is not None else [np.empty(0, "<i8")] * 3
    name = common.shared_file(pairs.sparkSession, "pairs.bin", np.array([len(columns[0])], "<i8").tobytes() + b"".join(c.tobytes() for c in columns))
    return name, least or 0, rest


_HEADS: dict[str, tuple[np.ndarray, ...]] = {}


def mapped_head(name: str) -> tuple[np.ndarray, ...]:
    """Keys in order, their counts, and which are best."""
    if name not in _HEADS:
        _HEADS.clear()
        with open(SparkFiles.get(name), "rb") as f:
            data = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), "<i8")
        _HEADS[name] = tuple(np.split(data[1:], 3)) if data[0] else (np.empty(0, np.int64),) * 3
    return _HEADS[name]


def in_head(keys: np.ndarray, head: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in the head, and which of them are there."""
    if not len(head[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(head[0], keys), len(head[0]) - 1)
    return at, head[0][at] == keys


def link_statistics(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """id_col, the columns of TEXT_COLUMNS, n_best and count_sum of every row."""
    found = aligned(docs, path_a, path_b, id_col, text_col)
    pairs = pair_counts(found, len(sentence_piece.Pieces(path_b).tokens))
    name, least, rest = head_file(pairs, head_pairs)
    kind = found.schema[id_col].dataType.simpleString()
    passed = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def by_head(batches):
        for batch in common.slices(batches):
            _, counts, best = head = mapped_head(name)
            links, times = (batch.column(c).cast(pa.large_binary()) for c in ("links", "times"))
            keys, n = _flat(links, "<i8"), _flat(times, "<u4").astype(np.int64)
            at, there = in_head(keys, head)
            values = [np.where(there, column[at] * n, 0) if len(counts) else np.zeros(len(keys), np.int64) for column in (best, counts)]
            bounds = np.concatenate(([0], np.cumsum(np.diff(raw(times)[1]) // 4)))
            sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[bounds])) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "row", *passed)] + sums, names=["id", "row", *passed, "n_best", "count_sum"])

    def rare(batches):
        for batch in common.slices(batches):
            links, times = (batch.column(c).cast(pa.large_binary()) for c in ("links", "times"))
            keys, rows = _flat(links, "<i8"), np.repeat(batch.column("row").to_numpy(), np.diff(raw(times)[1]) // 4)
            out = ~in_head(keys, mapped_head(name))[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(rows[out]), pa.array(_flat(times, "<u4").astype(np.int64)[out])], names=["key", "row", "times"])

    source = found.withColumnRenamed(id_col, "id")
    out = source.mapInArrow(by_head, f"id {kind}, row long, {TEXT_COLUMNS}, n_best long, count_sum long")
    if rest:
        links = source.select("row", "links", "times").mapInArrow(rare, "key long, row long, times long")
        tail = pairs.filter(F.col("n") < least) if least else pairs
        more = links.join(tail, "key").groupBy("row").agg(F.sum(F.expr("best * times")).alias("more_best"), F.sum(F.expr("n * times")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.expr("n_best + coalesce(more_best, 0)"), "count_sum": F.expr("count_sum + coalesce(more_sum, 0)")})
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers over every text of documents."""
    return link_statistics(common.table(spark, sf_dir, "documents"), bpe.default_vocabulary(), sentence_piece.default_model())
