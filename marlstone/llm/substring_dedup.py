"""Repeated word windows, found by a count-min prefilter and grouped exactly.

A window is `window` consecutive words of a text. Each window is represented by its anchor, the smallest hash
among its runs of `gram` words: equal windows have equal anchors at equal places, so an anchor's places are at
least as many as any of its windows' places. The first pass adds every place of every anchor to a count-min
sketch; the tasks' partial sketches go to the merge as lists of the cells they touch, dealt by cell range. The
sketch's width grows with the input: a range is held by one task and has 2**32 cells for about SHARD_ANCHORS anchors,
so a window's count is overestimated for a few in ten thousand, and never underestimated.

The cells that reached two are what the second pass asks for. As bits under several hashes they are broadcast, sized
by their counted number, so that under one percent of the other anchors pass as well; if they are too many for that,
the texts' own cells are joined with them by a shuffle instead, and each text gets the list of its repeated cells.

The second pass keeps the runs of windows whose anchor the sketch estimates repeated. Equal runs are counted
first, so a passage in very many texts is one row per task. Only where an anchor has runs that differ (the ends
of a passage, or a false estimate) are single windows grouped, exactly, by window and anchor hash (128 bits).
The sketch bounds memory and time, not the result.

Defined cases: a null, empty or short text has no window and loses nothing; repeated rows are texts of their own,
so all their windows repeat; windows are judged on the input, so overlapping ones all count; ids may be null or
repeated, since texts are found again by their content; an empty table gives an empty result; other columns are
kept by `remove_repeats` and not read by the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common, words

#: Anchors of a range of the sketch, about; ranges at least and at most.
SHARD_ANCHORS, SHARDS = 1 << 20, (64, 1 << 16)
#: Bytes of a word with the blank after it, at least in most texts: for the first guess of the number of anchors.
WORD_BYTES = 4
#: Bits for each repeated cell, hashes of a cell, and (as a power of two) the most bits that are broadcast: 128 MB.
CELL_BITS, HASHES, MOST_BITS = 12, 4, 30
#: Words of a text that are held as numbers at a time, and anchors of a task before they go to the merge.
CHUNK_WORDS = 1 << 20
TASK_ANCHORS = 1 << 21
_SEEDS = [np.uint64(words.xxhash.xxh3_64_intdigest(f"row {i}")) for i in range(HASHES)]
#: Ranges of the broadcast bits, each made by one task.
_PARTS_BITS = 6


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each `width` consecutive values."""
    step = 1
    while step * 2 <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def gram_size(window: int) -> int:
    return max(1, window * 4 // 7)


def anchors(word_hashes: np.ndarray, window: int, places: bool) -> np.ndarray:
    """Each window's anchor; or, with places, the anchors' values once for each place that is one."""
    gram = gram_size(window)
    grams, span = words.sequence_hashes(word_hashes, gram), window - gram + 1
    least = _sliding(np.minimum, grams, span)
    if not places:
        return least
    edge = np.zeros(span - 1, np.uint64)
    return grams[_sliding(np.maximum, np.concatenate((edge, least, edge)), span) == grams]


def chunks(text: str | None, window: int):
    """(place of the first word, hashes of the words) of parts that together hold each window once."""
    parts = words.split(text)
    for at in range(0, max(len(parts) - window + 1, 0), CHUNK_WORDS):
        yield at, words.hashes(parts[at : at + CHUNK_WORDS + window - 1])


def cells(anchor: np.ndarray, shards: int) -> np.ndarray:
    """The anchors' cells: range << 32 | cell of the range."""
    h = words.mix(anchor ^ np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def shard_count(texts: DataFrame, window: int) -> int:
    """Ranges for the anchors that texts of so many bytes have, about."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    anchors_ = size / WORD_BYTES * 2 / (window - gram_size(window) + 2)
    return int(min(max(anchors_ // SHARD_ANCHORS + 1, SHARDS[0]), SHARDS[1]))


def sketch(texts: DataFrame, window: int, shards: int) -> DataFrame:
    """shard, cells (binary: sorted unsigned 32-bit integers): the cells of the merged sketch that reached two."""

    def partial(batches):
        held: list[np.ndarray] = []

        def emit():
            cell = np.sort(cells(np.concatenate(held), shards))
            held.clear()
            # Of more than two places in a cell, two say as much.
            cell = cell[np.concatenate((np.ones(min(2, len(cell)), bool), cell[2:] != cell[:-2]))]
            shard = (cell >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), shard[1:] != shard[:-1])))
            parts = np.split(cell.astype(np.uint32), starts[1:]) if len(cell) else []
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard[starts], pa.int32()), "cells": pa.array([p.tobytes() for p in parts], pa.binary())})

        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                for _, hashes in chunks(text, window):
                    held.append(anchors(hashes, window, places=True))
            if sum(map(len, held)) > TASK_ANCHORS:
                yield from emit()
        if held:
            yield from emit()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.empty(0, np.uint32), np.empty(0, np.uint32)
        for batch in batches:
            parts = [np.frombuffer(p, np.uint32) for p in batch.column("cells").to_pylist()]
            seen, count = np.unique(np.concatenate((seen, *parts)), return_counts=True)
            twice = np.union1d(twice, seen[count > 1])
        common.release_memory()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([twice.tobytes()], pa.binary())})

    merged = texts.select("text").mapInArrow(partial, "shard int, cells binary").groupBy("shard").applyInArrow(merge, "shard int, cells binary")
    return common.written(merged, "repeat-sketch")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The cells of rows of a sketch, as `cells` gives them."""
    parts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    return np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(c, np.uint32).astype(np.uint64) | np.uint64(s << 32) for s, c in parts)])


def places(key: np.ndarray, row: int, bits: int) -> np.ndarray:
    return words.mix(key ^ _SEEDS[row]) & np.uint64((1 << bits) - 1)


def bit_map(repeated: DataFrame, bits: int) -> np.ndarray:
    """The repeated cells as 2**bits bits."""
    width = bits - _PARTS_BITS

    def spread(batches):
        for batch in common.slices(batches, 1):
            key = _keys(batch)
            at = np.unique(np.concatenate([places(key, row, bits) for row in range(HASHES)]))
            parts = np.split(at, np.searchsorted(at, np.arange(1, 1 << _PARTS_BITS, dtype=np.uint64) << np.uint64(width)))
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(1 << _PARTS_BITS), pa.int32()), "at": pa.array([(p & np.uint64((1 << width) - 1)).astype(np.uint32).tobytes() for p in parts], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << width, bool)
        for batch in batches:
            for part in batch.column("at").to_pylist():
                found[np.frombuffer(part, np.uint32)] = True
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

    whole, size = np.zeros(1 << bits - 3, np.uint8), 1 << width - 3
    for part, own in repeated.mapInArrow(spread, "part int, at binary").groupBy("part").applyInArrow(merge, "part int, bits binary").toLocalIterator():
        whole[part * size : (part + 1) * size] = np.frombuffer(own, np.uint8)
    return whole


def estimated_repeated(bit_map: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which cells have all their bits."""
    found = np.ones(len(key), bool)
    for row in range(HASHES):
        at = places(key, row, int(len(bit_map)).bit_length() + 2)
        found &= (bit_map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def with_cells(texts: DataFrame, window: int, shards: int, repeated: DataFrame) -> DataFrame:
    """digest, text, cells: the repeated cells of each text, by a shuffle of all texts' cells."""

    def own(batches):
        for batch in common.slices(batches):
            of, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                key = [np.unique(cells(anchors(hashes, window, places=True), shards)) for _, hashes in chunks(text, window)]
                found += key
                of += [np.full(len(k), i) for k in key]
            of, found = (np.concatenate([*x, np.empty(0, kind)]).astype(kind) for x, kind in ((of, np.int64), (found, np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(found.view(np.int64))], names=["digest", "cell"])

    def flat(batches):
        for batch in common.slices(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(_keys(batch).view(np.int64))], names=["cell"])

    pairs = texts.select("digest", "text").mapInArrow(own, "digest binary, cell long")
    marked = pairs.join(repeated.mapInArrow(flat, "cell long"), "cell", "left_semi")
    listed = common.written(marked.groupBy("digest").agg(F.collect_set("cell").alias("cells")), "repeat-cells")
    return texts.join(listed, "digest")


def runs(texts: DataFrame, window: int, shards: int, bits=None) -> DataFrame:
    """digest, start, anchor, key, inner, windows: runs of windows with one anchor, where it is estimated repeated.

    The estimate is by the broadcast bits, or by the texts' column `cells`.
    windows: the windows' hashes; key: a hash of them all; inner: one of them repeats in the run itself.
    """

    def run(batches):
        for batch in common.slices(batches):
            out: dict[str, list] = {x: [] for x in ("digest", "start", "anchor", "key", "inner", "windows")}
            lists = batch.column(2).to_pylist() if bits is None else [None] * batch.num_rows
            for digest, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists):
                for at, hashes in chunks(text, window):
                    anchor = anchors(hashes, window, places=False)
                    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
                    key = cells(anchor[first], shards)
                    keep = np.isin(key.view(np.int64), own) if bits is None else estimated_repeated(bits.value, key)
                    if not keep.any():
                        continue
                    whole = words.sequence_hashes(hashes, window).view(np.int64)
                    last = np.append(first[1:], len(anchor))
                    for a, b in zip(first[keep].tolist(), last[keep].tolist()):
                        part = whole[a:b]
                        out["digest"].append(digest)
                        out["start"].append(at + a)
                        out["anchor"].append(int(anchor[a].view(np.int64)))
                        out["key"].append(words.xxhash.xxh3_64_intdigest(part.tobytes()) - (1 << 63))
                        out["inner"].append(len(part) > 1 and len(np.unique(part)) < len(part))
                        out["windows"].append(part)
            kinds = {"digest": pa.binary(), "start": pa.int64(), "anchor": pa.int64(), "key": pa.int64(), "inner": pa.bool_(), "windows": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({x: pa.array(v, kinds[x]) for x, v in out.items()})

    return texts.select("digest", "text", *([] if bits else ["cells"])).mapInArrow(run, "digest binary, start long, anchor long, key long, inner boolean, windows array<long>")


def digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def repeated_spans(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """digest (of a text), spans: the places [from, to) of its words that a repeated window covers."""
    texts = docs.select(digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    shards = shard_count(texts, window)
    repeated = sketch(texts, window, shards)
    n = repeated.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0] // 4
    bits = max((n * CELL_BITS).bit_length(), 16)
    if bits <= MOST_BITS:
        shared = docs.sparkSession.sparkContext.broadcast(bit_map(repeated, bits))
        found = common.written(runs(texts, window, shards, shared), "repeat-runs")
        shared.unpersist()
    else:
        found = common.written(runs(with_cells(texts, window, shards, repeated), window, shards), "repeat-runs")

    same = ["anchor", "key"]
    distinct = found.groupBy(*same).agg(F.count("*").alias("c"), F.max("inner").alias("inner"), F.first("windows").alias("windows"))
    distinct = common.written(distinct, "repeat-distinct")
    differ = distinct.groupBy("anchor").agg(F.count("*").alias("d"), F.max("inner").alias("inner")).filter("d > 1 or inner").select("anchor")
    each = distinct.join(common.written(differ, "repeat-differ"), "anchor", "left_semi").select(*same, "c", F.posexplode("windows").alias("at", "w"))
    each = common.written(each, "repeat-windows")
    twice = common.written(each.groupBy("anchor", "w").agg(F.sum("c").alias("c")).filter("c > 1").select("anchor", "w"), "repeat-twice")
    single = each.filter("c = 1").join(twice, ["anchor", "w"], "left_semi").groupBy(*same)
    single = single.agg(F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))).alias("ranges"))
    whole = distinct.filter("c > 1").select(*same, F.array(F.struct(F.lit(0).alias("lo"), F.size("windows").alias("hi"))).alias("ranges"))
    flagged = common.written(whole.unionByName(single), "repeat-flagged")

    spans = F.transform("ranges", lambda r: F.struct((F.col("start") + r.lo).alias("a"), (F.col("start") + r.hi - 1 + window).alias("b")))
    hits = found.select("digest", "start", *same).distinct().join(flagged, same).select("digest", spans.alias("spans"))
    return hits.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(n: int, spans) -> np.ndarray:
    """Which of n words the spans cover."""
    change = np.zeros(n + 1, np.int64)
    for span in spans or ():
        change[span["a"]] += 1
        change[span["b"]] -= 1
    return np.cumsum(change[:n]) > 0


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 50) -> DataFrame:
    """docs without the words that a repeated window covers, with n_words, n_removed and kept_words.

    text_col loses the removed words and the white space after each; other text stays as it is. kept_words are
    the kept words joined by one blank. Columns of these names in docs are replaced.
    """
    spans = common.written(repeated_spans(docs, text_col, window), "repeat-spans").toDF("_digest", "_spans")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_words", "_digest", "_spans")]
    kept = docs.select(*names, digest(text_col).alias("_digest")).join(spans, "_digest", "left").drop("_digest")
    schema = docs.select(*names).schema
    at, last = names.index(text_col), len(names)

    def run(batches):
        for batch in common.slices(batches):
            counts, removed, joined, texts = [], [], [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()):
                parts = words.split(text)
                counts.append(len(parts))
                if not found:
                    removed.append(0)
                    texts.append(text)
                    joined.append(b" ".join(parts).decode())
                    continue
                gone = covered(len(parts), found)
                removed.append(int(gone.sum()))
                joined.append(b" ".join([w for w, g in zip(parts, gone.tolist()) if not g]).decode())
                starts = [m.start() for m in _WORD.finditer(text)]
                # The white space after a word goes with it.
                stay = [text[x:y] for x, y, g in zip(starts, [*starts[1:], len(text)], gone.tolist()) if not g]
                texts.append(text[: starts[0]] + "".join(stay))
            columns = [batch.column(i) for i in range(last)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(joined, pa.string())], names=[*names, "n_words", "n_removed", "kept_words"])

    out = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in schema)
    return kept.mapInArrow(run, f"{out}, n_words long, n_removed long, kept_words string")


def op8_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))
