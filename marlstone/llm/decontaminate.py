"""Benchmark decontamination by the q-gram lemma.

An item of m characters that stands in a text with at most e edits shares at least m + 1 - q * (e + 1) of its
q-grams with the text, and their diagonals (place in the text less place in the item) lie within e of each other.
The first stage looks up every q-gram of every whole text, counts distinct item q-grams in overlapping bands of
diagonals, of width 2 * (e + 1) and e + 1 apart, and retains the bands that meet the bound; none within the budget
is missed. The second stage, dealt out anew, verifies each region by banded alignment. The budget is a tenth of the
item's characters for every length: q is 8 for items of some 70 characters or more, and smaller for shorter ones, so
that the bound stays positive. Long texts are looked up in overlapping parts.

Texts and items are compared in lower case with white space as single blanks. The benchmark is the query set: it is
broadcast in blocks of bounded size, each against all texts; a block is let go when its matches are written.

Defined cases: null or empty texts and items match nothing; an item of less than ten characters has no budget, and one
shorter than q is searched for as it is; repeated items or rows are reported once for each pair of ids; of several
places with equally few edits the region that starts first is reported; matches of a row without id have a null id;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common, words

#: Lengths of q-grams, and the shared ones that an item's bound should be at least, if any length allows it.
GRAMS, ENOUGH = (8, 7, 6, 5, 4, 3, 2), 3
#: Edits allowed, in percent of the item's characters.
EDIT_PERCENT = 10
#: Characters of the benchmark that are broadcast at a time, and of a text that are looked up at a time.
BLOCK_CHARS, PART_CHARS = 1_000_000, 1 << 20
_TABLE_BITS = 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def gram_hashes(text: str, q: int) -> np.ndarray:
    return words.sequence_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), q)


def bound(length: int, edits: int, q: int) -> int:
    """The q-grams that a text shares with an item that stands in it with so many edits, at least."""
    return length + 1 - q * (edits + 1)


def gram_length(length: int, edits: int) -> int:
    """The longest q with a good bound, or else the longest with any."""
    for least in (ENOUGH, 1):
        for q in GRAMS:
            if q <= length and bound(length, edits, q) >= least:
                return q
    return 1


class Grams:
    """The q-grams of items of one q."""

    def __init__(self, q: int, numbers: list[int], texts: list[str], edits: np.ndarray):
        self.q, length = q, np.array([len(t) for t in texts], np.int64)
        self.numbers, self.edits = np.array(numbers, np.int64), edits
        self.least = bound(length, edits, q)
        self.fewest, self.longest = int(self.least.min()), int((length + 2 * edits).max())
        grams = [gram_hashes(t, q) for t in texts]
        counts = np.array([len(g) for g in grams], np.int64)
        item = np.repeat(np.arange(len(texts)), counts)
        place = np.concatenate([np.arange(n) for n in counts] + [np.empty(0, np.int64)]).astype(np.int64)
        every = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - _TABLE_BITS)] = True

    def regions(self, text: str) -> list[tuple[int, int, int]]:
        """(item, lowest and highest diagonal) of every band that meets its item's bound."""
        found, step = [], max(PART_CHARS, 2 * self.longest)
        for at in range(0, max(len(text) - self.longest, 0) + 1, step):
            part = text if len(text) <= step else text[at : at + step + self.longest]
            found += [(k, low + at, high + at) for k, low, high in self._part(part)]
        return found

    def _part(self, text: str) -> list[tuple[int, int, int]]:
        if len(text) < self.q:
            return []
        h = gram_hashes(text, self.q)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
        if len(at) < self.fewest:
            return []
        which = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        hit = self.grams[which] == h[at]
        at, which = at[hit], which[hit]
        if len(at) < self.fewest:
            return []
        n = self.count[which]
        entry = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, place = self.item[entry].astype(np.int64), self.place[entry].astype(np.int64)
        width = self.edits[item] + 1
        band = (np.repeat(at, n) - place) // width
        lowest = int(band.min()) - 1
        # A diagonal lies in two bands. Distinct places of an item's q-grams count.
        key = np.concatenate((band, band - 1)) - lowest
        item, place = np.tile(item, 2), np.tile(place, 2)
        span, longest = int(key.max()) + 1, int(place.max()) + 1
        pair = np.unique((item * span + key) * longest + place) // longest
        pair, count = np.unique(pair, return_counts=True)
        item, band = pair // span, pair % span + lowest
        good = count >= self.least[item]
        item, band = item[good], band[good]
        return [(k, b * w, (b + 2) * w - 1) for k, b, w in zip(self.numbers[item].tolist(), band.tolist(), (self.edits[item] + 1).tolist())]


class Items:
    """A block of items, and their q-grams."""

    def __init__(self, items: list[tuple[int, str]], edit_percent: int):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.edits = np.array([len(t) * edit_percent // 100 for t in self.texts], np.int64)
        by_length: dict[int, list[int]] = {}
        for k, (t, e) in enumerate(zip(self.texts, self.edits.tolist())):
            by_length.setdefault(GRAMS[0] if not e else gram_length(len(t), e), []).append(k)
        self.short = [k for k in by_length.get(GRAMS[0], []) if len(self.texts[k]) < GRAMS[0]]
        long = {q: [k for k in own if len(self.texts[k]) >= q] for q, own in by_length.items()}
        self.grams = [Grams(q, own, [self.texts[k] for k in own], self.edits[own]) for q, own in long.items() if own]

    def regions(self, text: str) -> list[tuple[int, int, int]]:
        """(item, lowest and highest diagonal) of every band that meets its item's bound."""
        found = [(k, at, at) for k in self.short if (at := text.find(self.texts[k])) >= 0]
        for own in self.grams:
            found += own.regions(text)
        return found


def banded_edits(item: str, region: str, most: int) -> int | None:
    """Fewest edits from the item to any part of the region, if at most `most`.

    The alignment may begin anywhere in the region's first characters; the cells of each row are those of the
    band of diagonals that the region's length leaves.
    """
    if item in region:
        return 0
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (item, region))
    width = max(len(b) - len(a), 0) + 2 * most + 1
    # Column k of row i is the cell after i characters of the item and i + k - most of the region.
    steps = np.arange(width)
    far = len(a) + len(b) + 1
    row = np.where((steps >= most) & (steps - most <= len(b)), 0, far)
    padded = np.concatenate((np.full(most + 1, 0xFFFFFFFF, np.uint32), b, np.full(width + len(a), 0xFFFFFFFF, np.uint32)))
    for i in range(1, len(a) + 1):
        across = row + (padded[i : i + width] != a[i - 1])
        down = np.append(row[1:], far) + 1
        row = np.minimum(across, down)
        column = steps + i - most
        row[(column < 0) | (column > len(b))] = far
        row = np.minimum.accumulate(row - steps) + steps
        if row.min() > most:
            return None
    return int(row.min())


def _scan(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    arrow = {"id": None, "item": pa.int64(), "start": pa.int64(), "region": pa.string()}

    def retain(batches):
        items = shared.value
        for batch in common.slices(batches):
            at, out = [], {"item": [], "start": [], "region": []}
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = normal(text)
                for k, low, high in items.regions(text):
                    e = int(items.edits[k])
                    start = max(0, low - e)
                    at.append(i)
                    out["item"].append(k)
                    out["start"].append(start)
                    out["region"].append(text[start : high + len(items.texts[k]) + e])
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[c], arrow[c]) for c in out)], names=["id", *out])

    def verify(batches):
        items = shared.value
        for batch in common.slices(batches):
            keep, edits = [], []
            for k, region in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                found = banded_edits(items.texts[k], region, int(items.edits[k]))
                keep.append(found is not None)
                edits.append(found)
            ids = pa.array([items.ids[k] for k in batch.column(1).to_pylist()], pa.int64())
            whole = pa.RecordBatch.from_arrays([batch.column(0), ids, batch.column(2), pa.array(edits, pa.int64())], names=["id", "item_id", "start", "edits"])
            yield whole.filter(pa.array(keep, pa.bool_()))

    regions = plain.mapInArrow(retain, f"id {kind}, item long, start long, region string")
    # Regions of one text or item do not stay together.
    dealt = regions.repartition(F.xxhash64("item", "start", "region"))
    return dealt.mapInArrow(verify, f"id {kind}, item_id long, start long, edits long")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_percent: int = EDIT_PERCENT) -> DataFrame:
    """id_col, item_id, edits (the fewest), start (of the region, in the normal form of the text), for each pair."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("length(trim(text)) > 0")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CHARS))
    found = None
    for block in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = Items([(r.item_id, normal(r.text)) for r in own.collect() if normal(r.text)], edit_percent)
        shared = docs.sparkSession.sparkContext.broadcast(held)
        part = common.written(_scan(docs, shared, id_col, text_col), "decontamination")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct("edits", "start"))
    return found.groupBy("id", "item_id").agg(best.alias("best")).select(F.col("id").alias(id_col), "item_id", "best.edits", "best.start")


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
