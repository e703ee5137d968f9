"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every document becomes the set of its word shingles, hashed once. Documents with equal sets form a class;
   a class has one sketch, the k smallest hashes.
2. Inverted lists of retained values generate the pairs. Two sets at or above the similarity share at least
   `overlap` of their retained values (exactly so when the sketch is the whole set, else but for a chance of
   about 1e-8), so it suffices that the lists hold, of each sketch, the size - overlap + 1 values that are
   rarest in the corpus: what very many documents share stays out, unless they share most of their text.
3. A union sketch estimates each pair's similarity; pairs far below the threshold go.
4. Full sets verify the others. Links join classes into components.
Pairs are generated in rounds, for in the end only the components count: first each list's members with its
smallest member; then, while that joins many, the members of long lists with a member drawn by its hash; then all
pairs of short lists that still cross components. Members of long lists that still cross components are compared
in blocks, set by set, by exact intersection counts: each block with itself first, then with the others; blocks of
the largest component are not compared with each other. A block emits the links of a spanning forest, fewer than
it has components. So no pairs of a large group are ever rows, nothing is capped, and no link between different
components is lost.

The retained values decide twice by chance, both times far off the threshold: that two similar sets share fewer than
half of their k values (about 1e-8), and that a union sketch is DEVIATIONS standard deviations low (under 1e-8).

Defined cases: a document without words (null, empty, white space) has the empty set and no link; repeated rows
and rows that share an id are documents of their own with that id; a row without id takes part, gives no
component its id, and is kept; ties are broken by the smallest id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import common, graph, words

#: Members of a list up to which all its pairs may be rows; longer lists are compared in blocks.
SHORT_LIST = 64
#: Sets in a block.
BLOCK = 512
#: A union sketch's estimate may be too low by so many standard deviations.
DEVIATIONS = 6
#: Of each class, so many of its long lists are drawn in a round; a round that joins fewer than this share is the last.
DRAWN_LISTS, WORTHWHILE = 3, 0.1


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, k: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, n (size of the set), cid (binary: digest of the set; null if it is empty), sketch (array<long>), and the extra columns."""

    def run(batches):
        for batch in common.slices(batches):
            sets = [words.shingle_set(words.hashes(words.split(t, lower=True)), size) for t in batch.column(1).to_pylist()]
            lows = [s[:k] for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lows]))).astype(np.int32)
            values = np.concatenate([*lows, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    *batch.columns[2:],
                ],
                names=["id", "n", "cid", "sketch", *extra],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *extra)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return plain.mapInArrow(run, f"id long, n long, cid binary, sketch array<long>{kinds}")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """cls, shingles (binary: sorted int64) of the wanted classes(cls, cid, id): one of their documents is read."""

    def run(batches):
        for batch in common.slices(batches):
            sets = [words.shingle_set(words.hashes(words.split(t, lower=True)), size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["id", "cid", "shingles"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    plain = plain.join(wanted.select(F.col("id").alias("wanted_id")), F.expr("id <=> wanted_id"), "left_semi")
    sets = plain.mapInArrow(run, "id long, cid binary, shingles binary")
    return sets.join(wanted.select("cls", "cid"), "cid").dropDuplicates(["cls"]).select("cls", "shingles")


def postings(classes: DataFrame, similarity: int, k: int) -> DataFrame:
    """cls, n, v (retained value), df (classes that retain it): the lists that generate pairs."""
    values = classes.select("cls", "n", F.explode("sketch").alias("v"))
    shared = common.written(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "near-shared")
    own = values.join(shared, "v").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("own"))
    # At most k values a class. Below k * similarity the sketch of either set of a pair is the whole set.
    size, least = F.least(F.col("n"), F.lit(k)), k // 2
    overlap = F.when(100 * F.col("n") <= k * similarity, F.ceil(F.col("n") * similarity / 100)).otherwise(least)
    length = (size - overlap + 1 - (size - F.size("own"))).cast("int")
    own = own.withColumn("length", length).filter("length > 0")
    listed = own.select("cls", "n", F.explode(F.slice("own", 1, F.col("length"))).alias("x"))
    return common.written(listed.select("cls", "n", "x.v", "x.df"), "near-lists")


def verified(pairs: DataFrame, classes: DataFrame, sets_of, similarity: int, k: int) -> DataFrame:
    """Of pairs(a, b), those whose estimate and then full sets reach the similarity."""
    left = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"))
    share = similarity / 100
    low = share - DEVIATIONS * (share * (1 - share) / k) ** 0.5

    def estimate(batches):
        for batch in common.slices(batches):
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = np.sort(np.concatenate((a, b)))
                equal = both[1:] == both[:-1]
                distinct = both[np.concatenate(([True], ~equal))][:k]
                # Of the union's k smallest, how many are in both sketches. Whole sets bound it exactly.
                keep.append((both[:-1][equal] <= distinct[-1]).sum() >= low * len(distinct))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long")
    near = common.written(near, "near-pairs")

    def exact(batches):
        for batch in common.slices(batches, 64):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = sets_of(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return near.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(exact, "a long, b long")


def crossing(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists, with comp, that members of more than one component stand in."""
    with_comp = lists.join(labels, lists.cls == labels.node, "left").select(*lists.columns, F.coalesce("comp", "cls").alias("comp"))
    with_comp = common.written(with_comp, "near-labelled")
    several = with_comp.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("v")
    return common.written(with_comp.join(common.written(several, "near-crossing"), "v", "left_semi"), "near-open")


def sizes_fit(n: str, m: str, similarity: int) -> str:
    return f"100 * least({n}, {m}) >= {similarity} * greatest({n}, {m})"


def drawn_links(lists: DataFrame, draw: int, similarity: int, check) -> DataFrame:
    """a, b: links of classes with members, drawn by their hash, of a few of their lists."""
    order = F.row_number().over(Window.partitionBy("cls").orderBy(F.xxhash64("v", F.lit(draw))))
    few = common.written(lists.withColumn("_order", order).filter(F.col("_order") <= DRAWN_LISTS).drop("_order"), "near-drawn")
    centres = few.groupBy("v").agg(F.min_by(F.struct("cls", "n", "comp"), F.xxhash64("v", "cls")).alias("c"))
    pairs = few.join(common.written(centres, "near-centres"), "v").filter("comp <> c.comp").filter(sizes_fit("n", "c.n", similarity))
    return check(pairs.select(F.col("c.cls").alias("a"), F.col("cls").alias("b")).distinct())


def spanning(linked: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Of the linked pairs of rows, those of a spanning forest of their components."""
    names, of = np.unique(comp, return_inverse=True)
    edge = np.full((len(names), len(names)), -1, np.int64)
    i, j = np.nonzero(linked)
    edge[of[i], of[j]] = i * len(comp) + j
    unseen, found = np.ones(len(names), bool), []
    for root in range(len(names)):
        todo = [root] if unseen[root] else []
        unseen[root] = False
        while todo:
            at = todo.pop()
            fresh = np.flatnonzero((edge[at] >= 0) & unseen)
            unseen[fresh] = False
            todo += fresh.tolist()
            found += [divmod(int(e), len(comp)) for e in edge[at, fresh]]
    return found


def block_links(lists: DataFrame, sets_of, similarity: int, own: bool) -> DataFrame:
    """a, b: links that join the components of classes which stand in the same long lists, compared in blocks.

    own: each block with itself alone.
    """
    smallest = lists.groupBy("v").agg(F.min("cls").alias("b"))
    together = lists.join(common.written(smallest, "near-long"), "v").select(F.col("cls").alias("a"), "b")
    cluster = graph.components(together.distinct(), "near-cluster").toDF("cls", "cluster")
    members = lists.select("cls", "n", "comp").distinct().join(cluster, "cls")
    counts = members.groupBy("cluster", "comp").agg(F.count("*").alias("m"))
    per = counts.groupBy("cluster").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("main_m"), F.sum("m").alias("m"))
    members = members.join(per, "cluster")
    # Blocks 0, 1, ... hold the smaller components' classes, blocks -1, -2, ... those of the largest one.
    others = F.ceil((F.col("m") - F.col("main_m")) / BLOCK).cast("int")
    mains = F.ceil(F.col("main_m") / BLOCK).cast("int")
    at = F.when(F.col("comp") == F.col("main"), -1 - F.pmod(F.xxhash64("cls"), mains)).otherwise(F.pmod(F.xxhash64("cls"), others)).cast("int")
    members = members.withColumn("at", at).withColumn("others", others).withColumn("mains", mains)
    with_other = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.greatest("at", o).alias("hi"), F.least("at", o).alias("lo")))
    with_main = F.transform(F.sequence(F.lit(1), F.col("mains")), lambda o: F.struct(F.col("at").alias("hi"), (-o).alias("lo")))
    pairs = F.when(F.col("at") < 0, with_other).otherwise(F.array_union(with_other, with_main))
    if own:
        members, pairs = members.filter("at >= 0"), F.array(F.struct(F.col("at").alias("hi"), F.col("at").alias("lo")))
    members = members.filter("others > 0").select("cluster", "cls", "comp", "at", F.explode(pairs).alias("pair"))
    members = common.written(members.select("cluster", "cls", "comp", "at", "pair.hi", "pair.lo"), "near-blocks")
    sets = sets_of(members.select("cls").distinct())

    def compare(table: pa.Table) -> pa.Table:
        cls, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
        at, hi, lo = (table.column(x).to_numpy() for x in ("at", "hi", "lo"))
        sets = [np.frombuffer(x, np.int64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets])
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Columns of the values that at least two of the sets have.
        place = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[column]
        row, rows, columns = np.repeat(np.arange(len(sets)), n), len(sets), int((seen > 1).sum())
        shared = np.zeros((rows, rows), np.float32)
        for start in range(0, columns, 4096):
            matrix = np.zeros((rows, min(4096, columns - start)), np.float32)
            inside = (place >= start) & (place < start + 4096)
            matrix[row[inside], place[inside] - start] = 1
            # Counts below 2**24 are exact in these numbers.
            shared += matrix @ matrix.T
        shared = shared.astype(np.int64)
        linked = 100 * shared >= similarity * (n[:, None] + n[None, :] - shared)
        if hi[0] != lo[0]:
            across = (at == hi[0])[:, None] & (at == lo[0])[None, :]
            linked &= across | across.T
        linked &= comp[:, None] != comp[None, :]
        found = spanning(linked, comp)
        common.release_memory()
        return pa.table({"a": pa.array([cls[x] for x, _ in found], pa.int64()), "b": pa.array([cls[y] for _, y in found], pa.int64())})

    return members.join(sets, "cls").groupBy("cluster", "hi", "lo").applyInArrow(compare, "a long, b long")


def grouped_classes(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: int, k: int, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, with the extra columns; and cid, id (the smallest), comp of every class."""
    rows = common.written(sketches(docs, id_col, text_col, size, k, extra), "near-rows")
    grouped = rows.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = common.written(grouped.select(F.monotonically_increasing_id().alias("cls"), "*"), "near-classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = classes.select("cls", "cid", "id").join(wanted, "cls", "left_semi")
        return common.written(full_sets(docs, common.written(chosen, "near-wanted"), id_col, text_col, size), "near-sets")

    lists = postings(classes, similarity, k)
    links: list[DataFrame] = []

    def check(pairs: DataFrame) -> DataFrame:
        return verified(pairs, classes, sets_of, similarity, k)

    def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
        """The components with these links too."""
        more = common.written(more, "near-links")
        if more.isEmpty():
            return labels
        links.append(more)
        return graph.components(reduce(DataFrame.union, links), "near")

    stars = common.written(lists.groupBy("v").agg(F.min(F.struct("cls", "n")).alias("first")), "near-stars")
    pairs = lists.join(stars, "v").filter("cls <> first.cls").filter(sizes_fit("n", "first.n", similarity))
    links.append(common.written(check(pairs.select(F.col("first.cls").alias("a"), F.col("cls").alias("b")).distinct()), "near-links"))
    labels = graph.components(links[0], "near")

    lists = crossing(lists, labels)
    is_long = F.col("df") > SHORT_LIST
    rest, draw = lists.filter(is_long).count(), 0
    while rest:
        labels = joined(labels, drawn_links(lists.filter(is_long), draw, similarity, check))
        lists = crossing(lists.drop("comp"), labels)
        left, draw = lists.filter(is_long).count(), draw + 1
        if rest - left < WORTHWHILE * rest:
            break
        rest = left

    short = lists.filter(~is_long).groupBy("v").agg(F.collect_list(F.struct("cls", "n", "comp")).alias("l"))
    pairs = short.select("l", F.explode("l").alias("x")).select("x", F.explode(F.filter("l", lambda y: (y.cls > F.col("x.cls")) & (y.comp != F.col("x.comp")))).alias("y"))
    pairs = pairs.filter(sizes_fit("x.n", "y.n", similarity)).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    labels = joined(labels, check(pairs))

    lists = lists.filter(is_long)
    for own in (True, False):
        if not lists.isEmpty():
            lists = crossing(lists.drop("comp"), labels)
        if not lists.isEmpty():
            labels = joined(labels, block_links(lists, sets_of, similarity, own))

    named = classes.join(labels, classes.cls == labels.node, "left").select("cid", "id", F.coalesce("comp", "cls").alias("comp"))
    return rows, common.written(named, "near-named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: int = 80, k: int = 64) -> DataFrame:
    """id_col, n_shingles, component_id, kept of every row; similarity is a percentage of at least 60."""
    rows, named = grouped_classes(docs, id_col, text_col, size, similarity, k)
    smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = common.written(named.join(smallest, "comp").select("cid", "component_id"), "near-components")
    out = rows.select("id", "n", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def surplus_rows(docs: DataFrame, tie_col: str, row_col: str, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: int = 80, k: int = 64) -> DataFrame:
    """row_col of all rows of each component but one: that with the smallest id (null last), tie_col and row_col.

    row_col tells rows apart and must be the same whenever docs is read; rows without words are in no component.
    """
    rows, named = grouped_classes(docs, id_col, text_col, size, similarity, k, (tie_col, row_col))
    rows = rows.filter("cid is not null")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col(tie_col).alias("tie"), F.col(row_col).alias("row"))
    of_class = rows.groupBy("cid").agg(F.min(order).alias("first"))
    survivors = named.join(of_class, "cid").groupBy("comp").agg(F.min("first").alias("first"))
    return rows.select(row_col).join(survivors.select(F.col("first.row").alias(row_col)), row_col, "left_anti")


def op5_bottom_k_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=4, similarity=80)
