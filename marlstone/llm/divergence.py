"""How far the sources of a language differ in their words, by an inverted index of corrections.

p of a term in a group is its smoothed share in parts of SCALE; f(p, q) = floor((p - q)^2 / q). A pair (g, h) of sources
of one language would have V * f(z_g, z_h) if no term occurred in either, z being p of a count of zero. Terms correct
that: each posting (g, t) by f(p, z_h) - f(z_g, z_h), and the same from the side of h, which depends on the posting's count
alone, so that postings of one count are summed before they meet the other sources; and each term with both in its list
by f(p, q) - f(p, z_h) - f(z_g, q) + f(z_g, z_h). Terms that occur in neither source are never touched. All numbers are integers.

Defined cases: a null text, lang or source is ''; a group of rows without terms takes part with counts of zero;
a language whose terms are all too rare has V = 0 and pairs of value 0; rows are counted as documents whatever their
doc_id; a source alone in its language has no pairs; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import common
from marlstone.llm.bpe import raw

#: p is a share in parts of this.
SCALE = 1_000_000_000
#: Documents of its language that a term must be in.
LEAST_DOCS = 3
#: Terms that are reported for a source.
MOST_TERMS = 200
#: Distinct (group, term) that a task holds before it emits their counts.
TASK_TERMS = 300_000
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20

#: Of each byte: a-z for letters, a blank for other ASCII characters, itself otherwise.
_FOLDED = np.frombuffer(bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)), np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms (large binary) of the texts (large strings without nulls), and the text that each stands in."""
    data, offsets = raw(texts.cast(pa.large_binary()))
    data, offsets = _FOLDED[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.large_binary()), np.empty(0, np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    if not len(starts):
        return pa.array([], pa.large_binary()), starts
    # Terms and what stands between them, by turns.
    both = np.column_stack((starts, ends)).ravel()
    turns = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(both) - 1, [None, pa.py_buffer(both), pa.py_buffer(data)])
    return turns.take(pa.array(np.arange(0, len(both), 2))), np.searchsorted(offsets, starts, "right") - 1


def group_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (its occurrences), docs (rows with it); every group also has a row of term '' with zeros."""

    def of_batch(batch) -> pa.Table:
        lang, source, texts = (pc.fill_null(c.cast(pa.large_string()), "") for c in batch.columns)
        places: dict[tuple, int] = {}
        group = np.array([places.setdefault(k, len(places)) for k in zip(lang.to_pylist(), source.to_pylist())], np.int64)
        terms, text = terms_of(texts)
        coded = terms.dictionary_encode()
        names, size = coded.dictionary, max(len(coded.dictionary), 1)
        in_text, n = np.unique(text * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        keys, place = np.unique(group[in_text // size] * size + in_text % size, return_inverse=True)
        at = np.concatenate((keys // size, np.arange(len(places))))
        columns = [pa.array([k[i] for k in places], pa.string()).take(pa.array(at)) for i in (0, 1)]
        names = pa.concat_arrays([names.take(pa.array(keys % size)), pa.array([b""] * len(places), pa.large_binary())]).cast(pa.large_string()).cast(pa.string())
        zeros = np.zeros(len(places), np.int64)
        n, rows = (np.concatenate((np.bincount(place, w, len(keys)).astype(np.int64), zeros)) for w in (n, np.ones(len(n))))
        return pa.table({"lang": columns[0], "source": columns[1], "term": names, "n": n, "docs": rows})

    def partial(batches):
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            by = ["lang", "source", "term"]
            whole = pa.concat_tables(held).group_by(by).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*by, "n", "docs"])
            held[:] = [whole]
            return whole

        for batch in common.slices(batches, BATCH_ROWS, BATCH_BYTES):
            held.append(of_batch(batch))
            if sum(map(len, held)) > 2 * TASK_TERMS and len(whole := summed()) > TASK_TERMS:
                held.clear()
                yield from whole.to_batches(TASK_TERMS // 8)
        if held:
            yield from summed().to_batches(TASK_TERMS // 8)

    plain = docs.select(*(F.col(c).cast("string") for c in ("lang", "source", "text")))
    counts = plain.mapInArrow(partial, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(27, 0)) * cast({SCALE} as decimal(10, 0))) div cast({total} + {terms} as decimal(27, 0))")


def distance(p: str, q: str) -> str:
    """floor((p - q)^2 / q) of columns: at most SCALE^2."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value (long), rank (int): the pairs of sources, and each source's terms.

    Part `pair`: every other source of the language. Part `term`: the terms that are more frequent in the source than in
    the language, up to most_terms.
    """
    counts = common.written(group_counts(docs), "term-counts")
    real = counts.filter("term <> ''")
    kept = real.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    postings = common.written(real.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "postings")

    # A row for each group: what its terms' shares need.
    of_lang = postings.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    vocabulary = postings.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("v"))
    groups = counts.groupBy("lang", "source").agg(F.lit(0).alias("none"))
    groups = groups.join(postings.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(of_lang.join(vocabulary, "lang"), "lang", "left").fillna(0).drop("none")
    groups = common.written(groups.withColumn("z", F.when(F.col("v") > 0, share("0", "total", "v"))), "groups")

    shares = postings.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    shares = common.written(shares.withColumn("q", share("lang_n", "lang_total", "v")).select("lang", "source", "term", "p", "q", "z", "n"), "shares")

    g = groups.select("lang", "source", "v", F.col("z").alias("zg"))
    h = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zh"))
    zeros = g.join(h, "lang").filter("source <> item")
    base = zeros.select("lang", "source", "item", F.expr(f"coalesce(v * ({distance('zg', 'zh')}), 0)").alias("value"))
    # Postings of one share, counted; by their side.
    same = common.written(shares.groupBy("lang", "source", "p", F.col("z")).agg(F.count("*").alias("m")), "same-shares")
    first = same.withColumnRenamed("z", "zg").join(h, "lang").filter("source <> item")
    first = first.select("lang", "source", "item", F.expr(f"m * ({distance('p', 'zh')} - {distance('zg', 'zh')})").alias("value"))
    second = same.toDF("lang", "item", "ph", "zh", "m").join(g.drop("v"), "lang").filter("source <> item")
    second = second.select("lang", "source", "item", F.expr(f"m * ({distance('zg', 'ph')} - {distance('zg', 'zh')})").alias("value"))
    # Terms with both sources in their lists: no list is longer than the sources are many.
    left = shares.select("lang", "term", "source", F.col("p").alias("pg"), F.col("z").alias("zg"))
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("ph"), F.col("z").alias("zh"))
    joint = f"{distance('pg', 'ph')} - {distance('pg', 'zh')} - {distance('zg', 'ph')} + {distance('zg', 'zh')}"
    joint = left.join(right, ["lang", "term"]).filter("source <> item").select("lang", "source", "item", F.expr(joint).alias("value"))
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (base, first, second, joint)]
    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    terms = shares.filter("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    ranked[1] = ranked[1].filter(F.col("rank") <= most_terms)
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in zip(("pair", "term"), ranked)]
    return out[0].unionByName(out[1])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the sources of documents."""
    return audit(common.table(spark, sf_dir, "documents"))
