"""Text processing: chunks, summaries, repository digests, code metadata, JSON repair."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import code, json_text
from marlstone.functions import text as X
from marlstone.sources.shared import short_batches


def chunk_bounds(costs: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks as [from, to): each as long as `size` allows, by sums of the costs before each place.

    What costs more than `size` is a chunk of its own. Any other chunk but the first after such a one begins with up to
    `overlap` members of the chunk before, and has at least one more.
    """
    before = [0, *accumulate(costs)]
    alone = [i for i, c in enumerate(costs) if c > size]
    bounds: list[tuple[int, int]] = []
    start = new = 0
    while new < len(costs):
        if alone and alone[0] == new:
            start, end = new, alone.pop(0) + 1
        else:
            room = bisect_right(before, before[start] + size) - 1
            end = min(max(room, new + 1), alone[0] if alone else len(costs))
        bounds.append((start, end))
        reset = end - 1 == start and costs[start] > size or bool(alone) and alone[0] == end
        start, new = end if reset else max(start, end - overlap), end
    return bounds


def chunk_sentences(sentences: list[str], size: int, overlap: int | None = None, cost: Callable[[str], int] = lambda s: len(s.split())) -> list[list[str]]:
    """The sentences in chunks; the default overlap is a twentieth of them, at least one."""
    return [sentences[a:b] for a, b in _bounds(list(map(cost, sentences)), size, overlap)]


def _bounds(costs: list[int], size: int, overlap: int | None) -> list[tuple[int, int]]:
    return chunk_bounds(costs, size, max(1, len(costs) // 20) if overlap is None else overlap)


#: Texts of which a task of `chunks` holds the sentences as Python objects.
CUT_ROWS = 64


def chunks(docs: DataFrame, size: int = 500, overlap: int | None = None, field: str = "text", key: str = "_key") -> DataFrame:
    """key, chunk_index, chunk, n_sentences of every document. Python holds the sentences of few texts at a time and returns places alone."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<start: int, n: int>>")
    def cut(parts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(parts), CUT_ROWS):
            costs = ([len(s.split()) for s in p or []] for p in parts.slice(at, CUT_ROWS).to_pylist())
            found += [[{"start": a + 1, "n": b - a} for a, b in _bounds(c, size, overlap)] for c in costs]
        return pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))

    parts = docs.select(key, X.sentences(field).alias("sentences")).withColumn("cut", cut("sentences"))
    # A text's chunks are made before they are dealt to rows, so that no row has all its sentences.
    made = F.transform("cut", lambda at: F.struct(F.concat_ws(" ", F.slice(F.col("sentences"), at["start"], at["n"])).alias("chunk"), at["n"].cast("long").alias("n_sentences")))
    each = parts.select(key, F.posexplode(made).alias("chunk_index", "c"))
    return each.select(key, F.col("chunk_index").cast("long"), "c.chunk", "c.n_sentences")


def lead_sentences(text: Column, n: int = 2) -> Column:
    """The summariser that needs no model: the first sentences."""
    return F.concat_ws(" ", F.slice(X.sentences(text), 1, n))


def summarise(docs: DataFrame, summariser: Callable[[Column], Column] = lead_sentences, direct_tokens: int = 3800, chunk_words: int = 500, depth: int = 3, field: str = "text", key: str = "_key") -> DataFrame:
    """key, summary: short texts directly, long ones chunk by chunk, until the joined summaries are short.

    At most `depth` rounds; what is still long then is cut to four characters a token.
    """
    now, done = docs.select(key, F.col(field).alias("t")), None
    for _ in range(depth):
        short = now.filter(F.coalesce(X.token_estimate("t"), F.lit(0)) <= direct_tokens).select(key, summariser(F.coalesce("t", F.lit(""))).alias("summary"))
        done = short if done is None else done.unionByName(short)
        parts = chunks(now.filter(X.token_estimate("t") > direct_tokens), chunk_words, 0, "t", key)
        mapped = parts.select(key, "chunk_index", summariser(F.col("chunk")).alias("s"))
        now = mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "s"))).alias("p")).select(key, F.concat_ws(" ", "p.s").alias("t"))
    rest = now.select(key, summariser(F.substring("t", 1, 4 * direct_tokens)).alias("summary"))
    return done.unionByName(rest)


def summary_budget(tokens: Column) -> Column:
    """Tokens that a summary may take."""
    return F.least(F.greatest(F.lit(100.0), 0.6 * tokens), F.lit(500.0)).cast("long")


def summary_check(similarity: Column, original: Column, summary: Column, expected: float, concepts: list[str], least: float = 0.7) -> Column:
    """Similar enough, compressed about as expected, and with every key concept."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    ratio = words(summary) / F.nullif(words(original), F.lit(0))
    held = F.forall(F.array(*[F.lit(c.lower()) for c in concepts]), lambda c: F.contains(F.lower(summary), c)) if concepts else F.lit(True)
    return (similarity >= least) & (F.abs(ratio - expected) <= 0.4) & held


def greedy_prefix(parts: DataFrame, group: str, order: str, cost: Column, most: int) -> DataFrame:
    """The parts of each group, in order, whose running cost is at most `most`."""
    from pyspark.sql import Window

    running = F.sum(cost).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("running", running).filter(F.col("running") <= most)


def digest_by_extension(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """extension, n_files, n_chars, n_tokens."""
    extension = F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)
    return files.groupBy(extension.alias("extension")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.length(content)), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.sum(X.token_estimate(content)), F.lit(0)).cast("long").alias("n_tokens"))


def digest_entries(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, entry: each file under a header; written in path order they are the digest, without one task holding it."""
    bar = "=" * 48
    entry = F.concat(F.lit(f"{bar}\nFile: "), F.col(path), F.lit(f"\n{bar}\n"), F.coalesce(content, F.lit("")), F.lit("\n"))
    return files.select(F.col(path).alias("path"), entry.alias("entry"))


def write_digest(files: DataFrame, folder: str, path: str = "path", content: str = "content") -> None:
    """DIGEST (text parts in path order), TREE (paths in order) and SUMMARY (one line of totals) below a folder."""
    digest_entries(files, path, content).sort("path").select("entry").write.mode("overwrite").text(f"{folder}/DIGEST")
    files.select(path).sort(path).write.mode("overwrite").text(f"{folder}/TREE")
    total = digest_by_extension(files, path, content).agg(F.sum("n_files").alias("files"), F.sum("n_chars").alias("chars"), F.sum("n_tokens").alias("tokens"))
    total.select(F.format_string("files: %d, characters: %d, estimated tokens: %d", "files", "chars", "tokens").alias("value")).write.mode("overwrite").text(f"{folder}/SUMMARY")


def language_of(path: Column | str) -> Column:
    """The language of a file by its name's end; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in code.EXTENSIONS.items() for x in pair]), extension)


def code_functions(files: DataFrame, language: Column | str | None = None, content: str = "content", key: str = "path") -> DataFrame:
    """key, place (from 0), name, parameters, docstring of every function in the files.

    language names one for all files, or is a column; without it the ends of the keys tell. Files of other languages,
    or without content, give no rows.
    """
    named = F.lit(language) if isinstance(language, str) else language_of(key) if language is None else language

    def run(batches):
        for batch in batches:
            keys, found = [], []
            for row, (kind, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = code.functions(text, kind)
                keys += [row] * len(own)
                found += [(place, *f) for place, f in enumerate(own)]
            columns = list(zip(*found)) or [[]] * 4
            types = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *arrays], names=["k", "place", "name", "parameters", "docstring"])

    plain = files.select(F.col(key).alias("k"), named.cast("string").alias("language"), F.col(content).cast("string").alias("content")).filter(F.col("language").isin(*code.LANGUAGES))
    schema = f"k {plain.schema['k'].dataType.simpleString()}, place int, name string, parameters array<string>, docstring string"
    return plain.mapInArrow(run, schema).withColumnRenamed("k", key)


#: The first JSON value of a text, mended: see `functions.json_text`.
repair_json = json_text.repaired


@F.pandas_udf(T.StringType())
def clean_json(texts: pd.Series) -> pd.Series:
    return texts.map(repair_json)


def json_to_markdown(value, level: int = 0) -> str:
    """Nested lists of keys and values."""
    pad = "  " * level
    if isinstance(value, dict):
        return "\n".join(f"{pad}- **{k}**:" + (f"\n{json_to_markdown(v, level + 1)}" if isinstance(v, dict | list) else f" {v}") for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(json_to_markdown(v, level) if isinstance(v, dict | list) else f"{pad}- {v}" for v in value)
    return f"{pad}{value}"


def flatten_nodes(nodes: DataFrame, order: str = "at") -> DataFrame:
    """order, content of section nodes (type, line_text, table_data, description): text, tables, image descriptions."""
    content = F.when(F.col("type") == "text", F.col("line_text")).when(F.col("type") == "table", F.concat(F.lit("Table:\n"), F.col("table_data"))).when(F.col("type") == "image", F.concat(F.lit("Image: "), F.col("description")))
    return nodes.select(order, content.alias("content")).filter("content is not null")
