"""Keyword, fuzzy and glossary search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import bm25
from marlstone.operators.documents import condition, has_tags
from marlstone.sources.shared import written


def search_keyword(docs: DataFrame, term: str, fields: Sequence[str] = ("text",), tags: Sequence[str] = (), key: str = "_key", top_n: int | None = 10, index: bm25.TextIndex | None = None) -> DataFrame:
    """Documents with the term's first token: score 1 if a field contains the whole term, else 0.9; then BM25 order."""
    first = bm25.query_terms(docs.sparkSession, term)[0]
    found = bm25.bm25_scores(docs, first, fields, key, index).withColumnRenamed("score", "bm25")
    if tags:
        found = found.filter(has_tags(tags))
    whole = reduce(or_, [F.coalesce(F.contains(F.lower(f), F.lit(term.lower())), F.lit(False)) for f in fields])
    found = found.withColumn("score", F.when(whole, 1.0).otherwise(0.9))
    return found if top_n is None else found.orderBy(F.desc("score"), F.desc("bm25"), F.col(key)).limit(top_n)


def letters_bound(word: Column, term: str) -> Column:
    """At most how alike (0 to 100) a word and the term are: by the letters that they share, whatever their order."""
    shared = [F.least(F.length(word) - F.length(F.replace(word, F.lit(c))), F.lit(term.count(c))) for c in sorted(set(term))]
    return 200 * reduce(lambda a, b: a + b, shared, F.lit(0)) / (F.length(word) + len(term))


def fuzzy_keyword(docs: DataFrame, term: str, threshold: float = 97.0, field: str = "text", key: str = "_key", index: bm25.TextIndex | None = None) -> DataFrame:
    """key, score (best ratio of a word with the term, from 0 to 1) of documents that reach the threshold.

    Each distinct word of the collection is compared once, and only if its length and letters can reach the threshold. With
    an index these are its terms, and the documents those of its postings; no text is read.
    """
    low, n = term.lower(), len(term)
    if index is None:
        words = docs.select(F.col(key).alias("key"), F.explode(F.array_distinct(X.tokens(field))).alias("word"))
        distinct = words.select("word").distinct()
    else:
        words = index.postings.filter(F.col("field") == field).select("key", F.col("term").alias("word"))
        distinct = index.terms.filter(F.col("field") == field).select(F.col("term").alias("word"))
    length = F.length("word")
    # The bounds stand before the Python function: Spark evaluates it for the words that they leave.
    able = distinct.filter((200 * F.least(length, F.lit(n)) >= threshold * (length + n)) & (letters_bound(F.col("word"), low) >= threshold - 1e-9))
    rated = able.withColumn("ratio", X.indel_ratio(F.col("word"), F.lit(low))).filter(F.col("ratio") >= threshold)
    return words.join(rated, "word").groupBy(F.col("key").alias(key)).agg((F.max("ratio") / 100).alias("score"))


def fuzzy_tags(docs: DataFrame, tags: Sequence[str], threshold: float = 80.0, key: str = "_key") -> DataFrame:
    """key, matched: how many of the tags are like one of the document's."""
    wanted = F.explode(F.array(*map(F.lit, tags)))
    own = docs.select(key, F.explode("tags").alias("tag"))
    rated = own.select("tag").distinct().select("tag", wanted.alias("wanted"))
    rated = rated.withColumn("ratio", X.indel_ratio(F.lower("tag"), F.lower("wanted"))).filter(F.col("ratio") >= threshold)
    return own.join(rated, "tag").groupBy(key).agg(F.countDistinct("wanted").alias("matched"))


def partial_ratio_rank(docs: DataFrame, terms: str | Sequence[str], field: str, filter_expr=None, key: str = "_key", threshold: float = 60.0, require_all: bool = False) -> DataFrame:
    """key, score: the best ratio of a term with a part of the field; of several terms, the sum of those that pass.

    Documents are those of which any, or all, of the terms pass.
    """
    terms = [terms] if isinstance(terms, str) else list(terms)
    parts = F.array(*[X.partial_indel_ratio(F.lower(field), F.lit(t.lower())) for t in terms])
    rated = docs.filter(condition(filter_expr)).select(key, F.filter(parts, lambda r: r >= threshold).alias("_passed"))
    rated = rated.filter(F.size("_passed") >= (len(terms) if require_all else 1))
    return rated.select(key, F.aggregate("_passed", F.lit(0.0), lambda s, r: s + r).alias("score"))


def ngram_search(docs: DataFrame, query: str, field: str, threshold: float = 0.7, n: int = 3) -> DataFrame:
    return docs.withColumn("similarity", X.ngram_similarity(F.col(field), query, n)).filter(F.col("similarity") >= threshold)


def upsert_terms(glossary: DataFrame, added: DataFrame) -> DataFrame:
    """term, term_lower, definition, length: the added definitions replace those of equal terms, whatever the case."""
    both = glossary.select("term", "definition", F.lit(0).alias("v")).unionByName(added.select("term", "definition", F.lit(1).alias("v")))
    latest = both.groupBy(F.lower("term").alias("term_lower")).agg(F.max_by(F.struct("term", "definition"), F.struct("v", "term", "definition")).alias("x"))
    return latest.select("x.term", "term_lower", "x.definition", F.length("x.term").cast("long").alias("length"))


def find_terms(docs: DataFrame, terms: Sequence[str], field: str = "text", key: str = "_key", most_chars: int | None = 5000) -> DataFrame:
    """key, term, start, end: whole-word matches from left to right, the longest term at each place, without overlaps.

    Texts beyond most_chars are searched as their head and tail halves around three dots, as the option says; None
    searches whole texts. Terms are a bounded list, part of the function.
    """
    ordered = sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t))
    pattern = re.compile(rf"(?<!{X.WORD})(?:{'|'.join(map(re.escape, ordered))})(?!{X.WORD})", re.I) if ordered else None

    @F.pandas_udf("array<struct<term string, start long, end long>>")
    def matches(texts: pd.Series) -> pd.Series:
        found = ([{"term": m[0].lower(), "start": m.start(), "end": m.end()} for m in pattern.finditer(text or "")] if pattern else [] for text in texts)
        return pd.Series(list(found))

    source = F.col(field) if most_chars is None else X.truncated(field, most_chars)
    return docs.select(key, F.explode(matches(source)).alias("m")).select(key, "m.term", "m.start", "m.end")


#: Terms of a glossary that one automaton holds; a larger glossary is searched in so many parts as it needs.
MOST_TERMS = 500_000
_MATCHES = "array<struct<term string, start long, end long>>"


def _folded(text: str) -> str:
    """The text in lower case, as long as it was: characters that would become several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _leftmost(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (start, end) those that are chosen from left to right, the longest at each place, without overlaps."""
    chosen, free = [], 0
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= free:
            chosen.append((start, end))
            free = end
    return chosen


_AUTOMATA: dict[int, tuple] = {}


def _automaton(shared):
    """The worker's automaton for a broadcast list of terms."""
    import ahocorasick

    terms = shared.value
    if id(terms) not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for term in terms:
            made.add_word(term, len(term))
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[id(terms)] = made, terms
    return _AUTOMATA[id(terms)][0]


def find_glossary(docs: DataFrame, glossary: DataFrame, field: str = "text", key: str = "_key", term: str = "term", most: int = MOST_TERMS) -> DataFrame:
    """key, term, start, end: whole-word matches of a table's terms in whole texts, as `find_terms` chooses them.

    An automaton (Aho and Corasick) reads each text once, however many terms there are. A glossary of more terms than
    `most` is dealt into parts, and the matches of all parts meet at their text, where the choice is made.
    """
    is_word = re.compile(X.WORD).match
    terms = written(glossary.select(F.lower(term).alias("t")).filter("t <> ''").distinct().withColumn("part", F.pmod(F.xxhash64("t"), F.lit(1 << 20))), "glossary")
    parts = max(1, -(-terms.count() // most))
    texts = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(field).cast("string").alias("text"))
    texts = written(texts, "glossary-texts") if parts > 1 else texts

    def matches(part: int, choose: bool):
        own = [r.t for r in terms.filter(F.col("part") % parts == part).select("t").collect()]  # at most about `most`
        shared = docs.sparkSession.sparkContext.broadcast(own)

        @F.pandas_udf(_MATCHES)
        def find(column: pd.Series) -> pd.Series:
            out = []
            for text in column:
                low = _folded(text or "")
                found = [(at + 1 - n, at + 1) for at, n in _automaton(shared).iter(low)] if own and low else []
                found = [(a, b) for a, b in found if not (a and is_word(low[a - 1])) and not (b < len(low) and is_word(low[b]))]
                out.append([{"term": low[a:b], "start": a, "end": b} for a, b in (_leftmost(found) if choose else found)])
            return pd.Series(out)

        return texts.select("key", "row", F.explode(find("text")).alias("m"))

    if parts == 1:
        return matches(0, True).select(F.col("key").alias(key), "m.term", "m.start", "m.end")

    @F.pandas_udf(_MATCHES)
    def chosen(column: pd.Series) -> pd.Series:
        kept = []
        for found in column:
            names = {(m["start"], m["end"]): m["term"] for m in found}
            kept.append([{"term": names[x], "start": x[0], "end": x[1]} for x in _leftmost(list(names))])
        return pd.Series(kept)

    every = reduce(DataFrame.unionByName, [matches(p, False) for p in range(parts)])
    # A text's matches are bounded by its own length.
    whole = every.groupBy("row").agg(F.first("key").alias("key"), F.collect_list("m").alias("found"))
    return whole.select("key", F.explode(chosen("found")).alias("m")).select(F.col("key").alias(key), "m.term", "m.start", "m.end")
