"""Queries over a document collection: filter, sort, page, project, count, tags and substrings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def condition(filter_expr: Column | str | None) -> Column:
    """A filter as a column; a string is a SQL expression; none lets everything pass."""
    if filter_expr is None:
        return F.lit(True)
    return F.expr(filter_expr) if isinstance(filter_expr, str) else filter_expr


def run_sql(spark: SparkSession, query: str, parameters: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A SQL query whose markers (:name) are bound to values, and whose {name} are tables; values are never spliced in."""
    return spark.sql(query, args=dict(parameters or {}), **tables)


def sample(docs: DataFrame, n: int, key: str = "_key", seed: int = 0) -> DataFrame:
    """n documents drawn by a hash of their key: the same ones each time."""
    return docs.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def first_documents(docs: DataFrame, n: int, key: str = "_key") -> DataFrame:
    return docs.orderBy(F.col(key)).limit(n)


def recent_with(docs: DataFrame, field: str, part: str, time: str = "timestamp", key: str = "_key", limit: int = 10) -> DataFrame:
    """Documents whose field contains the part, newest first."""
    return docs.filter(F.contains(F.col(field), F.lit(part))).orderBy(F.desc(time), F.col(key)).limit(limit)


def query_documents(docs: DataFrame, filter_expr: Column | str | None = None, sort: Sequence[Column] = (), key: str = "_key", limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Filtered documents in order, ties by key, as one page."""
    out = docs.filter(condition(filter_expr)).orderBy(*sort, F.col(key))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def keep(docs: DataFrame, fields: Sequence[str], always: Sequence[str] = ("_key", "tags")) -> DataFrame:
    """The named columns and those that are always kept; missing ones are skipped."""
    names = list(dict.fromkeys([*always, *fields]))
    return docs.select(*[n for n in names if n in docs.columns])


def count_matching(docs: DataFrame, filter_expr: Column | str | None = None) -> DataFrame:
    return docs.filter(condition(filter_expr)).agg(F.count("*").alias("total"))


def lookup(docs: DataFrame, value, key: str = "_key") -> DataFrame:
    return docs.filter(F.col(key) == F.lit(value))


def _literals(tags: Sequence[str]) -> Column:
    return F.array(*map(F.lit, tags))


def has_tags(tags: Sequence[str], require_all: bool = False, column: str = "tags") -> Column:
    """Any or all of the tags are among the document's. No tags: all of them are there, and none of them is."""
    own = F.col(column)
    if not tags:
        return F.lit(require_all)
    return reduce(and_, [F.array_contains(own, t) for t in tags]) if require_all else F.arrays_overlap(own, _literals(tags))


def tags_within(tags: Sequence[str], column: str = "tags") -> Column:
    """Every tag of the document is in the list; true without tags."""
    return F.forall(column, lambda t: t.isin(list(tags)))


def shared_tags(tags: Sequence[str], column: str = "tags") -> Column:
    return F.size(F.array_intersect(F.col(column), _literals(tags))).cast("long")


def tag_match_score(tags: Sequence[str], column: str = "tags") -> Column:
    """The share of the tags that the document has, whatever their case."""
    if not tags:
        return F.lit(0.0)
    return F.size(F.filter(_literals([t.lower() for t in tags]), lambda t: F.exists(F.col(column), lambda x: F.lower(x) == t))) / F.lit(float(len(tags)))


def tag_search(docs: DataFrame, tags: Sequence[str], filter_expr: Column | str | None = None, require_all: bool = False, key: str = "_key", limit: int | None = 10, offset: int = 0) -> DataFrame:
    """Documents with any or all of the tags, by key, with tag_match_score."""
    found = query_documents(docs.filter(has_tags(tags, require_all)), filter_expr, key=key, limit=limit, offset=offset)
    return found.withColumn("tag_match_score", tag_match_score(tags))


def contains_keywords(fields: Sequence[str], keywords: Sequence[str], require_all: bool = False) -> Column:
    """Each keyword is a substring of some field, whatever the case; any or all of them."""
    each = [reduce(or_, [F.coalesce(F.contains(F.lower(f), F.lit(k.lower())), F.lit(False)) for f in fields]) for k in keywords]
    return reduce(and_ if require_all else or_, each)


def additive_score(weights: dict[str, float], conditions: dict[str, Column]) -> Column:
    """The sum of the weights whose conditions hold."""
    return reduce(lambda a, b: a + b, [F.when(conditions[n], w).otherwise(0.0) for n, w in weights.items()])


def distinct_tags(docs: DataFrame, column: str = "tags") -> DataFrame:
    """All tags in lower case, once each."""
    return docs.select(F.explode(column).alias("tag")).select(F.lower("tag").alias("tag")).distinct()


def keep_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order; its other columns travel with it through the aggregation."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = F.min_by(F.struct(*df.columns), rank)
    return df.groupBy(F.col(key).alias("_group")).agg(best.alias("best")).select("best.*")
