"""Text functions as columns; pandas functions only for what Spark SQL cannot express."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]+"
#: A character of a word, alike in Spark, Python and SQL engines: letters of ASCII and Latin-1, digits and underscores.
WORD = "[A-Za-z0-9_\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, numbers and underscores; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text)).cast("long")


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("long")


def sentences(text: Column | str) -> Column:
    """Split after sentence ends that white space follows."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def truncated(text: Column | str, most: int = 100) -> Column:
    """Longer texts as their first and last halves of `most` characters around three dots; an image's header is kept before its data."""
    text = F.col(text) if isinstance(text, str) else text
    half = max(most // 2, min(most, 1))
    header = F.regexp_extract(text, r"^data:image/[^;,]+;base64,", 0)
    data = F.substring(text, F.length(header) + 1, F.length(text))
    short = F.concat(header, F.substring(data, 1, half), F.lit("..."), F.right(data, F.lit(half)))
    return F.when(F.length(data) > most, short).otherwise(text)


def log_safe(df: DataFrame, most: int = 100, most_elements: int = 10) -> DataFrame:
    """Rows for a log: long texts, arrays, and the texts in maps and structs, are cut short."""

    def safe(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return truncated(value, most)
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType | T.MapType | T.ArrayType):
            return truncated_list(value, kind.elementType.simpleString(), most_elements)
        if isinstance(kind, T.ArrayType):
            return F.when(F.size(value) > most_elements, F.array().cast(kind)).otherwise(F.transform(value, lambda v: safe(v, kind.elementType)) if not isinstance(kind.elementType, T.ArrayType) else value)
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda _, v: truncated(v, most))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[safe(value[f.name], f.dataType).alias(f.name) for f in kind]))
        return value

    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def truncated_list(values: Column, kind: str, most: int = 10) -> Column:
    """Long arrays as one element that tells their length and type."""
    return F.when(F.size(values) > most, F.array(F.concat(F.lit("[<"), F.size(values).cast("string"), F.lit(f" {kind} elements>]")))).otherwise(F.transform(values, lambda v: v.cast("string")))


def truncated_tokens(text: Column | str, most: int) -> Column:
    """The first and last halves of a text's white-space tokens, if it has more than `most`."""
    parts = F.filter(F.split(text, r"\s+"), lambda s: s != "")
    half = most // 2
    cut = F.concat_ws(" ", F.concat_ws(" ", F.slice(parts, 1, half)), F.lit("..."), F.concat_ws(" ", F.slice(parts, -half, half)))
    return F.when(F.size(parts) > most, cut).otherwise(F.concat_ws(" ", parts))


def highlighted(text: Column | str, terms: list[str]) -> Column:
    """Whole-word matches of the terms, longest first, between double asterisks."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    pattern = rf"(?i)(?<!{WORD})(" + "|".join(re.escape(t).replace(r"\ ", " ") for t in ordered) + rf")(?!{WORD})"
    return F.regexp_replace(text, pattern, r"\*\*$1\*\*")


def ngram_similarity(text: Column, query: str, n: int = 3) -> Column:
    """The share of the query's n-grams that the text has: those that it contains."""
    own = sorted({query.lower()[i : i + n] for i in range(len(query) - n + 1)})
    if not own:
        return F.lit(0.0)
    low = F.lower(text)
    return sum((F.contains(low, F.lit(g)).cast("int") for g in own), F.lit(0)) / F.lit(float(len(own)))


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


#: Windows of a text that are compared at a time.
WINDOWS = 1 << 18


def _longest_in_windows(short: str, long: str) -> int:
    """The longest common subsequence of a text of at most 62 characters with any window of its length, all windows at once."""
    size = len(short)
    codes = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
    hits = np.zeros(len(codes), np.uint64)
    for c in set(short):
        hits[codes == ord(c)] = sum(1 << i for i, x in enumerate(short) if x == c)
    full = np.uint64((1 << size) - 1)
    row = np.full(len(codes) - size + 1, full)
    for j in range(size):
        hit = row & hits[j : j + len(row)]
        row = (row + hit | row - hit) & full
    return size - int(np.bitwise_count(row).min())


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Normalised indel similarity times 100."""
    return 100.0 if not a and not b else 200.0 * _common_subsequence(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any part of the longer one that is as long."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    if short in long:
        return 100.0
    size = len(short)
    if size > 62:
        return max(200.0 * _common_subsequence(short, part) / (2 * size) for part in {long[i : i + size] for i in range(len(long) - size + 1)})
    return max(100.0 * _longest_in_windows(short, long[at : at + WINDOWS + size - 1]) / size for at in range(0, len(long) - size + 1, WINDOWS))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A deterministic unit vector of 64 values for each text, from a generator seeded with its whole digest: a part of it recurs among many texts."""
    import hashlib

    for texts in parts:
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            seed = int(hashlib.md5(text.encode()).hexdigest(), 16)
            vector = np.random.default_rng(seed).standard_normal(64)
            out.append((vector / np.linalg.norm(vector)).astype("float32"))
        yield pd.Series(out)


_VOWEL = "aeiou"


def porter_stem(word: str) -> str:
    """The Porter (1980) stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word

    def shape(stem: str) -> str:
        out = ""
        for i, c in enumerate(stem):
            vowel = c in _VOWEL or c == "y" and i > 0 and out[-1] == "c"
            out += "v" if vowel else "c"
        return out

    def measure(stem: str) -> int:
        return len(re.findall("v+c+", shape(stem)))

    def ends_cvc(stem: str) -> bool:
        return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    def first(word: str, rules: list[tuple[str, str]], least: int) -> str:
        for suffix, new in rules:
            if word.endswith(suffix):
                stem = word[: len(word) - len(suffix)]
                return stem + new if measure(stem) > least else word
        return word

    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    # The suffixes of steps 2 to 4.
    word = first(word, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    word = first(word, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for suffix in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not ends_cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    return porter_stem(word)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(words: pa.Array) -> pa.Array:
    """The stems of words: those of a batch's distinct words, dealt out to their places."""
    coded = words.flatten().dictionary_encode()
    stems = pa.array([w if w is None else _stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), stems.take(coded.indices), mask=pc.is_null(words))
