"""Quality rules with a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit per failed rule, so a
policy is a mask: a document passes a policy if no bit of the mask is set. The ledger is a stored table: policies
have versions and are applied, changed and compared by it, without reading a text again; ablations (what each rule
fails, and what would come back without it) are bitwise aggregations over it.

Defined cases: a null or empty text has no words, measures zero and fails `few_words`; repeated rows are
measured each; an empty table gives an empty ledger; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_alpha_words")
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5

#: The rules by bit: a name and the condition, in terms of the measures, under which a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("mean_word_length", "word_chars > 30 * n_words or word_chars < n_words * 2"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("not_alphabetic", "2 * n_alpha_words < n_words"),
    ("very_long", "n_words > 1000000"),
]
#: The names of the rules that each version of the policy applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "mean_word_length", "symbols"),
    "web-2": ("few_words", "repeated_words", "mean_word_length", "symbols", "repeated_lines", "not_alphabetic"),
}
NEWEST = "web-2"
_SPACE = " \t\n\x0b\x0c\r"


def mask(policy: str) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[policy])


def repeat_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, how many of its words stand in a window that occurs twice or more in that text."""
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - REPEAT_WINDOW + 1
    if n < 1:
        return np.zeros(len(counts), np.int64)
    inside = text[:n] == text[REPEAT_WINDOW - 1 :]
    # The text's number is part of the hash, so equal windows are in the same text.
    h = words.mix(words.sequence_hashes(hashes, REPEAT_WINDOW) + text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(inside)
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(hashes) + 1, np.int64)
    starts = order[twice]
    change[starts] += 1
    np.add.at(change, starts + REPEAT_WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(text[covered], minlength=len(counts)).astype(np.int64)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the measures (long) of every row."""

    def run(batches):
        for batch in common.slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hashes, counts = words.batch_hashes(texts)
            out = {
                "n_words": counts,
                "word_chars": [len(t) - sum(map(t.count, _SPACE)) for t in texts],
                "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
                "n_dup_lines": [],
                "n_lines": [],
                "n_repeat_words": repeat_words(hashes, counts),
                "n_alpha_words": [],
            }
            for t in texts:
                lines = [x for x in t.split("\n") if x.strip(_SPACE)]
                out["n_lines"].append(len(lines))
                out["n_dup_lines"].append(len(lines) - len(set(lines)))
                parts = words.split(t)
                out["n_alpha_words"].append(len(parts) - sum(map(_PLAIN.issuperset, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[m], pa.int64()) for m in MEASURES)], names=["id", *MEASURES])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("id", id_col)


#: Bytes that are no letters: a word of these alone is not alphabetic.
_PLAIN = frozenset(b for b in range(128) if not chr(b).isalpha())


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the measures and fail_bits (long): bit i is set if RULES[i] fails."""
    bits = sum((F.when(F.expr(failed), F.lit(1 << i)).otherwise(0) for i, (_, failed) in enumerate(RULES)), F.lit(0))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledger_df: DataFrame, policy: str) -> DataFrame:
    """rule, failed, removed_alone (fail no other rule of the policy): one aggregation over the failure bits."""
    whole = mask(policy)
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    each = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    hit, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("removed_alone"))


def restoring_rule(policy: str, bits: str = "fail_bits") -> Column:
    """The rule without which a document that the policy removes would be kept, or null."""
    own = F.col(bits).bitwiseAND(F.lit(mask(policy)))
    cases = [F.when(own == 1 << i, name) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    return F.coalesce(*cases)


def op9_rule_bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, each policy's verdict, and the ablation of the rule that alone removes a document."""
    stored = common.written(ledger(common.table(spark, sf_dir, "documents")), "quality-ledger")
    rules = F.broadcast(ablations(stored, NEWEST).select(F.col("rule").alias("only_rule"), F.col("removed_alone").alias("n_only_rule")))  # a row for each rule
    verdicts = [passes(p).alias("kept_" + p.replace("-", "_")) for p in POLICIES if p != NEWEST]
    rows = stored.withColumn("only_rule", restoring_rule(NEWEST)).join(rules, "only_rule", "left")
    measures = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(*measures, (~passes("base-1")).alias("base_failed"), passes(NEWEST).alias("kept"), "fail_bits", *verdicts, "only_rule", "n_only_rule")
