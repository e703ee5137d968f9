"""Language identification as multilingual mixture inference.

Every document is taken as a mixture of languages that draws its character trigrams from the languages'
trigram distributions. Expectation-maximisation estimates the proportions. The set of languages is selected by
penalised likelihood: languages are added in the order of their weight in the full mixture as long as the
likelihood gains more than PENALTY * ln(n) for n trigrams. Languages of less weight than LEAST_WEIGHT in the full
mixture are not tried: a share that small is not told from noise.

The distributions come from all labelled training rows: tasks count hashed trigrams, Spark adds the counts. Every
language is learned; more than MOST_LANGUAGES are an error, since the model would outgrow the driver and the workers.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows without a label are predicted
but not learned from; with no labelled row at all everything is `und`; ties go to the language that comes first
in the alphabet; a text is read in parts of bounded size; repeated rows count and are predicted each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common

#: Trigrams are hashed to so many numbers; the model has a row of them for each language.
BUCKETS = 1 << 14
#: Languages of a model, each 64 KB: it bounds what the driver gathers and broadcasts.
MOST_LANGUAGES = 1024
ROUNDS = 12
PENALTY = 4.0
LEAST_WEIGHT = 0.02
#: Languages that a task counts before it emits.
TASK_LANGUAGES = 256
#: Documents whose trigrams are counted at a time, and characters of them.
GROUP, GROUP_CHARS = 64, 1 << 20


def trigrams(text: str):
    """Numbers of the trigrams of the lower-cased letters, where any other characters are one blank; part by part."""
    last, blank = np.array([32], np.uint32), True
    for at in range(0, max(len(text), 1), GROUP_CHARS):
        codes = np.frombuffer(text[at : at + GROUP_CHARS].lower().encode("utf-32-le"), np.uint32)
        # Letters: those of ASCII, and whatever lies beyond it but for the signs of Latin-1 and general punctuation.
        letter = ((codes >= 97) & (codes <= 122)) | (codes == 0xAA) | (codes == 0xB5) | (codes == 0xBA) | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ((codes < 0x2000) | (codes > 0x206F)))
        keep = letter.copy()
        # A blank stands for the first of several other characters; the text begins and ends with one.
        keep |= ~letter & np.concatenate(([not blank], letter))[:-1]
        codes = np.concatenate((last, np.where(letter, codes, np.uint32(32))[keep]))
        blank = not letter[-1] if len(letter) else blank
        if at + GROUP_CHARS >= len(text):
            codes = np.append(codes, np.uint32(32)) if not blank or len(codes) < 2 else codes
        last = codes[-2:]
        h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        yield (h >> np.uint32(18)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(labelled: DataFrame, lang_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and the logarithms of their trigram probabilities, from all rows of `labelled`."""

    def partial(batches):
        counts: dict[str, np.ndarray] = {}

        def emit():
            for lang, row in counts.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(row[at], pa.int64())})
            counts.clear()

        for batch in common.slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    row = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for grams in trigrams(text):
                        if len(grams) < BUCKETS // 4:
                            np.add.at(row, grams, 1)
                        else:
                            row += np.bincount(grams, minlength=BUCKETS)
            if len(counts) > TASK_LANGUAGES:
                yield from emit()
        yield from emit()

    plain = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = plain.mapInArrow(partial, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = common.written(counts, "language-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; raise MOST_LANGUAGES, with 64 KB for each on the driver and in the workers")
    table, number = np.zeros((len(langs), BUCKETS), np.float32), {lang: i for i, lang in enumerate(langs)}
    # At most BUCKETS rows of each language; a partition at a time.
    for lang, bucket, n in counts.toLocalIterator():
        table[number[lang], bucket] = n
    table += 0.5
    return langs, np.log(table / table.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)


class Mixture:
    """Mixture inference for many documents at a time: document, trigram and count are parallel arrays."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = log_p

    def fit(self, doc, p, n, size, allowed):
        """Weights (documents x languages) and log-likelihoods, with weight only where `allowed`."""
        total = np.bincount(doc, n, minlength=size)
        weights = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
        starts = np.searchsorted(doc, np.arange(size))
        for _ in range(ROUNDS):
            joint = p * weights[doc]
            joint *= (n / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
            weights = np.add.reduceat(joint, starts, axis=0) / total[:, None]
        seen = np.maximum((p * weights[doc]).sum(axis=1), 1e-30)
        return weights, np.bincount(doc, n * np.log(seen), minlength=size)

    def infer(self, doc: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        """Weights of the selected languages of documents 0 to size - 1, each of which has a trigram."""
        log_p = self.log_p[:, gram].T
        # Scaled by each trigram's best language, so that no probability vanishes.
        best = log_p.max(axis=1, keepdims=True)
        p = np.exp(log_p - best)
        langs = p.shape[1]
        starts = np.searchsorted(doc, np.arange(size))
        alone = np.add.reduceat((log_p - best) * n[:, None], starts, axis=0)
        full, _ = self.fit(doc, p, n, size, np.ones((size, langs)))
        order = np.argsort(-full, axis=1, kind="stable")
        total = np.bincount(doc, n, minlength=size)
        chosen = np.zeros((size, langs))
        first = alone.argmax(axis=1)
        chosen[np.arange(size), first] = 1
        weights, likelihood = chosen.copy(), alone[np.arange(size), first]
        open_ = np.arange(size)
        for k in range(langs):
            # Add the k-th language of the full mixture where the set so far lacks it.
            open_ = open_[full[open_, order[open_, k]] > LEAST_WEIGHT]
            grow = open_[chosen[open_, order[open_, k]] == 0]
            if not len(grow):
                if not len(open_):
                    break
                continue
            place = np.full(size, -1)
            place[grow] = np.arange(len(grow))
            rows = place[doc] >= 0
            more = chosen[grow].copy()
            more[np.arange(len(grow)), order[grow, k]] = 1
            w, value = self.fit(place[doc[rows]], p[rows], n[rows], len(grow), more)
            better = value - likelihood[grow] > PENALTY * np.log(total[grow] + 1)
            won = grow[better]
            chosen[won], weights[won], likelihood[won] = more[better], w[better], value[better]
            open_ = np.setdiff1d(open_, grow[~better])
        return weights


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (the proportion of that language), proportions (map of the selected languages)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, log_p))

    def run(batches):
        langs, log_p = shared.value
        mixture = Mixture(log_p)
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            weights = np.zeros((len(texts), max(len(langs), 1)))
            usable = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            while usable:
                take, chars = 0, 0
                while take < min(GROUP, len(usable)) and (not take or chars + len(texts[usable[take]]) <= GROUP_CHARS):
                    chars += len(texts[usable[take]])
                    take += 1
                group, usable = usable[:take], usable[take:]
                counts = np.zeros(len(group) * BUCKETS, np.int64)
                for k, i in enumerate(group):
                    for grams in trigrams(texts[i]):
                        own = counts[k * BUCKETS : (k + 1) * BUCKETS]
                        if len(grams) < BUCKETS // 4:
                            np.add.at(own, grams, 1)
                        else:
                            own += np.bincount(grams, minlength=BUCKETS)
                at = np.flatnonzero(counts)
                weights[group] = mixture.infer(at // BUCKETS, at % BUCKETS, counts[at].astype(np.float64), len(group))
            best = weights.argmax(axis=1)
            some = weights.sum(axis=1) > 0
            preds = [langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]
            mixed = [[(langs[j], w[j]) for j in np.flatnonzero(w > 0).tolist()] for w in weights]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds, pa.string()), pa.array(np.clip(weights.max(axis=1), 0, 1), pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))],
                names=["id", "lang_pred", "score", "proportions"],
            )

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, lang_pred string, score double, proportions map<string,double>").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from; rows without id are in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op4_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    langs, log_p = learn(docs.filter(~held_out()), "lang", "text")
    return predict(docs, langs, log_p).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "proportions")
