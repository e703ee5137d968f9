"""Nearest-neighbour classification, evaluation and training helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import written


def vote(neighbours: DataFrame, query_id: str, label: str = "label", power: int = 2, k: int | None = None, accept: float = 0.7) -> DataFrame:
    """query_id, prediction, confidence, auto_accept from neighbours(query_id, label, score, rank).

    Votes are scores to a power (0: one each) of positive scores; a tie is 0.
    """
    used = neighbours if k is None else neighbours.filter(F.col("rank") <= k)
    weight = F.when(F.col("score") > 0, F.pow("score", F.lit(power))).otherwise(0.0)
    sums = used.groupBy(query_id).agg(F.sum(F.when(F.col(label) == 1, weight).otherwise(0.0)).alias("v1"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(weight)).alias("v0"), F.count("*").alias("n"))
    total, one = F.col("v1") + F.col("v0"), F.col("v1") > F.col("v0")
    confidence = F.when(total > 0, F.greatest("v0", "v1") / total).otherwise(0.0)
    enough = F.lit(True) if k is None else F.col("n") >= k
    return sums.select(query_id, F.when(one, 1).otherwise(0).cast("long").alias("prediction"), confidence.alias("confidence"), ((total > 0) & (confidence >= accept) & enough).alias("auto_accept"))


def majority(neighbours: DataFrame, query_id: str, label: str = "label", k: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """query_id, prediction: the label of most of the k nearest; a tie is 1. Of the queries, those without neighbours have null."""
    n1 = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    found = neighbours.filter(F.col("rank") <= k).groupBy(query_id).agg(F.when(2 * n1 >= F.count("*"), 1).otherwise(0).cast("long").alias("prediction"))
    return found if queries is None else queries.select(query_id).join(found, query_id, "left")


def label_name(prediction: Column) -> Column:
    return F.when(prediction == 1, "Complex").when(prediction == 0, "Simple").otherwise("Unknown")


def metrics(df: DataFrame, actual: str, predicted: str, *groups: str) -> DataFrame:
    """groups, tp, fp, fn, tn, accuracy, precision, recall, f1; undefined ratios are 0."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    cells = {"tp": a & p, "fp": ~a & p, "fn": a & ~p, "tn": ~a & ~p}
    counts = df.groupBy(*groups).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in cells.items()])

    def ratio(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(0.0)

    tp, fp, fn, tn = (F.col(n) for n in cells)
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def weighted_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, precision, recall, f1: averages over all classes, weighted by each class's rows; undefined ratios are 0."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = cells.select(F.explode(F.array("a", "p")).alias("c"), "a", "p", "n").distinct()
    per = both.groupBy("c").agg(*[F.sum(F.when(x, F.col("n")).otherwise(0)).alias(name) for name, x in (("tp", (F.col("a") == F.col("c")) & (F.col("p") == F.col("c"))), ("actual", F.col("a") == F.col("c")), ("guessed", F.col("p") == F.col("c")))])
    precision = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(0.0)
    f1 = F.when(F.col("actual") + F.col("guessed") > 0, 2 * F.col("tp") / (F.col("actual") + F.col("guessed"))).otherwise(0.0)
    total = F.sum("actual")
    return per.agg(*[(F.sum(x * F.col("actual")) / total).alias(name) for name, x in (("precision", precision), ("recall", recall), ("f1", f1))], (F.sum("tp") / total).alias("accuracy"))


def evaluate_by_k(neighbours: DataFrame, truth: DataFrame, query_id: str, ks: list[int], power: int = 2) -> DataFrame:
    """k, the metrics of votes among the k nearest, and their mean confidence, from one search of max(ks)."""
    each = neighbours.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k"))
    weight = F.when(F.col("score") > 0, F.pow("score", F.lit(power))).otherwise(0.0)
    signed = F.sum(F.when(F.col("label") == 1, weight).otherwise(-weight))
    share = F.when(F.sum(weight) > 0, (F.abs(signed) + F.sum(weight)) / (2 * F.sum(weight))).otherwise(0.0)
    votes = each.groupBy("k", query_id).agg(F.when(F.round(signed, 12) > 0, 1).otherwise(0).alias("prediction"), share.alias("confidence"))
    joined = votes.join(truth, query_id)
    means = joined.groupBy("k").agg(F.avg("confidence").alias("mean_confidence"))
    return metrics(joined, "actual", "prediction", "k").join(means, "k")


def graph_scores(semantic: DataFrame, graph: DataFrame, key: str, depth: int = 2, semantic_weight: float = 0.7, graph_weight: float = 0.3) -> DataFrame:
    """key, score: weighted best similarity, and nearness in the graph 1 - distance / (depth + 1)."""
    both = semantic.select(key, F.col("score").alias("sim"), F.lit(None).cast("double").alias("near")).unionByName(graph.select(key, F.lit(0.0).alias("sim"), (1 - F.col("depth") / (depth + 1)).alias("near")))
    merged = both.groupBy(key).agg(F.max("sim").alias("sim"), F.max("near").alias("near"))
    return merged.select(key, (semantic_weight * F.col("sim") + graph_weight * F.coalesce("near", F.lit(0.0))).alias("score"))


def graph_classify(near: DataFrame, labels: DataFrame, key: str, label: str = "label", k: int = 25, power: int = 2, shown: int = 3) -> DataFrame:
    """prediction, confidence, n, n_complex, n_simple, nearest (the best `shown`: key, score, label) of one question.

    near: its neighbours by meaning and by the graph with their merged score (see `graph_scores`), of which the best k
    vote; only a strict majority of the votes is 1.
    """
    best = near.orderBy(F.desc(F.round("score", 12)), key).limit(k).join(labels.select(key, label), key)
    weight = F.when(F.col("score") > 0, F.pow("score", F.lit(power))).otherwise(0.0)
    one = F.col(label) == 1
    sums = best.agg(
        F.coalesce(F.sum(F.when(one, weight)), F.lit(0.0)).alias("v1"),
        F.coalesce(F.sum(F.when(~one, weight)), F.lit(0.0)).alias("v0"),
        F.count("*").alias("n"),
        F.count(F.when(one, 1)).alias("n_complex"),
        F.count(F.when(~one, 1)).alias("n_simple"),
        F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("o"), F.col(key), "score", F.col(label)))), 1, shown).alias("s"),
    )
    total = F.col("v1") + F.col("v0")
    confidence = F.when(total > 0, F.greatest("v0", "v1") / total).otherwise(0.0)
    nearest = F.transform("s", lambda x: F.struct(x[key].alias(key), x["score"].alias("score"), x[label].alias(label)))
    return sums.select(F.when(F.col("v1") > F.col("v0"), 1).otherwise(0).cast("long").alias("prediction"), confidence.alias("confidence"), "n", "n_complex", "n_simple", nearest.alias("nearest"))


def balanced(df: DataFrame, label: str, order: Column) -> DataFrame:
    """The first rows of each label, as many as the rarer label has.

    A label's cut is found among counts of ranges of its order: no task ranks more than the rows of one range.
    """
    rows = df.filter(F.col(label).isNotNull()).withColumn("_order", order)
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row for each label
    if len(counts) < 2:
        return df.limit(0)
    fewest = min(counts.values())
    names = df.columns
    # Ranges of the order, numbered in it, and how many rows of each label lie before each.
    ranges = rows.repartitionByRange(F.col(label), F.col("_order")).withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "balanced")
    sizes = ranges.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.withColumn("_before", before))  # a row for each label and range
    near = ranges.join(sizes, [label, "_range"])
    whole = near.filter(F.col("_before") + F.col("_n") <= fewest).select(*names)
    cut = near.filter((F.col("_before") < fewest) & (F.col("_before") + F.col("_n") > fewest))
    at = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_order")) + F.col("_before")
    return whole.unionByName(cut.withColumn("_at", at).filter(F.col("_at") <= fewest).select(*names))


def dataset_stats(df: DataFrame, label: str) -> DataFrame:
    """original, valid, invalid, complex, simple, balanced: the rows of a labelled collection."""
    counts = df.agg(F.count("*").alias("original"), F.count(F.when(F.col(label) == 1, 1)).alias("complex"), F.count(F.when(F.col(label) == 0, 1)).alias("simple"))
    valid = F.col("complex") + F.col("simple")
    return counts.select("original", valid.alias("valid"), (F.col("original") - valid).alias("invalid"), "complex", "simple", (2 * F.least("complex", "simple")).alias("balanced"))


def binary_label(rating: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    return (rating >= threshold if inclusive else rating > threshold).cast("int")


def split(key: Column, parts: int = 10) -> Column:
    """train, validation and test as 8 : 1 : 1 by a key's remainder."""
    at = F.pmod(key, F.lit(parts))
    return F.when(at < parts - 2, "train").when(at == parts - 2, "validation").otherwise("test")


def hashed_order(key: str, seed: int = 42) -> Column:
    """An order of rows that looks random, and is the same for a seed wherever it is computed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, shares: tuple[int, int] = (8, 1), parts: int = 10) -> DataFrame:
    """df with part: of the n rows of each label, in hashed order, the first 8 n / 10 (rounded down) are train; with those up to
    9 n / 10 (rounded down) being validation, the rest is test: at least one row.

    shares: tenths (or `parts`) of train and validation. Null labels are a label of their own. A row's place is counted
    within a range of the order; only counts of ranges meet, so no task has all rows of a label.
    """
    names = df.columns
    rows = df.withColumns({"_label": F.col(label), "_order": F.struct(hashed_order(key, seed), F.col(key))})
    ranges = written(rows.repartitionByRange("_label", "_order").withColumn("_range", F.spark_partition_id()), "split")
    sizes = ranges.groupBy("_label", "_range").agg(F.count("*").alias("_size"))
    each = Window.partitionBy("_label")
    before = F.coalesce(F.sum("_size").over(each.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each label and range.
    sizes = F.broadcast(sizes.withColumns({"_before": before, "_all": F.sum("_size").over(each)}).select(F.col("_label").alias("_of"), F.col("_range").alias("_in"), "_before", "_all"))
    own = F.row_number().over(Window.partitionBy("_label", "_range").orderBy("_order")) - 1
    placed = ranges.withColumn("_own", own).join(sizes, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    upto = (F.col("_before") + F.col("_own") + 1) * parts
    part = F.when(upto <= F.col("_all") * shares[0], "train").when(upto <= F.col("_all") * (shares[0] + shares[1]), "validation").otherwise("test")
    return placed.select(*names, part.alias("part"))


def training_params(model_size: Column, rows: Column, batch: Column) -> tuple[Column, Column]:
    """Epochs and patience for sizes of model, data and batch."""
    epochs = F.when(model_size < 1e8, 5).when(model_size < 3e8, 10).otherwise(20)
    patience = F.when(model_size < 1e8, 5).when(model_size < 3e8, 10).otherwise(15)
    scale = F.when(rows < 50_000, 0.8).when(rows < 500_000, 1.0).otherwise(1.5) * F.when(batch >= 32, 1.0).otherwise(1.2)
    return ((10 + epochs) * scale).cast("int"), ((5 + patience) * scale).cast("int")


def mean_vectors(neighbours: DataFrame, query_id: str, vector: str = "embedding") -> DataFrame:
    """query_id, at, mean: the mean of the neighbours' vectors, value by value."""
    return neighbours.select(query_id, F.posexplode(vector).alias("at", "x")).groupBy(query_id, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def logistic_baseline(df: DataFrame, label: str, key: str, vector: str = "embedding", max_iter: int = 1000, seed: int = 42):
    """A logistic regression fitted on the training and validation parts (see `stratified_split`), and the test part with its prediction."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = written(stratified_split(df, label, key, seed), "logistic").withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(featuresCol="_v", labelCol=label, maxIter=max_iter, predictionCol="prediction").fit(data.filter("part <> 'test'"))
    return model, model.transform(data.filter("part = 'test'")).drop("_v", "part", "rawPrediction", "probability")


def neighbour_baseline(neighbours: DataFrame, labels: DataFrame, query_id: str, label: str, vector: str = "embedding"):
    """The same regression on the means of each question's neighbours' vectors; labels has query_id and label."""
    means = mean_vectors(neighbours, query_id, vector).groupBy(query_id)
    rows = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("_mean"))
    return logistic_baseline(rows.join(labels, query_id), label, query_id, "_mean")
