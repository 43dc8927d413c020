"""Models on traces: logistic regression by gradient descent, naive Bayes, hold-outs, clusters.

Gradient steps are aggregations: a step sends one weight for each feature to the tasks and brings one
gradient for each feature back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelith.functions import stats
from tracelith.functions.tokens import ngrams, prefix
from tracelith.operators import evaluate
from tracelith.sources.scratch import Scratch

SCALAR_EPOCHS, SCALAR_RATE, SPARSE_EPOCHS, SPARSE_RATE, L2 = 400, 0.3, 300, 0.4, 1e-3


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def feature_sets(traces: DataFrame, low: int = 1, high: int = 3, fraction: float = 1.0) -> DataFrame:
    """features: distinct n-grams of the first part of each trace, as strings."""
    cut = prefix(F.col("tokens"), fraction)
    return traces.withColumn("features", F.array_sort(F.transform(F.array_distinct(ngrams(cut, low, high)), lambda m: F.array_join(m, " "))))


def vocabulary(rows: DataFrame, least: int) -> list[str]:
    """Features of `least` rows at least, sorted. A model has one weight for each of them, on the driver too."""
    counts = rows.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return sorted(r.f for r in counts.select("f").collect())


def weighted(rows: DataFrame, weights: DataFrame, bias: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds score: the sigmoid of the bias and the weights (f, w, and keys) of a row's features. Rows are known by trace_id."""
    found = rows.select("trace_id", *keys, F.explode("features").alias("f")).join(weights, ["f", *keys]).groupBy("trace_id", *keys).agg(F.sum("w").alias("_w"))
    return rows.join(found, ["trace_id", *keys], "left").withColumn("score", sigmoid(bias + F.coalesce("_w", F.lit(0.0)))).drop("_w")


def descend(x: list[np.ndarray], y: np.ndarray, n: np.ndarray, width: int, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    """Full-batch descent on rows with sets of features; n rows of each kind, y of them positive."""
    w, b, total = np.zeros(width), 0.0, n.sum()
    flat, owner = np.concatenate([*x, np.zeros(0, int)]).astype(int), np.repeat(np.arange(len(x)), [len(a) for a in x])
    for _ in range(epochs):
        z = b + np.bincount(owner, w[flat], minlength=len(x))
        error = n / (1 + np.exp(-z)) - y
        w, b = w - rate * (np.bincount(flat, error[owner], minlength=width) / total + l2 * w), b - rate * error.sum() / total
    return w, float(b)


@dataclass
class Logistic:
    weights: dict[str, float]
    bias: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds score; unknown features add nothing."""
        return weighted(rows, rows.sparkSession.createDataFrame(list(self.weights.items()), "f string, w double"), F.lit(self.bias))

    def top(self, k: int = 20) -> list[tuple[str, float]]:
        return sorted(self.weights.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:k]


def sparse_logistic(rows: DataFrame, least: int = 12, epochs: int = SPARSE_EPOCHS, rate: float = SPARSE_RATE, l2: float = L2, kinds: int = 200_000) -> Logistic:
    """Binary features by full-batch descent.

    Rows with equal known features are one weighted row, and up to `kinds` of those the descent runs in
    memory; beyond that every step is an aggregation over all rows. Both do the same steps.
    """
    return fold_logistic(rows.withColumn("fold", F.lit(0)), [None], least, epochs, rate, l2, kinds)[None]


def known_sets(rows: DataFrame, names: DataFrame) -> DataFrame:
    """fold, features (numbers of the named ones, in order), n rows, y of them positive."""
    held = rows.select("trace_id", F.explode("features").alias("f")).join(names, "f").groupBy("trace_id").agg(F.sort_array(F.collect_list("i")).alias("features"))
    sets = rows.select("trace_id", "fold", F.col("is_correct").cast("double").alias("y")).join(held, "trace_id", "left")
    return sets.groupBy("fold", F.coalesce("features", F.expr("cast(array() as array<int>)")).alias("features")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


def fold_logistic(rows: DataFrame, folds: list[int | None], least: int, epochs: int = SPARSE_EPOCHS, rate: float = SPARSE_RATE, l2: float = L2, kinds: int = 200_000) -> dict[int | None, Logistic]:
    """For each of `folds` a model of the rows (trace_id, features, is_correct, fold) of all other folds; None leaves out none.

    Features and sets are counted once, by fold.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    counts = rows.select("fold", F.explode("features").alias("f")).groupBy("f", "fold").agg(F.count(F.lit(1)).alias("n")).groupBy("f").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("by"))
    vocab = sorted((r.f, r.n, r.by) for r in counts.filter(F.col("n") >= least).collect())
    names = spark.createDataFrame([(f, i) for i, (f, _, _) in enumerate(vocab)], "f string, i int")
    sets = scratch.write(known_sets(rows, names), "sets")
    small = sets.count() <= kinds
    data = sorted((r.features, r.fold, r.n, r.y) for r in sets.collect()) if small else []
    out = {}
    for k in folds:
        known = np.array([n - by.get(k, 0) >= least for _, n, by in vocab], bool)
        place = np.cumsum(known) - 1
        words = [f for (f, _, _), ok in zip(vocab, known, strict=True) if ok]
        if small:
            mine = [(fs, n, y) for fs, fold, n, y in data if fold != k]
            each = [np.array(fs, int) for fs, _, _ in mine]
            w, b = descend([place[f[known[f]]] for f in each], np.array([y for *_, y in mine], float), np.array([n for _, n, _ in mine], float), len(words), epochs, rate, l2)
            out[k] = Logistic(dict(zip(words, w.tolist(), strict=True)), b)
        else:
            train = sets if k is None else sets.filter(F.col("fold") != k)
            out[k] = wide_descent(train, {i: f for i, ((f, _, _), ok) in enumerate(zip(vocab, known, strict=True)) if ok}, epochs, rate, l2)
    return out


def wide_descent(sets: DataFrame, words: dict[int, str], epochs: int, rate: float, l2: float) -> Logistic:
    """The same descent where the sets don't fit the driver: each step is an aggregation."""
    spark = sets.sparkSession
    w, b, total = dict.fromkeys(words, 0.0), 0.0, sets.agg(F.sum("n")).first()[0]
    rows = sets.withColumn("id", F.xxhash64("fold", "features"))
    for _ in range(epochs):
        table = spark.createDataFrame(list(w.items()), "i int, w double")
        z = rows.select("id", F.explode("features").alias("i")).join(table, "i").groupBy("id").agg(F.sum("w").alias("z"))
        error = rows.join(z, "id", "left").withColumn("e", F.col("n") * sigmoid(F.lit(b) + F.coalesce("z", F.lit(0.0))) - F.col("y"))
        step = error.select("e", F.explode(F.concat("features", F.array(F.lit(-1)))).alias("i")).groupBy("i").agg(F.sum("e").alias("g"))
        g = {r.i: r.g for r in step.collect()}
        w = {i: x - rate * (g.get(i, 0.0) / total + l2 * x) for i, x in w.items()}
        b -= rate * g.get(-1, 0.0) / total
    return Logistic({words[i]: x for i, x in w.items()}, b)


@dataclass
class Scalar:
    mean: float
    deviation: float
    weight: float
    bias: float

    def score(self, rows: DataFrame, value: Column) -> DataFrame:
        return rows.withColumn("score", sigmoid(F.lit(self.bias) + self.weight * (value - self.mean) / self.deviation))


def scalar_logistic(rows: DataFrame, value: Column, epochs: int = SCALAR_EPOCHS, rate: float = SCALAR_RATE, l2: float = L2) -> Scalar:
    """One standardised number by full-batch descent, on the counts of its distinct values."""
    return scalar_folds(rows.withColumn("fold", F.lit(0)), value, [None], epochs, rate, l2)[None]


def scalar_folds(rows: DataFrame, value: Column, folds: list[int | None], epochs: int = SCALAR_EPOCHS, rate: float = SCALAR_RATE, l2: float = L2) -> dict[int | None, Scalar]:
    """For each of `folds` a model of the rows of all others. Distinct values (lengths: a few thousand) come to the driver once."""
    counts = rows.select("fold", value.cast("double").alias("x"), F.col("is_correct").cast("double").alias("y")).groupBy("fold", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    data = sorted((r.x, r.fold, r.n, r.y) for r in counts.collect())
    out = {}
    for k in folds:
        x, n, y = (np.array(c, float) for c in zip(*((x, n, y) for x, fold, n, y in data if fold != k), strict=True))
        mean = float((x * n).sum() / n.sum())
        deviation = math.sqrt(float((n * (x - mean) ** 2).sum() / n.sum())) or 1.0
        deviation = deviation if deviation > 1e-9 else 1.0
        z, w, b = (x - mean) / deviation, 0.0, 0.0
        for _ in range(epochs):
            e = n / (1 + np.exp(-(w * z + b))) - y
            w, b = w - rate * float((e * z).sum() / n.sum() + l2 * w), b - rate * float(e.sum() / n.sum())
        out[k] = Scalar(mean, deviation, w, b)
    return out


def naive_bayes(rows: DataFrame, least: int = 12) -> Logistic:
    """Bernoulli naive Bayes as a sum: a constant, and a difference for each feature that is present."""
    total = rows.agg(F.count_if("is_correct").alias("s"), F.count_if(~F.col("is_correct")).alias("f")).first()
    counts = rows.select("is_correct", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("is_correct").alias("s"), F.count_if(~F.col("is_correct")).alias("n")).filter(F.col("s") + F.col("n") >= least).orderBy("f").collect()
    constant, deltas = math.log((total.s + 1) / (total.f + 1)), {}
    for r in counts:
        p, q = (r.s + 1) / (total.s + 2), (r.n + 1) / (total.f + 2)
        absent = math.log((1 - p) / (1 - q))
        constant += absent
        deltas[r.f] = math.log(p / q) - absent
    return Logistic(deltas, constant)


def hold_out(traces: DataFrame, folds: int = 5, low: int = 1, high: int = 3, fraction: float = 1.0, least: int = 12, dealt: DataFrame | None = None) -> DataFrame:
    """Each trace scored by the model of the folds without its question: `score`, and `length_score` of the baseline on trace length.

    Questions fall into folds by a hash of their id, or as `dealt` (question_id, fold) says, such as evaluate.question_folds.
    """
    spark = traces.sparkSession
    scratch = Scratch(spark)
    fold = evaluate.hashed_folds(traces, folds) if dealt is None else dealt
    rows = scratch.write(feature_sets(traces, low, high, fraction).select("trace_id", "question_id", "tokens", "is_correct", "features").join(fold, "question_id"), "rows")
    ks = list(range(folds))
    models = fold_logistic(rows, ks, least)
    weights = spark.createDataFrame([(k, f, w) for k in ks for f, w in models[k].weights.items()], "fold int, f string, w double")
    n = F.size("tokens")
    base = scalar_folds(rows, n, ks)
    fits = spark.createDataFrame([(k, models[k].bias, base[k].mean, base[k].deviation, base[k].weight, base[k].bias) for k in ks], "fold int, bias double, mean double, deviation double, slope double, base double")
    out = weighted(rows.join(F.broadcast(fits), "fold"), weights, F.col("bias"), ("fold",))
    return out.select("fold", "question_id", "trace_id", "tokens", "is_correct", "score", sigmoid(F.col("base") + F.col("slope") * (n - F.col("mean")) / F.col("deviation")).alias("length_score"))


def hold_out_metrics(scored: DataFrame) -> DataFrame:
    """Mean over folds of AUC, accuracy and question-local AUC of both scores."""
    rows = scored.select("fold", "question_id", "is_correct", F.explode(F.array(F.struct(F.lit("motifs").alias("model"), F.col("score").alias("s")), F.struct(F.lit("length").alias("model"), F.col("length_score").alias("s")))).alias("t")).select("fold", "question_id", "is_correct", "t.*")
    keys = ["model", "fold"]
    per = stats.auc(rows, "s", "is_correct", keys).select(*keys, "auc").join(evaluate.confusion(rows, "s", "is_correct", by=tuple(keys)).select(*keys, "accuracy"), keys)
    local = stats.auc(rows, "s", "is_correct", [*keys, "question_id"]).filter("positives > 0 and negatives > 0").groupBy(*keys).agg(F.avg("auc").alias("local_auc"))
    return per.join(local, keys, "left").groupBy("model").agg(F.avg("auc").alias("auc"), F.avg("accuracy").alias("accuracy"), F.avg("local_auc").alias("question_local_auc"))


def transfer(a: DataFrame, b: DataFrame, least: int = 12) -> DataFrame:
    """Scores of b's traces under a model of a."""
    return sparse_logistic(feature_sets(a), least).score(feature_sets(b))


def shared_features(a: Logistic, b: Logistic) -> dict[str, float]:
    """Features of both models, and the share whose weights have one sign."""
    both = a.weights.keys() & b.weights.keys()
    return {"shared": len(both), "sign_agreement": sum(a.weights[f] * b.weights[f] > 0 for f in both) / len(both) if both else 0.0}


def compression_curve(spark: SparkSession, traces: DataFrame, sizes: tuple[int, ...] = (1, 5, 10, 25, 50)) -> list[tuple[int, float]]:
    """AUC of naive Bayes with its k strongest features alone."""
    rows = feature_sets(traces)
    model = naive_bayes(rows)
    out = []
    for k in sizes:
        small = Logistic(dict(model.top(k)), model.bias)
        out.append((k, stats.auc(small.score(rows), "score", "is_correct").first().auc))
    return out


def clusters(matrix: DataFrame, tokens: list[str], k: int = 4, dims: int = 2, seed: int = 7) -> DataFrame:
    """question_id, cluster: standardised columns, principal components, k-means.

    It stands where the toolkit embeds and clusters by density; its clusters aren't comparable to those.
    The fits read a written matrix: none of them makes it anew, and k-means, which reads on after the last row,
    fails on rows that a sorted join makes.
    """
    matrix = Scratch(matrix.sparkSession).write(matrix.sortWithinPartitions("question_id"), "matrix")
    rows = VectorAssembler(inputCols=tokens, outputCol="raw").transform(matrix)
    rows = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    rows = PCA(k=min(dims, len(tokens)), inputCol="scaled", outputCol="pca").fit(rows).transform(rows)
    return KMeans(k=k, seed=seed, featuresCol="pca", predictionCol="cluster").fit(rows).transform(rows).drop("raw", "scaled", "pca")
