"""Out-of-fold evaluation of four models of success, by folds of whole questions.

M0 the question's own success rate (an oracle), M1 trace length, M2 bags of tokens, M3 tokens, first
action and length. Regularised logistic regression with the strength chosen on inner folds. Question
effects are encoded for training; a held-out question is unknown to them, so they vanish in scoring.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelith.functions import stats
from tracelith.functions.tokens import first_action, prefix, qualifier_words
from tracelith.operators import evaluate
from tracelith.operators.signals import shuffled_prefix, trajectory
from tracelith.operators.summaries import nonzero

STRENGTHS = (0.01, 0.1, 1.0, 10.0)
MODELS = ("M0", "M1", "M2", "M3")
FIRST_MODELS = ("FA0", "FA1", "FA2", "FA3")


def columns(traces: DataFrame) -> DataFrame:
    """length, first (the first action, or token) and label, beside tokens and question_id."""
    first = F.coalesce(F.nullif(first_action(F.col("tokens")), F.lit("__NO_FIRST_ACTION__")), F.get("tokens", F.lit(0)), F.lit(""))
    return traces.withColumn("length", F.size("tokens").cast("double")).withColumn("first", first).withColumn("words", F.filter(F.split(qualifier_words(F.col("first")), " "), lambda w: w != "")).withColumn("label", F.col("is_correct").cast("double")).withColumn("has_action", (F.coalesce(F.nullif(first_action(F.col("tokens")), F.lit("__NO_FIRST_ACTION__")), F.lit("")) != "").cast("double"))


def stages(model: str, strength: float, n: int, bigrams: bool = False) -> Pipeline:
    """L1 for bags of tokens, L2 for the length; C is `strength` for n rows."""
    parts, inputs = [], []
    if model in ("M1", "M3"):
        parts += [VectorAssembler(inputCols=["length"], outputCol="length_v"), StandardScaler(inputCol="length_v", outputCol="length_s", withMean=True)]
        inputs.append("length_s")
    if model in ("M2", "M3"):
        parts.append(CountVectorizer(inputCol="tokens", outputCol="bag", minDF=2.0))
        inputs.append("bag")
        if bigrams:
            parts += [NGram(n=2, inputCol="tokens", outputCol="pairs"), CountVectorizer(inputCol="pairs", outputCol="pair_bag", minDF=2.0)]
            inputs.append("pair_bag")
        parts += [StringIndexer(inputCol="question_id", outputCol="question_i", handleInvalid="keep"), OneHotEncoder(inputCol="question_i", outputCol="question_v")]
        inputs.append("question_v")
    if model == "FA1":
        inputs.append("has_action")
    if model == "FA3":
        parts.append(CountVectorizer(inputCol="words", outputCol="word_bag", minDF=1.0))
        inputs.append("word_bag")
    if model in ("M3", "FA2"):
        parts += [StringIndexer(inputCol="first", outputCol="first_i", handleInvalid="keep"), OneHotEncoder(inputCol="first_i", outputCol="first_v")]
        inputs.append("first_v")
    parts += [VectorAssembler(inputCols=inputs, outputCol="features"), LogisticRegression(regParam=1.0 / (strength * max(1, n)), elasticNetParam=0.0 if model in ("M1", "FA1") else 1.0, standardization=False, maxIter=50)]
    return Pipeline(stages=parts)


def fit_score(train: DataFrame, test: DataFrame, model: str, strength: float, bigrams: bool = False) -> DataFrame:
    if model == "FA0" or (model == "FA3" and train.filter(F.size("words") > 0).isEmpty()):
        return test.crossJoin(F.broadcast(train.agg(F.avg("label").alias("score"))))
    out = stages(model, strength, train.count(), bigrams).fit(train).transform(test)
    return out.withColumn("score", vector_to_array("probability")[1])


def chosen_strength(spark: SparkSession, train: DataFrame, model: str, strengths: Iterable[float], folds: int) -> float:
    """The first strength with the best mean AUC over inner folds of questions."""
    strengths = tuple(strengths)
    if len(strengths) == 1:
        return strengths[0]
    rows = train.drop("fold").join(F.broadcast(evaluate.group_folds(spark, train, folds)), "question_id").persist()
    best = (-1.0, strengths[0])
    for c in strengths:
        values = [stats.auc(fit_score(rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k), model, c), "score", "is_correct").first().auc for k in range(folds)]
        if (mean := sum(values) / len(values)) > best[0] + 1e-12:
            best = (mean, c)
    rows.unpersist()
    return best[1]


def out_of_fold(spark: SparkSession, traces: DataFrame, model: str, folds: int = 5, inner: int = 3, strengths: Iterable[float] = (1.0,), shuffled: bool = False, reordered: bool = False, seed: int = 73) -> DataFrame:
    """trace_id, question_id, is_correct, fold, score of each trace by a model of the other folds. Controls: labels dealt anew (shuffled), tokens in random order (reordered)."""
    if reordered:
        traces = traces.withColumn("tokens", shuffled_prefix(F.col("tokens"), F.col("trace_id"), seed))
    if shuffled:
        from tracelith.operators.resample import shuffled_labels

        traces = shuffled_labels(traces, 1, seed).drop("draw")
    rows = columns(traces).join(F.broadcast(evaluate.group_folds(spark, traces, folds)), "question_id").persist()
    keep = ["trace_id", "question_id", "is_correct", "fold", "score"]
    if model == "M0":
        return evaluate.leave_out_rate(rows).select(*keep)
    out = None
    for k in range(folds):
        train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        part = fit_score(train, test, model, chosen_strength(spark, train, model, strengths, inner)).select(*keep)
        out = part if out is None else out.unionByName(part)
    return out


def report(spark: SparkSession, traces: DataFrame, models: Iterable[str] = MODELS, fraction: float = 1.0, **options) -> DataFrame:
    """AUC, accuracy, balanced accuracy and calibration error of each model over all out-of-fold scores of the first part of the traces."""
    cut = traces.withColumn("tokens", prefix(F.col("tokens"), fraction))
    out = None
    for m in models:
        scored = out_of_fold(spark, cut, m, **options)
        row = stats.auc(scored, "score", "is_correct").select("auc").crossJoin(evaluate.confusion(scored, "score", "is_correct").select("accuracy", "balanced_accuracy")).crossJoin(evaluate.calibration_error(scored, "score", "is_correct"))
        row = row.withColumn("model", F.lit(m)).withColumn("fraction", F.lit(fraction))
        out = row if out is None else out.unionByName(row)
    return out


def coefficients(train: DataFrame, model: str = "M2", strength: float = 1.0) -> DataFrame:
    """feature, coefficient (not zero) of a model of all rows; features are named by their stage's vocabulary."""
    spark = train.sparkSession
    rows = columns(train)
    fitted = stages(model, strength, rows.count()).fit(rows)
    attrs = fitted.transform(rows.limit(1)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for kind in attrs.values() for a in kind}
    bag = next((m.vocabulary for m in fitted.stages if hasattr(m, "vocabulary")), [])
    # a bag's attributes are numbered, not named
    spelled = {i: f"bag_{n[4:]}:{bag[int(n[4:])]}" if n.startswith("bag_") and n[4:].isdigit() else n for i, n in names.items()}
    values = fitted.stages[-1].coefficients.toArray().tolist()
    made = spark.createDataFrame([(spelled.get(i, str(i)), float(v)) for i, v in enumerate(values)], "feature string, coefficient double")
    return nonzero(made)


def prefix_report(spark: SparkSession, traces: DataFrame, models: Iterable[str] = ("M1", "M2"), fractions: Iterable[float] = (0.25, 0.5, 0.75, 1.0), **options) -> tuple[DataFrame, DataFrame]:
    """The report for first parts of the traces, as they are and with their tokens in random order; and each model's slope over the fractions and whether its AUC never falls."""
    parts = None
    for f in fractions:
        for control in (False, True):
            part = report(spark, traces, models, f, reordered=control, **options).withColumn("reordered", F.lit(control))
            parts = part if parts is None else parts.unionByName(part)
    return parts, trajectory(parts, "fraction", "auc", ("model", "reordered"))
