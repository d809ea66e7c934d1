"""Training the sentiment classifier on the library's own confident labels.

Feature weights, naive Bayes and all evaluation are relational and carry a ``run``
column: run 0 is the train/test split, runs 1 to 5 are the cross-validation folds,
so six models are fitted by one job.  Logistic regression is fitted by MLlib.
"""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatframe.functions.text import ngrams_of, round_half_even, words_of
from chatframe.operators.enrich import has_cleaned_text, is_text
from chatframe.operators.sampling import assign_folds, ranked, split_train_test
from chatframe.operators.topn import top_rows
from chatframe.plans.store import stored
from chatframe.schema import (
    FOLDS, LABELS, MIN_MESSAGES_FOR_MODEL, MIN_TIER_ROWS, MIN_TRAINING_ROWS,
    SAMPLES_PER_CLASS, require_columns,
)

# Feature and model settings.
MAX_FEATURES = 5000
MIN_DOCUMENTS = 2
ALPHA = 0.1
REGRESSION_C = 1.0
MAX_ITERATIONS = 500
TOLERANCE = 1e-14
ROWS_PER_TASK = 20_000

NAIVE_BAYES, LOGISTIC_REGRESSION = "Naive Bayes", "Logistic Regression"
TIERS = (("High",), ("High", "Medium"), ("High", "Medium", "Low"))
KEY = ("chat_id", "msg_seq")


@dataclass
class SentimentModel:
    """A linear model over TF-IDF terms; at most ``MAX_FEATURES`` terms.

    ``terms`` maps a term to its idf followed by one weight per label of ``labels``.
    """

    name: str
    labels: list[str]
    bias: list[float]
    terms: dict[str, tuple[float, ...]]

    def table(self, spark: SparkSession) -> DataFrame:
        """``(term, weights)``, a row per term."""
        terms, weights = list(self.terms), [[float(x) for x in v] for v in self.terms.values()]
        return spark.createDataFrame(
            pa.table({"term": pa.array(terms, pa.string()), "weights": pa.array(weights, pa.list_(pa.float64()))})
        )


@dataclass
class ClassifierResult:
    """What :func:`train_classifier` measured, for the winner, plus both candidates."""

    model: SentimentModel
    model_name: str
    accuracy: float
    f1_score: float
    cross_val_scores: list[float]
    cross_val_mean: float
    cross_val_std: float
    training_samples: int
    test_samples: int
    classes: list[str]
    label_distribution: dict[str, int]
    confusion: DataFrame
    report: DataFrame
    candidates: dict[str, dict[str, object]] = field(default_factory=dict)
    trained_at: str = ""

    def metadata(self) -> dict[str, object]:
        names = (
            "model_name", "accuracy", "f1_score", "cross_val_mean", "cross_val_std",
            "training_samples", "test_samples", "classes", "trained_at",
        )
        return {n: getattr(self, n) for n in names}


# --- choosing rows -------------------------------------------------------------


def run_modes(
    messages: DataFrame, *, model_exists: bool, force: bool = False,
    min_messages: int = MIN_MESSAGES_FOR_MODEL,
) -> DataFrame:
    """Per chat: fewer text messages than ``min_messages`` (1: every chat with text gets a
    model), train one, or use the saved one."""
    enough = "FULL" if force or not model_exists else "FAST"
    return messages.groupBy("chat_id").agg(F.count_if(is_text()).alias("text_messages")).withColumn(
        "mode",
        F.when(F.col("text_messages") < min_messages, "NO_ML").otherwise(enough),
    )


def training_sample(scored: DataFrame, n: int = SAMPLES_PER_CLASS) -> DataFrame:
    """Equally many confident messages per label, at most ``n`` each.

    High confidence alone is used when it gives at least 30 rows of two labels, else
    Medium is added, else all text messages are taken.  One aggregation counts rows
    by confidence and label; the driver reads those (at most nine) numbers.  Pass a
    stored table, as it is read a second time for the rows.
    """
    require_columns(scored, ("cleaned_message", "sentiment_label", "sentiment_confidence"))
    base = scored.filter(is_text() & has_cleaned_text()).select(
        *KEY, "cleaned_message", "sentiment_label", "sentiment_confidence"
    )
    cells = base.groupBy("sentiment_confidence", "sentiment_label").count().collect()
    sizes: dict[str, int] = {}
    for tier in TIERS:
        sizes = {}
        for confidence, label, count in cells:
            if confidence in tier:
                sizes[label] = sizes.get(label, 0) + count
        if sum(sizes.values()) >= MIN_TIER_ROWS and len(sizes) >= 2:
            break
    per_class = min([n, *sizes.values()])
    chosen = base.filter(F.col("sentiment_confidence").isin(*tier)).drop("sentiment_confidence")
    return ranked(chosen, "sentiment_label", "sample", limit=per_class).select(
        *KEY, "cleaned_message", "sentiment_label"
    )


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows with text and one of the three labels."""
    require_columns(rows, ("cleaned_message", "sentiment_label"))
    return rows.filter(has_cleaned_text() & F.col("sentiment_label").isin(*LABELS))


def runs_of(sample: DataFrame) -> DataFrame:
    """``(run, part, chat_id, msg_seq, sentiment_label)``: the split and the folds."""
    split = split_train_test(sample).select(
        F.lit(0).alias("run"), "part", *KEY, "sentiment_label"
    )
    in_fold = F.col("fold") == F.col("run") - 1
    folds = (
        assign_folds(sample)
        .withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(FOLDS))))
        .select("run", F.when(in_fold, "test").otherwise("train").alias("part"), *KEY, "sentiment_label")
    )
    return split.unionByName(folds)


# --- features --------------------------------------------------------------------


def term_counts(rows: DataFrame) -> DataFrame:
    """``(chat_id, msg_seq, term, n)`` of words and word pairs."""
    words = F.col("_words")
    return (
        rows.select(*KEY, words_of(F.col("cleaned_message")).alias("_words"))
        .select(*KEY, F.explode(F.concat(words, ngrams_of(words, 2))).alias("term"))
        .groupBy(*KEY, "term")
        .agg(F.count("*").alias("n"))
    )


def vocabulary(
    counts: DataFrame, runs: DataFrame, max_features: int = MAX_FEATURES
) -> DataFrame:
    """``(run, term, idf)`` learned from the training part of each run."""
    train = runs.filter(F.col("part") == "train")
    documents = train.groupBy("run").agg(F.count("*").alias("documents"))
    totals = (
        counts.join(train, list(KEY))
        .groupBy("run", "term")
        .agg(F.sum("n").alias("total"), F.count("*").alias("df"))
        .filter(F.col("df") >= MIN_DOCUMENTS)
    )
    by_count = [F.desc("total"), F.col("term")]
    return (
        top_rows(totals, ["run"], by_count, max_features, key="term", rank="position")
        .join(documents, "run")
        .select(
            "run", "term", "position",
            (F.ln((1 + F.col("documents")) / (1 + F.col("df"))) + 1).alias("idf"),
        )
    )


def features(counts: DataFrame, runs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(run, part, chat_id, msg_seq, sentiment_label, term, weight)``, unit length
    per message; the cut comes before the length."""
    message = Window.partitionBy("run", *KEY)
    weight = (1 + F.ln("n")) * F.col("idf")
    return (
        counts.join(runs, list(KEY))
        .join(vocab, ["run", "term"])
        .withColumn("weight", weight)
        .withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") ** 2).over(message)))
        .select("run", "part", *KEY, "sentiment_label", "term", "position", "weight")
    )


# --- naive Bayes -----------------------------------------------------------------


def naive_bayes_weights(weighted: DataFrame, runs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(run, label, term, weight)``: smoothed log share of the term in the class."""
    labels = class_priors(runs).select("run", "label")
    sums = (
        weighted.filter(F.col("part") == "train")
        .groupBy("run", F.col("sentiment_label").alias("label"), "term")
        .agg(F.sum("weight").alias("s"))
    )
    # at most three labels per run, so this equi-join gives at most three rows per term
    grid = (
        vocab.select("run", "term")
        .join(labels, "run")
        .join(sums, ["run", "label", "term"], "left")
        .withColumn("s", F.coalesce("s", F.lit(0.0)))
    )
    totals = grid.groupBy("run", "label").agg(
        F.sum("s").alias("class_total"), F.count("*").alias("terms")
    )
    return grid.join(totals, ["run", "label"]).select(
        "run", "label", "term",
        F.ln((F.col("s") + ALPHA) / (F.col("class_total") + ALPHA * F.col("terms"))).alias("weight"),
    )


def class_priors(runs: DataFrame) -> DataFrame:
    """``(run, label, bias)``: log share of the label among training rows."""
    counts = (
        runs.filter(F.col("part") == "train")
        .groupBy("run", F.col("sentiment_label").alias("label"))
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("run"))
    return counts.withColumn("bias", F.ln(F.col("n") / total)).select("run", "label", "bias")


def naive_bayes_predictions(
    weighted: DataFrame, runs: DataFrame, weights: DataFrame
) -> DataFrame:
    """``(run, label, prediction)`` of the test rows; the smaller label on a tie."""
    test = runs.filter(F.col("part") == "test")
    candidates = test.join(class_priors(runs), "run")
    evidence = (
        weighted.filter(F.col("part") == "test")
        .withColumnRenamed("weight", "w")
        .join(weights, ["run", "term"])
        .groupBy("run", *KEY, "label")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("evidence"))
    )
    return (
        candidates.join(evidence, ["run", *KEY, "label"], "left")
        .withColumn("score", F.col("bias") + F.coalesce("evidence", F.lit(0.0)))
        .groupBy("run", *KEY, "sentiment_label")
        .agg(F.min_by("label", F.struct(-F.col("score"), "label")).alias("prediction"))
        .select("run", F.col("sentiment_label").alias("label"), "prediction")
    )


# --- evaluation --------------------------------------------------------------------


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("run", "label", "prediction").agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per run and label of the confusion counts."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = matrix.groupBy("run", "label").agg(
        F.sum("n").alias("support"), F.sum(hit).alias("hits")
    )
    predicted = matrix.groupBy("run", F.col("prediction").alias("label")).agg(
        F.sum("n").alias("predicted")
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.col("hits") / F.col("support")
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted")))
    return actual.join(predicted, ["run", "label"], "left").select(
        "run", "label", "support", "hits",
        precision.alias("precision"), recall.alias("recall"),
        F.coalesce(f1, F.lit(0.0)).alias("f1"),
    )


def run_scores(report: DataFrame) -> DataFrame:
    """Accuracy and weighted F1 per run."""
    n = F.sum("support")
    return report.groupBy("run").agg(
        (F.sum("hits") / n).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
    )


def cross_validation(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the weighted F1 over the folds."""
    return scores.filter(F.col("run") > 0).agg(
        F.count("*").alias("folds"),
        round_half_even(F.avg("weighted_f1"), 4).alias("cross_val_mean"),
        round_half_even(F.stddev_pop("weighted_f1"), 4).alias("cross_val_std"),
    )


# --- logistic regression -------------------------------------------------------------


def regression_rows(weighted: DataFrame, runs: DataFrame, size: int = MAX_FEATURES) -> DataFrame:
    """One vector per run and message; a message has at most ``size`` entries.

    The vectors are written as the structs they consist of and read back as vectors.
    """
    packed = weighted.groupBy("run", *KEY).agg(
        F.array_sort(F.collect_list(F.struct("position", "weight"))).alias("entries")
    )
    empty = F.array().cast("array<struct<position:int,weight:double>>")
    entries = F.coalesce("entries", empty)
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),  # sparse
        F.lit(size).alias("size"),
        F.transform(entries, lambda e: (e["position"] - 1).cast("int")).alias("indices"),
        F.transform(entries, lambda e: e["weight"]).alias("values"),
    )
    rows = runs.join(packed, ["run", *KEY], "left").select(
        "run", "part", *KEY, "sentiment_label", vector.alias("features")
    )
    return stored(rows, "training-vectors", {"features": VectorUDT()})


def fit_regression(train: DataFrame, labels: list[str]):
    """Class-balanced, L2-regularised; the penalty is ``1 / (C * rows)``."""
    counts = {r[0]: r[1] for r in train.groupBy("sentiment_label").count().collect()}
    n = sum(counts.values())
    weight = reduce(
        lambda acc, x: acc.when(F.col("sentiment_label") == x, n / (len(counts) * counts[x])),
        labels[1:],
        F.when(F.col("sentiment_label") == labels[0], n / (len(counts) * counts[labels[0]])),
    )
    # every iteration is a job over these partitions: do not run it over empty ones
    rows = train.select(
        "features", _label_index(labels).alias("label"), weight.alias("class_weight")
    ).coalesce(max(1, n // ROWS_PER_TASK))
    return LogisticRegression(
        regParam=1.0 / (REGRESSION_C * n), elasticNetParam=0.0, standardization=False,
        maxIter=MAX_ITERATIONS, tol=TOLERANCE, weightCol="class_weight", family="auto",
    ).fit(rows)


def _label_index(labels: list[str]) -> Column:
    index = F.array_position(F.array(*map(F.lit, labels)), F.col("sentiment_label")) - 1
    return index.cast("double")


def regression_predictions(model, test: DataFrame, labels: list[str]) -> DataFrame:
    names = F.array(*map(F.lit, labels))
    return model.transform(test).select(
        "run", F.col("sentiment_label").alias("label"),
        F.get(names, F.col("prediction").cast("int")).alias("prediction"),
    )


def regression_coefficients(spark: SparkSession, vocab: DataFrame, fitted: dict[int, object], labels: list[str]) -> DataFrame:
    """``(run, label, term, weight)`` of all fits; the intercept has the empty term.

    Two classes have one row of weights, that of the second label.
    """
    rows: dict[str, list] = {"run": [], "label": [], "position": [], "weight": []}
    for run, model in fitted.items():
        matrix, intercepts = model.coefficientMatrix.toArray(), list(model.interceptVector.toArray())
        for label, weights, bias in zip(labels[-len(intercepts):], matrix, intercepts):
            rows["run"] += [run] * (len(weights) + 1)
            rows["label"] += [label] * (len(weights) + 1)
            rows["position"] += range(len(weights) + 1)
            rows["weight"] += [float(bias), *map(float, weights)]
    types = (pa.int32(), pa.string(), pa.int32(), pa.float64())
    table = spark.createDataFrame(pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types)}))
    known = vocab.select("run", "position", "term")
    return table.join(known, ["run", "position"], "left").filter("term IS NOT NULL OR position = 0").select(
        "run", "label", F.coalesce("term", F.lit("")).alias("term"), "weight"
    )


def regression_gradient(weighted: DataFrame, runs: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``(run, label, term, gradient)`` of the penalised loss at the coefficients: 0 at the optimum.

    The loss is ``C * sum(weight_i * loss_i) + |w|^2 / 2`` over the training rows, with weights
    that balance the classes and no penalty on the intercepts, divided by ``C * rows``.
    """
    train = runs.filter(F.col("part") == "train")
    entries = weighted.filter(F.col("part") == "train").select("run", *KEY, "term", F.col("weight").alias("x"))
    entries = entries.union(train.select("run", *KEY, F.lit("").alias("term"), F.lit(1.0).alias("x")))
    sizes = train.groupBy("run", "sentiment_label").agg(F.count("*").alias("n_label"))
    per_run = sizes.groupBy("run").agg(F.sum("n_label").alias("n"), F.count("*").alias("k"))
    balance = sizes.join(per_run, "run").select(
        "run", "sentiment_label", "n", (F.col("n") / (F.col("k") * F.col("n_label"))).alias("balance")
    )
    margins = (
        entries.join(coefficients, ["run", "term"])
        .groupBy("run", *KEY, "label").agg(F.sum(F.col("x") * F.col("weight")).alias("margin"))
    )
    # With one row of weights the other label's margin is 0, which the sum of powers starts from.
    one_row = coefficients.groupBy("run").agg((F.count_distinct("label") == 1).cast("double").alias("other"))
    whole = margins.join(one_row, "run").groupBy("run", *KEY).agg(
        (F.first("other") + F.sum(F.exp("margin"))).alias("powers")
    )
    slopes = (
        margins.join(whole, ["run", *KEY]).join(train.select("run", *KEY, "sentiment_label"), ["run", *KEY])
        .join(balance, ["run", "sentiment_label"])
        .select(
            "run", *KEY, "label", "n",
            (F.col("balance") * (F.exp("margin") / F.col("powers") - (F.col("sentiment_label") == F.col("label")).cast("double"))).alias("slope"),
        )
    )
    summed = slopes.join(entries, ["run", *KEY]).groupBy("run", "label", "term").agg(
        (F.sum(F.col("slope") * F.col("x")) / F.first("n")).alias("data")
    )
    return coefficients.join(per_run, "run").join(summed, ["run", "label", "term"], "left").select(
        "run", "label", "term",
        (
            F.coalesce("data", F.lit(0.0))
            + F.when(F.col("term") == "", 0.0).otherwise(F.col("weight") / (REGRESSION_C * F.col("n")))
        ).alias("gradient"),
    )


def fit_regressions(weighted: DataFrame, runs: DataFrame, labels: list[str]) -> tuple[dict[int, object], DataFrame]:
    """A model for each run, and the vectors they were fitted on."""
    vectors = regression_rows(weighted, runs)
    parts = [vectors.filter((F.col("run") == run) & (F.col("part") == "train")) for run in range(FOLDS + 1)]
    # the iterations of one fit leave most cores idle, so the fits run side by side
    with ThreadPoolExecutor(len(parts)) as pool:
        fit = inheritable_thread_target(weighted.sparkSession)(fit_regression)
        return dict(enumerate(pool.map(fit, parts, [labels] * len(parts)))), vectors


# --- the whole training ----------------------------------------------------------------


def model_of(vocab: DataFrame, weights: DataFrame, priors: DataFrame) -> SentimentModel:
    """The naive Bayes model of run 0; at most ``MAX_FEATURES`` terms reach the driver."""
    bias = sorted((r["label"], r["bias"]) for r in priors.filter("run = 0").collect())
    rows = (
        vocab.filter("run = 0")
        .join(weights.filter("run = 0"), ["run", "term"])
        .groupBy("term", "idf")
        .agg(F.array_sort(F.collect_list(F.struct("label", "weight"))).alias("w"))
        .collect()
    )
    return SentimentModel(
        NAIVE_BAYES, [x for x, _ in bias], [b for _, b in bias],
        {r["term"]: (r["idf"], *[w["weight"] for w in r["w"]]) for r in rows},
    )


def train_classifier(rows: DataFrame) -> ClassifierResult:
    """Fit and evaluate both models; the higher weighted F1 wins, naive Bayes on a tie.

    The winner is the model of the training part; it is not fitted again.
    """
    spark = rows.sparkSession
    sample = stored(
        valid_rows(rows).select(*KEY, "cleaned_message", "sentiment_label"), "training-sample"
    )
    distribution = {
        r[0]: r[1] for r in sample.groupBy("sentiment_label").count().orderBy("sentiment_label").collect()
    }
    if sum(distribution.values()) < MIN_TRAINING_ROWS:
        raise ValueError(
            f"only {sum(distribution.values())} valid training rows, need {MIN_TRAINING_ROWS}"
        )
    if len(distribution) < 2:
        raise ValueError("training needs at least two labels")
    runs = stored(runs_of(sample), "training-runs")
    counts = stored(term_counts(sample), "training-counts")
    vocab = stored(vocabulary(counts, runs), "training-vocabulary")
    weighted = stored(features(counts, runs, vocab), "training-features")
    labels = sorted(distribution)
    weights = naive_bayes_weights(weighted, runs, vocab)
    bayes = naive_bayes_predictions(weighted, runs, weights)
    regressions, vectors = fit_regressions(weighted, runs, labels)
    regression = reduce(
        DataFrame.unionByName,
        [
            regression_predictions(
                m, vectors.filter((F.col("run") == run) & (F.col("part") == "test")), labels
            )
            for run, m in regressions.items()
        ],
    )
    candidates = {
        NAIVE_BAYES: _evaluate(spark, bayes),
        LOGISTIC_REGRESSION: _evaluate(spark, regression),
    }
    best = max(candidates, key=lambda name: candidates[name]["f1_score"])
    sizes = {r[0]: r[1] for r in runs.filter("run = 0").groupBy("part").count().collect()}
    if best == NAIVE_BAYES:
        model = model_of(vocab, weights, class_priors(runs))
    else:
        model = _regression_model(vocab, regressions[0], labels)
    won = candidates[best]
    return ClassifierResult(
        model=model, model_name=best, accuracy=won["accuracy"], f1_score=won["f1_score"],
        cross_val_scores=won["cross_val_scores"], cross_val_mean=won["cross_val_mean"],
        cross_val_std=won["cross_val_std"], training_samples=sizes.get("train", 0),
        test_samples=sizes.get("test", 0), classes=labels, label_distribution=distribution,
        confusion=won["confusion"], report=won["report"], candidates=candidates,
        trained_at=datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S"),
    )


def _evaluate(spark: SparkSession, predictions: DataFrame) -> dict[str, object]:
    """Collect the counts (runs x labels x labels, at most 54 rows) and derive metrics."""
    rows = confusion(predictions).collect()
    matrix = spark.createDataFrame(rows, "run int, label string, prediction string, n long")
    report = class_report(matrix)
    scores = {r["run"]: r for r in run_scores(report).collect()}
    folds = [scores[i]["weighted_f1"] for i in sorted(scores) if i > 0]
    mean = sum(folds) / len(folds)
    deviation = (sum((f - mean) ** 2 for f in folds) / len(folds)) ** 0.5
    return {
        "accuracy": round(scores[0]["accuracy"], 4),
        "f1_score": round(scores[0]["weighted_f1"], 4),
        "cross_val_scores": folds,
        "cross_val_mean": round(mean, 4),
        "cross_val_std": round(deviation, 4),
        "confusion": matrix.filter("run = 0").drop("run"),
        "report": report.filter("run = 0").drop("run", "hits"),
    }


def _regression_model(vocab: DataFrame, fitted, labels: list[str]) -> SentimentModel:
    """Weights of an MLlib model by term; two classes are written as (0, margin)."""
    matrix = fitted.coefficientMatrix.toArray()
    intercepts = list(fitted.interceptVector.toArray())
    if len(labels) == 2:
        matrix, intercepts = [[0.0] * matrix.shape[1], matrix[0]], [0.0, intercepts[0]]
    rows = vocab.filter("run = 0").select("term", "idf", "position").collect()
    return SentimentModel(
        LOGISTIC_REGRESSION, labels, [float(b) for b in intercepts],
        {t: (idf, *[float(row[p - 1]) for row in matrix]) for t, idf, p in rows},
    )
