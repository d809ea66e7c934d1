"""Saving and loading trained models: a folder per version, a manifest written last.

A version is written as a whole below ``versions/`` under a name of its own; then one row is
added to the manifest.  Readers follow the row with the highest number, so a training that dies
half way leaves the model before it in place, and one that runs while others predict changes
nothing under them.  Nothing is overwritten.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatframe.operators.training import MAX_FEATURES, ClassifierResult, SentimentModel

METADATA_SCHEMA = (
    "model_name string, accuracy double, f1_score double, cross_val_mean double, "
    "cross_val_std double, training_samples int, test_samples int, classes array<string>, "
    "trained_at string"
)
MANIFEST_SCHEMA = "number long, version string, model_name string, saved_at string"


def save_model(spark: SparkSession, result: ClassifierResult | SentimentModel, path: str) -> str:
    """Add a version below ``path`` and make it the current one; returns its name.

    A version has ``terms`` and ``head`` as Parquet and ``metadata`` as JSON, which has no row
    for a bare model.
    """
    model = result if isinstance(result, SentimentModel) else result.model
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    model.table(spark).coalesce(1).write.parquet(f"{folder}/terms")
    spark.createDataFrame(
        [(model.name, model.labels, [float(b) for b in model.bias])],
        "name string, labels array<string>, bias array<double>",
    ).write.parquet(f"{folder}/head")
    rows = []
    if result is not model:
        meta = result.metadata()
        rows = [tuple(meta[field.split()[0]] for field in METADATA_SCHEMA.split(", "))]
    spark.createDataFrame(rows, METADATA_SCHEMA).coalesce(1).write.json(f"{folder}/metadata")
    last = _current(spark, path)
    _publish(spark, path, (last["number"] + 1 if last else 1, version, model.name))
    return version


def _publish(spark: SparkSession, path: str, row: tuple[int, str, str]) -> None:
    """Add one row, as one new file, to the manifest."""
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    spark.createDataFrame([(*row, now)], MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/manifest")


def model_versions(spark: SparkSession, path: str) -> DataFrame:
    """``(number, version, model_name, saved_at)``; no row where nothing was saved."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def _current(spark: SparkSession, path: str):
    """The last row of the manifest; of two trainings with one number the same for all readers."""
    return model_versions(spark, path).orderBy(F.desc("number"), F.desc("version")).first()


def current_version(spark: SparkSession, path: str | None) -> str | None:
    row = _current(spark, path) if path is not None else None
    return row["version"] if row else None


def model_exists(spark: SparkSession, path: str | None) -> bool:
    return current_version(spark, path) is not None


def _folder(spark: SparkSession, path: str, version: str | None) -> str:
    version = version or current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no trained model under {path}")
    return f"{path}/versions/{version}"


def load_model(spark: SparkSession, path: str, version: str | None = None) -> SentimentModel:
    """The current version or the one named; ``FileNotFoundError`` when there is none."""
    folder = _folder(spark, path, version)
    try:
        head = spark.read.parquet(f"{folder}/head").first()
        terms = spark.read.parquet(f"{folder}/terms")
    except AnalysisException as error:
        raise FileNotFoundError(f"no trained model in {folder}") from error
    rows = terms.limit(MAX_FEATURES + 1).collect()
    if len(rows) > MAX_FEATURES:
        raise ValueError(f"a model has at most {MAX_FEATURES} terms")
    return SentimentModel(
        head["name"], list(head["labels"]), list(head["bias"]),
        {r["term"]: tuple(r["weights"]) for r in rows},
    )


def model_terms(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """``(term, label, idf, weight)`` of a saved model."""
    folder = _folder(spark, path, version)
    head = spark.read.parquet(f"{folder}/head").select("labels")
    terms = spark.read.parquet(f"{folder}/terms").crossJoin(F.broadcast(head))  # one row
    return terms.select(
        "term", F.col("weights")[0].alias("idf"),
        F.posexplode("labels").alias("place", "label"), "weights",
    ).select("term", "label", "idf", F.get("weights", F.col("place") + 1).alias("weight"))


def model_metadata(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """One row of metadata; no row when there is no model.

    ``path`` is a folder of models, or a single JSON document over several lines.
    """
    version = version or current_version(spark, path)
    at = path if version is None else f"{path}/versions/{version}/metadata"
    try:
        return spark.read.schema(METADATA_SCHEMA).json(at, multiLine=version is None)
    except AnalysisException:
        return spark.createDataFrame([], METADATA_SCHEMA)


def metadata_rows(metadata: DataFrame) -> DataFrame:
    """``(key, value)`` of the one metadata row, for reports."""
    names = metadata.columns
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("key"),
                (F.concat_ws(", ", c) if c == "classes" else F.col(c).cast("string")).alias("value"),
            )
            for c in names
        ]
    )
    return metadata.select(F.inline(pairs))
