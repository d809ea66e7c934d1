"""Streams: scoring messages as they come, and the trend over event time.

A micro-batch is a table, so it takes the path of tables and gives the same values.  What a batch
gives is written to a folder of its own and entered in a ledger last.  A batch that is run
again, after a crash or from an older checkpoint, is skipped if it is in the ledger and else
replaces its folder; readers see the batches of the ledger only.  So each batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chatframe.functions.lists import WordLists
from chatframe.functions.text import round_half_even
from chatframe.operators.enrich import DEFAULT_LISTS, is_text
from chatframe.operators.mood import mean, score_sum
from chatframe.operators.scoring import check_texts, predict_texts
from chatframe.operators.training import SentimentModel
from chatframe.sources.models import current_version, load_model

# Epoch day 0 is a Thursday: four days on, weeks start on Monday.
WINDOWS = {"D": ("1 day", None), "W": ("7 days", "4 days")}
LEDGER_SCHEMA = "batch_id long, note string"


class Ledger:
    """Outputs of micro-batches below ``folder``: ``batches/<id>`` and, when done, ``ledger/<id>``."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(batch_id, note)`` of the batches that are done."""
        try:
            return spark.read.schema(LEDGER_SCHEMA).json(f"{self.folder}/ledger/*")
        except AnalysisException:
            return spark.createDataFrame([], LEDGER_SCHEMA)

    def done(self, spark: SparkSession, batch_id: int) -> bool:
        try:
            return bool(spark.read.schema(LEDGER_SCHEMA).json(f"{self.folder}/ledger/{batch_id}").limit(1).count())
        except AnalysisException:
            return False

    def add(self, batch: DataFrame, batch_id: int, note: str = "") -> None:
        """Write the batch, then its row."""
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch_id}")
        row = spark.createDataFrame([(batch_id, note)], LEDGER_SCHEMA)
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/ledger/{batch_id}")

    def read(self, spark: SparkSession, schema: StructType | str) -> DataFrame:
        """All rows of finished batches, with ``batch_id``."""
        done = sorted(r["batch_id"] for r in self.rows(spark).collect())
        if not done:
            return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0).cast("long"))
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)/", 1).cast("long")
        read = spark.read.schema(schema).parquet(*(f"{self.folder}/batches/{i}" for i in done))
        return read.withColumn("batch_id", number)


def live_scores(
    texts: DataFrame, model: SentimentModel, text: str = "text", lists: WordLists = DEFAULT_LISTS,
    max_chars: int | None = None,
) -> DataFrame:
    """Validate and predict each text; rejected texts carry ``error`` and no label."""
    scored = check_texts(predict_texts(texts, model, text, lists), text, max_chars)
    names = ("label", "confidence", "prob_positive", "prob_neutral", "prob_negative")
    return scored.withColumns({n: F.when(F.col("error").isNull(), F.col(n)) for n in names})


class LiveScorer:
    """Scores each micro-batch with the model that is current when the batch begins."""

    def __init__(
        self, model_path: str, folder: str, text: str = "text", lists: WordLists = DEFAULT_LISTS,
        max_chars: int | None = None,
    ):
        self.model_path, self.ledger = model_path, Ledger(folder)
        self.text, self.lists, self.max_chars = text, lists, max_chars
        self.version: str | None = None
        self.model: SentimentModel | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.ledger.done(spark, batch_id):
            return
        version = current_version(spark, self.model_path)
        if version != self.version or self.model is None:
            self.model, self.version = load_model(spark, self.model_path, version), version
        scored = live_scores(batch, self.model, self.text, self.lists, self.max_chars)
        self.ledger.add(scored.withColumn("model_version", F.lit(version)), batch_id, version)


def start_live_scores(
    texts: DataFrame, model_path: str, folder: str, checkpoint: str, text: str = "text",
    max_chars: int | None = None,
) -> StreamingQuery:
    """Score everything that is there, then stop; run again for new texts."""
    return _started(texts, LiveScorer(model_path, folder, text, max_chars=max_chars), checkpoint)


def _started(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_results(spark: SparkSession, folder: str, texts: StructType) -> DataFrame:
    """The scored texts of all finished batches; ``texts`` is the schema of the stream."""
    schema = StructType([
        *texts.fields,
        *StructType.fromDDL(
            "label string, confidence double, prob_positive double, prob_neutral double, prob_negative double,"
            " error string, model_version string"
        ).fields,
    ])
    return Ledger(folder).read(spark, schema)


def trend_stream(scored: DataFrame, freq: str = "W", delay: str = "1 day") -> DataFrame:
    """Mean score and messages per day or week of event time, late rows up to ``delay``.

    ``datetime`` is read as UTC; run the stream with that session time zone.
    """
    return (
        scored.filter(is_text())
        .withColumn("datetime", F.col("datetime").cast("timestamp"))
        .withWatermark("datetime", delay)
        .groupBy("chat_id", _period(freq).alias("period"))
        .agg(score_sum().alias("_sum"), F.count("*").alias("message_count"))
        .select(
            "chat_id", F.date_sub(F.to_date("period.end"), 1).alias("date"),
            round_half_even(mean(F.col("_sum"), F.col("message_count")), 4).alias("avg_score"),
            "message_count",
        )
    )


def _period(freq: str):
    if freq not in WINDOWS:
        raise ValueError("freq must be 'D' or 'W'")
    length, offset = WINDOWS[freq]
    return F.window("datetime", length, length, offset) if offset else F.window("datetime", length)


TREND_SCHEMA = "chat_id string, date date, avg_score double, message_count long"
SEEN_SCHEMA = "chat_id string, date date, messages long"


def start_trend(scored: DataFrame, folder: str, checkpoint: str, freq: str = "W", delay: str = "1 day") -> list[StreamingQuery]:
    """Keep the trend and count what came, from all that is there.

    Open periods live in the state store until they are ``delay`` past; every batch writes the
    periods it changed.  The second query only counts the messages of each batch by period: what
    the first did not take, came too late.
    """
    trend, seen = Ledger(f"{folder}/trend"), Ledger(f"{folder}/seen")

    def keep(batch: DataFrame, batch_id: int) -> None:
        if not trend.done(batch.sparkSession, batch_id):
            trend.add(batch, batch_id)

    def count(batch: DataFrame, batch_id: int) -> None:
        if not seen.done(batch.sparkSession, batch_id):
            date = F.date_sub(F.to_date(F.col("period.end")), 1).alias("date")
            by_period = batch.select("chat_id", _period(freq).alias("period")).groupBy("chat_id", date)
            seen.add(by_period.agg(F.count("*").alias("messages")), batch_id)

    texts = scored.filter(is_text()).select("chat_id", F.col("datetime").cast("timestamp").alias("datetime"))
    return [
        _started(trend_stream(scored, freq, delay), keep, f"{checkpoint}/trend", "update"),
        _started(texts, count, f"{checkpoint}/seen"),
    ]


def trend_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of every period."""
    states = Ledger(f"{folder}/trend").read(spark, TREND_SCHEMA)
    last = F.max(F.struct("batch_id", "avg_score", "message_count")).alias("s")
    return states.groupBy("chat_id", "date").agg(last).select("chat_id", "date", "s.avg_score", "s.message_count")


def late_messages(spark: SparkSession, folder: str) -> DataFrame:
    """``(chat_id, date, late_messages)``: messages that no period could take any more.

    Exact once both queries have read the same input.
    """
    seen = Ledger(f"{folder}/seen").read(spark, SEEN_SCHEMA).groupBy("chat_id", "date").agg(F.sum("messages").alias("n"))
    kept = trend_so_far(spark, folder).select("chat_id", "date", "message_count")
    late = F.col("n") - F.coalesce("message_count", F.lit(0))
    return seen.join(kept, ["chat_id", "date"], "left").select("chat_id", "date", late.alias("late_messages")).filter(
        "late_messages > 0"
    )
