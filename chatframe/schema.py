"""Column names, fixed values and the one schema check shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

POSITIVE, NEGATIVE, NEUTRAL = "Positive", "Negative", "Neutral"
LABELS = (POSITIVE, NEUTRAL, NEGATIVE)

# Label, confidence and mood thresholds.
LABEL_THRESHOLD = 0.05
HIGH_CONFIDENCE = 0.35
MEDIUM_CONFIDENCE = 0.15
STRONG_MOOD = 0.3

# A reply is counted up to twelve hours after the previous message.
MAX_REPLY_SECONDS = 43200

# Training gates and split.
MIN_MESSAGES_FOR_MODEL = 50
MIN_TRAINING_ROWS = 20
MIN_TIER_ROWS = 30
SAMPLES_PER_CLASS = 300
TEST_SHARE = 0.2
FOLDS = 5
SEED = 42

# Live scoring accepts texts up to this many characters.

# Calendar names in calendar order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

BASE_COLUMNS = ("chat_id", "msg_seq", "datetime", "sender", "message")

MESSAGE_COLUMNS = (
    "chat_id", "msg_seq", "datetime", "date", "time", "year", "month", "month_name",
    "day", "day_name", "hour", "sender", "message", "is_media", "is_deleted",
    "word_count", "char_count",
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ``ValueError`` while the plan is built, before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
