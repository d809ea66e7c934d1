"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatframe import analyze, dashboard  # noqa: E402
from chatframe.sources.tables import chat_messages  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from checks.session import local_session  # noqa: E402

NAMES = (
    "sender_stats", "word_frequency", "bigram_frequency", "trigram_frequency", "sender_keywords",
    "reply_times", "scored_messages", "overall_mood", "sentiment_weekly", "parsed_messages",
    "training_sample", "naive_bayes_confusion", "predicted_messages",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def full_analysis(spark, sf_dir: str) -> None:
    """Read, clean, score, train, predict, and every result of the dashboard."""
    result = analyze(chat_messages(spark, sf_dir))
    run(dashboard(result.messages))
    for table in (
        result.chat_summary, result.feature_summary, result.processing_stats,
        result.overall_mood, result.agreement, result.features.sender_stats,
    ):
        run(table)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    run(QUERIES["message_table"](spark, sf_dir))  # start-up and code generation
    seconds: dict[str, float] = {}
    for name in NAMES:
        started = time.time()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.time() - started, 3)
    started = time.time()
    full_analysis(spark, sf_dir)
    seconds["full_analysis"] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "chat analytics, total of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "messages": chat_messages(spark, sf_dir).count(),
                "cpus": int(os.environ.get("BENCH_CPUS", "8")),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
