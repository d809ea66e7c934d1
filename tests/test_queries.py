"""Spark against DuckDB on the smallest tables."""

import os

import pytest

from checks.compare import compare, connect
from checks.oracles import ORACLES
from checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")

NAMES = [
    "enriched_messages", "scored_messages", "chat_summary", "processing_stats", "sender_stats",
    "bigram_frequency", "sender_keywords", "activity_peaks", "reply_gaps", "overall_mood",
    "sentiment_weekly", "parsed_messages", "train_test_split", "naive_bayes_confusion",
    "predicted_messages", "live_stream", "written_report", "saved_model", "trend_stream", "dashboard", "feed_ledger",
    "regression_certificate",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, con, name):
    result = compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name])
    assert result["columns"] and result["equal"], result


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_view_has_no_timestamps_or_outer_blanks(spark):
    from chatframe.sources.tables import chat_messages

    m = chat_messages(spark, SMALL)
    bad = m.filter(r"message rlike '(?U)^\\s|\\s$' or message rlike '\\d/\\d{4}, \\d'")
    assert bad.count() == 0
    assert m.count() == m.select("chat_id", "msg_seq").distinct().count()
