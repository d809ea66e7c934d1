"""Results are wall-clock results, whatever the session time zone."""

import datetime as dt

import pytest

from chatframe.operators.activity import reply_gaps
from chatframe.sources.exports import parse_texts

TEXT = (
    "10/03/2024, 01:30 - A: one\n10/03/2024, 02:30 - B: two\n10/03/2024, 03:30 - A: three\n"
    "03/11/2024, 01:30 - A: four\n03/11/2024, 02:30 - B: five"
)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        m = parse_texts(spark.createDataFrame([("c", TEXT)], "chat_id string, raw_text string"))
        rows = m.orderBy("msg_seq").collect()
        assert rows[1]["datetime"] == dt.datetime(2024, 3, 10, 2, 30)
        assert [(r["hour"], r["time"], r["day_name"]) for r in rows[:2]] == [
            (1, "01:30:00", "Sunday"), (2, "02:30:00", "Sunday"),
        ]
        gaps = [(r["msg_seq"], r["gap_seconds"]) for r in reply_gaps(m).orderBy("msg_seq").collect()]
        assert gaps == [(2, 3600), (3, 3600), (5, 3600)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
