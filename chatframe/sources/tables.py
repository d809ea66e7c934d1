"""The message view over the driver's tables: documents, conversations and events.

Every row of the three tables is one message and keeps its whole text.  Documents
get a short phrase in front and at the end, so that lexicon words, links and emoji
occur; events, which have no text, say something that depends on their type.
One chat (``team``) holds most rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CHAT_MESSAGES = """
SELECT doc_id AS msg_seq, lang AS chat_id, source AS sender,
       :minutes('2024-01-01', (doc_id - doc_id % 4) * 211 + (doc_id % 4) * (doc_id % 3)) AS datetime,
       concat(
         CASE doc_id % 5 WHEN 0 THEN 'I really love this, GREAT work!! '
                         WHEN 1 THEN 'This is not good, terrible. '
                         WHEN 2 THEN 'Meeting at 5pm. '
                         WHEN 3 THEN 'We all thought it was the bomb, but the end is kind of a kiss of death. '
                         ELSE '' END,
         trim(text), '.',
         CASE WHEN doc_id % 7 = 0
              THEN concat(' https://example.com/p/', CAST(doc_id AS STRING)) ELSE '' END,
         CASE WHEN doc_id % 11 = 0 THEN ' 🔥😂 nice ❤️' ELSE '' END) AS message
FROM documents
UNION ALL
SELECT conv_id * 1000000 + turn, 'support', role,
       :minutes('2024-02-01', 480 + conv_id * 47 + turn * 2),
       concat(trim(text), '.')
FROM conversations
UNION ALL
SELECT event_id, 'team', concat('user', CAST(user_id AS STRING)),
       :wall_clock(ts),
       CASE WHEN value < 5 THEN 'This message was deleted'
            WHEN event_type = 'view' THEN '<Media omitted>'
            WHEN event_type = 'click' THEN 'ok'
            WHEN event_type = 'error' THEN concat('Why this error?? Bad, but we hope: ', props)
            WHEN event_type = 'signup' THEN 'Hello and WELCOME to this very nice team 🔥😂'
            ELSE concat('Thanks, extremely good work! WWW.example.com/p/',
                        CAST(event_id AS STRING)) END
FROM events
"""

TABLES = ("documents", "conversations", "events")
#: Minutes after a day start over after a hundred years, so that any id gives a timestamp.
CENTURY = 36_525 * 1_440

MINUTES = re.compile(r":minutes\('([^']*)', (.*)\)(?= AS datetime,|,$)", re.MULTILINE)


def spark_sql() -> str:
    """The statement with the two expressions that engines spell differently."""
    sql = MINUTES.sub(
        lambda m: f"TIMESTAMP_NTZ '{m[1]} 00:00:00' + make_dt_interval(CAST(pmod({m[2]}, {CENTURY}) DIV 1440 AS INT),"
        f" 0, CAST(pmod({m[2]}, {CENTURY}) % 1440 AS INT))",
        CHAT_MESSAGES,
    )
    return sql.replace(":wall_clock(ts)", "CAST(ts AS TIMESTAMP_NTZ)")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chat_id, msg_seq, datetime, sender, message)`` over the tables in ``sf_dir``."""
    query = spark_sql()
    for name in TABLES:
        query = query.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(query).select("chat_id", "msg_seq", "datetime", "sender", "message")
