"""Exported chat transcripts: text in, message table out.

``read_lines`` splits files of any size into blocks of lines, so that one huge export is
read by many tasks.  The layout of a file is the one with most message starts in all of
its lines.  ``split_texts`` takes texts that are rows of a table already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatframe.functions.text import strip
from chatframe.operators.enrich import message_table
from chatframe.schema import require_columns

# ---- Fixed values: layouts of a message start, and how their times read ---------
DAY = r"(\d{1,2}/\d{1,2}/\d{4}),\s"
LAYOUTS = (
    ("android 12-hour", DAY + r"(\d{1,2}:\d{2}\s?[aApP][mM])\s-\s", "h:mm a"),
    ("android 24-hour", DAY + r"(\d{1,2}:\d{2})\s-\s", "H:mm"),
    ("ios 12-hour", r"\[" + DAY + r"(\d{1,2}:\d{2}:\d{2}\s?[aApP][mM])\]", "h:mm:ss a"),
)
DATE_ORDERS = {"dmy": "d/M/yyyy", "mdy": "M/d/yyyy"}

START, FIELD, ESCAPE = "\u0001", "\u0002", "\u0003"


def _regex(layout: int) -> str:
    return "(?U)" + LAYOUTS[layout][1]


# --- reading files ------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``(chat_id, raw_text)``, one row per file; UTF-8, else Latin-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    content = F.col("content")
    text = F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))
    return files.select(F.col("path").alias("chat_id"), text.alias("raw_text"))


def read_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``(chat_id, block, line_no, line)`` for files of any size."""
    rows = (
        spark.read.option("pathGlobFilter", glob)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("chat_id"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_no"),
            F.col("value").alias("line"),
        )
    )
    encodings = rows.groupBy("chat_id").agg(
        F.bool_and(F.is_valid_utf8("line")).alias("_utf8")
    )
    line = F.when(F.col("_utf8"), F.col("line")).otherwise(
        F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    )
    return rows.join(encodings, "chat_id").select("chat_id", "block", "line_no", line.alias("line"))


# --- layout and message blocks ---------------------------------------------------------


#: What stands for the characters that are marks here, where a text has them.
ESCAPED = ((ESCAPE, f"{ESCAPE}c"), (START, f"{ESCAPE}a"), (FIELD, f"{ESCAPE}b"))


def _escaped(text: Column) -> Column:
    out = text
    for mark, code in ESCAPED:
        out = F.replace(out, F.lit(mark), F.lit(code))
    return F.when(F.regexp_like(text, F.lit(f"[{START}{FIELD}{ESCAPE}]")), out).otherwise(text)


def _restored(text: Column) -> Column:
    out = text
    for mark, code in reversed(ESCAPED):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return F.when(F.contains(text, F.lit(ESCAPE)), out).otherwise(text)


def _best_layout(counts: list[Column]) -> Column:
    """Index of the layout with most matches, the first on a tie; NULL without any."""
    most = F.greatest(*counts)
    chosen = F.when(most == 0, F.lit(None).cast("int"))
    for i, count in enumerate(counts):
        chosen = chosen.when(count == most, i)
    return chosen


def _marked(text: Column, layout: Column) -> Column:
    """Put a start mark, the date and the time in place of every message start."""
    replacement = f"{START}$1{FIELD}$2{FIELD}"
    marked = F.when(layout == 0, F.regexp_replace(text, _regex(0), replacement))
    for i in range(1, len(LAYOUTS)):
        marked = marked.when(layout == i, F.regexp_replace(text, _regex(i), replacement))
    return marked


def _block_columns(piece: Column) -> list[Column]:
    parts = F.split(piece, FIELD, 3)
    return [
        F.get(parts, F.lit(0)).alias("date_text"),
        F.get(parts, F.lit(1)).alias("time_text"),
        strip(_restored(F.get(parts, F.lit(2)))).alias("body"),
    ]


def split_texts(texts: DataFrame) -> DataFrame:
    """``(chat_id, raw_text)`` to message blocks
    ``(chat_id, msg_seq, layout, date_text, time_text, body)``.

    A message runs from one timestamp to the next, also when that one stands inside a
    line.  A text without any known timestamp gives one block without a layout.
    """
    require_columns(texts, ("chat_id", "raw_text"))
    text = _escaped(F.regexp_replace("raw_text", r"\r\n?", "\n"))
    counts = [F.regexp_count("_text", F.lit(_regex(i))) for i in range(len(LAYOUTS))]
    pieces = F.split(F.coalesce(_marked(F.col("_text"), F.col("layout")), F.lit("")), START)
    return (
        texts.select("chat_id", text.alias("_text"))
        .withColumn("layout", _best_layout(counts))
        .select("chat_id", "layout", F.posexplode(pieces).alias("pos", "piece"))
        .filter((F.col("pos") > 0) | F.col("layout").isNull())
        .select(
            "chat_id", F.col("pos").cast("long").alias("msg_seq"), "layout",
            *_block_columns(F.col("piece")),
        )
    )


def split_lines(lines: DataFrame) -> DataFrame:
    """The same blocks from ``(chat_id, block, line_no, line)``.

    Lines are numbered within their block only; the number of message starts in the
    blocks before gives the message number in the chat, so a line at the head of a
    block finds the message it continues.  No task sees more than one block of lines
    in order, and lines meet again per message.
    """
    require_columns(lines, ("chat_id", "block", "line_no", "line"))
    rows = lines.select(
        "chat_id", "block", "line_no", _escaped(F.regexp_replace("line", "\r$", "")).alias("line")
    )
    counts = [
        F.sum(F.regexp_count("line", F.lit(_regex(i)))) for i in range(len(LAYOUTS))
    ]
    names = [f"_n{i}" for i in range(len(LAYOUTS))]
    counted = rows.groupBy("chat_id", "block").agg(*[c.alias(n) for c, n in zip(counts, names)])
    layouts = counted.groupBy("chat_id").agg(_best_layout([F.sum(n) for n in names]).alias("layout"))
    # Lines meet the layout by block: dealt by chat alone, they would stay so, a whole chat in one task.
    of_block = counted.select("chat_id", "block").join(layouts, "chat_id")
    pieces = F.split(F.coalesce(_marked(F.col("line"), F.col("layout")), F.lit("")), START)
    known = (
        rows.join(of_block, ["chat_id", "block"])
        .withColumn("_pieces", pieces)
        .select(
            "chat_id", "layout", "block", "line_no", F.size("_pieces").alias("_k"),
            F.posexplode("_pieces").alias("pos", "piece"),
        )
        .filter(F.col("layout").isNotNull())
        .filter((F.col("pos") > 0) | (F.col("piece") != "") | (F.col("_k") == 1))
    )
    starts = F.when(F.col("pos") > 0, 1).otherwise(0)
    in_block = (
        Window.partitionBy("chat_id", "block")
        .orderBy("line_no", "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    blocks = known.groupBy("chat_id", "block").agg(F.sum(starts).alias("_starts"))
    before = (
        Window.partitionBy("chat_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        "chat_id", "block", F.coalesce(F.sum("_starts").over(before), F.lit(0)).alias("_offset")
    )
    numbered = (
        known.withColumn("_local", F.sum(starts).over(in_block))
        .join(offsets, ["chat_id", "block"])
        .withColumn("msg_seq", F.col("_offset") + F.col("_local"))
        .filter(F.col("msg_seq") > 0)
    )
    piece = F.struct("block", "line_no", "pos", "piece")
    text = F.array_join(
        F.transform(
            F.array_sort(F.col("_lines")),
            lambda x: F.when(x["pos"] > 0, x["piece"]).otherwise(F.concat(F.lit("\n"), x["piece"])),
        ),
        "",
    )
    messages = (
        numbered.groupBy("chat_id", "msg_seq", "layout")
        .agg(F.collect_list(piece).alias("_lines"))
        .select("chat_id", "msg_seq", "layout", text.alias("_text"))
        .select("chat_id", "msg_seq", "layout", *_block_columns(F.col("_text")))
    )
    unknown = layouts.filter(F.col("layout").isNull()).select(
        "chat_id", F.lit(0).cast("long").alias("msg_seq"), "layout",
        *[F.lit(None).cast("string").alias(c) for c in ("date_text", "time_text", "body")],
    )
    return messages.unionByName(unknown)


# --- timestamps, senders, quality ----------------------------------------------------------


def _timestamp(date_order: str) -> Column:
    clock = strip(F.regexp_replace("time_text", "[\u202f\u00a0]", " "))
    text = F.concat_ws(" ", strip(F.col("date_text")), clock)
    pattern = DATE_ORDERS[date_order]
    # read as UTC and moved to a wall clock, so the session time zone plays no part
    utc = F.concat(text, F.lit("+00:00"))

    def read(layout: int) -> Column:
        return F.try_to_timestamp(utc, F.lit(f"{pattern} {LAYOUTS[layout][2]}XXX"))

    instant = F.when(F.col("layout") == 0, read(0))
    for i in range(1, len(LAYOUTS)):
        instant = instant.when(F.col("layout") == i, read(i))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=F.unix_seconds(instant).cast("decimal(18,6)"))


def timed_blocks(blocks: DataFrame, date_order: str = "dmy") -> DataFrame:
    """Add ``datetime`` (NULL when unreadable), ``sender`` and ``message`` to blocks.

    ``date_order`` is ``dmy``, ``mdy`` or ``auto``: per chat the order that leaves fewer
    timestamps unread, day first on a tie.  A block without ``': '`` is a system notice
    and has no sender.
    """
    if date_order not in (*DATE_ORDERS, "auto"):
        raise ValueError("date_order must be 'dmy', 'mdy' or 'auto'")
    if date_order == "auto":
        both = blocks.withColumns({"_dmy": _timestamp("dmy"), "_mdy": _timestamp("mdy")})
        failures = both.groupBy("chat_id").agg(
            (F.count_if(F.col("_mdy").isNull()) < F.count_if(F.col("_dmy").isNull())).alias("_swap")
        )
        timed = both.join(failures, "chat_id").withColumn(
            "datetime", F.when(F.col("_swap"), F.col("_mdy")).otherwise(F.col("_dmy"))
        )
    else:
        timed = blocks.withColumn("datetime", _timestamp(date_order))
    colon = F.instr("body", ": ")
    sender = strip(F.substring("body", F.lit(1), colon - 1))
    message = strip(F.substring("body", colon + 2, F.char_length("body")))
    return timed.select(
        "chat_id", "msg_seq", "layout", "datetime",
        F.when((colon > 0) & (sender != "System"), sender).alias("sender"),
        F.when(colon > 0, message).alias("message"),
    )


def messages_from(timed: DataFrame) -> DataFrame:
    """The message table of the blocks with a timestamp and a sender."""
    kept = timed.filter(F.col("datetime").isNotNull() & F.col("sender").isNotNull())
    return message_table(kept.select("chat_id", "msg_seq", "datetime", "sender", "message"))


def parse_report(timed: DataFrame) -> DataFrame:
    """One row per chat instead of an error that ends the job."""
    read, named = F.col("datetime").isNotNull(), F.col("sender").isNotNull()
    cells = timed.groupBy("chat_id", "sender").agg(
        F.count_if(F.col("layout").isNotNull()).alias("blocks"),
        F.count_if(F.col("layout").isNotNull() & ~read).alias("bad"),
        F.count_if(read & ~named).alias("notices"),
        F.count_if(read & named).alias("parsed"),
        F.min(F.when(read & named, F.col("datetime"))).alias("first"),
        F.max(F.when(read & named, F.col("datetime"))).alias("last"),
        F.max("layout").alias("layout"),
    )
    names = F.array(*[F.lit(name) for name, _, _ in LAYOUTS])
    return (
        cells.groupBy("chat_id")
        .agg(
            F.max("layout").alias("layout"),
            F.sum("blocks").alias("message_blocks"),
            F.sum("bad").alias("bad_timestamps"),
            F.sum("notices").alias("system_notices"),
            F.sum("parsed").alias("parsed_messages"),
            F.count_if(F.col("parsed") > 0).alias("senders"),
            F.to_date(F.min("first")).alias("date_start"),
            F.to_date(F.max("last")).alias("date_end"),
        )
        .withColumn(
            "status",
            F.when(F.col("layout").isNull(), "unsupported")
            .when(F.col("parsed_messages") == 0, "empty")
            .otherwise("ok"),
        )
        .withColumn("layout", F.get(names, F.col("layout")))
    )


def parse_texts(texts: DataFrame, date_order: str = "dmy") -> DataFrame:
    """``(chat_id, raw_text)`` to the message table."""
    return messages_from(timed_blocks(split_texts(texts), date_order))


def parse_lines(lines: DataFrame, date_order: str = "dmy") -> DataFrame:
    """``(chat_id, block, line_no, line)`` to the message table."""
    return messages_from(timed_blocks(split_lines(lines), date_order))


def parse_chats(
    spark: SparkSession, path: str, *, glob: str = "*.txt", date_order: str = "dmy"
) -> DataFrame:
    """Message table of all exports under ``path``, files of any size."""
    return parse_lines(read_lines(spark, path, glob), date_order)
