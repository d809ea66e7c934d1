import datetime as dt

import pytest

from chatframe.sources import exports as ex

THREE = "23/01/2024, 10:45 am - Bob: hi\nsecond\n\nfourth\n23/01/2024, 10:46 am - Al: a: b\n"
CASES = {
    "p1": "23/01/2024, 10:45 am - Bob: hi",
    "p2": "23/01/2024, 10:45\u202fam - Bob: hi",
    "p3": "23/01/2024, 22:45 - Bob: hi",
    "p4": "[23/01/2024, 10:45:30 AM] Bob: hi",
    "p5": "1/23/2024, 10:45 AM - Bob: hi",
    "p6": "23/01/2024, 10:45am - A: x\n23/01/2024, 13:05 pm - A: x\n23/01/2024, 00:05 AM - A: x",
    "p7": THREE,
    "p8": "noise\nmore noise\n23/01/2024, 22:45 - Bob: hi",
    "p9": "23/01/2024, 22:45 - Al joined using the link",
    "p10": '23/01/2024, 22:45 - Al changed the subject to "a: b"',
    "p12": "23/01/2024, 22:45 - Bob:\n23/01/2024, 22:46 - Bob: ",
    "p13": "23/01/2024, 22:45 - B: <Media omitted>\n23/01/2024, 22:46 - B: image omitted\n"
    "23/01/2024, 22:47 - B: GIF omitted",
    "p14": "23/01/2024, 22:45 - B: This message was deleted",
    "p15": "23/01/2024, 22:45 - B: he said 24/01/2024, 07:00 - C: yes\nand more",
    "p17": THREE.replace("\n", "\r\n"),
    "p18": "no timestamps here\nat all",
    "p20": "23/01/2024, 22:45 - B: one\n23/01/2024, 22:45 - A: two",
    "sys": "23/01/2024, 22:45 - System: hello\n23/01/2024, 22:46 - Bob: x",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(CASES.items()), "chat_id string, raw_text string")


def as_lines(spark, per_block):
    rows = []
    for chat, text in CASES.items():
        for i, line in enumerate(text.split("\n")):
            rows.append((chat, i // per_block, i, line))
    return spark.createDataFrame(rows, "chat_id string, block long, line_no long, line string")


def rows(df):
    out = {}
    for r in df.orderBy("chat_id", "msg_seq").collect():
        out.setdefault(r["chat_id"], []).append(r)
    return out


@pytest.fixture(scope="module", params=["texts", "lines", "short blocks"])
def timed(request, spark, texts):
    if request.param == "texts":
        blocks = ex.split_texts(texts)
    else:
        blocks = ex.split_lines(as_lines(spark, 2 if request.param == "lines" else 1))
    return ex.timed_blocks(blocks).cache()


@pytest.fixture(scope="module")
def parsed(timed):
    return rows(ex.messages_from(timed))


@pytest.fixture(scope="module")
def report(timed):
    return {r["chat_id"]: r for r in ex.parse_report(timed).collect()}


def test_layouts(parsed):
    assert parsed["p1"][0]["datetime"] == dt.datetime(2024, 1, 23, 10, 45)
    assert parsed["p2"][0]["datetime"] == dt.datetime(2024, 1, 23, 10, 45)
    assert parsed["p3"][0]["datetime"] == dt.datetime(2024, 1, 23, 22, 45)
    assert parsed["p4"][0]["datetime"] == dt.datetime(2024, 1, 23, 10, 45, 30)
    assert [(r["sender"], r["message"]) for r in parsed["p4"]] == [("Bob", "hi")]


def test_bad_timestamps_are_counted(report, parsed):
    assert report["p5"]["bad_timestamps"] == 1 and "p5" not in parsed
    assert report["p6"]["bad_timestamps"] == 3
    assert report["p6"]["status"] == "empty"


def test_multi_line_and_noise(parsed):
    assert [r["message"] for r in parsed["p7"]] == ["hi\nsecond\n\nfourth", "a: b"]
    assert [r["message"] for r in parsed["p17"]] == ["hi\nsecond\n\nfourth", "a: b"]
    assert [r["message"] for r in parsed["p8"]] == ["hi"]


def test_senders(parsed, report):
    assert "p9" not in parsed and report["p9"]["system_notices"] == 1
    assert parsed["p10"][0]["sender"] == 'Al changed the subject to "a'
    assert "p12" not in parsed
    assert [r["sender"] for r in parsed["sys"]] == ["Bob"]


def test_flags(parsed):
    assert [(r["is_media"], r["word_count"], r["char_count"]) for r in parsed["p13"]] == [(True, 0, 0)] * 3
    assert [(r["is_deleted"], r["word_count"]) for r in parsed["p14"]] == [(True, 4)]


def test_timestamp_inside_a_body_splits(parsed):
    assert [(r["sender"], r["message"]) for r in parsed["p15"]] == [
        ("B", "he said"), ("C", "yes\nand more"),
    ]


def test_unsupported_and_order(parsed, report):
    assert report["p18"]["status"] == "unsupported" and report["p18"]["message_blocks"] == 0
    assert [r["message"] for r in parsed["p20"]] == ["one", "two"]
    assert [r["msg_seq"] for r in parsed["p20"]] == [1, 2]


def test_date_orders(texts):
    only = texts.filter("chat_id in ('p1', 'p5')")
    swapped = rows(ex.parse_texts(only, "auto"))
    assert swapped["p5"][0]["date"] == dt.date(2024, 1, 23)
    assert swapped["p1"][0]["date"] == dt.date(2024, 1, 23)
    with pytest.raises(ValueError):
        ex.parse_texts(only, "ymd")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(THREE, encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("[23/01/2024, 10:45:30 AM] Zoë: né\r\nça".encode("latin-1"))
    (tmp_path / "skip.csv").write_text(THREE)
    got = rows(ex.parse_chats(spark, str(tmp_path)))
    found = {k.rsplit("/", 1)[1]: [(r["sender"], r["message"]) for r in v] for k, v in got.items()}
    assert found == {
        "a.txt": [("Bob", "hi\nsecond\n\nfourth"), ("Al", "a: b")],
        "b.txt": [("Zoë", "né\nça")],
    }


def test_a_preamble_and_the_split_size_change_nothing(spark, tmp_path):
    lines = [f"note {i}" for i in range(40)]
    lines += [f"23/01/2024, {i // 60 % 24:02d}:{i % 60:02d} - A{i % 3}: text {i}" for i in range(200)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    key, found = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    try:
        for size in ("200", "4096", "134217728"):
            spark.conf.set(key, size)
            got = ex.parse_chats(spark, str(tmp_path)).orderBy("msg_seq").collect()
            found.append([(r["msg_seq"], r["sender"], r["message"]) for r in got])
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] == found[2] == [(i + 1, f"A{i % 3}", f"text {i}") for i in range(200)]


def test_control_characters_stay(spark):
    text = "a\u0001b\u0002c\u0003d\u0003a\u0001"
    texts = spark.createDataFrame([("x", f"23/01/2024, 22:45 - Bob: {text}")], "chat_id string, raw_text string")
    assert ex.parse_texts(texts).first()["message"] == text
    lines = texts.selectExpr("chat_id", "0L as block", "0L as line_no", "raw_text as line")
    assert ex.parse_lines(lines).first()["message"] == text
