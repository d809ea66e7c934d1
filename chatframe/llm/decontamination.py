"""Benchmark decontamination by one Aho-Corasick automaton over the words of the test items.

Texts are normalised to words: A-Z in lower case, runs of digits, letters a-z and characters
beyond ASCII.  The keys of the automaton are windows of ``width`` consecutive words of an
item; an item of fewer words is one window.  The automaton reads the words of a document
once and reports every occurrence; words inside any are hit.  Runs of hit words are mapped
to places in the original text, as code points.

The automaton is sent to the tasks, so its size is checked: beyond ``automaton_words`` the
windows are split over several automata of at most about that size, and the documents are
read once for each, with a stored table in between.

A null text has no words; items without words have no window; an item without id counts
as one item with an empty id; the windows of rows that share an id count as one item's; an
empty benchmark hits nothing; equal documents keep a row each.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import stored

WIDTH = 10
_SEPARATORS = bytes(
    c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127
    else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32
    for c in range(256)
)
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = "n_words long, starts array<int>, ends array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SEPARATORS).split()


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(window, items)``: distinct windows, words joined by a blank, with the ids of their items."""

    def cut(batches):
        for batch in batches:
            ids, keys = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if words:
                    found = {b" ".join(words[a : a + width]) for a in range(max(1, len(words) - width + 1))}
                    ids += [item] * len(found)
                    keys += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.string())], ["window", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    return items.mapInArrow(cut, "window binary, item string").groupBy("window").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )


def build(keys: list[tuple[bytes, list[str]]]):
    """The numbers of the words and the automaton over them."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, items in keys:
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in window.split(b" "))
        automaton.add_word(key, (len(key), items))
    automaton.make_automaton()
    return numbers, automaton


def merged(starts, ends) -> tuple[list[int], list[int]]:
    """The union of intervals, as disjoint runs in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [a for a, _ in out], [b for _, b in out]


def original_spans(text: str, starts: list[int], ends: list[int]) -> list[dict]:
    """Code points from the first to the end of the last word of each run."""
    places = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(starts, ends)]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    width: int = WIDTH,
    automaton_words: int = 4_000_000,
    result: str = "_hits",
) -> DataFrame:
    """The columns ``keep`` of every document (all by default) and a struct, ``result``.

    The struct: number of words, runs of hit words (``starts``, ``ends`` exclusive, by word),
    the ids of items with an occurring window in order, and ``spans`` in the text.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    keys = stored(windows(benchmark, width), "windows")
    size = F.lit(1) + F.size("items") + F.length("window") / 4
    total = keys.agg(F.sum(size)).first()[0] or 0
    shards = int(total // automaton_words) + 1
    columns = keep if "text" in keep else [*keep, "text"]
    df = docs.select(*(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(columns)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    for shard in range(shards):
        rows = keys.filter(F.pmod(F.xxhash64("window"), F.lit(shards)) == shard).collect()
        sent = spark.sparkContext.broadcast([(bytes(r["window"]), list(r["items"])) for r in rows])
        last = shard == shards - 1
        n = len(keep) if last else len(columns)
        scanner = _scanner(uuid.uuid4().hex, sent, columns.index("text"), n, len(columns) if shard else None)
        df = df.mapInArrow(scanner, ", ".join([*fields[:n], f"_hits struct<{_struct()}>"]))
        if not last:
            df = stored(df, "scanned")
    return df.select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("_hits").alias(result))


def _struct() -> str:
    return ", ".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in RESULT.split(", "))


_HITS = pa.struct([
    ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
    ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
_BUILT: dict[str, tuple] = {}


def _scanner(name: str, sent, text_at: int, n: int, hits_at: int | None):
    """Reads the text in column ``text_at`` and earlier hits; returns the first ``n`` columns and hits."""

    def run(batches):
        if name not in _BUILT:  # one automaton per worker process
            _BUILT.clear()
            _BUILT[name] = build(sent.value)
        numbers, automaton = _BUILT[name]
        number, find = numbers.get, automaton.iter
        for batch in batches:
            earlier = repeat(None) if hits_at is None else batch.column(hits_at).to_pylist()
            hits = []
            for value, before in zip(batch.column(text_at), earlier):
                text = value.as_py()
                words = words_of(text)
                starts, ends, items = [], [], set()
                if numbers and words:
                    for last, (length, ids) in find(tuple(map(number, words, repeat(0)))):
                        starts.append(last - length + 1)
                        ends.append(last + 1)
                        items.update(ids)
                if before and before["items"]:
                    starts, ends = starts + before["starts"], ends + before["ends"]
                    items.update(before["items"])
                starts, ends = merged(starts, ends)
                hits.append({
                    "n_words": len(words), "starts": starts, "ends": ends, "items": sorted(items),
                    "spans": original_spans(text, starts, ends) if starts else [],
                })
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(hits, _HITS)], [*batch.schema.names[:n], "_hits"]
            )

    return run


def report(hits: DataFrame) -> DataFrame:
    """Per document, from ``scan``: counts, a digest of the items, whether it is contaminated."""
    n_hit = F.aggregate(
        F.zip_with("_hits.starts", "_hits.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y
    )
    return hits.select(
        *[c for c in hits.columns if c != "_hits"],
        F.col("_hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
