"""Token ids in files of Simple-8b words.

A 64-bit word holds a selector in its top 4 bits and, below, as many ids of one width as
fit: 120 zeros, 60 ids of 1 bit, ... 1 id of 60 bits.  An id of more than 60 bits is an
escape: selector 0 and the number of its 64-bit value in the list behind the block's
words.  So the place and the count of every word follow from the selectors alone, and a
block is decoded by whole arrays.

A file is ``MAGIC``, blocks, an index and the length of the index.  A block is the numbers
of ids, words and escapes (three 32-bit integers), the words, the escapes.  The index is
an Arrow stream: one table with the offset of each block, one with the id and the number
of tokens of each document.  All integers are little-endian.

Documents are dealt by ranges of ``doc_id`` and sorted, so files in order of their
partition hold documents in ascending order.  A null text is an empty text; a null
``doc_id`` sorts first; equal ids are ordered by text and each keeps its own entry; an
empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatframe.llm.common import fresh_folder, shuffle_partitions, stored
from chatframe.llm.files import existing, new_file

MAGIC = b"S8BIDS01"
#: (ids in a word, bits of an id) by selector; selector 0 is the escape.
PACKINGS = [(1, 60), (120, 0)] + [
    (60 // bits, bits) for bits in range(1, 61) if bits == 60 // (60 // bits)
]
BLOCK = 65_536
END_ID = 2


def pack(ids: np.ndarray) -> bytes:
    """One block."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    counts, selectors = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    for selector in sorted(range(1, len(PACKINGS)), key=lambda s: PACKINGS[s][0]):
        count, bits = PACKINGS[selector]
        fits = np.ones(n + count, bool)  # beyond the end, zeros
        np.less_equal(ids, np.uint64((1 << bits) - 1), out=fits[:n])
        span = 1
        while span < count:  # all of the next ``count`` ids
            step = min(span, count - span)
            fits = fits[: len(fits) - step] & fits[step:]
            span += step
        fits = fits[:n]
        np.copyto(counts, count, where=fits)
        np.copyto(selectors, selector, where=fits)
    places, at, steps = [], 0, counts.tolist()
    while at < n:
        places.append(at)
        at += steps[at]
    places = np.array(places, np.int64)
    chosen = selectors[places]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(120, np.uint64)])
    for selector in np.unique(chosen).tolist():
        count, bits = PACKINGS[selector]
        rows = np.flatnonzero(chosen == selector)
        if selector == 0:
            escapes = ids[places[rows]]
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
        elif bits:
            for k in range(count):
                words[rows] |= padded[places[rows] + k] << np.uint64(k * bits)
    if not (chosen == 0).any():
        escapes = np.zeros(0, np.uint64)
    return (
        struct.pack("<III", n, len(words), len(escapes))
        + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
    )


_COUNTS = np.array([count for count, _ in PACKINGS], np.int64)


def unpack(n: int, words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of one block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    places = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(selectors).tolist():
        count, bits = PACKINGS[selector]
        rows = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[places[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[places[rows] + k] = (words[rows] >> np.uint64(k * bits)) & mask
    return out[:n]


class IdFile:
    """Writes one file; documents come one after the other."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        stream.write(MAGIC)
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.offsets, self.doc_ids, self.n_tokens = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_tokens.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            block = pack(ids[a : min(a + BLOCK, whole)])
            self.offsets.append(self.at)
            self.stream.write(block)
            self.at += len(block)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        sink = pa.BufferOutputStream()
        for t in (
            pa.table({"offset": pa.array(self.offsets, pa.int64())}),
            pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "n_tokens": pa.array(self.n_tokens, pa.int64())}),
        ):
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
        index = sink.getvalue().to_pybytes()
        self.stream.write(index + struct.pack("<Q", len(index)))
        self.stream.close()


def read_index(file) -> tuple[pa.Table, pa.Table]:
    """Block offsets and documents of a file."""
    size = file.size()
    file.seek(size - 8)
    (length,) = struct.unpack("<Q", file.read(8))
    file.seek(size - 8 - length)
    source = pa.BufferReader(file.read(length))
    return pa.ipc.open_stream(source).read_all(), pa.ipc.open_stream(source).read_all()


def read_blocks(file, offsets: list[int]) -> Iterator[np.ndarray]:
    for offset in offsets:
        file.seek(offset)
        n, n_words, n_escapes = struct.unpack("<III", file.read(12))
        body = np.frombuffer(file.read(8 * (n_words + n_escapes)), "<u8")
        yield unpack(n, body[:n_words], body[n_words:])


# --- tokenizing ---------------------------------------------------------------------------

#: Texts with these bytes go to the tokenizer whole: they may hold a special token, which may
#: start inside a piece, or blanks that the tokenizer might not count as blanks.
_WHOLE = (b"<|", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
#: A word of Latin letters; most pieces are such a word and marks behind it.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Where these come out alike by both ways, a tokenizer splits at blanks and before marks.
_PROBES = ("The house, a  house.\nhouse", "Été à côté; größer?!", "a\tb c: d's x-y 12 (z)", "ÀÖØÞß ÿé")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts; the pieces between blanks are encoded once and remembered.

    That holds for tokenizers that lower-case, split at blanks and before marks, and drop
    blanks: the ids of a text are then those of its pieces, one after the other.  It is
    tried on ``_PROBES``; any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.cached, self.known = Tokenizer.from_file(path), cached, {}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
        self.byte_letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self.by_pieces = all(
            self.whole([p])[0] == b"".join(map(self.piece, p.encode().lower().split())) for p in _PROBES
        )

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def piece(self, piece: bytes) -> bytes:
        word = piece.rstrip(_MARKS)
        if word[-1:].isalnum() and word != piece and word in self.known:  # other ends run on into the marks
            return self.known[word] + self.ids_of(piece[len(word) :].decode())
        text = word.decode().lower()
        if not _PLAIN.fullmatch(text):
            return self.whole([piece.decode()])[0]
        ids = self.ids_of(text if text.isascii() else text.translate(self.byte_letters))
        return ids + self.ids_of(piece[len(word) :].decode()) if word != piece else ids

    def ids_of(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        data = text.encode()
        if not self.by_pieces or any(mark in data for mark in _WHOLE):
            return np.frombuffer(self.whole([text])[0], "<u4")
        known = self.known
        if len(known) > self.cached:
            known.clear()
        pieces = data.lower().split()
        once = {}
        for p in set(pieces):
            if p not in known:
                (known if len(p) <= 64 else once)[p] = self.piece(p)
        if once:
            return np.frombuffer(b"".join([once[p] if p in once else known[p] for p in pieces]), "<u4")
        return np.frombuffer(b"".join([known[p] for p in pieces]), "<u4")


def encoder(path: str, cached: int = 1_000_000) -> Encoder:
    """One per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cached)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, tokenizer: str, file_ids: int = 32_000_000) -> DataFrame:
    """Write the files; returns ``(path, part, file, n_docs, n_ids, base)``, a row per file.

    ``base``: the ids in all files before it.  A file ends with the document that brings it
    to ``file_ids``.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "token-ids")

    def write(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        part, number, out = TaskContext.get().partitionId(), 0, None

        def finished():
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"path": path, "part": part, "file": number, "n_docs": len(out.doc_ids), "n_ids": out.n_ids}],
                schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        end = np.array([END_ID], "<u4")
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), map(encode, texts)):
                if out is None:
                    stream, path = new_file(folder, ".s8b")
                    out = IdFile(stream)
                out.add(doc_id, np.concatenate([ids, end]))
                if out.n_ids >= file_ids:
                    yield finished()
                    out, number = None, number + 1
        if out is not None:
            yield finished()

    dealt = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    files = stored(
        dealt.mapInArrow(write, "path string, part int, file int, n_docs long, n_ids long"), "token-files"
    )
    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read_ids(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, from the files.

    ``ids`` is an array of a document's ids; leave it out where only their checksum matters,
    and no document has to fit in memory.
    """
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        schema.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(schema)

    def documents(path: str, base: int) -> Iterator[dict]:
        with existing(path) as file:
            offsets, docs = read_index(file)
            blocks = read_blocks(file, offsets["offset"].to_pylist())
            block, at, start = np.zeros(0, "<u4"), 0, base
            for doc_id, n in zip(docs["doc_id"].to_pylist(), docs["n_tokens"].to_pylist()):
                crc, left, parts = 0, n, []
                while left:
                    if at == len(block):
                        block, at = next(blocks).astype("<u4"), 0
                    part = block[at : at + left]
                    crc = zlib.crc32(part, crc)
                    if with_ids:
                        parts.append(part)
                    at, left = at + len(part), left - len(part)
                row = {"doc_id": doc_id, "start": start, "n_tokens": n, "ids_crc32": crc}
                yield row | {"ids": np.concatenate(parts)} if with_ids else row
                start += n

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, waiting = [], 0
                for row in documents(path, base):
                    rows.append(row)
                    waiting += row["n_tokens"] if with_ids else 1
                    if waiting >= 100_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, waiting = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    tasks = max(1, min(files.count(), 10_000))
    return files.select("path", "base").repartition(tasks).mapInArrow(read, fields)
