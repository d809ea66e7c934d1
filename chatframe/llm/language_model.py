"""Hierarchical Pitman-Yor language model, sampled and applied in blocks.

Restaurants: one for each word that stands before another (the end token stands before a
text), told apart by a 64-bit hash of that word, all with one parent, the restaurant of
words without context, whose parent is uniform over the known words and one unknown.
Customers are the training tokens; every table of a child is a customer of the parent.  A
Gibbs sweep seats the customers of each dish of each restaurant anew, given the parent's
prediction and the tables of the restaurant in the sweep before; after ``burn_in`` sweeps
the predictions of the others are averaged.  Customers beyond the 256th of a dish are seated
in groups of a 64th of those already there.  Random numbers are functions of word, context,
sweep and customer, so results do not depend on how rows are dealt.  Discounts are estimated
from the counts of ones and twos over the whole corpus.

How it runs, in jobs that pass small packed rows and leave what they know in files:

1. ``blocks``: a task turns documents into files of some million tokens.
2. ``asked``: a block counts its (word, context) pairs and asks the *buckets* of its words,
   cut by a hash of the word.  The number of buckets follows the counted tokens.
3. ``merged``: a bucket brings together all cells of its words.  A cell of one customer has
   one table for ever; only cells of two or more are sampled.
4. ``replied`` and ``sampled``, once a sweep: a bucket sends, for each context, the customers
   without a table of their own to the bucket of the context word.  That bucket knows all
   customers of the restaurant (the count of the word), so it replies with the tables.  Each
   bucket then seats its cells anew and leaves the seating in a file for the next sweep.
5. ``answers`` and ``add_up``: each block gets counts and tables of its words and pairs, and
   adds up its documents.

No word, context, count or document goes through the driver, only seven sums over all buckets
a sweep.  Words are told apart by a 64-bit hash: among 10**9 distinct words, two are taken for
one with a probability of 3 %.

Null and empty texts are one end token.  A null id counts as empty text.  Without training
tokens every token has the uniform probability 1.  Equal rows are scored each; texts longer
than a block go on in the next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import arrow_batches, fresh_folder, shuffle_partitions, stored
from chatframe.llm.files import existing, new_file

PIECE = re.compile(rb"[\s\S]{1,4000000}(?:[^\x20\x09-\x0D]*)")
END = b""


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


# --- packed numbers and files ---------------------------------------------------------------


def pack(x: np.ndarray, dtype: str) -> bytes:
    """Compressed, first bytes of all numbers first."""
    from zstandard import ZstdCompressor

    x = np.ascontiguousarray(x, dtype)
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    from zstandard import ZstdDecompressor

    size = np.dtype(dtype).itemsize
    bytes_of = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(bytes_of.T).view(dtype).ravel()


def save(folder: str, suffix: str, *tables: pa.Table, **numbers: tuple[np.ndarray, str]) -> str:
    """A new file with tables and named arrays; its address."""
    schema = pa.schema([(k, pa.large_binary()) for k in numbers], metadata={k: d for k, (_, d) in numbers.items()})
    row = pa.Table.from_pydict({k: [pack(x, d)] for k, (x, d) in numbers.items()}, schema=schema)
    stream, path = new_file(folder, suffix)
    with stream:
        for t in (*tables, row):
            with pa.ipc.new_stream(stream, t.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                w.write_table(t)
    return path


def load(path: str, tables: int = 0) -> tuple[list[pa.Table], dict[str, np.ndarray]]:
    with existing(path) as file:
        first = [pa.ipc.open_stream(file).read_all() for _ in range(tables)]
        row = pa.ipc.open_stream(file).read_all()
        types = {k.decode(): d.decode() for k, d in (row.schema.metadata or {}).items()}
        return first, {k: unpack(row[k][0].as_py(), d) for k, d in types.items()}


# --- blocks -------------------------------------------------------------------------------


class _Words(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    def __init__(self, folder: str):
        self.folder, self.words, self.n = folder, _Words(), 0
        self.ids, self.docs = [], []

    def add(self, key: str, doc_id: int | None, held: bool, words: list[bytes], before: bytes) -> None:
        number = self.words.__getitem__
        self.ids.append(np.frombuffer(array("i", map(number, words)), np.int32))
        self.docs.append((key, doc_id, held, len(words), number(before)))
        self.n += len(words)

    def close(self) -> dict:
        from xxhash import xxh64_intdigest

        keys, doc_ids, held, n, before = zip(*self.docs)
        docs = pa.table({
            "key": pa.array(keys), "doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(held),
            "n_tokens": pa.array(n, pa.int64()), "before": pa.array(before, pa.int64()),
        })
        hashes = np.fromiter(map(xxh64_intdigest, self.words), np.uint64, len(self.words))
        path = save(self.folder, ".block", docs, hashes=(hashes, "<u8"), ids=(np.concatenate(self.ids), "<u4"))
        return {"block": path, "tokens": self.n}


def blocks(docs: DataFrame, held: Column, block_tokens: int) -> DataFrame:
    """Address and size of the files with all documents as numbers of their words."""
    folder = fresh_folder(docs.sparkSession, "lm-blocks")

    def run(batches):
        from uuid import uuid4

        task, number, block = uuid4().hex, 0, Block(folder)

        def row():
            return pa.RecordBatch.from_pylist([block.close()], schema=pa.schema([("block", pa.string()), ("tokens", pa.int64())]))

        for batch in batches:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = (text.as_py() or "").encode().lower()
                number += 1
                before, pieces = END, [m[0] for m in PIECE.finditer(data)] if len(data) > 4_000_000 else [data]
                for i, piece in enumerate(pieces):
                    words = piece.split()
                    if i == len(pieces) - 1:
                        words.append(END)
                    if words:
                        block.add(f"{task}-{number}", doc_id, out, words, before)
                        before = words[-1]
                    if block.n >= block_tokens:
                        yield row()
                        block = Block(folder)
        if block.n:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), held, "text").mapInArrow(run, "block string, tokens long")
    with arrow_batches(docs.sparkSession, "8m"):  # a task holds a block besides
        return stored(rows, "lm-blocks")


class Pairs:
    """The (word, context) pairs of a block, in an order that depends on its file alone.

    ``words`` and ``pairs`` list them by bucket; those of bucket ``k`` end at ``word_ends[k]``
    and ``pair_ends[k]``.
    """

    def __init__(self, path: str, buckets: int):
        (self.docs,), x = load(path, 1)
        self.hashes, ids = x["hashes"], x["ids"].astype(np.int64)
        n = self.docs["n_tokens"].to_numpy()
        self.starts = np.cumsum(n) - n
        before = np.roll(ids, 1)
        before[self.starts] = self.docs["before"].to_numpy()
        pairs, self.place = np.unique(ids * len(self.hashes) + before, return_inverse=True)
        self.word, self.context = np.divmod(pairs, len(self.hashes))
        learn = np.repeat(~np.array(self.docs["held_out"].to_pylist(), bool), n)
        self.count = np.bincount(self.place, learn, len(pairs)).astype(np.int64)
        bucket = (self.hashes % np.uint64(buckets)).astype(np.int64)
        self.words = np.argsort(bucket, kind="stable")
        self.pairs = np.argsort(bucket[self.word], kind="stable")
        self.word_ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        self.pair_ends = np.cumsum(np.bincount(bucket[self.word], minlength=buckets))
        self.per_word = np.bincount(self.word, minlength=len(self.hashes))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The words and pairs of a bucket."""
        a, b = (int(ends[k - 1]) if k else 0 for ends in (self.word_ends, self.pair_ends))
        return self.words[a : self.word_ends[k]], self.pairs[b : self.pair_ends[k]]


REQUESTS = pa.schema([
    ("bucket", pa.int64()), ("block", pa.string()), ("words", pa.binary()), ("per_word", pa.binary()),
    ("contexts", pa.binary()), ("counts", pa.binary()),
])


def asked(files: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """What each block asks of each bucket."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                b = Pairs(path, buckets)
                for k in range(buckets):
                    w, p = b.of(k)
                    if len(w):
                        yield pa.RecordBatch.from_pylist([{
                            "bucket": k, "block": path, "words": b.hashes[w].tobytes(), "per_word": pack(b.per_word[w], "<u4"),
                            "contexts": b.hashes[b.context[p]].tobytes(), "counts": pack(b.count[p], "<u4"),
                        }], schema=REQUESTS)

    return files.select("block").repartition(tasks).mapInArrow(
        run, "bucket long, block string, words binary, per_word binary, contexts binary, counts binary"
    )


# --- the model ----------------------------------------------------------------------------

MESSAGES = pa.schema([
    ("part", pa.int64()), ("bucket", pa.int64()), ("seated", pa.binary()), ("contexts", pa.binary()),
    ("path", pa.string()), ("index", pa.string()), ("state", pa.string()), ("facts", pa.list_(pa.int64())),
])
MESSAGE = "part long, bucket long, seated binary, contexts binary, path string, index string, state string, facts array<long>"
REPLIES = pa.schema([
    ("bucket", pa.int64()), ("part", pa.int64()), ("tables", pa.binary()), ("mine", pa.binary()),
    ("path", pa.string()), ("index", pa.string()), ("state", pa.string()),
])
REPLY = "bucket long, part long, tables binary, mine binary, path string, index string, state string"


class Cells:
    """The cells of a bucket's words, from what blocks ask.

    ``two``-fold cells, of two customers or more, are listed as ``w``, ``u`` (places in ``hash``
    and ``contexts``) and ``c``.  ``code`` says of each pair of each block: no customer, one, or
    which of those cells.
    """

    def __init__(self, words: list[np.ndarray], per_word: list[np.ndarray], contexts: list[np.ndarray], counts: list[np.ndarray], buckets: int):
        self.block_words, self.n_pairs = [len(x) for x in words], np.concatenate(per_word).astype(np.int64)
        self.hash, self.word = np.unique(np.concatenate(words), return_inverse=True)
        names, context = np.unique(np.concatenate(contexts), return_inverse=True)
        cells, cell = np.unique(np.repeat(self.word, self.n_pairs) * len(names) + context, return_inverse=True)
        c = np.bincount(cell, np.concatenate(counts), len(cells)).astype(np.int64)
        w, u = np.divmod(cells, len(names))
        n = len(self.hash)
        self.word_count = np.bincount(w, c, n).astype(np.int64)
        self.ones = np.bincount(w[c == 1], minlength=n)
        two = np.flatnonzero(c > 1)
        code = np.minimum(c, 1)
        code[two] = 2 + np.arange(len(two))
        self.code = code[cell]
        self.w, self.c = w[two], c[two]
        used, u = np.unique(u[two], return_inverse=True)
        part = (names[used] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.contexts, self.u = names[used][order], place[u]
        self.part_ends = np.cumsum(np.bincount(part, minlength=buckets))
        customers = np.bincount(w[c > 0], minlength=n)
        self.customers = customers
        self.facts = [
            int(customers.sum()), int((customers > 0).sum()), int(self.word_count.sum()),
            *(int((x == k).sum()) for x in (customers, c) for k in (1, 2)),
        ]

    def arrays(self) -> dict:
        return {
            "hash": (self.hash, "<u8"), "word": (self.word, "<u4"), "block_words": (np.array(self.block_words), "<u4"),
            "n_pairs": (self.n_pairs, "<u4"), "code": (self.code, "<u4"), "word_count": (self.word_count, "<i8"),
            "ones": (self.ones, "<i8"), "w": (self.w, "<u4"), "u": (self.u, "<u4"), "c": (self.c, "<i8"),
            "contexts": (self.contexts, "<u8"), "part_ends": (self.part_ends, "<i8"),
        }


def messages(k: int, x: dict, seated: np.ndarray, path: str, state: str, facts: list[int], index: str | None = None, first: bool = False):
    """For each part of the contexts, and for the bucket's own, the customers seated beside others."""
    a = 0
    rows = []
    for part, b in enumerate(x["part_ends"].tolist()):
        if b > a or part == k:
            own = part == k
            rows.append({
                "part": part, "bucket": k, "seated": pack(seated[a:b], "<i8"), "contexts": x["contexts"][a:b].tobytes() if first else None,
                "path": path if own else None, "index": index if own else None, "state": state if own else None,
                "facts": facts if own else None,
            })
        a = b
    return pa.Table.from_pylist(rows, schema=MESSAGES)


def merged(requests: DataFrame, folder: str, buckets: int) -> DataFrame:
    """The first messages of all buckets: every cell has one table."""

    def run(key, t):
        t = t.sort_by("block")
        cells = Cells(
            [np.frombuffer(x, "<u8") for x in t["words"].to_pylist()], [unpack(x, "<u4") for x in t["per_word"].to_pylist()],
            [np.frombuffer(x, "<u8") for x in t["contexts"].to_pylist()], [unpack(x, "<u4") for x in t["counts"].to_pylist()], buckets,
        )
        x = cells.arrays()
        path = save(folder, ".bucket", t.select(["block"]), **x)
        state = save(
            folder, ".state", customers=(cells.customers, "<i8"), opened=(np.minimum(cells.customers, 1), "<i8"),
            sum=(np.zeros(len(cells.c), np.int64), "<i8"),
        )
        seated = np.bincount(cells.u, cells.c - 1, len(cells.contexts)).astype(np.int64)
        return messages(key[0].as_py(), {k: v for k, (v, _) in x.items()}, seated, path, state, cells.facts, first=True)

    return stored(requests.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, MESSAGE), "lm-messages")


def replied(sent: DataFrame, folder: str, buckets: int) -> DataFrame:
    """The tables of each context, to each bucket that has customers in it."""

    def run(key, t):
        t = t.sort_by("bucket")
        k, senders = key[0].as_py(), t["bucket"].to_pylist()
        own = t.slice(senders.index(k), 1).to_pylist()[0]
        seated = [unpack(x, "<i8") for x in t["seated"].to_pylist()]
        if own["index"] is None:  # which contexts the senders list, once
            names, place = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in t["contexts"].to_pylist()]), return_inverse=True)
            _, x = load(own["path"], 1)
            at = np.searchsorted(x["hash"], names)
            own["index"] = save(folder, ".index", place=(place, "<u4"), at=(at, "<u4"), customers=(x["word_count"][at], "<i8"))
        _, x = load(own["index"])
        tables = x["customers"] - np.bincount(x["place"], np.concatenate(seated), len(x["at"])).astype(np.int64)
        ends = np.cumsum([len(s) for s in seated])
        return pa.Table.from_pylist([{
            "bucket": b, "part": k, "tables": pack(tables[x["place"][end - len(s) : end]], "<i8"),
            **({c: own[c] for c in ("path", "index", "state")} | {"mine": pack(tables, "<i8")} if b == k else {}),
        } for b, s, end in zip(senders, seated, ends)], schema=REPLIES)

    return sent.repartition(buckets, "part").groupBy("part").applyInArrow(run, REPLY)


def _uniform(seed: np.ndarray, *numbers: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on a 64-bit seed and some integers."""
    with np.errstate(over="ignore"):
        x = seed.copy()
        for n in numbers:
            x += np.uint64(0x9E3779B97F4A7C15) * np.uint64(n + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _binomial(n: np.ndarray, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Binomial numbers from uniform ones: by inversion up to a mean of 30, else rounded normal ones."""
    z = np.sqrt(-2 * np.log(x)) * np.cos(2 * np.pi * y)
    out = np.clip(np.rint(n * p + np.sqrt(n * p * (1 - p)) * z), 0, n)
    few = np.flatnonzero(n * p < 30)
    n, p, x = n[few], p[few], x[few]
    share = np.exp(n * np.log1p(-np.minimum(p, 1 - 1e-12)))
    below, k, found = share.copy(), 0, np.zeros(len(few))
    while (left := (x > below) & (k < n)).any():
        k += 1
        found += left
        share *= (n - k + 1) / k * p / np.maximum(1 - p, 1e-12)
        below += np.maximum(share, 0)
    out[few] = found
    return out


def seat(c: np.ndarray, opening: np.ndarray, discount: float, seed: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of ``c`` customers of each dish, seated one by one; ``opening``: the weight of a new table."""
    tables = np.minimum(c, 1)
    active, i, step = np.flatnonzero(c > 1), 1, 0
    while len(active):
        size = np.minimum(1 if i < 256 else i // 64, c[active] - i)
        a, t = opening[active], tables[active]
        p = a / (a + i + (size - 1) / 2 - discount * t)
        x = _uniform(seed[active], sweep, step)
        more = x < p if i < 256 else _binomial(size, p, x, _uniform(seed[active], sweep, step, 1))
        tables[active] = t + more.astype(np.int64)
        i, step = i + (1 if i < 256 else i // 64), step + 1
        active = active[c[active] > i]
    return tables


class Totals:
    """What all restaurants have in common: a few numbers a sweep."""

    def __init__(self, facts: list[int], strength: float):
        customers, self.words, self.tokens, *rest = facts
        self.strength = strength
        self.discounts = tuple(  # of the parent, of the contexts
            float(np.clip(one / max(1, one + 2 * two), 0.05, 0.95)) for one, two in (rest[:2], rest[2:])
        )
        self.sweeps = [(customers, self.words)]  # customers and tables of the parent

    def spread(self, sweep: int) -> float:
        """The weight of a new table of the parent times the probability of any word."""
        return (self.strength + self.discounts[0] * self.sweeps[sweep][1]) / (self.words + 1)

    def parent(self, sweep: int, customers: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """The probability of words without context."""
        seated = customers - self.discounts[0] * opened
        return (seated + self.spread(sweep)) / (self.strength + self.sweeps[sweep][0])


def sweep_of(x: dict, before: dict, tables: np.ndarray, totals: Totals, sweep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seat a bucket's cells anew: tables of cells, the parent's customers and tables of words."""
    d0, d1 = totals.discounts
    p0 = totals.parent(sweep, before["customers"], before["opened"])
    opening = (totals.strength + d1 * tables[x["u"]]) * p0[x["w"]]
    seed = x["hash"][x["w"]] ^ np.bitwise_xor(x["contexts"] << np.uint64(23), x["contexts"] >> np.uint64(41))[x["u"]]
    t = seat(x["c"], opening, d1, seed, sweep)
    customers = x["ones"] + np.bincount(x["w"], t, len(x["ones"])).astype(np.int64)
    opened = seat(customers, np.full(len(customers), totals.spread(sweep)), d0, x["hash"], sweep)
    return t, customers, opened


def _received(t: pa.Table) -> tuple[dict, dict, dict, np.ndarray, np.ndarray]:
    """Of the replies to a bucket: its own row, cells, state, tables by context, tables of its words."""
    t = t.sort_by("part")
    own = t.slice(t["path"].is_valid().to_pylist().index(True), 1).to_pylist()[0]
    _, x = load(own["path"], 1)
    _, state = load(own["state"])
    tables = np.concatenate([unpack(r, "<i8") for r in t["tables"].to_pylist()])
    mine = x["word_count"].copy()
    mine[load(own["index"])[1]["at"]] = unpack(own["mine"], "<i8")
    return own, x, state, tables, mine


def sampled(replies: DataFrame, folder: str, buckets: int, totals: Totals, sweep: int, burn_in: int) -> DataFrame:
    """One sweep: the messages after it."""

    def run(key, t):
        own, x, before, tables, mine = _received(t)
        cells, customers, opened = sweep_of(x, before, tables, totals, sweep)
        kept = {k: (v, "<i8") for k, v in before.items() if k[0] == "s"}  # of the averaged sweeps
        if sweep > burn_in:
            kept[f"s{sweep}_tables"] = (mine, "<i8")
        if sweep + 1 > burn_in:
            kept["sum"] = (before["sum"] + cells, "<i8")
            kept[f"s{sweep + 1}_customers"], kept[f"s{sweep + 1}_opened"] = (customers, "<i8"), (opened, "<i8")
        state = save(folder, ".state", customers=(customers, "<i8"), opened=(opened, "<i8"), **kept)
        seated = np.bincount(x["u"], x["c"] - cells, len(x["contexts"])).astype(np.int64)
        return messages(key[0].as_py(), x, seated, own["path"], state, [int(customers.sum()), int(opened.sum())], own["index"])

    rows = replies.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, MESSAGE)
    return stored(rows, "lm-messages")


def summed(sent: DataFrame) -> list[int]:
    """The sums of the buckets' facts, at most seven numbers."""
    rows = sent.filter("facts is not null").select(F.posexplode("facts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    return [r["n"] for r in sorted(rows, key=lambda r: r["pos"])]


ANSWERS = pa.schema([
    ("block", pa.string()), ("bucket", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), ("tables", pa.binary()),
])


def answers(replies: DataFrame, buckets: int, sweeps: int, burn_in: int) -> DataFrame:
    """Per block and bucket: for words, the count and (customers, tables, tables as context) in each
    averaged sweep; for pairs, customers and the sum of tables."""

    def run(key, t):
        own, x, state, _, mine = _received(t)
        (paths,), _ = load(own["path"], 1)
        state[f"s{sweeps}_tables"] = mine
        names = [f"s{i}_{c}" for i in range(burn_in + 1, sweeps + 1) for c in ("customers", "opened", "tables")]
        words = np.stack([x["word_count"], *(state[c] for c in names)])
        c = np.concatenate([[0, 1], x["c"]])
        tables = np.concatenate([[0, sweeps - burn_in], state["sum"]])
        ends, pair_ends = np.cumsum(x["block_words"].astype(np.int64)), np.cumsum(x["n_pairs"].astype(np.int64))
        rows, a, p = [], 0, 0
        for path, end in zip(paths["block"].to_pylist(), ends):
            q = int(pair_ends[end - 1])
            code = x["code"][p:q]
            rows.append({
                "block": path, "bucket": key[0].as_py(), "words": pack(words[:, x["word"][a:end]].ravel(), "<i8"),
                "pairs": pack(c[code], "<i8"), "tables": pack(tables[code], "<i8"),
            })
            a, p = end, q
        return pa.Table.from_pylist(rows, schema=ANSWERS)

    return replies.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        run, "block string, bucket long, words binary, pairs binary, tables binary"
    )


def probability(c, tables, count, asked_of, opened, restaurant, context_count, totals: Totals, first: int) -> np.ndarray:
    """Of pairs, averaged over sweeps from ``first`` on; a row a sweep of the last arrays but one."""
    d1, new = totals.discounts[1], np.zeros(len(c))
    for i in range(len(asked_of)):
        new += (totals.strength + d1 * restaurant[i]) * totals.parent(first + i, asked_of[i], opened[i])
    return (c + (new - d1 * tables) / len(asked_of)) / (totals.strength + context_count)


def add_up(replies: DataFrame, tasks: int, buckets: int, totals: Totals, burn_in: int) -> DataFrame:
    """``(key, doc_id, held_out, n_tokens, n_known, base_score, score)`` of the documents in each block."""
    schema = pa.schema([
        ("key", pa.string()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def run(key, t):
        b = Pairs(key[0].as_py(), buckets)
        n = len(totals.sweeps) - 1 - burn_in
        words = np.zeros((1 + 3 * n, len(b.hashes)), np.int64)
        c, tables = np.zeros((2, len(b.word)), np.int64)
        for k, w, p, s in zip(*(t[x].to_pylist() for x in ("bucket", "words", "pairs", "tables"))):
            at, pairs = b.of(k)
            words[:, at] = unpack(w, "<i8").reshape(1 + 3 * n, -1)
            c[pairs], tables[pairs] = unpack(p, "<i8"), unpack(s, "<i8")
        count = words[0]
        log = np.log10(probability(
            c, tables, count, words[1::3][:, b.word], words[2::3][:, b.word], words[3::3][:, b.context], count[b.context], totals, burn_in + 1
        ))
        base = np.log10((count + 1) / (totals.tokens + totals.words + 1))[b.word]
        sums = [np.add.reduceat(v[b.place], b.starts) for v in ((count > 0)[b.word].astype(np.int64), base, log)]
        return pa.Table.from_arrays(
            [*(b.docs[x].combine_chunks() for x in ("key", "doc_id", "held_out", "n_tokens")), *map(pa.array, sums)], schema=schema
        )

    return replies.repartition(tasks, "block").groupBy("block").applyInArrow(
        run, "key string, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )


def score(
    docs: DataFrame,
    held: Column | None = None,
    sweeps: int = 4,
    burn_in: int = 1,
    strength: float = 1.0,
    buckets: int | None = None,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """Per document: tokens, known tokens, training tokens, add-one and model log10 probability.

    ``buckets`` is one for each ``block_tokens`` of the input, or more if there are more shuffle partitions.
    """
    if not 0 <= burn_in < sweeps:
        raise ValueError("burn_in must be less than sweeps")
    spark = docs.sparkSession
    held = held_out() if held is None else held
    files = blocks(docs, held.alias("held_out"), block_tokens)
    n_files, tokens = files.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    buckets = buckets or max(shuffle_partitions(spark), -(-tokens // block_tokens))
    tasks, folder = max(n_files, 1), fresh_folder(spark, "lm-buckets")
    sent = merged(asked(files, buckets, tasks), folder, buckets)
    totals = Totals(summed(sent) or [0] * 7, strength)
    for sweep in range(sweeps):
        sent = sampled(replied(sent, folder, buckets), folder, buckets, totals, sweep, burn_in)
        totals.sweeps.append(tuple(summed(sent)) or (0, 0))
    parts = add_up(answers(replied(sent, folder, buckets), buckets, sweeps, burn_in), tasks, buckets, totals, burn_in)
    return parts.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    ).drop("key")
