"""Collocations: phrases of 2 to 4 words that occur more often together than apart.

Texts are cut into pieces at punctuation and line ends, pieces into words.  Phrases are counted
by tries in double arrays.  Their candidates are Apriori-safe: a phrase can only be frequent if
all phrases inside it are, so each reading of the texts looks only at places where all shorter
ones may be.  What "may be frequent" is a set of bits addressed by a hash, 64 for each frequent
phrase up to a fixed size; two phrases with one bit can only add candidates.

1. Words are counted in the tasks and added up.
2. Pairs of frequent words, triples of frequent pairs and their continuations are counted by
   64-bit hash.  A task's counts leave it packed, by ranges of the hash.
3. Each frequent hash is dealt to one partition that holds it, whose task writes the phrase: the
   candidates, once each however many tasks there are.
4. The candidates, at most ``trie_phrases`` at a time, are built into a trie by one task, which
   writes it to the shared folder; each worker reads it once.  numpy moves the states of all words of a batch one level further at a time:
   ``next = base[state] + word``, kept where ``check[next] == state``; accepting states are
   counted by ``bincount`` and the counts of all tasks are added up.

More candidates than ``trie_phrases`` are split over several tries, with one more reading of the
texts each.  Two phrases with one hash, or partitions that came in another order, show by a
count below that of the hash; all phrases with such a hash are listed and counted as well.  The rest, scores by the weakest cut and the choice of the best, are joins of counts.

Null texts have no words, a null ``lang`` counts as ``und``; equal rows count each; texts are
read in slices of about ``SLICE`` bytes that overlap by three words, so a very long text needs
no more memory; an empty table has no phrase; other columns are never read.
"""

from __future__ import annotations

import io
import json
import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import arrow_batches, fresh_folder, groups_of, running_sums, shuffle_partitions, stored
from chatframe.llm.files import existing, new_file
from chatframe.operators.topn import top_rows

LONGEST = 4
LEAST = 30
TOP = 2_000
BITS = 30
BLOCK = 10
FEW, WINDOW, PACKED = 4, 1 << 14, 1 << 14
PARTS, PACKETS = 9, 64
TRIE_PHRASES = 2_000_000
SLICE = 1 << 20
HELD_WORDS, HELD_HASHES, BATCH_ROWS = 150_000, 1_500_000, 20_000
# A-Z in lower case, tabs as blanks, every mark that ends a piece as a full stop.
_BYTES = bytes(
    ord(".") if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if chr(c) in " \t"
    else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c
    for c in range(256)
)
_GAP, _WORD = re.compile(rb"[ .]"), re.compile(rb"[^ .]+")
_BASE = 0x9E3779B97F4A7C15 | 1


def slices(batches):
    """``(lang, data, known)``: texts joined by language, in slices cut between words.

    The first ``known`` bytes are the last three words of the slice before.
    """
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (value.as_py() or "").encode().translate(_BYTES)
            texts.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            if sizes[lang] >= SLICE:
                yield from _cut(lang, b".".join(texts.pop(lang)))
                del sizes[lang]
        for lang, some in texts.items():
            yield from _cut(lang, b".".join(some))


def _cut(lang: str, data: bytes):
    at = again = 0
    while at < len(data):
        gap = _GAP.search(data, at + SLICE)
        end = gap.start() if gap else len(data)
        yield lang, data[again:end], at - again
        at, again = end, _last_words(data, again, end)


def _last_words(data: bytes, begin: int, end: int) -> int:
    """Where the last ``LONGEST - 1`` words of a slice begin."""
    size = 1_024
    while True:
        tail = max(begin, end - size)
        found = [m.start() for m in _WORD.finditer(data, tail, end)]
        if len(found) >= LONGEST:
            return found[1 - LONGEST]
        if tail == begin:
            return found[1 - LONGEST] if len(found) >= LONGEST - 1 else begin
        size *= 16


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64)
                for x in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        return cls.up, cls.down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, their hashes, and whether the next word is in the same piece.

    The hash is a polynomial in the bytes, taken for all words from one running sum.
    """
    d = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (d != 32) & (d != 46), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = Powers.of(len(d) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((d.astype(np.uint64) + np.uint64(1)) * up[: len(d)])])
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts])
    marks = np.concatenate([[0], np.cumsum(d == 46)])
    together = np.zeros(len(starts), bool)
    together[:-1] = marks[ends[:-1]] == marks[starts[1:]]
    return starts, ends, hashes, together


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _seed(lang: str) -> np.uint64:
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest(lang.encode()))


class Bits:
    """What may be frequent, by length: bits at the first places of the hashes."""

    def __init__(self, sets: dict[int, np.ndarray]):
        self.sets = sets

    def hold(self, n: int, hashes: np.ndarray) -> np.ndarray:
        bits = self.sets[n]
        at = hashes >> np.uint64(64 - int(len(bits) * 8).bit_length() + 1)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def levels(lang: str, data: bytes, known: int, bits: Bits, longest: int):
    """``(n, begins, ends, hashes)`` of the phrases of 2 to ``longest`` words that may be frequent.

    They are those in which all phrases of ``n - 1`` words may be, as far as ``bits`` tell.
    Phrases inside the first ``known`` bytes are left out, as they were counted before.
    """
    starts, ends, words, together = word_hashes(data)
    places, hashes = np.arange(len(words)), _mixed(words + _seed(lang))
    for n in range(1, longest):
        if n in bits.sets:
            often = bits.hold(n, hashes)
            places, hashes = places[often], hashes[often]
        # A longer phrase begins where one begins right after it.
        goes_on = places[1:] == places[:-1] + 1
        if n == 1:
            goes_on &= together[places[:-1]]
        goes_on = np.flatnonzero(goes_on)
        places, hashes = places[goes_on], hashes[goes_on]
        hashes = _mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + words[places + n])
        fresh = ends[places + n] > known
        yield n + 1, starts[places[fresh]], ends[places[fresh] + n], hashes[fresh]


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, phrase, a)`` for every word."""

    def run(batches):
        from collections import Counter

        counts: dict[str, Counter] = {}

        def flushed():
            for lang, c in counts.items():
                words = pa.array(list(c), pa.binary()).cast(pa.string())
                yield from _batches(
                    ["lang", "phrase", "a"], pa.array([lang] * len(c), pa.string()), words, pa.array(list(c.values()), pa.int64())
                )
            counts.clear()

        for lang, data, known in slices(batches):
            counts.setdefault(lang, Counter()).update(data[known:].replace(b".", b" ").split())
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from flushed()
        yield from flushed()

    return docs.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def hash_counts(docs: DataFrame, bits, n: int, least: int) -> DataFrame:
    """``(h, n, at)``: hashes of phrases of ``n`` words that occur often enough, or share it with one that does.

    ``n`` counts their occurrences, ``at`` is a partition of ``docs`` that holds some.  Tasks
    write sorted hashes in ``PARTS`` parts of their range, so that a part is added up by itself.
    """

    def run(batches):
        held: list[np.ndarray] = []
        size, at = 0, TaskContext.get().partitionId()

        def flushed():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            parts = (values >> np.uint64(64 - PARTS)).astype(np.int64)
            edges = np.flatnonzero(np.diff(parts)) + 1
            packed = [
                (int(p[0]), v.tobytes(), c.tobytes())
                for p, v, c in zip(np.split(parts, edges), np.split(values, edges), np.split(counts.astype(np.int64), edges))
                if len(p)
            ]
            for i in range(0, len(packed), PACKETS):
                part, hashes, numbers = zip(*packed[i : i + PACKETS])
                columns = [pa.array(part, pa.int32()), pa.array([at] * len(part), pa.int32()), pa.array(hashes, pa.binary()), pa.array(numbers, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "at", "hashes", "counts"])

        for lang, data, known in slices(batches):
            for length, _, _, found in levels(lang, data, known, bits.value, n):
                if length == n:
                    held.append(found)
                    size += len(found)
            if size > HELD_HASHES:
                yield from flushed()
                size = 0
        if held:
            yield from flushed()

    def added(batches):
        for some in groups_of(batches, ["part"]):
            values, counts = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in some[c]]) for c, t in (("hashes", np.uint64), ("counts", np.int64)))
            at = np.repeat(some["at"].to_numpy(), [len(x.as_buffer()) // 8 for x in some["hashes"]])
            order = np.argsort(values, kind="stable")
            values, counts, at = values[order], counts[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            total, several = np.add.reduceat(counts, first), np.diff(first, append=len(values))
            # any of the partitions that hold it, so that each gets its share
            at = at[first + (values[first] % several.astype(np.uint64)).astype(np.int64)]
            often = total >= least
            yield from _batches(["h", "n", "at"], pa.array(values[first][often].view(np.int64)), pa.array(total[often]), pa.array(at[often]))

    packed = docs.mapInArrow(run, "part int, at int, hashes binary, counts binary")
    dealt = packed.repartition(shuffle_partitions(docs.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(added, "h long, n long, at int")


def _bits_of(hashes: DataFrame) -> np.ndarray:
    """The set bits of all ``h``, made in blocks by the tasks.

    There are 64 bits for each hash, up to ``2**BITS`` in all, so what arrives is bounded.
    """
    n_bits = min(BITS, max(20, (64 * hashes.count()).bit_length()))
    inside = n_bits - BLOCK

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.sort(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - n_bits)).astype(np.int64)
            for part in np.split(at, np.flatnonzero(np.diff(at >> inside)) + 1):
                if len(part):
                    cells = found.setdefault(int(part[0]) >> inside, np.zeros(1 << inside, bool))
                    cells[part & ((1 << inside) - 1)] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(packed, pa.binary())], ["block", "bits"])

    block = F.shiftrightunsigned("h", 64 - BLOCK)
    dealt = hashes.repartition(shuffle_partitions(hashes.sparkSession), block)
    out = np.zeros((1 << BLOCK, 1 << (inside - 3)), np.uint8)
    for row in dealt.mapInArrow(run, "block long, bits binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def hashes_of(words: DataFrame) -> DataFrame:
    """``(h)`` of ``(lang, phrase)`` with one word each."""

    def run(batches):
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(word.encode())
            found = [_mixed(word_hashes(b" ".join(some))[2] + _seed(lang)) for lang, some in by_lang.items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h long")


def frequent_hashes(docs: DataFrame, frequent_words: DataFrame, least: int = LEAST) -> DataFrame:
    """``(h, n, at)`` of :func:`hash_counts` for 2 to ``LONGEST`` words, stored."""
    spark = docs.sparkSession
    bits, tables = _bits_of(hashes_of(frequent_words)), []
    for n in range(2, LONGEST + 1):  # frequent phrases hold frequent ones only, so one length is enough
        sent = spark.sparkContext.broadcast(Bits({n - 1: bits}))
        tables.append(stored(hash_counts(docs, sent, n, least), "phrase-hashes"))
        if n < LONGEST:
            bits = _bits_of(tables[-1].select("h"))
    return reduce(DataFrame.union, tables)


def hash_files(hashes: DataFrame) -> dict[int, str]:
    """By ``at``, a file with the sorted ``h`` of ``(h, at)``."""
    spark = hashes.sparkSession
    folder = fresh_folder(spark, "hashes")

    def write(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            values, at = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k in np.unique(at).tolist():
                held.setdefault(k, []).append(values[at == k])
        for k, some in held.items():
            stream, path = new_file(folder, ".hashes")
            with stream:
                stream.write(np.unique(np.concatenate(some)).tobytes())
            yield pa.RecordBatch.from_pydict({"at": pa.array([k], pa.int32()), "path": [path]})

    dealt = hashes.select("h", F.col("at").cast("int")).repartition(shuffle_partitions(spark), "at")
    return {r["at"]: r["path"] for r in stored(dealt.mapInArrow(write, "at int, path string"), "hash-files").collect()}


def _few_bits(hashes: np.ndarray) -> Bits:
    n_bits = min(BITS, max(20, (64 * len(hashes)).bit_length()))
    cells = np.zeros(1 << n_bits, bool)
    cells[(hashes >> np.uint64(64 - n_bits)).astype(np.int64)] = True
    return Bits({0: np.packbits(cells, bitorder="little")})


def listed(docs: DataFrame, files: dict[int, str]) -> DataFrame:
    """``(lang, phrase, h)``: for each hash the first phrase with it in its own partition of ``docs``.

    A phrase is written once, by one task, however many hold it.  What another phrase with the
    hash, or another order of the partitions, leaves out is found by its count in :func:`frequent_phrases`.
    """

    def run(batches):
        path = files.get(TaskContext.get().partitionId())
        wanted = _hashes_in(path) if path else np.zeros(0, np.uint64)
        left, few = np.ones(len(wanted), bool), _few_bits(wanted)
        rows: list[tuple[str, bytes, int]] = []
        for lang, data, known in slices(batches):
            for begins, ends, keys, place in _places(lang, data, known, wanted, few):
                place, one = np.unique(place, return_index=True)
                one = one[left[place]]
                left[place] = False
                rows += ((lang, b" ".join(data[a:b].split()), h) for a, b, h in zip(begins[one].tolist(), ends[one].tolist(), keys[one].tolist()))
            if len(rows) > BATCH_ROWS:
                yield from _rows(rows)
                rows = []
        yield from _rows(rows)

    return docs.mapInArrow(run, "lang string, phrase string, h long")


def listed_by_all(docs: DataFrame, path: str) -> DataFrame:
    """``(lang, phrase, h)``: every phrase with one of the hashes in a file, written by each task that holds it."""

    def run(batches):
        wanted = _hashes_in(path)
        few = _few_bits(wanted)
        rows: set[tuple[str, bytes, int]] = set()
        for lang, data, known in slices(batches):
            for begins, ends, keys, _ in _places(lang, data, known, wanted, few):
                rows.update((lang, b" ".join(data[a:b].split()), h) for a, b, h in zip(begins.tolist(), ends.tolist(), keys.tolist()))
            if len(rows) > HELD_WORDS:
                yield from _rows(list(rows))
                rows.clear()
        yield from _rows(list(rows))

    return docs.mapInArrow(run, "lang string, phrase string, h long").distinct()


def _hashes_in(path: str) -> np.ndarray:
    with existing(path) as stream:
        return np.frombuffer(stream.read(), np.uint64)


def _places(lang: str, data: bytes, known: int, wanted: np.ndarray, few: Bits):
    """``(begins, ends, hashes, places in wanted)`` of the phrases with a wanted hash, by length."""
    for _, begins, ends, keys in levels(lang, data, known, Bits({}), LONGEST):
        near = few.hold(0, keys)
        begins, ends, keys = begins[near], ends[near], keys[near]
        place = np.searchsorted(wanted, keys)
        good = np.flatnonzero(place < len(wanted))
        good = good[wanted[place[good]] == keys[good]]
        yield begins[good], ends[good], keys[good], place[good]


def _rows(rows: list[tuple[str, bytes, int]]):
    if rows:
        langs, phrases, keys = zip(*rows)
        keys = pa.array(np.array(keys, np.uint64).view(np.int64))
        yield from _batches(["lang", "phrase", "h"], pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), keys)


def frequent_phrases(docs: DataFrame, hashes: DataFrame, least: int = LEAST, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """``(lang, phrase, a)`` of all phrases with at least ``least`` occurrences.

    The frequent phrases with one hash occur at most as often as the hash.  Where those that were
    counted fall short of it, all phrases with the hash are listed, so none is lost.
    """
    often = F.col("a") >= least
    phrases = stored(listed(docs, hash_files(hashes)), "phrases")
    found = stored(phrase_counts(docs, phrases, trie_phrases).filter(often), "frequent-phrases")
    seen = found.groupBy("h").agg(F.sum("a").alias("seen"))
    short = hashes.groupBy("h").agg(F.sum("n").alias("n")).join(seen, "h", "left").filter("coalesce(seen, 0) < n")
    short = stored(short.select("h"), "short")
    n = short.count()
    if n:
        dealt = short.withColumn("at", F.pmod("h", F.lit(-(-n // trie_phrases))))
        for path in hash_files(dealt).values():
            more = listed_by_all(docs, path).join(found, ["lang", "phrase"], "left_anti")
            more = phrase_counts(docs, stored(more, "phrases"), trie_phrases).filter(often)
            found = found.union(stored(more, "frequent-phrases"))
    return found.select("lang", "phrase", "a")


class Trie:
    """A trie in double arrays over ``(lang, phrase)``: a root per language, symbols are words by number."""

    def __init__(self, langs: pa.Array, phrases: pa.Array):
        self.n_keys = len(phrases)
        langs = pa.array(langs, pa.string()).dictionary_encode()
        self.roots = {lang: i for i, lang in enumerate(langs.dictionary.to_pylist())}
        split = pc.split_pattern(pa.array(phrases, pa.string()), " ")
        words = split.flatten().dictionary_encode()
        self.words = {w: i for i, w in enumerate(words.dictionary.cast(pa.binary()).to_pylist(), 1)}
        span = len(self.words) + 1
        length = split.value_lengths().to_numpy()
        table = np.zeros((self.n_keys, LONGEST), np.int64)
        table[np.arange(LONGEST) < length[:, None]] = words.indices.to_numpy() + 1
        # Nodes level by level: the distinct pairs of a parent and a symbol.
        state = langs.indices.to_numpy().astype(np.int64)
        edges, accepting, n_nodes = [], [], len(self.roots)
        for level in range(LONGEST):
            live = np.flatnonzero(length > level)
            pairs, place = np.unique(state[live] * span + table[live, level], return_inverse=True)
            state[live] = n_nodes + place
            edges.append(pairs)
            n_nodes += len(pairs)
            done = live[length[live] == level + 1]
            accepting.append((state[done], done))
        self.key = np.full(n_nodes, -1, np.int64)
        for nodes, keys in accepting:
            self.key[nodes] = keys
        pairs = np.concatenate(edges)
        self._place(pairs // span, pairs % span, n_nodes, span)

    def save(self, stream) -> None:
        held = {n: getattr(self, n) for n in ("base", "check", "target", "key")}
        words, roots = b" ".join(self.words), json.dumps(list(self.roots)).encode()
        np.savez(stream, **held, words=np.frombuffer(words, np.uint8), roots=np.frombuffer(roots, np.uint8))

    @classmethod
    def load(cls, stream) -> "Trie":
        trie, held = cls.__new__(cls), np.load(stream)
        trie.base, trie.check, trie.target, trie.key = (held[n] for n in ("base", "check", "target", "key"))
        trie.words = {w: i for i, w in enumerate(held["words"].tobytes().split(b" "), 1)}
        trie.roots = {lang: i for i, lang in enumerate(json.loads(held["roots"].tobytes()))}
        trie.n_keys = int((trie.key >= 0).sum())
        return trie

    def _place(self, parent: np.ndarray, symbol: np.ndarray, n_nodes: int, span: int) -> None:
        """A base for every node, so that no two children share a cell.

        Large families take the first base that fits, those of a few children draw bases together
        until none shares a cell with another.
        """
        child = np.arange(n_nodes - len(parent), n_nodes)
        order = np.lexsort((symbol, parent))
        parent, symbol, child = parent[order], symbol[order], child[order]
        families, first, size = np.unique(parent, return_index=True, return_counts=True)
        self.base = np.zeros(n_nodes, np.int64)
        room = 2 * len(parent) + 64
        used = np.zeros(room + span + WINDOW, bool)
        begin = 0
        for k in np.flatnonzero(size > FEW)[np.argsort(-size[size > FEW], kind="stable")].tolist():
            symbols = symbol[first[k] : first[k] + size[k]].tolist()
            at = begin
            while True:
                if at + span + WINDOW > len(used):
                    used = np.append(used, np.zeros(len(used), bool))
                taken = used[at + symbols[0] : at + symbols[0] + WINDOW].copy()
                for x in symbols[1:]:
                    taken |= used[at + x : at + x + WINDOW]
                fit = int(np.argmin(taken))
                if not taken[fit]:
                    break
                at += WINDOW
            self.base[families[k]] = at + fit
            used[at + fit + np.array(symbols)] = True
            while used[begin : begin + WINDOW].mean() > 0.9:
                begin += WINDOW
        draws = np.random.default_rng(0)
        room = max(room, int(np.flatnonzero(used)[-1]) + 1 if used.any() else 0)
        used = np.append(used, np.zeros(max(0, room + span - len(used)), bool))
        for n in range(FEW, 0, -1):
            left = np.flatnonzero(size == n)
            while len(left):
                base = draws.integers(0, room, len(left))
                cells = base[:, None] + symbol[first[left][:, None] + np.arange(n)]
                alone = np.zeros(cells.size, bool)
                alone[np.unique(cells, return_index=True)[1]] = True
                placed = alone.reshape(cells.shape).all(1) & ~used[cells].any(1)
                used[cells[placed]] = True
                self.base[families[left[placed]]] = base[placed]
                left = left[~placed]
        self.check = np.full(len(used), -1, np.int32)
        self.target = np.zeros(len(used), np.int32)
        cells = self.base[parent] + symbol
        self.check[cells], self.target[cells] = parent, child

    def count(self, lang: str, data: bytes, known: int, counts: np.ndarray) -> None:
        """Add the occurrences in ``data`` that do not end in its first ``known`` bytes."""
        if lang not in self.roots:
            return
        words = data.replace(b".", b" . ").split()
        known = len(data[:known].replace(b".", b" . ").split())
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        places = np.arange(len(ids))
        states = np.full(len(ids), self.roots[lang])
        for level in range(LONGEST):
            inside = places + level < len(ids)
            places, states = places[inside], states[inside]
            symbols = ids[places + level]
            cells = self.base[states] + symbols
            good = (symbols > 0) & (self.check[cells] == states)
            places, states = places[good], self.target[cells[good]]
            keys = self.key[states]
            keys = keys[(keys >= 0) & (places + level >= known)]
            if len(keys):
                counts += np.bincount(keys, minlength=self.n_keys)


def phrase_counts(docs: DataFrame, phrases: DataFrame, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """``a``, the exact number of occurrences, for each row of ``phrases(lang, phrase, …)``."""
    spark = docs.sparkSession
    placed = running_sums(phrases, [F.col("lang"), F.col("phrase")], {"place": F.lit(1)})
    placed = stored(placed.withColumn("shard", F.floor(F.col("place") / trie_phrases).cast("int")), "candidates")
    folder = fresh_folder(spark, "tries")

    def build(batches):
        """The task of one shard, with a bounded number of phrases."""
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        shards = rows["shard"].to_numpy()
        for shard in np.unique(shards).tolist():  # shards with one hash of their number share a task
            some = rows.filter(pa.array(shards == shard)).sort_by("place").combine_chunks()
            trie = Trie(some["lang"].chunk(0), some["phrase"].chunk(0))
            held = io.BytesIO()
            trie.save(held)
            stream, path = new_file(folder, ".npz")
            with stream:
                stream.write(held.getbuffer())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path]})

    shards = (placed.agg(F.max("shard")).first()[0] or 0) + 1
    tries = placed.select("shard", "place", "lang", "phrase").repartition(shards, "shard")
    paths = {r["shard"]: r["path"] for r in stored(tries.mapInArrow(build, "shard int, path string"), "tries").collect()}
    parts = [phrases.select("*", F.lit(0).cast("long").alias("a")).filter("false")]
    for shard, path in sorted(paths.items()):
        counted = _added(docs.mapInArrow(_counter(path), "part long, counts binary"))
        counted = counted.withColumn("place", F.col("i") + shard * trie_phrases)
        here = placed.filter(F.col("shard") == shard)
        parts.append(stored(here.join(counted, "place").select(*phrases.columns, "a"), "phrase-counts"))
    return reduce(DataFrame.union, parts)


_BUILT: dict[str, Trie] = {}


def _counter(path: str):
    def run(batches):
        if path not in _BUILT:  # one trie per worker process
            _BUILT.clear()
            with existing(path) as stream:
                _BUILT[path] = Trie.load(io.BytesIO(stream.read()))
        trie = _BUILT[path]
        counts = np.zeros(trie.n_keys, np.int64)
        for lang, data, known in slices(batches):
            trie.count(lang, data, known, counts)
        parts = [(k, counts[a : a + PACKED]) for k, a in enumerate(range(0, len(counts), PACKED))]
        parts = [(k, x.tobytes()) for k, x in parts if x.any()]
        for k, data in parts:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([data], pa.binary())], ["part", "counts"])

    return run


def _added(packed: DataFrame) -> DataFrame:
    """``(i, a)``: the sums over all tasks, of parts of the counts that come one after the other."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(data.as_buffer(), np.int64)
                held[part] = held[part] + counts if part in held else counts
        for part, counts in held.items():
            at = np.flatnonzero(counts)
            yield from _batches(["i", "a"], pa.array(at + part * PACKED, pa.int64()), pa.array(counts[at]))

    dealt = packed.repartition(shuffle_partitions(packed.sparkSession), "part")
    return dealt.mapInArrow(run, "i long, a long")


def _batches(names: list[str], *columns: pa.Array):
    """Record batches of a bounded number of rows."""
    for a in range(0, len(columns[0]), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(a, BATCH_ROWS) for c in columns], names)


def _cuts(words: Column) -> Column:
    """``(k, first, rest)`` for every way to cut an array of words in two."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"),
            F.array_join(F.slice(words, k + 1, F.size(words) - k), " ").alias("rest"),
        ),
    )


def _inner(words: Column) -> Column:
    """All phrases of at least two words inside a longer one."""
    size = F.size(words)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")
            ),
        )
    )


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of frequent phrases that no longer one explains."""
    counts = words.union(phrases)
    cut = phrases.select("lang", "phrase", "a", F.explode(_cuts(F.split("phrase", " "))).alias("c"))
    cut = cut.select("lang", "phrase", "a", F.col("c.k").alias("k"), F.col("c.first").alias("first"), F.col("c.rest").alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(2000000 * CAST(a AS DECIMAL(28, 0))) div (CAST(l AS DECIMAL(28, 0)) + r)")
    weakest = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a")).alias("w")
    )
    longer = phrases.filter(F.size(F.split("phrase", " ")) > 2).select(
        "lang", F.explode(_inner(F.split("phrase", " "))).alias("phrase"), F.col("a").alias("longer")
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(
        "longer IS NULL OR 100 * CAST(longer AS DECIMAL(28, 0)) < 80 * CAST(w.a AS DECIMAL(28, 0))"
    )
    return kept.select("lang", "phrase", *(F.col(f"w.{c}").alias(c) for c in ("a", "l", "r", "score")))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, trie_phrases: int = TRIE_PHRASES
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with arrow_batches(docs.sparkSession, "4m"):  # a task holds counts besides
        words = stored(word_counts(texts), "words")
        totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
        frequent = stored(words.filter(F.col("a") >= least), "frequent-words")
        found = frequent_phrases(texts, frequent_hashes(texts, frequent, least), least, trie_phrases)
    best = top_rows(scored(frequent, found), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
