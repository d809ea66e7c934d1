"""Prefix trie of conversations from padded matrices of turn ids.

A conversation is a sequence of turns; a node is a distinct beginning of one.  Sequences are
cut into blocks of ``WIDTH`` turns, so a conversation of any length is many small rows.  A row
has the ids of its turns, a sum that identifies all turns before the block, whether more follow, and the
conversation's id.  Rows are dealt by ranges of that order.  Inside a task the ids are a padded
matrix: one lexsort orders the rows, masks of changed columns, OR-accumulated from left to right,
mark where the nodes of every depth start, and ``reduceat`` aggregates each depth.  A node that
touches the first or last row of its range may go on in the next one: such boundary nodes, at
most two per depth and range, are recombined by their keys, all others are complete.

The id of a turn is 120 bits of a SHA-256 over its position, role and text; the key of a node
is its depth and the sum of its turns' ids.  Texts are read once and never shuffled.

Subtree sums need no walk: a node belongs to its smallest member, so each value is given to
one conversation at one depth; sums over the rest of each row are then added up over the members
of every node, by the same matrices.

Nulls: rows without ``conv_id`` belong to no conversation; a null role or text is empty; a null
turn comes first.  Turns with equal numbers are ordered by the SHA-256 of role and text, and
repeated rows are turns of their own.  An empty table has no node, not even a root.  Other columns
are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import running_sums, shuffle_partitions, stored

WIDTH = 16
SHARD_ROWS = 50_000
SHARED = 100
HEADS = 6
BITS = 60
MASK = (1 << BITS) - 1
NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing
KEY = ["depth", "hi", "lo"]


def turn_digest(role: str = "role", text: str = "text") -> Column:
    role = F.coalesce(F.col(role).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, i, own, digest, points)``: turns numbered from 0, and how many there are."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest().alias("digest"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("points"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    placed = stored(running_sums(turns, order, {"place": F.lit(1)}), "turns")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("own"))
    return placed.join(first, "conv_id").select(
        "conv_id", (F.col("place") - F.col("first")).alias("i"), "own", "digest", "points"
    )


def with_shared_heads(turns: DataFrame, shared: int = SHARED, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, digest, points)`` and ``(conv_id, length)`` of rebuilt conversations.

    The first h turns of a conversation are replaced by those of the conversation that its
    hundred begins with; h is the remainder of a checksum of its id.
    """
    base = F.col("conv_id") - F.col("conv_id") % shared
    own = turns.groupBy("conv_id").agg(F.max("own").alias("own"))
    convs = own.select(
        "conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    )
    convs = convs.join(
        own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left"
    ).select("conv_id", "base", "h", "own", F.least("h", F.coalesce("base_own", F.lit(0))).alias("head"))
    convs = stored(convs, "rebuilt-sizes")
    first = turns.filter(f"conv_id % {shared} = 0 AND i < {heads - 1}").select(
        F.col("conv_id").alias("base"), F.col("i").alias("pos"), "digest", "points"
    )
    shared_part = convs.join(first, "base").filter("pos < h").select("conv_id", "pos", "digest", "points")
    rest = turns.drop("own").join(convs.select("conv_id", "h", "head"), "conv_id").filter("i >= h")
    rest = rest.select("conv_id", (F.col("i") - F.col("h") + F.col("head")).alias("pos"), "digest", "points")
    length = F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return shared_part.union(rest), convs.select("conv_id", length.alias("length"))


def _piece(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, BITS // 4), 16, 10).cast("long")


def block_rows(sequences: DataFrame, lengths: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for every ``width`` turns: ``block, hi, lo, ids, points, goes_on, conv_id, multi``."""
    g = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("digest")), 256)
    turns = sequences.select(
        "conv_id", "pos", "points", F.floor(F.col("pos") / width).cast("long").alias("block"), g.alias("g")
    ).select("conv_id", "block", F.struct("pos", _piece(F.col("g"), 1).alias("hi"), _piece(F.col("g"), 16).alias("lo"), "points").alias("t"))
    rows = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rows = lengths.join(rows, "conv_id", "left").select(
        "conv_id", F.coalesce("block", F.lit(0)).alias("block"),
        F.transform("ts", lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"))).alias("ids"),
        F.col("ts.points").alias("points"), (F.col("length") > width).alias("multi"),
        (F.coalesce("block", F.lit(0)) < F.floor((F.col("length") - 1) / width)).alias("goes_on"),
    )
    rows = stored(rows, "blocks")

    def total(name: str) -> Column:
        return F.aggregate("ids", F.lit(0).cast("decimal(38,0)"), lambda a, t: (a + t[name]).cast("decimal(38,0)"))

    long_ones = rows.filter("multi").select("conv_id", "block", total("hi").alias("s_hi"), total("lo").alias("s_lo"))
    before = running_sums(long_ones, [F.col("conv_id"), F.col("block")], {"b_hi": F.col("s_hi"), "b_lo": F.col("s_lo")})
    before = stored(before, "before")
    at_start = before.filter("block = 0").select("conv_id", F.col("b_hi").alias("f_hi"), F.col("b_lo").alias("f_lo"))
    modulus = F.lit(1 << BITS).cast("decimal(38,0)")
    before = before.join(at_start, "conv_id").select(
        "conv_id", "block",
        *(F.pmod((F.col(f"b_{p}") - F.col(f"f_{p}")).cast("decimal(38,0)"), modulus).cast("long").alias(p) for p in ("hi", "lo")),
    )
    empty = F.array().cast("array<struct<hi:long,lo:long>>")
    return rows.join(before, ["conv_id", "block"], "left").select(
        "block", F.coalesce("hi", F.lit(0)).alias("hi"), F.coalesce("lo", F.lit(0)).alias("lo"),
        F.coalesce("ids", empty).alias("ids"), F.coalesce("points", F.array().cast("array<long>")).alias("points"),
        "goes_on", "conv_id", "multi",
    )


class Matrix:
    """The rows of a shard as a padded matrix of ids, in order."""

    def __init__(self, rows: pa.Table, width: int):
        self.width, n = width, rows.num_rows

        def column(name: str) -> np.ndarray:
            return rows[name].to_numpy()

        def padded(lists: pa.ListArray, values: np.ndarray, mask: np.ndarray, fill: int) -> np.ndarray:
            out = np.full((n, width), fill, np.int64)
            out[mask] = values
            return out

        ids, points = (rows[c].combine_chunks() for c in ("ids", "points"))
        self.size = ids.value_lengths().to_numpy()
        mask = np.arange(width) < self.size[:, None]
        flat = ids.flatten()
        self.hi, self.lo = (padded(ids, flat.field(i).to_numpy(), mask, -1) for i in (0, 1))
        self.points = padded(points, points.flatten().to_numpy(), mask, 0)
        self.block, self.conv, self.goes_on = column("block"), column("conv_id"), column("goes_on").astype(bool)
        self.key_hi, self.key_lo = column("hi"), column("lo")
        keys = [self.conv, self.goes_on]
        for j in reversed(range(width)):
            keys += [self.lo[:, j], self.hi[:, j]]
        self.order = order = np.lexsort([*keys, self.key_lo, self.key_hi, self.block])
        for name in ("size", "hi", "lo", "points", "block", "conv", "goes_on", "key_hi", "key_lo"):
            setattr(self, name, getattr(self, name)[order])

    def nodes(self):
        """For every depth in the block: members, the first of each node, columns of the nodes."""
        n, new = len(self.conv), np.ones(len(self.conv), bool)
        new[1:] = reduce(np.logical_or, (x[1:] != x[:-1] for x in (self.block, self.key_hi, self.key_lo)))
        hi, lo = self.key_hi.copy(), self.key_lo.copy()
        for j in range(self.width + 1):
            up_hi, up_lo = hi, lo
            if j:
                a, b = self.hi[:, j - 1], self.lo[:, j - 1]
                new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                hi, lo = (hi + a) & MASK, (lo + b) & MASK
            # A later block begins with a node that the block before it ends with.
            members = np.flatnonzero((self.size >= j) if j else (self.block == 0))
            if not len(members):
                continue
            starts = np.flatnonzero(new[members])
            first = members[starts]
            is_open = np.zeros(len(starts), bool)
            is_open[0] |= members[0] == 0
            is_open[-1] |= members[-1] == n - 1
            yield j, members, starts, {
                "depth": self.block[first] * self.width + j, "hi": hi[first], "lo": lo[first],
                "up_hi": up_hi[first], "up_lo": up_lo[first], "is_open": is_open,
            }


def _whole(batches) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts) if parts else None


_NODES = "depth long, hi long, lo long, up_hi long, up_lo long, is_open boolean, n long, conv_id long, points long, ends string, first long"


def _members(width: int):
    def run(batches):
        from hashlib import sha256

        rows = _whole(batches)
        if rows is None:
            return
        m = Matrix(rows, width)
        names = m.conv.astype(str).tolist()
        for j, members, starts, columns in m.nodes():
            conv = m.conv[members]
            ending = ((m.size[members] == j) & ~m.goes_on[members]).astype(np.int64)
            n_ending = np.add.reduceat(ending, starts).tolist()  # they are a node's first rows
            texts = [NO_ENDS] * len(starts)
            for k in np.flatnonzero(n_ending).tolist() + np.flatnonzero(columns["is_open"]).tolist():
                at, count = members[starts[k]], n_ending[k]
                text = ",".join(names[at : at + count])
                texts[k] = text if columns["is_open"][k] else sha256(text.encode()).hexdigest()
            columns |= {
                "n": np.diff(np.append(starts, len(members))), "conv_id": np.minimum.reduceat(conv, starts),
                "points": m.points[members[starts], j - 1] if j else np.zeros(len(starts), np.int64),
                "ends": texts, "first": conv[starts],
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _digests(open_nodes: DataFrame) -> DataFrame:
    """SHA-256 of the joined ids of boundary nodes, from the parts of all their ranges in order."""

    def run(batches):
        from hashlib import sha256

        key, text, done = None, None, []

        def flushed():
            out = pa.RecordBatch.from_pylist(
                [dict(zip([*KEY, "ends"], row)) for row in done],
                schema=pa.schema([*((k, pa.int64()) for k in KEY), ("ends", pa.string())]),
            )
            done.clear()
            return out

        for batch in batches:
            for *at, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != key:
                    if key:
                        done.append([*key, text.hexdigest()])
                    key, text, some = at, sha256(), False
                if part:
                    text.update(("," + part if some else part).encode())
                    some = True
            if len(done) > 10_000:
                yield flushed()
        if key:
            done.append([*key, text.hexdigest()])
        yield flushed()

    parts = open_nodes.filter("ends <> ''").select(*KEY, "ends", "first")
    dealt = parts.repartition(shuffle_partitions(parts.sparkSession), *KEY).sortWithinPartitions(*KEY, "first")
    return dealt.select(*KEY, "ends").mapInArrow(run, "depth long, hi long, lo long, ends string")


def _subtrees(width: int):
    def run(batches):
        rows = _whole(batches)
        if rows is None:
            return
        m = Matrix(rows, width)
        n = len(m.conv)
        given = rows["given"].combine_chunks()
        at = np.repeat(np.arange(n), given.value_lengths().fill_null(0).to_numpy())
        flat = given.flatten()
        j = flat.field(0).to_numpy().astype(np.int64)
        sums = {}
        for i, name in enumerate(("saved", "leaves")):
            cells = np.zeros((n, width + 1), np.int64)
            cells[at, j] = flat.field(i + 1).to_numpy()
            cells[:, width] += rows[f"later_{name}"].to_numpy()
            sums[name] = np.cumsum(cells[:, ::-1], axis=1)[:, ::-1][m.order]
        for j, members, starts, columns in m.nodes():
            yield pa.RecordBatch.from_pydict(
                {k: columns[k] for k in (*KEY, "is_open")}
                | {name: np.add.reduceat(s[members, j], starts) for name, s in sums.items()}
            )

    return run


def trie(sequences: DataFrame, lengths: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie over ``(conv_id, pos, digest, points)``.

    ``lengths`` has every conversation, turnless ones too.  A range holds about ``shard_rows``
    rows of at most ``width`` turns, which bounds the memory of a task.
    """
    spark = sequences.sparkSession
    rows = stored(block_rows(sequences, lengths, width), "trie-blocks")
    shards = max(shuffle_partitions(spark), -(-rows.count() // shard_rows))
    order = ["block", "hi", "lo", "ids", "goes_on", "conv_id"]

    found = rows.repartitionByRange(shards, *order).drop("multi").mapInArrow(_members(width), _NODES)
    found = stored(found, "trie-parts")
    boundary = found.filter("is_open")
    joined = boundary.groupBy(*KEY).agg(
        *(F.min(c).alias(c) for c in ("up_hi", "up_lo", "conv_id", "points")), F.sum("n").alias("n")
    ).join(_digests(boundary), KEY, "left")
    columns = [*KEY, "up_hi", "up_lo", "conv_id", "points", "n", "ends"]
    nodes = found.filter("NOT is_open").select(columns).union(joined.select(columns))
    nodes = stored(nodes.fillna(NO_ENDS, ["ends"]), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")
    ).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "trie-children")

    block = F.greatest(F.floor((F.col("depth") - 1) / width), F.lit(0)).cast("long")
    given = nodes.select(
        "conv_id", block.alias("block"), (F.col("depth") - block * width).cast("long").alias("j"),
        ((F.col("n") - 1) * F.col("points")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"),
    ).filter("saved > 0 OR leaves > 0")
    given = stored(
        given.groupBy("conv_id", "block").agg(
            F.collect_list(F.struct("j", "saved", "leaves")).alias("given"),
            F.sum("saved").alias("in_saved"), F.sum("leaves").alias("in_leaves"),
        ),
        "trie-given",
    )
    names = ("saved", "leaves")
    long_ones = rows.filter("multi").select("conv_id", "block").join(given.drop("given"), ["conv_id", "block"], "left")
    long_ones = long_ones.fillna(0, [f"in_{k}" for k in names])
    long_ones = stored(
        running_sums(long_ones, [F.col("conv_id"), F.col("block")], {k: F.col(f"in_{k}") for k in names}), "trie-sums"
    )
    whole = long_ones.groupBy("conv_id").agg(
        *((F.min(k) + F.sum(f"in_{k}")).alias(f"all_{k}") for k in names)
    )
    later = long_ones.join(whole, "conv_id").select(
        "conv_id", "block", *((F.col(f"all_{k}") - F.col(k) - F.col(f"in_{k}")).alias(f"later_{k}") for k in names)
    )
    weighed = rows.join(given.select("conv_id", "block", "given"), ["conv_id", "block"], "left")
    weighed = weighed.join(later, ["conv_id", "block"], "left").fillna(0, [f"later_{k}" for k in names])
    sums = weighed.select(*order, "points", "given", *(f"later_{k}" for k in names))
    sums = sums.repartitionByRange(shards, *order).mapInArrow(
        _subtrees(width), "depth long, hi long, lo long, is_open boolean, saved long, leaves long"
    )
    sums = stored(sums, "trie-sums")
    total = [F.sum(k).alias(k) for k in names]
    sums = sums.filter("NOT is_open").drop("is_open").union(sums.filter("is_open").groupBy(*KEY).agg(*total))

    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return nodes.join(sums, KEY).join(above, ["depth", "up_hi", "up_lo"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of all conversations, rebuilt with shared heads."""
    turns = stored(numbered_turns(conversations), "numbered")
    return trie(*with_shared_heads(turns), width=width, shard_rows=shard_rows)
