"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated vectors lose
little: balanced binary codes.  A code is cut into segments.  Two vectors meet in a segment
if their bits there differ in at most ``radius`` places: of the two, the one with the smaller
key looks up the larger key.  Where vectors meet they are compared by cosine in double
precision, with their original values; a pair that meets in several segments counts in the
first.

What meets under one key is cut into blocks of about ``block`` rows and compared block by
block, so no task holds a hot key; a task returns one sum per vector and the links of a
spanning forest, never pairs.  Equal vectors are one node with a number of copies.

The rotation is fitted on at most ``sample_rows`` distinct vectors (the first by a hash of
their values); every vector is indexed.  A pair is lost if it is more than ``radius`` bits
apart in every segment; with 6 segments of 10 or 11 bits and radius 1 that is, for bits that
differ independently, 1 in 100 pairs at cosine 0.9 itself and 1 in 1,000 at 0.95.

Vectors of different lengths have no cosine; those of each length are searched by themselves.
Components are compared as they are, 32-bit floats or doubles.  Null and zero vectors, and those
with null or non-finite components, link with nothing and are their own component.  Null ids take part; equal rows
are vectors linked with each other; an empty table gives no rows; other columns, labels
included, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import components, groups_of, shuffle_partitions, split_ball, stored


def fit_rotation(x: np.ndarray, bits: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection ``(dim, bits)`` of unit vectors by iterative quantisation."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((axes.shape[1],) * 2))
    for _ in range(rounds):
        signs = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        rotation = (left @ right).T
    return mean, axes @ rotation


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # squares of very large values stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of numbers of a ``kind`` from a column of their bytes."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


def kind_of(vectors: DataFrame) -> str:
    """How components are held: 32-bit floats stay so, all other numbers are doubles."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, node)`` of every row, ``(node, copies, embedding, dim)`` of those that can link.

    ``node``: the MD5 of the values; null for vectors that link with nothing.
    """
    e = F.col("embedding").cast("array<float>" if kind_of(vectors) == "<f4" else "array<double>")
    usable = F.coalesce(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0),
        F.lit(False),
    )
    values = F.when(usable, e)
    rows = stored(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.md5(F.array_join(values.cast("array<string>"), ",")).alias("node"),
            values.alias("embedding"),
        ),
        "vectors",
    )
    distinct = rows.filter("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    return rows.select("vec_id", "node"), stored(distinct.withColumn("dim", F.size("embedding")), "distinct-vectors")


def learned(distinct: DataFrame, bits: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation, from a bounded sample in one task."""

    def run(batches):
        x = [np.array(b.column(0).to_pylist(), np.float64) for b in batches]
        if x:
            mean, projection = fit_rotation(unit(np.concatenate(x)), bits)
            yield pa.RecordBatch.from_arrays([pa.array([mean.tolist(), *projection.T.tolist()])], ["row"])

    sample = stored(distinct.orderBy("node").limit(sample_rows).select("embedding"), "itq-sample")
    rows = [r["row"] for r in sample.repartition(1).mapInArrow(run, "row array<double>").collect()]
    return np.array(rows[0]), np.array(rows[1:]).T


def coded(distinct: DataFrame, mean: np.ndarray, projection: np.ndarray, kind: str) -> DataFrame:
    """``(node, copies, code, vector)``; vector: the bytes of its components."""
    weights = 1 << np.arange(projection.shape[1], dtype=np.uint64)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), kind).reshape(batch.num_rows, -1)
            bits = (unit(x) - mean) @ projection >= 0 if len(x) else np.zeros((0, len(weights)), bool)
            codes = (bits * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes), rows], ["node", "copies", "code", "vector"]
            )

    return distinct.select("node", "copies", "embedding").mapInArrow(
        run, "node string, copies long, code long, vector binary"
    )


def compared(meetings: DataFrame, cut: list[tuple[int, int, list[int]]], radius: int, least: float, kind: str) -> DataFrame:
    """``(node, linked, other)``: per meeting and vector the copies it links with, and a tree link."""
    schema = pa.schema([("node", pa.string()), ("linked", pa.int64()), ("other", pa.string())])

    def close(a: np.ndarray, b: np.ndarray, segment: int) -> np.ndarray:
        """The pairs that meet in an earlier segment."""
        met = np.zeros(len(a), bool)
        for at, width, _ in cut[:segment]:
            differ = ((a ^ b) >> np.uint64(at)) & np.uint64((1 << width) - 1)
            met |= np.bitwise_count(differ) <= radius
        return met

    def group(t: pa.Table) -> pa.RecordBatch | None:
        own, block = t["own"].to_numpy(), t["block"].to_numpy()
        if t.num_rows < 2 or not own.any():
            return None
        x, code = unit(matrix(t["vector"], kind)), t["code"].to_numpy().view(np.uint64)
        mine = np.flatnonzero(own)
        i, j = np.nonzero(x[mine] @ x.T >= least)
        i = mine[i]
        left, right = t["left"][0].as_py(), t["right"][0].as_py()
        keep = (i < j) | ~own[j]  # two owners of the key once, an owner and a visitor once
        keep &= i != j
        if left != right:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        new = ~close(code[i], code[j], t["s"][0].as_py())
        i, j = i[new], j[new]
        if not len(i):
            return None
        copies, n = t["copies"].to_numpy(), t.num_rows
        linked = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root = np.arange(n)
        while True:  # the smallest row of each connected set
            low = np.minimum(root[i], root[j])
            after = root.copy()
            np.minimum.at(after, i, low)
            np.minimum.at(after, j, low)
            after = np.minimum(after, after[after])
            if (after == root).all():
                break
            root = after
        some = np.flatnonzero(linked)
        names = t["node"].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(some)), pa.array(linked[some].astype(np.int64)), names.take(pa.array(root[some]))], schema=schema
        )

    def run(batches):
        waiting, n = [], 0
        for t in groups_of(batches, ["s", "k", "left", "right"]):
            found = group(t)
            if found is not None:
                waiting.append(found)
                n += found.num_rows
            if n >= 10_000:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, n = [], 0
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    return meetings.mapInArrow(run, "node string, linked long, other string")


def _links(
    distinct: DataFrame, bits: int, kind: str, least: float, segments: int, radius: int, block: int, sample_rows: int
) -> DataFrame:
    """``(node, linked, other)``, stored: the links between distinct vectors of one length."""
    spark = distinct.sparkSession
    mean, projection = learned(distinct, bits, sample_rows)
    codes = stored(coded(distinct, mean, projection, kind), "codes")
    cut = split_ball(bits, [radius] * min(segments, bits))

    def keys(s: int, at: int, width: int, masks: list[int]):
        key = F.shiftrightunsigned("code", at).bitwiseAND((1 << width) - 1)
        around = F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: key.bitwiseXOR(m))
        return F.transform(
            F.filter(around, lambda k: k >= key),
            lambda k: F.struct(F.lit(s).alias("s"), k.alias("k"), (k == key).alias("own")),
        )

    visits = stored(
        codes.select("node", F.explode(F.concat(*(keys(s, *c) for s, c in enumerate(cut)))).alias("v")).select("node", "v.*"),
        "visits",
    )
    sizes = stored(
        visits.groupBy("s", "k").agg(F.count("*").alias("n"), F.count_if("own").alias("owners"))
        .filter("n > 1 and owners > 0").select("s", "k", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "buckets",
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = visits.join(sizes, ["s", "k"]).select(
        "node", "s", "k", "own", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    )
    meetings = placed.join(codes, "node").select(
        "s", "k", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "block", "own",
        "node", "copies", "code", "vector",
    )
    order = ["s", "k", "left", "right"]
    dealt = meetings.repartition(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return stored(compared(dealt, cut, radius, least, kind), "links")


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.9,
    bits: int = 64,
    segments: int = 6,
    radius: int = 1,
    block: int = 1_024,
    sample_rows: int = 20_000,
) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of every vector; links have a cosine of ``least`` or more.

    Vectors link with those of their own length; each length has a rotation and tables of its own.
    """
    rows, distinct = nodes_of(vectors)
    lengths = distinct.groupBy("dim").agg(F.count("*").alias("n")).filter("n > 1").orderBy("dim").collect()
    found = rows.sparkSession.createDataFrame([], "node string, linked long, other string")
    for dim in (r["dim"] for r in lengths):
        of_length = distinct.filter(F.col("dim") == dim).drop("dim")
        found = found.union(
            _links(of_length, min(bits, dim), kind_of(vectors), least, segments, radius, block, sample_rows)
        )
    linked = stored(found.groupBy("node").agg(F.sum("linked").alias("linked")), "linked")
    member = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    ids = stored(rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "ids")
    grouped = stored(
        ids.join(member, "node", "left").join(linked, "node", "left").select(
            "node", "first", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        ),
        "grouped",
    )
    smallest = stored(grouped.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    of = stored(grouped.join(smallest, "component").select("node", "n_links", "component_id"), "vector-components")
    return rows.join(of, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
