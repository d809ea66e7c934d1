"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatframe.plans.store import shared_folder, stored

__all__ = [
    "arrow_batches", "components", "free_name", "fresh_folder", "groups_of", "running_sums",
    "shuffle_partitions", "split_ball", "stored", "table",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, size: str):
    """Arrow batches of about ``size`` in the jobs that run inside, where tasks need the memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name, the sum of its column over all earlier rows in ``order``.

    The rows are dealt by ranges of ``order`` and stored; only one total per range meets
    in a task, and a range is summed by itself, so no task sees the whole table.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    dealt = stored(
        df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_all_{k}") for k, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row for each of n ranges
        "_range", *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums)
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns(
        {f"_in_{k}": F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()}
    )
    return summed.join(F.broadcast(offsets), "_range").select(
        *df.columns, *((F.col(f"_off_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums)
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component: the smallest node.

    Alternating large and small stars: every round points neighbours at the smallest
    known node, so paths shorten geometrically.  Each round is written and read again;
    minima are taken by partial aggregation and hubs are joined, never collected.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    links = stored(
        edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    before = state(links)
    while before[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            links.select("lo", "hi")
        )
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stored(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
            "large",
        )
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = (
            large.join(least, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        links = stored(small.union(least.select("hi", "m")).distinct(), "links")
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        links.select("lo", "lo").distinct()
    )


def split_ball(bits: int, radii: Iterable[int]) -> list[tuple[int, int, list[int]]]:
    """Segments of a ``bits``-bit code: (first bit, width, masks of at most ``radius`` bits)."""
    from itertools import combinations

    radii = list(radii)
    out, at = [], 0
    for i, radius in enumerate(radii):
        width = bits // len(radii) + (i >= len(radii) - bits % len(radii))
        masks = [
            sum(1 << b for b in chosen)
            for r in range(radius + 1)
            for chosen in combinations(range(width), r)
        ]
        out.append((at, width, masks))
        at += width
    return out


def groups_of(batches: Iterator, keys: list[str]) -> Iterator:
    """Consecutive Arrow tables with equal ``keys`` from batches sorted by them."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        t = pa.concat_tables([rest, t]) if rest is not None else t
        cut = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t[k].to_numpy()
            cut |= x[1:] != x[:-1]
        starts = [0, *(np.flatnonzero(cut) + 1).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(starts[-1]).combine_chunks()
    if rest is not None:
        yield rest
