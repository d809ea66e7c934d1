"""Reproducible order inside classes, without putting a class into one task.

The order is the md5 of a purpose, the seed and the message key, so it is the same
in every engine and does not depend on the layout of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatframe.schema import FOLDS, SEED, TEST_SHARE

# The first three hex digits of the hash; a class has at most this many buckets.
BUCKETS = 4096
# Spark limits windows inside the tasks up to this rank.
TASK_LIMIT = 1000


def hash_order(purpose: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(purpose), F.lit(str(seed)), "chat_id", "msg_seq"))


def ranked(
    df: DataFrame, label: str, purpose: str, seed: int = SEED, limit: int | None = None
) -> DataFrame:
    """Add ``rank`` (from 1) and ``class_size`` per class in hash order.

    The rows are counted per class and hash bucket; running totals of those counts
    (at most ``BUCKETS`` per class) say at which rank a bucket starts, so only rows
    of one bucket are sorted together.  With ``limit``, only that many rows per class
    are wanted: up to ``TASK_LIMIT`` each task keeps its own first rows before the
    shuffle (and there is no ``class_size``); beyond, buckets that start after the limit
    are dropped.
    """
    order = hash_order(purpose, seed)
    if limit is not None and limit <= TASK_LIMIT:
        first = F.row_number().over(Window.partitionBy(label).orderBy(order))
        return df.withColumn("rank", first).filter(F.col("rank") <= limit)
    hashed = df.withColumn("_hash", order).withColumn(
        "_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int")
    )
    counts = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    per_class = Window.partitionBy(label)
    running = per_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        label, "_bucket",
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_start"),
        F.sum("_n").over(per_class).alias("class_size"),
    )
    if limit is not None:
        starts = starts.filter(F.col("_start") < limit)
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_hash")
    # bounded: labels x BUCKETS rows
    out = (
        hashed.join(F.broadcast(starts), [label, "_bucket"])
        .withColumn("rank", F.col("_start") + F.row_number().over(in_bucket))
        .drop("_hash", "_bucket", "_start")
    )
    return out if limit is None else out.filter(F.col("rank") <= limit)


def split_train_test(rows: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Add ``part`` (``train`` or ``test``): 20 % of all rows, rounded up, shared out
    to the classes by their size; left-over rows go to the largest remainders."""
    r = ranked(rows, label, "split")
    classes = r.select(label, "class_size").distinct()
    everything = Window.partitionBy()
    n = F.sum("class_size").over(everything)
    exact = F.ceil(n * TEST_SHARE) * F.col("class_size") / n
    shares = classes.select(label, F.ceil(n * TEST_SHARE).alias("_test"), exact.alias("_exact"))
    left = F.col("_test") - F.sum(F.floor("_exact")).over(everything)
    place = F.row_number().over(
        Window.partitionBy().orderBy(F.desc(F.col("_exact") - F.floor("_exact")), label)
    )
    # bounded: one row per label
    quota = shares.select(
        label, (F.floor("_exact") + F.when(place <= left, 1).otherwise(0)).alias("_quota")
    )
    return (
        r.join(F.broadcast(quota), label)
        .withColumn("part", F.when(F.col("rank") <= F.col("_quota"), "test").otherwise("train"))
        .drop("_quota", "rank", "class_size")
    )


def assign_folds(rows: DataFrame, label: str = "sentiment_label", folds: int = FOLDS) -> DataFrame:
    """Add ``fold`` (0 to ``folds - 1``): equal parts of every class in hash order."""
    r = ranked(rows, label, "fold")
    small = F.floor(F.col("class_size") / folds)
    larger = F.col("class_size") % folds
    in_larger = larger * (small + 1)
    fold = F.when(
        F.col("rank") <= in_larger, F.floor((F.col("rank") - 1) / (small + 1))
    ).otherwise(larger + F.floor((F.col("rank") - 1 - in_larger) / F.greatest(small, F.lit(1))))
    return r.withColumn("fold", fold.cast("int")).drop("rank", "class_size")
