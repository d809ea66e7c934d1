"""Mixing sources to target weights along a curriculum that varies over training time.

Every source has a weight and a rate that changes over training time.  Its rate is
integrated into a demand for words; the documents of a source, in a fixed random order,
lie one after the other on the axis of its cumulative words, and inverting the demand at
the place where a document begins gives its training position.  Documents are then
range-sorted by position.

Words are runs of characters other than ASCII blanks.  Targets stop at ``repeats`` times
the words of a source; what is over goes to the others by weight.  A source takes whole
passes over its documents and, in the last pass, the documents that have their middle
before the target.

Null texts have no words and are never repeated words; a null source is a source of its
own, last in order; rows that are equal count one by one; rows that differ in any column are
told apart; rows without an id are ordered by a hash of their text; a table without words has
targets of 0; other columns are kept, never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import running_sums, stored

WORD = r"[^\x20\x09-\x0D]+"
#: (time, rate) of a source by its rank in order; each has an integral of 1 over time 0 to 1.
Curriculum = Callable[[Column], list[tuple[float, Column]]]


def ramps(rank: Column) -> list[tuple[float, Column]]:
    """By rank modulo 3: falling, even, rising rates, held in the last tenth."""
    start = F.when(rank % 3 == 0, 1.5).when(rank % 3 == 1, 1.0).otherwise(0.5)
    return [(0.0, start), (0.9, 2.0 - start), (1.0, 2.0 - start)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, key, row_1, row_2)``, a row per document.

    ``key`` is the random order within a source; ``row_1, row_2`` identify the whole row, so
    rows that share them are equal in every column.
    """
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("text").cast("string")))
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(id_text).alias("key"), *_row_key(docs)
    )


def _row_key(docs: DataFrame) -> list[Column]:
    """A hash of 128 bits over all columns; nulls count, which hashes by themselves pass over."""
    values = [
        F.array_sort(F.map_entries(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`")
        for f in docs.schema.fields
    ]
    values += [F.col(f"`{c}`").isNull() for c in docs.columns]
    return [F.xxhash64(*values).alias("row_1"), F.xxhash64(F.lit("second"), *values).alias("row_2")]


def targets(
    sources: DataFrame, weights: Column, share: float, repeats: float
) -> DataFrame:
    """``(source, source_size, rank, weight, target)`` from ``(source, source_size)``.

    Sorted by cap per weight, the capped sources are a prefix: each is capped if the
    level of what is left, before it, reaches its cap.  The level is highest where the
    prefix ends.
    """
    ranked = running_sums(
        sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}
    )
    priced = ranked.withColumn("weight", weights).withColumns(
        {"cap": F.col("source_size") * repeats, "ratio": F.col("source_size") * repeats / F.col("weight")}
    )
    total = priced.agg(F.sum("source_size"), F.sum("weight")).first()
    if total[0] is None:
        return priced.select("source", "source_size", "rank", "weight", F.lit(0.0).alias("target"))
    filled = running_sums(
        priced, [F.col("ratio"), F.col("rank")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}
    ).withColumn(
        "level", (F.lit(share * total[0]) - F.col("cap_before")) / (F.lit(total[1]) - F.col("weight_before"))
    )
    filled = stored(filled, "levels")
    level = filled.agg(F.max("level")).first()[0]
    return filled.select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("level") >= F.col("ratio"), F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"),
    )


def position_of(share: Column, knots: list[tuple[float, Column]]) -> Column:
    """The time at which ``share`` of the integral over piecewise linear rates is reached."""
    areas = [(a + b) / 2 * (t1 - t0) for (t0, a), (t1, b) in zip(knots, knots[1:])]
    need = share * sum(areas[1:], areas[0])
    times, below = [], F.lit(0.0)
    for area, (t0, a), (t1, b) in zip(areas, knots, knots[1:]):
        y = need - below
        root = a + F.sqrt(F.greatest(a * a + y * 2.0 * (b - a) / (t1 - t0), F.lit(0.0)))
        times.append((y, area, F.lit(t0) + F.coalesce(y * 2.0 / F.nullif(root, F.lit(0.0)), F.lit(0.0))))
        below = below + area
    out = times[-1][2]
    for y, area, time in reversed(times[:-1]):
        out = F.when(y < area, time).otherwise(out)
    return out


def mix_plan(
    docs: DataFrame,
    weights: Column | None = None,
    share: float = 1.5,
    repeats: int = 2,
    curriculum: Curriculum = ramps,
) -> DataFrame:
    """One row per document: its source's size and target, the copies and their positions.

    ``(doc_id, key, size, source_size, target, copies int, positions array<double>, row_1, row_2)``.
    ``weights`` is a column over ``rank``, the place of a source in code point order.
    Documents are dealt by ranges of their order and summed range by range, so neither a
    source nor the copies of a document are ever in one task.
    """
    if weights is None:
        weights = F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("rank") % 3 + 1).cast("int"))
    rows = stored(sized(docs).withColumn("nth", F.monotonically_increasing_id()), "sized")
    goal = stored(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats),
        "targets",
    )
    order = [F.col("source").asc_nulls_last(), *map(F.col, ("key", "doc_id", "size", "row_1", "row_2", "nth"))]
    placed = stored(running_sums(rows, order, {"before": F.col("size")}), "placed")
    first = placed.groupBy(F.col("source").alias("s")).agg(F.min("before").alias("first"))
    goal = stored(goal.join(first, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "goals")
    joined = placed.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    begin = F.col("before") - F.col("first")
    copies = F.ceil(
        (F.col("target") - begin - F.col("size") / 2) / F.nullif(F.col("source_size"), F.lit(0))
    )
    knots = curriculum(F.col("rank"))
    at = lambda k: position_of(
        (F.col("begin") + k * F.col("source_size")) / F.col("target"), knots
    )
    return (
        joined.withColumn("begin", begin)
        .withColumn("copies", F.coalesce(F.least(F.greatest(copies, F.lit(0)), F.lit(repeats)), F.lit(0)).cast("int"))
        .withColumn(
            "positions",
            F.array_compact(F.array(*(F.when(F.col("copies") > k, at(k)) for k in range(repeats)))),
        )
        .select("doc_id", "key", "size", "source_size", "target", "copies", "positions", "row_1", "row_2")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, a row per copy, range-sorted by training position.

    The plan's copies are joined with one row for each distinct document row.  Equal rows
    are interchangeable, so however often a row is repeated, none of its copies is numbered
    and no task holds them together.
    """
    key = ["row_1", "row_2"]
    plan = mix_plan(docs, **options).select(*key, F.explode("positions").alias("position"))
    distinct = docs.select(F.struct(*docs.columns).alias("doc"), *_row_key(docs)).groupBy(*key).agg(F.first("doc").alias("doc"))
    return plan.join(distinct, key).orderBy("position", *key).select("doc.*")
