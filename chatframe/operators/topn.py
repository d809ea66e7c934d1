"""The first rows of each group, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this rank Spark limits every group inside the tasks before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold); beyond it, parts do the same.
TASK_LIMIT = 1000
PARTS = 64


def top_rows(
    df: DataFrame, group: list[str], order: list[Column | str], n: int, key: str, rank: str = "rank"
) -> DataFrame:
    """Rows ranked 1 to ``n`` per ``group`` by ``order``, with their ``rank``.

    ``order`` must be total.  For a large ``n`` a first cut is made in ``PARTS`` parts
    of the group, chosen by the hash of ``key``: a row of the first ``n`` is among the
    first ``n`` of its part, so the result is exact.
    """
    if n > TASK_LIMIT:
        part = Window.partitionBy(*group, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
            .withColumn("_place", F.row_number().over(part))
            .filter(F.col("_place") <= n)
            .drop("_part", "_place")
        )
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)
