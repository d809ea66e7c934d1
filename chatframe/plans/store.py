"""Cutting lineage: a written table in the cluster's shared checkpoint folder.

A table that many results read is computed once, survives the loss of executors and
is read back by column.  Plans on top of it stay short.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="chatframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, types: dict[str, DataType] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    ``types`` names columns to read as another type that is stored in the same way.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fields = [StructField(f.name, (types or {}).get(f.name, f.dataType), f.nullable) for f in df.schema.fields]
    return spark.read.schema(StructType(fields)).parquet(path)
