"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a written table: the lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid(df: DataFrame, name: str, by: str, tasks: int) -> DataFrame:
    """The rows of df from a written table that lies by a column in so many tasks, for which grouping by that column shuffles nothing."""
    path = scratch(df.sparkSession, name)
    table = f"palimpsest_{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.repartition(tasks, by).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(tasks, by).saveAsTable(table)
    return df.sparkSession.table(table)
