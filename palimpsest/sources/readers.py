"""Sources and sinks: described text archives, provider responses, manifests, versioned publication."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tab_archive(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """Rows of tab-separated files, all columns strings in the descriptor's order; a row of another length fails the read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", header).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


def provider_responses(spark: SparkSession, path: str, record: str) -> tuple[DataFrame, DataFrame]:
    """(envelopes, records) of JSON responses: provider, licence, counts and problems a file; then its records, typed by ``record``."""
    schema = f"data_provider string, data_license string, records_found bigint, records_returned bigint, errors array<string>, warnings array<string>, records array<struct<{record}>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())
    problem = F.when(F.col("data_provider").isNull(), "provider").when(F.col("data_license").isNull(), "licence").when(F.size(F.coalesce("errors", F.array())) > 0, "errors").when(F.size(F.coalesce("warnings", F.array())) > 0, "warnings").when(F.col("records").isNull(), "records")
    return raw.select("file", "records_found", "records_returned", F.size("records").alias("records"), problem.alias("problem")), raw.select("file", F.inline("records"))


def manifest_check(spark: SparkSession, path: str, manifest: DataFrame, depth: int = 1) -> DataFrame:
    """(name, problem): files that are missing, not listed, or not of the manifest's (name, bytes, sha256).

    A name is the last ``depth`` parts of the file's path.
    """
    files = spark.read.format("binaryFile").load(path).select(F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias("name"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    both = manifest.join(files, "name", "full")
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("_bytes") != F.col("bytes"), "length").when(F.col("_sha") != F.col("sha256"), "digest")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def publish(frames: dict[str, DataFrame], path: str, checks: dict[str, DataFrame] | None = None) -> str:
    """Writes all frames as a new version below path and, if every check is empty, points to it; else nothing changes.

    Readers go through ``published``: they see the old version whole or the new one whole.
    """
    spark = next(iter(frames.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in frames.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    for name, violations in (checks or {}).items():
        if not violations.isEmpty():
            raise ValueError(f"{name} has violations; {path} stays as it was")
    pointer = spark.createDataFrame([(version, json.dumps(sorted(frames)))], "version string, frames string").withColumn("at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return version


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A frame of the version published last."""
    last = spark.read.parquet(f"{path}/pointer").orderBy(F.desc("at")).first()
    return spark.read.parquet(f"{path}/versions/{last['version']}/{name}")
