"""Sources, sinks and streams over files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.fixtures import Evidence
from palimpsest.plans.registry import query
from palimpsest.sources import readers
from palimpsest.sources.scratch import scratch
from palimpsest.streaming import revisions as st


@query("a01_tab_archive", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer", base=False)
def _(e: Evidence) -> DataFrame:
    path = scratch(e.spark, "archive")
    e.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).write.option("sep", "\t").option("header", True).csv(path)
    return readers.tab_archive(e.spark, path, ["id", "name", "segment"])


@query("a02_provider_responses", "SELECT o_orderstatus AS status, o_orderkey AS id, o_custkey AS owner FROM orders", base=False)
def _(e: Evidence) -> DataFrame:
    path = scratch(e.spark, "responses")
    parts = e.table("orders").count() // 2_000 + 1  # responses of some 2,000 records, however many orders there are
    rows = e.table("orders").groupBy("o_orderstatus", F.pmod(F.xxhash64("o_orderkey"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"))).alias("records"))
    body = rows.select(F.lit("p").alias("data_provider"), F.lit("l").alias("data_license"), F.size("records").alias("records_found"), F.size("records").alias("records_returned"), "records")
    body.write.option("maxRecordsPerFile", 1).json(path)
    envelopes, records = readers.provider_responses(e.spark, f"{path}/*.json", "id bigint, owner bigint, status string")
    good = envelopes.where("problem is null and records = records_returned").select("file")
    return records.join(good, "file", "left_semi").select("status", "id", "owner")


def _faulty_manifest(e: Evidence, table: str, key: str) -> DataFrame:
    """Problems (folder, problem) of a folder whose manifest is wrong in known ways: 0 unlisted, 1 altered, 2 longer, 99 missing."""
    path = scratch(e.spark, "files")
    e.table(table).withColumn("folder", F.pmod(F.col(key), F.lit(8)).cast("int")).write.partitionBy("folder").parquet(path)
    files = f"{path}/*/*.parquet"
    listed = e.spark.read.format("binaryFile").load(files).select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    folder = F.regexp_extract("name", "folder=([0-9]+)", 1).cast("int")
    said = listed.where(folder != 0).withColumn("sha256", F.when(folder == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256"))).withColumn("bytes", F.when(folder == 2, F.col("bytes") + 1).otherwise(F.col("bytes")))
    gone = listed.where(folder == 3).select(F.regexp_replace("name", "folder=3", "folder=99").alias("name"), "bytes", "sha256")
    return readers.manifest_check(e.spark, files, said.unionByName(gone), depth=2).select(folder.alias("folder"), "problem").distinct()


def _faulty_sql(table: str, key: str) -> str:
    return f"SELECT DISTINCT CASE WHEN f = 3 THEN 99 ELSE f END AS folder, CASE f WHEN 0 THEN 'unlisted' WHEN 1 THEN 'digest' WHEN 2 THEN 'length' ELSE 'missing' END AS problem FROM (SELECT CAST({key} % 8 AS INTEGER) AS f FROM {table}) WHERE f < 4"


@query("a04_manifest", _faulty_sql("part", "p_partkey"), base=False)
def _(e: Evidence) -> DataFrame:
    return _faulty_manifest(e, "part", "p_partkey")


@query("a19_staged_load", "SELECT DISTINCT event_type AS kind, user_id AS external, CAST(round(value * 100) AS BIGINT) AS content FROM events", base=False)
def _(e: Evidence) -> DataFrame:
    base = scratch(e.spark, "staged")
    rows = e.table("events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("external"), F.round(F.col("value") * 100).cast("bigint").alias("content"), "event_id")
    for k in (0, 1):  # the second load finds more files, and rows that it has already
        rows.where(F.col("event_id") % 3 != k).drop("event_id").write.mode("append").parquet(f"{base}/in")
        st.staged_load(e.spark, f"{base}/in", rows.drop("event_id").schema, ["kind", "external", "content"], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return e.spark.read.parquet(f"{base}/out")


@query("a23_published_projection", "SELECT locality_id, count(*) AS n FROM catalog GROUP BY locality_id")
def _(e: Evidence) -> DataFrame:
    path = scratch(e.spark, "published")
    summary = e.catalog.groupBy("locality_id").agg(F.count("*").alias("n"))
    readers.publish({"summary": summary}, path, {"counts": summary.where("n < 1")})
    return readers.published(e.spark, path, "summary")


@query("m08_object_audit", _faulty_sql("orders", "o_orderkey"), base=False)
def _(e: Evidence) -> DataFrame:
    return _faulty_manifest(e, "orders", "o_orderkey")


@query("n01_revision_stream", "SELECT record, seq, CASE WHEN p IS NULL THEN 'inserted' WHEN p = content_hash THEN 'unchanged' ELSE 'updated' END AS change FROM (SELECT *, lag(content_hash) OVER (PARTITION BY record ORDER BY seq) AS p FROM revisions)")
def _(e: Evidence) -> DataFrame:
    base = scratch(e.spark, "stream")
    rows = e.revisions.select("record", "content_hash", "seq")
    top = rows.agg(F.max("seq").alias("m")).first()["m"] or 0
    for k in range(3):
        rows.where((F.col("seq") > top * k // 3 - (k == 0)) & (F.col("seq") <= top * (k + 1) // 3)).write.mode("append").parquet(f"{base}/in")
        st.track_revisions(e.spark, f"{base}/in", rows.schema, "record", "content_hash", "seq", base).awaitTermination()
    return e.spark.read.parquet(f"{base}/changes/*")
