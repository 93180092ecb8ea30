"""Snapshot ingestion: checks, quarantine, merges, revisions, currentness, and the audit of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.aggregates import content_mark

RUNS = "run string, digest string, read bigint, accepted bigint, failed bigint, inserted bigint, updated bigint, unchanged bigint, skipped bigint, status string"


def count_contract(envelopes: DataFrame) -> DataFrame:
    """Envelopes (file, found, returned, records, limit_all) that break the contract, with the reason."""
    reason = F.when(F.col("returned") != F.col("records"), "returned").when(F.col("found") < F.col("returned"), "found").when(F.col("limit_all") & (F.col("found") != F.col("returned")), "incomplete")
    return envelopes.withColumn("reason", reason).where("reason is not null")


def census(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(id, problem): missing, unexpected, or duplicate ids."""
    seen = observed.groupBy("id").agg(F.count("*").alias("n"))
    missing = expected.select("id").distinct().join(seen, "id", "left_anti").withColumn("problem", F.lit("missing"))
    extra = seen.join(expected.select("id").distinct(), "id", "left_anti").select("id", F.lit("unexpected").alias("problem"))
    return missing.unionByName(extra).unionByName(seen.where("n > 1").select("id", F.lit("duplicate").alias("problem")))


def in_scope(column: Column, wanted: str) -> Column:
    return F.coalesce(F.lower(F.trim(column)) == wanted.strip().lower(), F.lit(False))


def quarantine(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with reason)."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def run_report(bad: DataFrame, key: str, accepted: DataFrame, shown: int = 20) -> DataFrame:
    """One row: accepted, failed, status, and the first messages by key."""
    first = bad.orderBy(key).limit(shown).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "reason"))), lambda x: F.concat_ws(":", x[key].cast("string"), x["reason"])), ",").alias("messages"))
    counts = bad.agg(F.count("*").alias("failed")).crossJoin(accepted.agg(F.count("*").alias("accepted")))
    return counts.crossJoin(first).withColumn("status", F.when(F.col("failed") > 0, "partial").otherwise("success"))


def first_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """rows with ``repeat``: whether an earlier row has the key."""
    return rows.withColumn("repeat", F.row_number().over(Window.partitionBy(key).orderBy(position)) > 1)


def conflicts(rows: DataFrame, key: str, hashed: str) -> DataFrame:
    """Keys that come with different contents."""
    return rows.groupBy(key).agg(F.count_distinct(hashed).alias("versions")).where("versions > 1")


def merged_views(rows: DataFrame, key: str, common: list[str], context: str) -> DataFrame:
    """One row per key: whether the common columns agree, and the context values as a sorted array."""
    return rows.groupBy(key).agg((F.count_distinct(F.struct(*common)) > 1).alias("conflict"), F.array_sort(F.collect_set(context)).alias("views"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table after new rows replace old ones by key; columns in keep stay as they were."""
    o, n = old.select(F.col(key), F.struct(*old.columns).alias("o")), new.select(F.col(key), F.struct(*old.columns).alias("n"))
    pick = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, key, "full").select(*pick)


def insert_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those of new whose keys are not in it."""
    return old.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def classify(old: DataFrame, new: DataFrame, key: str, hashed: str) -> DataFrame:
    """(key, change): inserted, updated or unchanged by content hash."""
    before = old.select(F.col(key), F.col(hashed).alias("_before"), F.lit(True).alias("_known"))
    change = F.when(F.col("_known").isNull(), "inserted").when(F.col("_before").eqNullSafe(F.col(hashed)), "unchanged").otherwise("updated")
    return new.join(before, key, "left").select(key, change.alias("change"))


def changed_rows(old: DataFrame, new: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(key, action): insert, or update where a column that is not ignored differs; unchanged rows are left out."""
    o, n = old.select(key, F.struct(*old.columns).alias("o")), new.select(key, F.struct(*old.columns).alias("n"))
    differs = F.lit(False)
    for c in old.columns:
        if c != key and c not in ignore:
            differs |= ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return n.join(o, key, "left").select(key, F.when(F.col("o").isNull(), "insert").when(differs, "update").alias("action")).where("action is not null")


def retire(current: DataFrame, snapshot: DataFrame, key: str, complete: bool) -> DataFrame:
    """current with is_current false where the snapshot lacks the key; an incomplete run leaves every row as it is."""
    if not complete:
        return current if "is_current" in current.columns else current.withColumn("is_current", F.lit(True))
    return current.join(snapshot.select(F.col(key), F.lit(True).alias("_seen")).distinct(), key, "left").withColumn("is_current", F.col("_seen").isNotNull()).drop("_seen")


def revision_history(rows: DataFrame, key: str, hashed: str, at: str) -> DataFrame:
    """One row per key and content: when it was first and last seen."""
    return rows.groupBy(key, hashed).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def population_control(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Kinds whose count differs from the declared one."""
    n = rows.groupBy("kind").agg(F.count("*").alias("n"))
    return n.join(controls, "kind", "full").where(~F.col("n").eqNullSafe(F.col("declared"))).select("kind", "n", "declared")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The audit of all runs so far; empty before the first."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(RUNS).parquet(path) if there else spark.createDataFrame([], RUNS)


def audited_run(path: str, run: str, known: DataFrame, snapshot: DataFrame, key: str, hashed: str, reason: Column) -> DataFrame:
    """Appends what a run does to the table of runs below path, and returns the rows that it would publish.

    A snapshot whose digest a stored run with status success or partial already has is a replay: all its rows are skipped and
    nothing is published.  Else rows with a reason have failed, and the first of those that share a key and all later ones
    are told by hash: inserted, updated or unchanged against ``known``; repeats of one key beyond the first, by hash, are
    skipped.  Status: replayed, success, partial (some failed), failed (all did), empty.
    """
    spark = snapshot.sparkSession
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (key, hashed)])
    digest = snapshot.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(content_mark(text), F.lit("0"))).alias("digest")).first()["digest"]
    if not runs(spark, path).where((F.col("digest") == digest) & F.col("status").isin("success", "partial")).isEmpty():
        row = snapshot.agg(F.count("*").alias("read")).select(F.lit(run).alias("run"), F.lit(digest).alias("digest"), "read", *[F.lit(0).cast("bigint").alias(c) for c in ("accepted", "failed", "inserted", "updated", "unchanged")], F.col("read").alias("skipped"), F.lit("replayed").alias("status"))
        row.coalesce(1).write.mode("append").parquet(path)
        return snapshot.where("false")
    good, bad = quarantine(snapshot, reason)
    firsts = good.groupBy(key).agg(F.min_by(F.struct(*good.columns), hashed).alias("r"), F.count("*").alias("n"))
    rows, repeats = firsts.select("r.*"), firsts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("skipped"))
    count = lambda change: F.count(F.when(F.col("change") == change, 1)).alias(change)
    changes = classify(known, rows, key, hashed).agg(*map(count, ("inserted", "updated", "unchanged")))
    total = snapshot.agg(F.count("*").alias("read")).crossJoin(bad.agg(F.count("*").alias("failed"))).crossJoin(repeats).crossJoin(changes)  # one row each
    status = F.when(F.col("read") == 0, "empty").when(F.col("failed") == F.col("read"), "failed").when(F.col("failed") > 0, "partial").otherwise("success")
    total.select(F.lit(run).alias("run"), F.lit(digest).alias("digest"), "read", (F.col("inserted") + F.col("updated") + F.col("unchanged")).alias("accepted"), "failed", "inserted", "updated", "unchanged", "skipped", status.alias("status")).coalesce(1).write.mode("append").parquet(path)
    return rows
