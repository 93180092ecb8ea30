"""Projections and their freshness, proofs and their validity, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def projected_or_live(projected: DataFrame, live: DataFrame, stored: DataFrame, now: DataFrame) -> DataFrame:
    """The projection while its inputs' fingerprint is the stored one, else the live derivation: the answer is the same."""
    return projected if stored.exceptAll(now).isEmpty() and now.exceptAll(stored).isEmpty() else live


def invalid_owners(frames: DataFrame, records: DataFrame) -> DataFrame:
    """Owners whose own record or a member of whose frame is not current, has another hash, or is synthetic.

    frames: (owner, member, content_hash) with the owner among its members; records: (record, content_hash, is_current,
    is_synthetic), one row a record.
    """
    state = records.select(F.col("record").alias("member"), F.col("content_hash").alias("_now"), (F.col("is_current") & ~F.col("is_synthetic")).alias("_good"))
    bad = ~(F.coalesce("_good", F.lit(False)) & F.col("content_hash").eqNullSafe(F.col("_now")))
    return frames.join(state, "member", "left").where(bad).select("owner").distinct()


def affected_owners(frames: DataFrame, changed: DataFrame) -> DataFrame:
    """Owners whose frame holds a changed record."""
    return frames.join(changed.select(F.col("record").alias("member")), "member", "left_semi").select("owner").distinct()


def freshness(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(projection, stale): whether a projection's stored fingerprint is that of its inputs; one that has none is stale."""
    return now.withColumnRenamed("fingerprint", "_now").join(stored, "projection", "left").select("projection", (~F.col("fingerprint").eqNullSafe(F.col("_now"))).alias("stale"))


def hash_audit(rows: DataFrame, stored: str, recomputed) -> DataFrame:
    """One row: rows, rows with a hash, and rows whose hash is not the recomputed one."""
    return rows.agg(F.count("*").alias("total"), F.count(stored).alias("covered"), F.count(F.when(~F.col(stored).eqNullSafe(recomputed), 1)).alias("mismatches"))


def proof_check(graph: DataFrame, proofs: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Keys whose fields are not those of their proof, or that have none."""
    p = proofs.select(*key, F.struct(*fields).alias("_p"), F.lit(True).alias("_has"))
    same = F.lit(True)
    for f in fields:
        same &= F.col(f).eqNullSafe(F.col(f"_p.{f}"))
    return graph.join(p, key, "left").where(F.col("_has").isNull() | ~same).select(*key)


def unpublished(edges: DataFrame, mapped: DataFrame) -> DataFrame:
    """(unmapped_ends, missing_edges) of edges (source, target) against mapped keys (key)."""
    has = lambda side: edges.join(mapped.select(F.col("key").alias(side)), side, "left_anti")
    ends = has("source").select(F.col("source").alias("k")).union(has("target").select(F.col("target").alias("k"))).distinct()
    lost = has("source").unionByName(has("target")).distinct()
    return ends.agg(F.count("*").alias("unmapped_ends")).crossJoin(lost.agg(F.count("*").alias("missing_edges")))
