"""The given tables seen as evidence: material records, occurrence records, their catalogue and the classification."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.hierarchy import prefix_paths

REFERENCE_DAY = "2025-01-01"
RANKS = ("kingdom", "family", "genus", "species")


def days_before(column: str) -> Column:
    return F.datediff(F.lit(REFERENCE_DAY).cast("date"), F.col(column).cast("date"))


def hundredths(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint").cast("string")


class Evidence:
    """Lazily read tables of one folder, and the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str, interval: tuple[float, float] | None = None):
        self.spark, self.sf_dir, self.interval = spark, sf_dir, interval

    def within(self, older: float, younger: float) -> Evidence:
        """The same evidence for readers of one interval: days outside it are left out by the scans already.

        Only what can't overlap goes; the overlap filter itself still applies.
        """
        return Evidence(self.spark, self.sf_dir, (older, younger))

    def _dated(self, rows: DataFrame, begins: str | None, ends: str | None) -> DataFrame:
        """rows whose first day isn't after the interval and whose last day isn't before it, by bare columns, so that Parquet can skip."""
        if self.interval is not None:
            older, younger = self.interval
            day = date.fromisoformat(REFERENCE_DAY)
            if begins:
                rows = rows.where(F.col(begins) < F.lit(day - timedelta(days=math.ceil(younger) - 1)))
            if ends:
                rows = rows.where(F.col(ends) >= F.lit(day - timedelta(days=math.floor(older))))
        return rows

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def material(self) -> DataFrame:
        """One specimen record per line item; orders are joined last, so that what is grouped by specimen lies together already."""
        return self._material(lambda rows, _: rows)

    def material_in(self, tasks: int) -> DataFrame:
        """The same, lying by specimen in so many tasks."""
        return self._material(lambda rows, specimen: rows.repartition(tasks, specimen))

    def _material(self, deal: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        lines = (
            self._dated(self.table("lineitem"), None, "l_shipdate").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        )
        rows = deal(lines, "l_orderkey").join(deal(self._dated(self.table("orders"), "o_orderdate", None), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], *map(hundredths, ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")))
        return rows.select(
            key.alias("record_id"), F.col("l_orderkey").alias("specimen_id"), F.col("l_partkey").alias("taxon_id"), F.concat(F.lit("s"), "l_suppkey").alias("locality_id"), F.col("o_orderpriority").alias("collection"), F.col("o_orderstatus").alias("institution"),
            "l_returnflag", "l_linestatus", "p_type", "p_brand", "p_name", F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), days_before("o_orderdate").alias("older"),
            F.when(F.col("l_shipdate") >= F.col("o_orderdate"), days_before("l_shipdate")).alias("younger"), ((F.col("s_nationkey") * 37) % 360 - 180).alias("lon"), ((F.col("s_nationkey") * 13) % 181 - 90).alias("lat"),
            (F.col("s_acctbal") < 0).alias("withheld"), (F.col("s_suppkey") % 7 == 0).alias("generalized"), F.col("p_name").alias("label"),
        )

    @cached_property
    def occurrence(self) -> DataFrame:
        """One published occurrence per event; never a specimen, sometimes no locality."""
        taxon = F.get_json_object("props", "$.k").cast("bigint")
        rows = self._dated(self.table("events"), "ts", "ts").withColumn("taxon_id", taxon).join(self.table("customer"), F.col("user_id") == F.col("c_custkey"), "left").join(self.table("part").select(F.col("p_partkey").alias("taxon_id"), "p_name"), "taxon_id", "left")
        return rows.select(
            F.md5(F.concat(F.lit("b|"), F.col("event_id").cast("string"))).alias("record_id"), "taxon_id", F.when(F.col("c_custkey").isNotNull(), F.concat(F.lit("c"), "user_id")).alias("locality_id"), F.col("event_type").alias("collection"),
            days_before("ts").alias("older"), days_before("ts").alias("younger"), ((F.col("c_nationkey") * 37) % 360 - 180).alias("lon"), ((F.col("c_nationkey") * 13) % 181 - 90).alias("lat"), (F.col("c_acctbal") < 0).alias("withheld"), F.col("p_name").alias("label"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        """Both sources, disjoint; specimens and institutions only in the first."""
        a = self.material.select(F.lit("a").alias("source"), "record_id", "specimen_id", "taxon_id", "locality_id", "collection", "institution", "older", "younger", "lon", "lat", "withheld", "label")
        b = self.occurrence.select(F.lit("b").alias("source"), "record_id", F.lit(None).cast("bigint").alias("specimen_id"), "taxon_id", "locality_id", "collection", F.lit(None).cast("string").alias("institution"), "older", "younger", "lon", "lat", "withheld", "label")
        return a.unionByName(b)

    @cached_property
    def closure(self) -> DataFrame:
        """(taxon_id, node, rank, name, depth): each part under itself and its supplied ancestors."""
        parts = self.table("part").withColumn("species", F.col("p_partkey").cast("string"))
        return prefix_paths(parts, F.col("p_partkey"), list(zip(RANKS, ("p_type", "p_brand", "p_name", "species")))).withColumnRenamed("leaf", "taxon_id")

    @cached_property
    def versions(self) -> DataFrame:
        """Events as versions of their user's record: (record, content_hash, seq, seen_at, event_type)."""
        content = F.md5(F.concat_ws("|", "event_type", hundredths("value")))
        return self.table("events").select(F.col("user_id").alias("record"), content.alias("content_hash"), F.col("event_id").alias("seq"), F.col("ts").alias("seen_at"), "event_type")

    @cached_property
    def revisions(self) -> DataFrame:
        """Events as revisions of their user's record: (record, content_hash, seen_at, seq), and whether it is the latest."""
        order = F.struct("ts", "event_id")
        rows = self.table("events").withColumn("content_hash", F.md5(F.concat_ws("|", "event_type", hundredths("value"))))
        last = rows.groupBy("user_id").agg(F.max(order).alias("_last"))
        return rows.join(last, "user_id").select(F.col("user_id").alias("record"), "content_hash", F.col("event_id").alias("seq"), F.col("ts").alias("seen_at"), "event_type", (order == F.col("_last")).alias("is_current"))


_DAY = f"DATE '{REFERENCE_DAY}'"
MATERIAL_SQL = f"""material AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity*100) AS BIGINT), CAST(round(l_extendedprice*100) AS BIGINT), CAST(round(l_discount*100) AS BIGINT), CAST(round(l_tax*100) AS BIGINT), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS record_id,
    l_orderkey AS specimen_id, l_partkey AS taxon_id, 's' || l_suppkey AS locality_id, o_orderpriority AS collection, o_orderstatus AS institution, l_returnflag, l_linestatus, p_type, p_brand, p_name, s_nationkey AS nation, n_regionkey AS region,
    date_diff('day', CAST(o_orderdate AS DATE), {_DAY}) AS older, CASE WHEN l_shipdate >= o_orderdate THEN date_diff('day', CAST(l_shipdate AS DATE), {_DAY}) END AS younger,
    (s_nationkey*37)%360-180 AS lon, (s_nationkey*13)%181-90 AS lat, s_acctbal < 0 AS withheld, s_suppkey%7=0 AS generalized, p_name AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
OCCURRENCE_SQL = f"""occurrence AS (
  SELECT md5('b|' || event_id) AS record_id, k AS taxon_id, CASE WHEN c_custkey IS NOT NULL THEN 'c' || user_id END AS locality_id, event_type AS collection, date_diff('day', CAST(ts AS DATE), {_DAY}) AS older, date_diff('day', CAST(ts AS DATE), {_DAY}) AS younger,
    (c_nationkey*37)%360-180 AS lon, (c_nationkey*13)%181-90 AS lat, c_acctbal < 0 AS withheld, p_name AS label
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) LEFT JOIN customer ON user_id = c_custkey LEFT JOIN part ON k = p_partkey)"""
CATALOG_SQL = """catalog AS (
  SELECT 'a' AS source, record_id, specimen_id, taxon_id, locality_id, collection, institution, older, younger, lon, lat, withheld, label FROM material
  UNION ALL SELECT 'b', record_id, NULL, taxon_id, locality_id, collection, NULL, older, younger, lon, lat, withheld, label FROM occurrence)"""
CLOSURE_SQL = """closure AS (
  SELECT p_partkey AS taxon_id, md5(concat_ws('|', 'kingdom', p_type)) AS node, 'kingdom' AS rank, p_type AS name, 3 AS depth FROM part
  UNION ALL SELECT p_partkey, md5(concat_ws('|', 'family', p_type, p_brand)), 'family', p_brand, 2 FROM part
  UNION ALL SELECT p_partkey, md5(concat_ws('|', 'genus', p_type, p_brand, p_name)), 'genus', p_name, 1 FROM part
  UNION ALL SELECT p_partkey, md5(concat_ws('|', 'species', p_type, p_brand, p_name, p_partkey)), 'species', CAST(p_partkey AS VARCHAR), 0 FROM part)"""
REVISIONS_SQL = """revisions AS (
  SELECT user_id AS record, md5(concat_ws('|', event_type, CAST(round(value*100) AS BIGINT))) AS content_hash, event_id AS seq, ts AS seen_at, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_current FROM events)"""
BASE_SQL = f"WITH RECURSIVE {MATERIAL_SQL},\n{OCCURRENCE_SQL},\n{CATALOG_SQL},\n{CLOSURE_SQL},\n{REVISIONS_SQL}\n"
COUNTS_SQL = """count(*) AS assertions, count(DISTINCT specimen_id) AS specimens, count(DISTINCT taxon_id) AS taxa, max(CASE WHEN younger IS NOT NULL THEN older END) AS older_bound, min(CASE WHEN older IS NOT NULL THEN younger END) AS younger_bound,
  count(CASE WHEN older IS NOT NULL AND younger IS NOT NULL THEN 1 END) AS known, count(CASE WHEN older IS NULL OR younger IS NULL THEN 1 END) AS unknown"""
