"""Pages, top rows of groups, and orderings with nulls in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import written


def keyset_page(rows: DataFrame, key: list[str], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows after the given key and one more, which tells that there is another page."""
    if after is not None:
        rows = rows.where(F.struct(*key) > F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(key, after)]))
    return rows.orderBy(*key).limit(size + 1)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, each with its place (``place``) and the group's size (``group_total``).

    Sizes are aggregated before the rows are ranked, so only the ranking needs a group's rows in order.  Null is a group.
    """
    sizes = rows.groupBy(*[F.col(g).alias(f"_size_{g}") for g in group]).agg(F.count("*").alias("group_total"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most)
    same = F.lit(True)
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_size_{g}"))
    return ranked.join(sizes, same).select(*group, *[c for c in rows.columns if c not in group], "place", "group_total")


def first_per_group(rows: DataFrame, group: list[str], order: Column) -> DataFrame:
    """One row per group, the one with the least order (a struct that makes ties impossible)."""
    best = rows.groupBy(*group).agg(F.min_by(F.struct(*rows.columns), order).alias("_r"))
    return best.select("_r.*")


def interleaved(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """rows with ``turn``, the row's place within its kind: ordering by turn takes kinds in rotation.

    Rows lie in ranges of (kind, key); each range numbers its own rows, and what the ranges before it hold of a kind is added
    from their counts, a row for each range and kind.  No task sorts a whole kind.
    """
    part, place = "_range", "_place"
    ranged = written(rows.repartitionByRange(kind, key).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(kind, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(kind).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select(F.col(kind).alias("_kind"), F.col(part).alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    own = ranged.withColumn(place, F.row_number().over(Window.partitionBy(part, kind).orderBy(key)))
    found = own.join(offsets, F.col(kind).eqNullSafe(F.col("_kind")) & (F.col(part) == F.col("_part")))
    return found.withColumn("turn", (F.col("_before") + F.col(place)).cast("int")).select(*rows.columns, "turn")


def preview(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group with ``has_more``, which tells that others were left out."""
    return top_per_group(rows, group, order, most).withColumn("has_more", F.col("group_total") > most)
