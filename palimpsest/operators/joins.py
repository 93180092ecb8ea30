"""Joins that recur: rules per combination, shared attributes, key mappings, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import written


def per_combination(rows: DataFrame, columns: list[str], rule: Column, name: str) -> DataFrame:
    """rows with ``name``, the rule evaluated once for each distinct combination of the columns (nulls match nulls)."""
    ruled = rows.select(*columns).distinct().select(*[F.col(c).alias(f"_{c}") for c in columns], rule.alias(name))
    on = F.lit(True)
    for c in columns:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(ruled, on, "left").drop(*[f"_{c}" for c in columns])


def offers(pairs: DataFrame, key: str, attribute: str, most: int, bounds: DataFrame | None = None) -> DataFrame:
    """Distinct (key, related): the first ``most + 1`` keys of each value of the attribute, offered to all others that have it.

    bounds: (key, _bound), beyond which a key takes no offer; a key without a bound takes all.
    """
    offered = pairs.withColumn("_p", F.row_number().over(Window.partitionBy(attribute).orderBy(key))).where(F.col("_p") <= most + 1).select(attribute, F.col(key).alias("related"))
    fits = F.col(key) != F.col("related")
    if bounds is not None:
        pairs = pairs.join(small(bounds), key, "left")
        fits &= F.col("_bound").isNull() | (F.col("related") <= F.col("_bound"))
    return pairs.join(offered, attribute).where(fits).select(key, "related").distinct()


def first_sharing(rows: DataFrame, key: str, attribute: str, most: int) -> DataFrame:
    """(key, related, place): for each key the first ``most`` other keys, by id, that share a value of the attribute.

    A key among a key's first ones is among the first ``most + 1`` of the value that they share, so each value offers that
    many at most: n keys that share a value give (most + 1) * n pairs, not n * n.  Few of these are kept either: one value in
    ``BOUND_BY`` gives each key ``most`` others, and whatever comes after the last of these can't be among its first.
    """
    pairs = written(rows.select(key, attribute).where(F.col(attribute).isNotNull()).distinct(), "pairs")
    ranked = lambda shared: shared.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("related"))).where(F.col("place") <= most)
    bounds = ranked(offers(pairs.where(F.pmod(F.xxhash64(attribute), F.lit(BOUND_BY)) == 0), key, attribute, most)).where(F.col("place") == most)
    return ranked(offers(pairs, key, attribute, most, written(bounds.select(key, F.col("related").alias("_bound")), "bounds")))


#: Fixed limits: pairs of one task, rows that are broadcast once they are counted, and rows of one task; one value in so many gives the bounds.
PAIRS_A_TASK, BROADCAST_ROWS, ROWS_A_TASK, BOUND_BY = 1_000_000, 1_000_000, 250_000, 16


def tasks_for(rows: DataFrame) -> int:
    """How many tasks the rows take.  Narrow rows shrink so well that a partition of the usual bytes would hold millions of them."""
    return max(1, -(-rows.count() // ROWS_A_TASK))


def small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if their count allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def dealt_join(asking: DataFrame, known: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """asking joined to known, however many rows share a key: the pairs of one value of ``by`` lie in one task.

    Pairs are counted by key first, and the rows that ask dealt out by ``by`` to as many tasks as these take; grouping or
    comparing the pairs by it shuffles nothing.
    """
    per = lambda rows, name: rows.groupBy(*on).agg(F.count("*").alias(name))
    sizes = per(asking, "_a").join(per(known, "_b"), on).agg(F.sum(F.col("_a") * F.col("_b")).alias("pairs"), F.sum("_b").alias("met")).first()
    if (sizes.pairs or 0) > PAIRS_A_TASK:
        if sizes.met <= BROADCAST_ROWS:
            known = F.broadcast(known.join(asking.select(*on).distinct(), on, "left_semi"))
        asking = asking.repartition(-(-sizes.pairs // PAIRS_A_TASK), by)
    return asking.join(known, on, how)


def map_keys(rows: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """rows with ``mapped``, the published key of theirs, and ``dangling`` where mapping (key, mapped) has none."""
    known = mapping.select(F.col("key").alias("_key"), "mapped", F.lit(False).alias("_known"))
    return rows.join(known, F.col(key) == F.col("_key"), "left").withColumn("dangling", F.col("_known").isNull()).drop("_key", "_known")


def differences(requested: DataFrame, received: DataFrame) -> DataFrame:
    """Ids asked for and not received (missing), and received though not asked for (surplus)."""
    a, b = requested.select("id").distinct(), received.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("surplus")))
