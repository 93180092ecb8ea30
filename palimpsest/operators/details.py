"""Details of records: what belongs to a record, of several kinds, as sorted arrays of a bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def child(rows: DataFrame, key: str, fields: list[str], number: Column | None = None, text: Column | None = None) -> DataFrame:
    """Rows of one kind for ``nested``: (key, number, text, body), in order of number (nulls last), text and body.

    ``body`` is the named fields as strings; a field that is null is null there.
    """
    body = F.array(*[F.col(f).cast("string") for f in fields])
    return rows.select(F.col(key).alias("key"), (F.lit(None) if number is None else number).cast("double").alias("number"), (F.lit(None) if text is None else text).cast("string").alias("text"), body.alias("body"))


def nested(children: dict[str, DataFrame], most: int) -> DataFrame:
    """(key, and for each kind: an array of its first ``most`` bodies in order, its size, and whether there are more).

    All kinds are tagged and go through one shuffle by key and kind.  Rows beyond ``most`` are cut before anything is gathered,
    so a record with a long history takes no more memory than any other; sizes count all rows, and meet the first rows where
    these are gathered.
    """
    tagged = None
    for i, rows in enumerate(children.values()):
        own = rows.withColumn("kind", F.lit(i).cast("byte"))
        tagged = own if tagged is None else tagged.unionByName(own)
    order = [F.asc_nulls_last("number"), F.asc_nulls_last("text"), F.asc("body")]
    first = tagged.withColumn("place", F.row_number().over(Window.partitionBy("key", "kind").orderBy(*order))).where(F.col("place") <= most)
    sizes = tagged.groupBy("key", "kind").agg(F.count("*").alias("size"))
    both = first.select("key", "kind", "place", "body").unionByName(sizes, allowMissingColumns=True)
    out = []
    for i, kind in enumerate(children):
        own = F.col("kind") == i
        bodies = F.transform(F.array_sort(F.collect_list(F.when(own & F.col("place").isNotNull(), F.struct("place", "body")))), lambda x: x["body"])
        size = F.coalesce(F.max(F.when(own, F.col("size"))), F.lit(0))
        out += [bodies.alias(kind), size.alias(f"{kind}_total"), (size > most).alias(f"{kind}_has_more")]
    return both.groupBy("key").agg(*out)


def nested_alike(rows: DataFrame, key: str, children: dict[str, tuple[list[str], list[Column], bool]], most: int, own: list[Column]) -> DataFrame:
    """(key, own aggregates, and what ``nested`` gives for each kind), for kinds that are all taken from the same rows and a small ``most``.

    A kind is its fields, its order, and whether equal rows count once; the order must tell rows of different fields apart.
    Places come from windows over the key alone: rows are derived once, and those that lie together by key, as after a join on
    it, are shuffled no more.  Each place is an aggregate of its own, so a group is streamed in its order and never gathered.
    """
    out = list(own)
    for kind, (fields, order, distinct) in children.items():
        place = f"_{kind}"
        rows = rows.withColumn(place, (F.dense_rank() if distinct else F.row_number()).over(Window.partitionBy(key).orderBy(*order)))
        body = F.array(*[F.col(f).cast("string") for f in fields])
        first = F.array(*[F.first(F.when(F.col(place) == i + 1, body), ignorenulls=True) for i in range(most)])
        size = F.max(place).cast("bigint")
        out += [F.filter(first, lambda b: b.isNotNull()).alias(kind), size.alias(f"{kind}_total"), (size > most).alias(f"{kind}_has_more")]
    return rows.groupBy(key).agg(*out)


def listed(bodies: str) -> Column:
    """An array of bodies as one text: fields joined by colons (null: -), bodies by commas."""
    return F.array_join(F.transform(bodies, lambda b: F.array_join(b, ":", "-")), ",")
