"""Time interpretation: labels to intervals, effective bounds, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.normalize import plain_name, text_or_null

# What marks a label as qualified or as one of several.
#: Stages that are the parts of an epoch which has no units of its own for them.
STAGES = {"early": "Greenlandian", "middle": "Northgrippian", "late": "Meghalayan"}
AMBIGUOUS = r"\?|\bor\b|\band\b|mixed|uncertain|approx|\bcf\b|\baff\b|[/()]"


def finest(*fields: tuple[str, Column]) -> Column:
    """struct(field, label) of the first field that is not blank, finest first; later ones are never a fallback."""
    return F.coalesce(*[F.when(text_or_null(c).isNotNull(), F.struct(F.lit(n).alias("field"), text_or_null(c).alias("label"))) for n, c in fields])


def alias_table(units: DataFrame) -> DataFrame:
    """(alias, unit, older, younger) from units (name, older, younger): each name, "Epoch, modifier" for "Modifier Epoch", and
    both forms of the parts of the Holocene for the stages that they are."""
    plain = units.select(plain_name(F.col("name")).alias("alias"), F.col("name").alias("unit"), "older", "younger")
    turned = plain.withColumn("alias", F.regexp_replace("alias", r"^(early|middle|late) (.+)$", "$2, $1"))
    forms = F.create_map(*[x for part, stage in STAGES.items() for x in (F.lit(stage.lower()), F.array(F.lit(f"holocene, {part}"), F.lit(f"{part} holocene")))])
    parts = plain.where(F.col("alias").isin(*[s.lower() for s in STAGES.values()])).select(F.explode(forms[F.col("alias")]).alias("alias"), "unit", "older", "younger")
    return plain.unionByName(turned).unionByName(parts).distinct()


def interpret(rows: DataFrame, label: str, aliases: DataFrame) -> DataFrame:
    """rows with status (absent, ambiguous, mapped, unmapped), unit, unit_older, unit_younger; a label is looked up exactly."""
    looked = F.when(~F.rlike(F.lower(label), F.lit(AMBIGUOUS)), plain_name(F.col(label)))
    table = aliases.select(F.col("alias").alias("_a"), F.col("unit"), F.col("older").alias("unit_older"), F.col("younger").alias("unit_younger"))
    out = rows.withColumn("_l", looked).join(table, F.col("_l") == F.col("_a"), "left")
    status = F.when(text_or_null(F.col(label)).isNull(), "absent").when(F.col("_l").isNull(), "ambiguous").when(F.col("unit").isNotNull(), "mapped").otherwise("unmapped")
    return out.withColumn("status", status).drop("_l", "_a")


def effective(older: Column, younger: Column, unit_older: Column, unit_younger: Column) -> Column:
    """struct(older, younger, basis): complete numeric bounds, else the interpreted unit, else none."""
    none = F.lit(None).cast("int")
    return F.when(older.isNotNull() & younger.isNotNull(), F.struct(older.cast("int").alias("older"), younger.cast("int").alias("younger"), F.lit("numeric").alias("basis"))).when(unit_older.isNotNull(), F.struct(unit_older.cast("int").alias("older"), unit_younger.cast("int").alias("younger"), F.lit("unit").alias("basis"))).otherwise(F.struct(none.alias("older"), none.alias("younger"), F.lit("none").alias("basis")))


def provider_basis(older: Column, younger: Column) -> Column:
    return F.when(older.isNotNull() & younger.isNotNull(), "provider-envelope").when(older.isNotNull() | younger.isNotNull(), "provider-partial").otherwise("absent")


def disjoint(older_a: Column, younger_a: Column, older_b: Column, younger_b: Column) -> Column:
    """Whether two envelopes share nothing; null if any bound is."""
    return F.when(older_a.isNotNull() & younger_a.isNotNull() & older_b.isNotNull() & younger_b.isNotNull(), (older_a < younger_b) | (older_b < younger_a))
