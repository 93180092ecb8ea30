"""Column functions that normalize what providers send."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The qualifiers of an uncertain identification, and texts that say nothing.
QUALIFIERS = ("cf", "aff", "sp", "spp", "indet", "uncertain")
MEANINGLESS = ("default", "none", "unspecified", "unknown", "not supplied", "n/a")


def text_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def finite_number(c: Column) -> Column:
    """A double, or null for what is none or not finite."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def strict_decimal(c: Column) -> Column:
    """struct(value decimal(38,10), invalid): blank is null, booleans and other text are invalid."""
    plain = text_or_null(c)
    value = F.when(F.rlike(plain, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), plain.try_cast("decimal(38,10)"))
    return F.struct(value.alias("value"), (plain.isNotNull() & value.isNull()).alias("invalid"))


def typed_id(c: Column, *prefixes: str) -> Column:
    """The positive number of an id ``prefix:digits`` with one of the prefixes and no leading zero, else null."""
    return F.nullif(F.regexp_extract(c, rf"^(?:{'|'.join(prefixes)}):([1-9]\d*)$", 1), F.lit("")).cast("bigint")


def optional_id(c: Column, *prefixes: str) -> Column:
    """struct(value, invalid): null, blank and 0 are null; anything else must be a typed id."""
    none = c.isNull() | c.isin("", "0")
    return F.struct(typed_id(c, *prefixes).alias("value"), (~none & typed_id(c, *prefixes).isNull()).alias("invalid"))


def position_status(withheld: Column, lon: Column, lat: Column, datum: Column) -> Column:
    """withheld, missing, out-of-range, unsupported-datum or published; only the last keeps its coordinates."""
    return F.when(withheld, "withheld").when(lon.isNull() | lat.isNull(), "missing").when(~(lon.between(-180, 180) & lat.between(-90, 90)), "out-of-range").when(~F.coalesce(datum.isin("WGS84", "EPSG:4326"), F.lit(False)), "unsupported-datum").otherwise("published")


def unverified_position(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNull() | lat.isNull(), "missing").when(~(lon.between(-180, 180) & lat.between(-90, 90)), "out-of-range").otherwise("datum-unverified")


def warnings(*pairs: tuple[Column, str]) -> Column:
    """The messages whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in pairs]), lambda x: x.isNotNull())


def zoned_timestamp(c: Column) -> Column:
    """struct(value, verbatim_only): converted only where a zone is given; else the text alone stands."""
    zoned = F.rlike(c, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    return F.struct(F.when(zoned, F.try_to_timestamp(c)).alias("value"), (c.isNotNull() & ~zoned).alias("verbatim_only"))


def some_keys(m: Column, keys: list[str]) -> Column:
    """The entries of a map with one of the keys and a value that is not blank."""
    return F.map_filter(m, lambda k, v: k.isin(*keys) & (F.trim(F.coalesce(v, F.lit(""))) != ""))


def content_hash(*columns: Column) -> Column:
    """SHA-256 over the columns in the order given; null and blank differ."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256)


def uuid_shape(hexed: Column) -> Column:
    """32 hex digits as a version 4 id: the digits of version and variant overwritten, dashes set."""
    marked = F.overlay(F.overlay(F.substring(hexed, 1, 32), F.lit("4"), F.lit(13)), F.lit("8"), F.lit(17))
    return F.concat_ws("-", *[F.substring(marked, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def stable_id(dataset: Column, kind: Column, key: Column) -> Column:
    """An id that depends on dataset, kind and key alone."""
    return uuid_shape(F.sha2(F.concat_ws("\u0001", dataset, kind, key), 256))


def text_id(text: Column) -> Column:
    return uuid_shape(F.md5(text))


def path_id(names: Column, isolation: Column) -> Column:
    """The id of a path of names, kept apart by the isolation token."""
    return uuid_shape(F.sha1(F.concat_ws("\u0001", names, isolation)))


def plain_name(c: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def is_qualified(c: Column) -> Column:
    return F.rlike(F.lower(c), F.lit(rf"(\b({'|'.join(QUALIFIERS)})\b|\?)"))


def inferred_rank(name: Column, ranks: list[tuple[str, Column]]) -> Column:
    """The rank whose column holds the name, the first of several; null if none does."""
    out = F.lit(None).cast("string")
    for rank, c in reversed(ranks):
        out = F.when(plain_name(c) == plain_name(name), rank).otherwise(out)
    return out


def qualified_name(name: Column, qualifier: Column) -> Column:
    q = text_or_null(qualifier)
    return F.when(q.isNull(), name).otherwise(F.concat(name, F.lit(" ("), q, F.lit(")")))


def search_text(*columns: Column) -> Column:
    """Lower case of the columns, then the same without anything but letters and digits."""
    joined = F.lower(F.concat_ws(" ", *columns))
    return F.concat(joined, F.lit(" "), F.regexp_replace(joined, r"[^\p{L}\p{N}]", ""))


def public_place(description: Column, withheld: Column) -> Column:
    """struct(country, state, county) of a JSON text; county hidden where withheld; malformed JSON gives nulls."""
    j = F.from_json(description, "country string, state string, county string")
    return F.struct(j["country"].alias("country"), j["state"].alias("state"), F.when(~withheld, j["county"]).alias("county"))


def author(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(" ", *map(text_or_null, parts)), F.lit(""))


def envelope_problems(older: Column, younger: Column) -> Column:
    """What is wrong with provider bounds: negative, or in the wrong order."""
    return warnings((older < 0, "negative-older"), (younger < 0, "negative-younger"), (older < younger, "reversed"))


def is_meaningful(c: Column) -> Column:
    """Whether a text says something: not blank, and none of MEANINGLESS, alone or with a number after a dash."""
    t = F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.coalesce((t != "") & ~F.rlike(t, F.lit(rf"^({'|'.join(MEANINGLESS)})(\s*-\s*\d+)?$")), F.lit(False))


def or_placeholder(c: Column, placeholder: str = "not supplied") -> Column:
    return F.coalesce(text_or_null(c), F.lit(placeholder))


def folded_names(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with ``name``: the column in compatibility form (NFKC), white space collapsed, case folded; null stays null.

    Neither form is a built-in function, so a vectorized one sees each distinct name once, and the result is joined back.
    """

    @F.pandas_udf("string")
    def folded(names: pd.Series) -> pd.Series:
        return names.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold())

    known = rows.select(F.col(column).alias("_given")).where("_given is not null").distinct().select("_given", folded("_given").alias(name))
    return rows.join(known, F.col(column) == F.col("_given"), "left").drop("_given")


# records of one provider: each a struct with its typed id, its fields, and whether any part of it is invalid


def _record(required: list[Column], optional: dict[str, tuple[Column, tuple[str, ...]]], invalid: Column | None = None, **fields: Column) -> Column:
    """required: the record's own id, then ids that it can't do without; optional: name to (text, prefixes)."""
    given = {n: optional_id(c, *prefixes) for n, (c, prefixes) in optional.items()}
    bad = F.lit(False) if invalid is None else invalid
    for c in required:
        bad = bad | c.isNull()
    for c in given.values():
        bad = bad | c["invalid"]
    return F.struct(required[0].alias("id"), *[c["value"].alias(n) for n, c in given.items()], *[c.alias(n) for n, c in fields.items()], bad.alias("invalid"))


def taxon_name_record(number: Column, original: Column, accepted: Column, parent: Column, name: Column, rank: Column, reference: Column) -> Column:
    taxon = ("txn", "var")
    return _record([typed_id(number, *taxon)], {"original": (original, taxon), "accepted": (accepted, taxon), "parent": (parent, taxon), "reference": (reference, ("ref",))}, name=name, rank=rank)


def material_record(number: Column, occurrence: Column, collection: Column, reidentification: Column, label: Column, reference: Column) -> Column:
    found = typed_id(occurrence, "occ")
    return _record([typed_id(number, "spm"), found], {"collection": (collection, ("col",)), "reidentification": (reidentification, ("rei",)), "reference": (reference, ("ref",))}, occurrence=found, label=label)


def measurement_record(number: Column, specimen: Column, kind: Column, values: dict[str, Column], unit: Column) -> Column:
    """``values`` is a map of decimals by name, null where nothing is given; ``faults`` names those that are no numbers."""
    found, numbers = typed_id(specimen, "spm"), {n: strict_decimal(c) for n, c in values.items()}
    faults = F.filter(F.array(*[F.when(d["invalid"], F.lit(n)) for n, d in numbers.items()]), lambda x: x.isNotNull())
    entries = F.create_map(*[x for n, d in numbers.items() for x in (F.lit(n), d["value"])])
    return _record([typed_id(number, "mea"), found], {}, F.size(faults) > 0, specimen=found, kind=kind, values=entries, faults=faults, unit=unit)


def opinion_record(number: Column, child: Column, original: Column, parent: Column, status: Column, reference: Column) -> Column:
    taxon = ("txn", "var")
    return _record([typed_id(number, "opn")], {"child": (child, taxon), "original": (original, taxon), "parent": (parent, taxon), "reference": (reference, ("ref",))}, status=status)


def reference_record(number: Column, title: Column, doi: Column, year: Column, raw: dict[str, Column]) -> Column:
    """``authors`` are the raw fields whose names begin with ``author``; a blank year is null."""
    authors = F.create_map(*[x for n, c in raw.items() if n.startswith("author") for x in (F.lit(n), c)])
    return _record([typed_id(number, "ref")], {}, title=title, doi=doi, year=text_or_null(year), authors=authors)
