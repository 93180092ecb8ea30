"""The shared context of all evidence reads: who is eligible, and which filters apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(rows: DataFrame, current: DataFrame, keys: list[str], policy: int | None = None) -> DataFrame:
    """Rows whose source record is current and not synthetic with the same content hash, under the active policy.

    ``current`` has the keys, is_current and is_synthetic; policy is compared with rows.policy_version.
    """
    if policy is not None:
        rows = rows.where(F.col("policy_version") == policy)
    return rows.join(current.where("is_current and not is_synthetic").select(*keys).distinct(), keys, "left_semi")


def eligible_normalized(rows: DataFrame, current: DataFrame, pointers: DataFrame, invalid: DataFrame, keys: list[str]) -> DataFrame:
    """As eligible, and only with a current normalization and without an invalid proof."""
    return eligible(rows, current, keys).join(pointers, ["record", "normalization_hash"], "left_semi").join(invalid, ["record"], "left_anti")


def overlaps(older: float, younger: float, older_col: str = "older", younger_col: str = "younger") -> Column:
    """Inclusive closed overlap of known intervals: a null end never matches."""
    return (F.col(older_col) >= F.lit(younger)) & (F.col(younger_col) <= F.lit(older))


def inside_box(west: float, south: float, east: float, north: float) -> Column:
    """Points in the box, edges included, across the antimeridian where west > east; withheld points never."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return ~F.col("withheld") & lon & F.col("lat").between(south, north)


def text_matches(query: str, document: Column, label: Column) -> Column:
    """From three characters on: all words of the query begin words of the document, or the query is a part of it.

    Shorter queries must begin the label.  No character of the query is a wildcard.
    """
    q = query.strip().lower()
    if len(q) < 3:
        return F.startswith(F.lower(label), F.lit(q))
    words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in q).split()]
    tokens = F.split(F.lower(document), r"[^\p{L}\p{N}_]+")
    prefixed = F.lit(bool(words))
    for w in map(F.lit, words):
        prefixed &= F.size(F.filter(tokens, _begins(w))) > 0
    return prefixed | F.contains(F.lower(document), F.lit(q))


def _begins(prefix: Column):
    return lambda t: F.startswith(t, prefix)


@dataclass(frozen=True)
class Context:
    """Filters that conjoin: one that conflicts with another leaves nothing, it never replaces it."""

    source: str = "all"
    locality: str | None = None
    collection: str | None = None
    institution: str | None = None
    node: str | None = None
    term: str | None = None
    interval: tuple[float, float] | None = None
    point: tuple[float, float] | None = None
    box: tuple[float, float, float, float] | None = None

    def apply(self, rows: DataFrame, closure: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
        """rows with every set filter applied; node needs closure (taxon_id, node), term needs terms (record_id, term)."""
        if self.source != "all":
            rows = rows.where(F.col("source") == self.source)
        for column, value in (("locality_id", self.locality), ("collection", self.collection), ("institution", self.institution)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        if self.interval is not None:
            rows = rows.where(overlaps(*self.interval))
        if self.point is not None:
            rows = rows.where((F.col("lon") == self.point[0]) & (F.col("lat") == self.point[1]) & ~F.col("withheld"))
        if self.box is not None:
            rows = rows.where(inside_box(*self.box))
        if self.node is not None:
            rows = rows.join(closure.where(F.col("node") == self.node).select("taxon_id"), "taxon_id", "left_semi")
        if self.term is not None:
            rows = rows.join(terms.where(F.col("term") == self.term).select("record_id"), "record_id", "left_semi")
        return rows
