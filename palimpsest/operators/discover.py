"""Discovery reads: ranked search over kinds of entities, references, viewports, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.scratch import written


def search_rank(query: str, label: Column, key: Column, kind: Column) -> Column:
    """0 for the exact label, its letters and digits, or the exact key; 3 for other records; 1 for a prefix; else 2."""
    q, compact = query.strip().lower(), "".join(c for c in query.lower() if c.isalnum())
    low = F.lower(label)
    exact = (low == q) | (F.regexp_replace(low, r"[^\p{L}\p{N}]", "") == compact) | (F.lower(key) == q)
    return F.when(exact, 0).when(kind == "record", 3).when(F.startswith(low, F.lit(q)), 1).otherwise(2)


def search(entities: DataFrame, query: str) -> DataFrame:
    """entities (kind, id, label, key) that hold the query in label or key, with ``rank``; the order is rank, kind, id."""
    q = query.strip().lower()
    found = entities.where(F.contains(F.lower("label"), F.lit(q)) | (F.lower("key") == q)).distinct()
    return found.withColumn("rank", search_rank(query, F.col("label"), F.col("key"), F.col("kind")))


def search_through(names: DataFrame, members: DataFrame, taxa: DataFrame, query: str) -> DataFrame:
    """(kind, id, label, rank) of all that the query finds among names (kind, id, label, key); nodes stand for the taxa below them.

    One scan over the names finds the hits; those of kind ``node`` are carried down members (node, taxon_id), and a taxon takes
    the best rank of the nodes above it, its own among them.  taxa: (taxon_id, taxon), their labels.
    """
    hits = written(search(names, query), "hits")
    below = hits.where("kind = 'node'").select(F.col("id").alias("node"), "rank").join(members, "node").groupBy("taxon_id").agg(F.min("rank").alias("rank"))
    found = below.join(taxa, "taxon_id").select(F.lit("taxon").alias("kind"), F.col("taxon_id").cast("string").alias("id"), F.col("taxon").alias("label"), "rank")
    return hits.where("kind != 'node'").select("kind", "id", "label", "rank").unionByName(found)


def mentioned_id(text: Column, prefixes: tuple[str, ...]) -> Column:
    """The id of a record named in free text (``occ 123``, ``col:5``), else null."""
    return F.nullif(F.regexp_extract(F.lower(text), rf"\b(?:{'|'.join(prefixes)})[ :/_-]*(\d+)\b", 1), F.lit("")).cast("bigint")


def grid(rows: DataFrame, cell: float) -> DataFrame:
    """Records per square of ``cell`` degrees."""
    return rows.groupBy(F.floor(F.col("lon") / cell).alias("x"), F.floor(F.col("lat") / cell).alias("y")).agg(F.count("*").alias("records"))


def buffered(viewports: DataFrame, share: float = 0.25) -> DataFrame:
    """viewports (id, west, south, east, north) with outer edges: each side moved out by ``share`` of its extent.

    Longitudes wrap, latitudes stop at the poles, and a viewport that would pass round the globe takes all of it.
    """
    width = F.when(F.col("east") >= F.col("west"), F.col("east") - F.col("west")).otherwise(F.col("east") - F.col("west") + 360)
    wrap = lambda x: F.pmod(x + 180, F.lit(360)) - 180
    round_all = width * (1 + 2 * share) >= 360
    height = F.col("north") - F.col("south")
    return (
        viewports.withColumn("outer_west", F.when(round_all, -180.0).otherwise(wrap(F.col("west") - width * share))).withColumn("outer_east", F.when(round_all, 180.0).otherwise(wrap(F.col("east") + width * share)))
        .withColumn("outer_south", F.greatest(F.lit(-90.0), F.col("south") - height * share)).withColumn("outer_north", F.least(F.lit(90.0), F.col("north") + height * share))
    )


def _cells(low: Column, high: Column, step: float, offset: float) -> Column:
    """The numbers of the cells of ``step`` degrees that a stretch touches."""
    return F.sequence(F.floor((low + offset) / step), F.floor((high + offset) / step))


def in_viewports(points: DataFrame, viewports: DataFrame, cell: float = 10.0) -> DataFrame:
    """Per viewport the records inside it and inside its outer edges.

    Points are first summed by coordinate; both sides are laid on a grid of ``cell`` degrees, viewports in all cells that their
    outer edges touch (past the antimeridian in two stretches), and meet by cell.  The exact test follows.
    """
    at = points.where("not withheld and lon is not null and lat is not null").groupBy("lon", "lat").agg(F.count("*").alias("n"))
    within = lambda w, s, e, n: F.col("lat").between(F.col(s), F.col(n)) & F.when(F.col(w) <= F.col(e), F.col("lon").between(F.col(w), F.col(e))).otherwise((F.col("lon") >= F.col(w)) | (F.col("lon") <= F.col(e)))
    outer, inner = within("outer_west", "outer_south", "outer_east", "outer_north"), within("west", "south", "east", "north")
    views = buffered(viewports)
    west, east = F.col("outer_west").cast("double"), F.col("outer_east").cast("double")
    across = F.when(west <= east, _cells(west, east, cell, 180)).otherwise(F.array_union(_cells(west, F.lit(180.0), cell, 180), _cells(F.lit(-180.0), east, cell, 180)))
    views = views.withColumn("_x", F.explode(across)).withColumn("_y", F.explode(_cells(F.col("outer_south").cast("double"), F.col("outer_north").cast("double"), cell, 90)))
    at = at.withColumns({"_x": F.floor((F.col("lon") + 180) / cell), "_y": F.floor((F.col("lat") + 90) / cell)})
    pairs = at.join(views, ["_x", "_y"]).where(outer)
    return pairs.groupBy("id").agg(F.sum(F.when(inner, F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("near"))
