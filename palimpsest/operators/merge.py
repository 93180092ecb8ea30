"""The merge of two classifications into one graph of nodes: placement, isolation, redirects, reparenting, rebuilt paths.

A classification is a row (source, key, terms, rooted, qualified, unresolved); terms is an array of structs (item, concept),
highest first, item being ``rank=name``.  Nothing of a source is altered: concepts keep their supplied path, and redirects
can be taken back.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.aggregates import content_mark
from palimpsest.operators.unify import compatible_pairs
from palimpsest.sources.scratch import written

#: Placements that keep a node, and all that stands below it, out of the merge.
APART = ("ambiguous", "qualified", "unresolved")


def container_id(kind: Column) -> Column:
    return F.md5(F.concat(F.lit("container#"), kind))


def _borrowed(rows: DataFrame, spine: str, root: str) -> DataFrame:
    """(first, second, before): what stands above two items in the spine's rooted paths, if that is one and the same everywhere."""
    paths = rows.where((F.col("source") == spine) & F.startswith(F.get("items", F.lit(0)), F.lit(f"{root}=")) & ~F.col("unresolved") & (F.size("items") > 1))
    pairs = paths.select("items", F.explode(F.sequence(F.lit(1), F.size("items") - 1)).alias("i"))
    known = pairs.select(F.element_at("items", F.col("i")).alias("first"), F.element_at("items", F.col("i") + 1).alias("second"), F.slice("items", 1, F.col("i") - 1).alias("before"))
    return known.distinct().groupBy("first", "second").agg(F.count("*").alias("n"), F.first("before").alias("before")).where("n = 1").drop("n")


def placed_levels(rows: DataFrame, spine: str, root: str = "kingdom") -> DataFrame:
    """Classifications by level: (source, key, level, item, concept, own, supplied, node, parent, placement, up, above).

    A row that is at odds with itself keeps its last term alone.  A path that does not begin with the root rank, nor says that
    it is rooted, borrows its upper levels from the spine where these are unique (``own`` is false for them), or hangs below a
    container.  A level is ambiguous where its source gives the path down to it to several concepts.  Ambiguous levels, and the
    last level of qualified and unresolved rows, add their concept to the isolation of the path: a node is the hash of its
    signature and of all isolation gathered down to it, so nothing meets below a node that stands apart, but leaves below one
    isolated level share it.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    at_odds = flag("unresolved")
    rows = rows.where(F.size("terms") > 0).select("source", "key", F.when(at_odds, F.slice("terms", -1, 1)).otherwise(F.col("terms")).alias("terms"), flag("rooted").alias("said"), flag("qualified").alias("qualified"), at_odds.alias("unresolved"), F.transform("terms", lambda t: t["item"]).alias("supplied"))
    rows = rows.withColumn("items", F.transform("terms", lambda t: t["item"])).repartition("source", "key")  # levels are gathered by path again below
    first = F.get("items", F.lit(0))
    rooted = F.col("said") | F.startswith(first, F.lit(f"{root}="))
    open_ = ~rooted & ~F.col("unresolved")
    found = rows.join(_borrowed(rows, spine, root), open_ & (first == F.col("first")) & (F.get("items", F.lit(1)) == F.col("second")), "left")
    before = F.coalesce("before", F.array().cast("array<string>"))
    upper = F.transform(before, lambda i: F.struct(i.alias("item"), i.alias("concept")))
    whole = found.select("source", "key", "supplied", "qualified", "unresolved", (rooted | (F.size(before) > 0)).alias("rooted"), F.size(before).alias("borrowed"), F.concat(upper, F.transform("terms", lambda t: F.struct(t["item"].alias("item"), t["concept"].cast("string").alias("concept")))).alias("terms"), F.concat(before, "items").alias("items"))
    each = whole.select("*", F.posexplode("terms").alias("level", "term")).withColumns({
        "item": F.col("term.item"), "concept": F.col("term.concept"), "own": F.col("level") >= F.col("borrowed"), "last": F.col("level") == F.size("items") - 1,
        "up": F.slice("items", F.lit(1), F.col("level")), "sig": F.array_join(F.slice("items", F.lit(1), F.col("level") + 1), "/"),
    }).drop("terms", "items", "term")
    several = each.where("own").groupBy("source", "sig").agg(F.count_distinct("concept").alias("n")).where("n > 1").select("source", "sig", F.lit(True).alias("ambiguous"))
    each = each.join(several, ["source", "sig"], "left").withColumn("ambiguous", flag("ambiguous"))
    odd = F.col("last") & (F.col("unresolved") | F.startswith("item", F.lit("=")))
    placement = F.when(F.col("last") & F.col("qualified"), "qualified").when(F.col("ambiguous"), "ambiguous").when(odd, "unresolved").when(~F.col("rooted"), "partial").otherwise("supported")
    each = each.withColumn("placement", placement).withColumn("token", F.when(F.col("placement").isin(*APART), F.concat_ws(":", "source", "concept")))
    path = Window.partitionBy("source", "key").orderBy("level")
    each = each.withColumn("node", F.md5(F.concat("sig", F.lit("#"), F.array_join(F.collect_list("token").over(path), "|"))))
    holder = F.when(~F.col("rooted"), container_id(F.when(F.col("unresolved"), "unresolved").otherwise("partial")))
    above = F.collect_list("node").over(path.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("above", above).withColumn("parent", F.coalesce(F.get("above", F.col("level") - 1), holder))
    return each.select("source", "key", "level", "item", "concept", "own", "supplied", "node", "parent", "placement", "up", "above")


def nodes_of(levels: DataFrame) -> DataFrame:
    """(node, item, placement, parent, up, above, sources): each node once, containers among them; sources that assert it themselves."""
    own = F.array_sort(F.collect_set(F.when(F.col("own"), F.col("source")))).alias("sources")
    nodes = levels.groupBy("node").agg(*[F.min(c).alias(c) for c in ("item", "placement", "parent", "up", "above")], own)
    kinds = levels.where("level = 0 and parent is not null").select(F.col("parent").alias("node")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    empty = F.array().cast("array<string>")
    return nodes.unionByName(kinds.select("node", none("string").alias("item"), F.lit("container").alias("placement"), none("string").alias("parent"), empty.alias("up"), empty.alias("above"), empty.alias("sources")))


def concept_bridge(levels: DataFrame) -> DataFrame:
    """(node, source, concept, supplied): what each source asserts, with the path as supplied (of the last key); borrowed levels assert nothing."""
    return levels.where("own").groupBy("node", "source", "concept").agg(F.max_by(F.array_join("supplied", "/"), "key").alias("supplied"))


def targets(nodes: DataFrame, spine: str, other: str, root: str = "kingdom") -> DataFrame:
    """(node, target, targets): nodes of the other source alone against the spine's compatible nodes of their name.

    Only supported nodes of the spine are targets, and only supported or partial nodes look for one.  target is set where
    there is exactly one; several are a disagreement, and none leaves the node out.
    """
    given = lambda rows: rows.select(F.col("node").alias("id"), "item", "up")
    a = given(nodes.where(F.array_contains("sources", spine) & (F.col("placement") == "supported")))
    b = given(nodes.where((F.size("sources") == 1) & F.array_contains("sources", other) & F.col("placement").isin("supported", "partial")))
    found = compatible_pairs(a, b, root).groupBy("id").agg(F.count_distinct("target").alias("targets"), F.min("target").alias("target"))
    return found.select(F.col("id").alias("node"), F.when(F.col("targets") == 1, F.col("target")).alias("target"), "targets")


def below_apart(nodes: DataFrame) -> DataFrame:
    """(node) that have an ambiguous, qualified or unresolved node above them."""
    apart = nodes.where(F.col("placement").isin(*APART)).select(F.col("node").alias("upper"))
    return nodes.select("node", F.explode("above").alias("upper")).join(apart, "upper", "left_semi").select("node").distinct()


def redirects(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, target) of the nodes that merge: one target, and nothing that stands apart above them."""
    return found.where("target is not null").join(below_apart(nodes), "node", "left_anti").select("node", "target")


def reparented(nodes: DataFrame, to: DataFrame) -> DataFrame:
    """(node, item, placement, parent) of the nodes that stay, their parents redirected.

    A node without parent that others were merged into takes their upper node, if all of them have one and the same.
    """
    moved = to.select(F.col("node").alias("parent"), F.col("target").alias("moved"))
    edges = nodes.select("node", "item", "placement", "parent").join(moved, "parent", "left").select("node", "item", "placement", F.coalesce("moved", "parent").alias("parent"))
    uppers = edges.where("parent is not null").join(to, "node").groupBy("target").agg(F.count_distinct("parent").alias("n"), F.min("parent").alias("upper")).where("n = 1")
    stay = edges.join(to.select("node"), "node", "left_anti").join(uppers.select(F.col("target").alias("node"), "upper"), "node", "left")
    return stay.select("node", "item", "placement", F.coalesce("parent", "upper").alias("parent"))


def rebuilt_paths(nodes: DataFrame) -> DataFrame:
    """nodes with ``path``, the items from the root down, parents first; containers are no part of a path.

    Each round joins the children of the nodes placed last.  Nodes that no round reaches stand in a cycle or below one (or
    below a parent that is no node): ValueError, and nothing is returned.
    """
    nodes = written(nodes, "merged")
    own = F.when(F.col("placement") == "container", F.array().cast("array<string>")).otherwise(F.array("item"))
    frontier = written(nodes.where("parent is null").withColumn("path", own), "paths")
    levels, reached = [frontier], frontier.count()
    children = nodes.where("parent is not null")
    for _ in count():
        up = frontier.select(F.col("node").alias("parent"), F.col("path").alias("upper"))
        frontier = written(children.join(up, "parent").withColumn("path", F.concat("upper", own)).select(*nodes.columns, "path"), "paths")
        found = frontier.count()
        if not found:
            break
        reached += found
        levels.append(frontier)
    if reached != nodes.count():
        raise ValueError(f"cyclic placement: {nodes.count() - reached} nodes have no path from a root")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def rewired(concepts: DataFrame, to: DataFrame) -> DataFrame:
    """concepts (node, source, concept, ...) at their node's target, repeats dropped, with ``browse_path_adjusted`` where it moved."""
    rest = [c for c in concepts.columns if c not in ("node", "source", "concept")]
    moved = concepts.join(to, "node", "left").select(F.coalesce("target", "node").alias("node"), "source", "concept", *rest, F.col("target").isNotNull().alias("browse_path_adjusted"))
    return moved.groupBy("node", "source", "concept").agg(*[F.max_by(c, F.struct("browse_path_adjusted", *rest)).alias(c) for c in rest], F.max("browse_path_adjusted").alias("browse_path_adjusted"))


def leaves(levels: DataFrame, to: DataFrame) -> DataFrame:
    """(source, key, node, browse_path_adjusted): the lowest node of each classification, and whether it was redirected there."""
    last = levels.groupBy("source", "key").agg(F.max_by("node", "level").alias("node"))
    return last.join(to, "node", "left").select("source", "key", F.coalesce("target", "node").alias("node"), F.col("target").isNotNull().alias("browse_path_adjusted"))


def unified(nodes: DataFrame, to: DataFrame) -> DataFrame:
    """nodes with ``unified``: whether others were merged into them."""
    into = to.select(F.col("target").alias("node"), F.lit(True).alias("unified")).distinct()
    return nodes.join(into, "node", "left").withColumn("unified", F.coalesce("unified", F.lit(False)))


def membership(records: DataFrame, leaf: DataFrame) -> DataFrame:
    """(record, node) of eligible records (record, key) by the leaf (key, node) of their classification, each exactly once.

    ValueError if a record has no leaf or several: then the members are not the eligible records.
    """
    found = written(records.join(leaf, "key", "left").select("record", "node"), "members")
    n = found.agg(F.count("*").alias("rows"), F.count("node").alias("placed")).first()
    eligible = records.count()
    if not n["rows"] == n["placed"] == eligible:
        raise ValueError(f"{eligible} eligible records, {n['placed']} placed, {n['rows'] - eligible} more than once")
    return found


def build_fingerprint(version: str, revision: str, snapshot: DataFrame, leaf: DataFrame) -> DataFrame:
    """One row: what a build was made of, as a hash of the rules' version, the input's revision, the snapshot's mark and the leaves' mark.

    Both marks are sums of digests over rows: they change with any row, and not with their order.
    """
    mark = lambda rows: rows.agg(F.coalesce(content_mark(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in rows.columns])), F.lit("0")).alias("m"))
    both = mark(snapshot).withColumnRenamed("m", "snapshot").crossJoin(mark(leaf).withColumnRenamed("m", "leaves"))  # one row each
    return both.select(F.sha2(F.concat_ws("|", F.lit(version), F.lit(revision), "snapshot", "leaves"), 256).alias("fingerprint"), "snapshot", "leaves")
