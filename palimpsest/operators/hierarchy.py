"""Classification hierarchies: prefix paths, closures, parent walks, reachability."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import joins
from palimpsest.sources.scratch import written


def prefix_paths(rows: DataFrame, leaf: Column, ranks: list[tuple[str, str]]) -> DataFrame:
    """(leaf, node, rank, name, depth) for each supplied rank, highest first in ``ranks``.

    A node is the hash of its rank and all names down to it, so equal names below different parents stay apart.  Blank
    ranks are skipped; depth counts from the lowest rank.
    """
    steps = []
    for i, (rank, column) in enumerate(ranks):
        prefix = [F.nullif(F.trim(F.col(c)), F.lit("")) for _, c in ranks[: i + 1]]
        steps.append(F.struct(F.md5(F.concat_ws("|", F.lit(rank), *prefix)).alias("node"), F.lit(rank).alias("rank"), F.col(column).alias("name"), F.lit(len(ranks) - 1 - i).alias("depth")))
    found = rows.select(leaf.alias("leaf"), F.explode(F.array(*steps)).alias("n")).select("leaf", "n.*")
    return found.where(F.nullif(F.trim("name"), F.lit("")).isNotNull())


def nodes_with_parents(paths: DataFrame) -> DataFrame:
    """Distinct nodes of prefix_paths, each with the nearest supplied node above it (null for roots)."""
    above = Window.partitionBy("leaf").orderBy("depth")
    return paths.withColumn("parent", F.lead("node").over(above)).select("node", "rank", "name", "parent").distinct()


def parent_closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) from (node, parent), each node under itself at depth 0.

    Every ancestor stands once, at its least depth, so nodes of a cycle and below one end when all of it is met.  One join per
    level over the frontier alone; levels are written so that plans stay small.
    """
    links = edges.select("node", "parent").where("parent is not null").distinct()
    frontier = written(edges.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct(), "closure")
    levels, seen = [frontier], frontier.select("node", "ancestor")
    for depth in count(1):
        up = frontier.join(links.select(F.col("node").alias("ancestor"), "parent"), "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).where(F.col("node") != F.col("ancestor"))
        frontier = written(up.dropDuplicates(["node", "ancestor"]).join(seen, ["node", "ancestor"], "left_anti").select("node", "ancestor", "depth"), "closure")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("node", "ancestor"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def parent_walk(edges: DataFrame, max_depth: int = 32) -> DataFrame:
    """(node, path, reason): the nodes met going up from each, and why the walk ended.

    Reasons: complete (a node without parent), missing-parent (a parent that is no node), cycle, depth-limit.
    """
    known = written(edges.select(F.col("node").alias("at"), "parent").distinct(), "walk")
    walk = known.select(F.col("at").alias("node"), F.array("at").alias("path"), F.col("parent").alias("next"), F.lit(None).cast("string").alias("reason"))
    done = []
    for depth in range(max_depth):
        walk = walk.withColumn("reason", F.when(F.col("next").isNull(), "complete").when(F.array_contains("path", F.col("next")), "cycle"))
        walk = written(walk.join(known.withColumnRenamed("parent", "after"), F.col("next") == F.col("at"), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("at").isNull(), "missing-parent"))).select("node", "path", "next", "reason", "after"), "walk")
        done.append(walk.where("reason is not null").select("node", "path", "reason"))
        walk = walk.where("reason is null").select("node", F.concat("path", F.array("next")).alias("path"), F.col("after").alias("next"), "reason")
        if walk.isEmpty():
            break
    else:
        done.append(walk.select("node", "path", F.lit("depth-limit").alias("reason")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def reachable(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(root, member): everything that (owner, target) edges lead to, the root itself left out.  Without roots every owner is one.

    Only owners that are targets too are walked, semi-naive: each round joins what the last one found, and keeps what is new,
    until nothing is.  Their finished closures are then joined to the direct targets of the roots, so what many roots share is
    walked once, and roots that nothing leads to, most of them as a rule, take part in no round.
    """
    links = written(edges.select("owner", "target").distinct(), "links")
    inner = links.join(links.select(F.col("target").alias("owner")).distinct(), "owner", "left_semi")
    inner = written(inner.select(F.col("owner").alias("via"), F.col("target").alias("member")), "reach")
    steps = inner.select(F.col("via").alias("member"), F.col("member").alias("next"))
    seen = frontier = inner
    while True:
        found = frontier.join(steps, "member").select("via", F.col("next").alias("member")).distinct()
        frontier = written(found.join(seen, ["via", "member"], "left_anti"), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    direct = links.select(F.col("owner").alias("root"), F.col("target").alias("via"))
    direct = direct if roots is None else roots.select("root").distinct().join(direct, "root")
    further = direct.join(seen, "via").select("root", "member")
    return direct.select("root", F.col("via").alias("member")).unionByName(further).distinct().where(F.col("root") != F.col("member"))


def levels(nodes: DataFrame) -> DataFrame:
    """(node, level) parents first, however deep; nodes that no round can place have level null: a cycle, or a parent that is missing."""
    placed = written(nodes.where("parent is null").select("node", F.lit(0).alias("level")), "levels")
    frontier, out = placed, placed
    for depth in count(1):
        frontier = written(nodes.join(frontier.select(F.col("node").alias("parent")), "parent").select("node", F.lit(depth).alias("level")), "levels")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return nodes.select("node").join(out, "node", "left")


def nearest_rule(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(leaf, rule) by the first node going up whose rule applies: at the node itself, or above if the rule is inherited.

    A neutral rule ends the search and gives no rule.  paths: (leaf, node, depth); rules: (node, rule, inherit, neutral).
    """
    fit = paths.join(rules, "node").where((F.col("depth") == 0) | F.col("inherit"))
    first = fit.groupBy("leaf").agg(F.min_by(F.struct("rule", "neutral"), "depth").alias("r"))
    return first.select("leaf", F.when(~F.col("r.neutral"), F.col("r.rule")).alias("rule"))


def typed_edges(owners: DataFrame, direct: dict[str, tuple[str, DataFrame]], aliased: dict[str, tuple[str, DataFrame]], intervals: DataFrame) -> DataFrame:
    """(owner, kind, target, missing): what records need, by foreign ids, by ids with aliases, and by names of intervals.

    ``direct``: kind to (column of owners with a target's id, targets (id)).  ``aliased``: kind to (column, aliases (alias, id)):
    an id stands for every target that lists it, its own id among them.  ``intervals``: (id, name), met by the names that the
    owners' array ``names`` holds; a name may have several.  A target that is not there is a row with ``missing``, its id being
    what was asked for; null asks for nothing, and an owner is no target of its own.

    Targets are counted for all kinds at once, and what an owner asks for is dealt out by owner to as many tasks as these take; there
    it is made distinct and meets the targets, kind by kind where they are too many to be broadcast.
    """
    told = {**{k: (c, t, "id") for k, (c, t) in direct.items()}, **{k: (c, t, "alias") for k, (c, t) in aliased.items()}, "interval": (None, intervals, "name")}
    ask = lambda kind, c: F.when(F.nullif(F.trim(c), F.lit("")).isNotNull() if kind == "interval" else c.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("asked")))
    asks = [F.array(*[ask(kind, F.col(c)) for kind, (c, _, _) in told.items() if c]), F.coalesce(F.transform("names", lambda x: ask("interval", x)), F.array())]
    asked = lambda rows: rows.select("owner", F.explode(F.array_compact(F.concat(*asks))).alias("a")).select("owner", "a.*")
    known = None
    for kind, (_, targets, by) in told.items():
        own = targets.select(F.lit(kind).alias("kind"), F.col(by).cast("string").alias("asked"), F.col("id").cast("string").alias("target")).distinct()
        known = own if known is None else known.unionByName(own)
    on = ["kind", "asked"]
    per = asked(owners).groupBy(*on).agg(F.count("*").alias("_a"))
    met = known.join(per, on)
    sizes = met.groupBy("kind").agg(F.sum("_a").alias("pairs"), F.count("*").alias("met")).orderBy("met").collect()  # a row a kind
    room, large = joins.BROADCAST_ROWS, []
    for size in sizes:
        room -= size.met
        large += [size.kind] if room < 0 else []
    tasks = -(-sum(size.pairs for size in sizes) // joins.PAIRS_A_TASK)
    owners = owners.where("owner is not null").select("owner", "names", *{c for c, _, _ in told.values() if c})
    wanted = asked(owners.repartition(tasks, "owner") if tasks > 1 else owners.repartition("owner")).distinct()
    # pairs of distinct rows differ, but where an owner asks for several things, which may lead to one target
    wanted = wanted.withColumn("_asks", F.count(F.lit(1)).over(Window.partitionBy("owner", "kind")))
    wanted = wanted.withColumn("_self", F.when(F.startswith("owner", F.concat("kind", F.lit("#"))), F.expr("substring(owner, length(kind) + 2)")))
    out = None
    for kinds in filter(None, ([kind for kind in told if kind not in large], *[[kind] for kind in large])):
        of = F.col("kind").isin(*kinds)
        own = known.where(of) if kinds[0] in large else F.broadcast(met.where(of).select(*on, "target"))
        found = wanted.where(of).join(own, on, "left").select("owner", "kind", F.coalesce("target", "asked").alias("target"), F.col("target").isNull().alias("missing"), "_asks", "_self")
        edges = found.where(~F.col("target").eqNullSafe(F.col("_self"))).drop("_self")
        edges = edges.where("_asks = 1").drop("_asks").unionByName(edges.where("_asks > 1").drop("_asks").distinct())
        out = edges if out is None else out.unionByName(edges)
    return out
