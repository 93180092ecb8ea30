"""Unifying the classifications of several sources, reversibly: paths, nodes, alignment, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.normalize import is_qualified, plain_name
from palimpsest.operators.hierarchy import parent_walk


def rank_path(ranks: list[tuple[str, Column]]) -> Column:
    """The supplied levels of a row as an array of ``rank=name``, highest first; blanks and NO_..._SPECIFIED are skipped."""
    given = [F.when((F.trim(c) != "") & ~F.rlike(c, F.lit(r"^NO_\w+_SPECIFIED$")), F.concat(F.lit(f"{r}="), F.trim(c))) for r, c in ranks]
    return F.filter(F.array(*given), lambda x: x.isNotNull())


def _flags(qualifiers: Column, name: Column) -> Column:
    """The qualifiers that are given, and one more where the name itself holds one."""
    said = F.filter(qualifiers, lambda q: F.coalesce(q != "", F.lit(False)))
    return F.when(F.coalesce(is_qualified(name), F.lit(False)), F.concat(said, F.array(F.lit("qualified source name")))).otherwise(said)


def supplied_classification(ranks: list[tuple[str, Column]], rank: Column, name: Column, accepted: Column, qualifiers: list[Column]) -> Column:
    """struct(path, qualifiers, conflict) of a row with explicit rank columns, highest rank first, and the name it stands for.

    The path has the supplied levels above the name's own rank (all, where that is none of the ranks) and ends with the name.  A row
    whose accepted name is given and is another one is in conflict; nothing is replaced.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r, _ in ranks]), rank), F.lit(0))
    above = rank_path([(r, F.when((place == 0) | (place > i), c)) for i, (r, c) in enumerate(ranks, 1)])
    path = F.concat(above, F.array(F.concat(F.coalesce(rank, F.lit("")), F.lit("="), name)))
    conflict = F.coalesce(plain_name(accepted) != plain_name(name), F.lit(False))
    return F.struct(path.alias("path"), _flags(F.array(*qualifiers), name).alias("qualifiers"), conflict.alias("conflict"))


def walked_classifications(taxa: DataFrame, records: DataFrame, most: int = 32) -> DataFrame:
    """(taxon, path, concepts, qualifiers, conflict) of the taxa that records name, by the parents that their source gives.

    taxa: (id, name, rank, parent), one row a taxon; records: (taxon, qualifier).  ``path`` holds ``rank=name``, highest first,
    ``concepts`` the taxa they stand for; of neighbours with one rank and one plain name the lower stays.  A walk that meets a
    taxon again, or ends not within ``most`` taxa, is in conflict and keeps what it met until then; a parent that is no taxon ends
    it.  ``qualifiers`` are the distinct ones of the taxon's records, in order.
    """
    named = records.groupBy("taxon").agg(F.array_sort(F.collect_set(F.nullif("qualifier", F.lit("")))).alias("given"))
    walk = parent_walk(taxa.select(F.col("id").alias("node"), "parent"), most).join(named.select(F.col("taxon").alias("node")), "node", "left_semi")
    steps = walk.select("node", F.col("reason").isin("cycle", "depth-limit").alias("conflict"), F.posexplode(F.slice("path", 1, most)).alias("at", "id"))
    item = F.concat(F.coalesce("rank", F.lit("")), F.lit("="), "name")
    mark = F.concat_ws("=", F.coalesce("rank", F.lit("")), plain_name(F.col("name")))
    met = steps.join(taxa.select("id", "name", item.alias("item"), mark.alias("mark")), "id").groupBy("node", "conflict").agg(F.array_sort(F.collect_list(F.struct("at", "id", "item", "mark", "name"))).alias("up"))
    kept = F.reverse(F.filter("up", lambda x, i: (i == 0) | ~x["mark"].eqNullSafe(F.get("up", i - 1)["mark"])))
    rows = met.join(named.withColumnRenamed("taxon", "node"), "node").withColumn("kept", kept)
    lowest = F.get("up", F.lit(0))["name"]
    return rows.select(F.col("node").alias("taxon"), F.transform("kept", lambda x: x["item"]).alias("path"), F.transform("kept", lambda x: x["id"]).alias("concepts"), _flags(F.col("given"), lowest).alias("qualifiers"), "conflict")


def levels(paths: DataFrame) -> DataFrame:
    """paths (source, key, path) by level: (source, key, level, item, sig, up), up being the signatures above."""
    each = paths.select("source", "key", F.posexplode("path").alias("level", "item"), "path")
    sig = F.array_join(F.slice("path", 1, F.col("level") + 1), "/")
    return each.select("source", "key", "level", "item", sig.alias("sig"), F.slice("path", 1, F.col("level")).alias("up"))


def completed(paths: DataFrame, root: str) -> DataFrame:
    """paths with ``prefix``: levels borrowed by a path that does not begin with the root rank, else empty.

    It borrows what stands above its first two levels in rooted paths, if that is one and the same everywhere.
    """
    first, second = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    rooted = F.coalesce(F.startswith(first, F.lit(f"{root}=")), F.lit(False))
    pairs = paths.where(rooted & (F.size("path") > 1)).select("path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i"))
    known = pairs.select(F.element_at("path", F.col("i")).alias("_first"), F.element_at("path", F.col("i") + 1).alias("_second"), F.slice("path", 1, F.col("i") - 1).alias("before"))
    unique = known.distinct().groupBy("_first", "_second").agg(F.count("*").alias("_n"), F.first("before").alias("before")).where("_n = 1")
    out = paths.join(unique, (first == F.col("_first")) & (second == F.col("_second")), "left")
    return out.withColumn("prefix", F.when(rooted | F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.col("before"))).drop("_first", "_second", "_n", "before")


def ambiguous(paths: DataFrame) -> DataFrame:
    """(source, sig) of whole paths that one source gives to several concepts."""
    return paths.groupBy("source", F.array_join("path", "/").alias("sig")).agg(F.count_distinct("key").alias("n")).where("n > 1").select("source", "sig")


def isolated_nodes(paths: DataFrame) -> DataFrame:
    """levels with ``node`` and ``isolated``: the node is the hash of the signature, and of the concept too from an ambiguous level on.

    A level is ambiguous where one source gives the whole path down to it to several concepts; what stands below it in a
    longer path is isolated with it, so that nothing meets below a node that doesn't.
    """
    marks = ambiguous(paths).withColumn("_iso", F.lit(True))
    above = Window.partitionBy("source", "key").orderBy("level")
    lv = levels(paths).join(marks, ["source", "sig"], "left").withColumn("isolated", F.coalesce(F.bool_or("_iso").over(above), F.lit(False)))
    return lv.withColumn("node", F.md5(F.concat("sig", F.lit("#"), F.when(F.col("isolated"), F.col("key").cast("string")).otherwise("")))).drop("_iso")


def placement(completed_paths: DataFrame, root: str, qualified: Column, unresolved: Column | None = None) -> DataFrame:
    """(source, key, status, container): qualified, ambiguous, unresolved, partial (neither rooted nor completed) or supported.

    ``unresolved`` says where a source is at odds with itself about a row, or gives its lowest level no rank.  What isn't
    rooted hangs below a container, one for partial and one for unresolved paths; container is null for all others.
    """
    amb = ambiguous(completed_paths).withColumn("_amb", F.lit(True))
    rows = completed_paths.withColumn("sig", F.array_join("path", "/")).join(amb, ["source", "sig"], "left")
    rooted = F.coalesce(F.startswith(F.get("path", F.lit(0)), F.lit(f"{root}=")), F.lit(False)) | (F.size("prefix") > 0)
    open_ = F.coalesce(unresolved, F.lit(False)) if unresolved is not None else F.lit(False)
    status = F.when(qualified, "qualified").when(F.col("_amb"), "ambiguous").when(open_, "unresolved").when(~rooted, "partial").otherwise("supported")
    return rows.select("source", "key", status.alias("status"), F.when(~rooted, F.when(open_, "unresolved").otherwise("partial")).alias("container"))


#: Ranks that stand for any rank, ranks that stand for each other, and ranks that a shared family may bridge; fixed values.
CLADES = ("clade", "unranked clade")
KINDRED = ("order", "suborder")
BRIDGED = ("order", "suborder", "superorder", "superfamily", "subclass", "infraclass")


def _rank(item: Column) -> Column:
    return F.split_part(item, F.lit("="), F.lit(1))


def _name(item: Column) -> Column:
    return F.lower(F.substring(item, F.length(_rank(item)) + 2, F.length(item)))


def _ranks_agree(a: Column, b: Column) -> Column:
    return (a == b) | a.isin(*CLADES) | b.isin(*CLADES) | (a.isin(*KINDRED) & b.isin(*KINDRED))


def _split(item: Column) -> Column:
    return F.struct(_rank(item).alias("rank"), _name(item).alias("name"))


def compatible(item_a: Column, up_a: Column, item_b: Column, up_b: Column, root: str = "kingdom") -> Column:
    """Whether two nodes of one name may be the same: items ``rank=name``, with the items above them, highest first.

    Their ranks agree; some level above is shared by name and agreeing rank (but for the root rank), and shared names stand
    in the same order; and for every rank that both have above, the nearest names are equal, or one of the two stands
    elsewhere above the other node (nested groups), or the rank is one that a shared family and a shared class bridge.
    """
    return _compatible(_split(item_a), F.transform(up_a, _split), _split(item_b), F.transform(up_b, _split), root)


def _compatible(a: Column, up_a: Column, b: Column, up_b: Column, root: str) -> Column:
    """``compatible`` for structs of rank and lower-case name."""
    names = lambda items: F.transform(items, lambda x: x["name"])
    shared = names(F.filter(up_a, lambda x: F.exists(up_b, lambda y: (x["name"] == y["name"]) & _ranks_agree(x["rank"], y["rank"]))))
    in_order = lambda items: F.array_distinct(F.filter(names(items), lambda n: F.array_contains(shared, n)))
    of_rank = lambda items, rank: F.filter(items, lambda x: x["rank"] == rank)
    families = [names(of_rank(F.concat(up, F.array(item)), F.lit("family"))) for item, up in ((a, up_a), (b, up_b))]
    bridge = F.arrays_overlap(*families) & F.exists(of_rank(up_a, F.lit("class")), lambda x: F.array_contains(shared, x["name"]))

    def fits(rank: Column) -> Column:
        near_a, near_b = F.element_at(of_rank(up_a, rank), -1)["name"], F.element_at(of_rank(up_b, rank), -1)["name"]
        return (near_a == near_b) | F.exists(up_b, lambda x: x["name"] == near_a) | F.exists(up_a, lambda x: x["name"] == near_b) | (bridge & rank.isin(*BRIDGED))

    ranks = lambda items: F.transform(items, lambda x: x["rank"])
    common = F.filter(F.array_intersect(ranks(up_a), ranks(up_b)), lambda r: ~r.isin(*CLADES))
    anchored = (F.size(shared) > 0) | (a["rank"] == root)
    return _ranks_agree(a["rank"], b["rank"]) & anchored & (in_order(up_a) == in_order(up_b)) & F.forall(common, fits)


def compatible_pairs(a: DataFrame, b: DataFrame, root: str = "kingdom") -> DataFrame:
    """(id, target): nodes of b (id, item, up) with the nodes of a that ``compatible`` allows.

    Nodes meet by name and by a name that stands above both, so a name that many nodes have is no hot key; a node of a with
    the root rank needs no such anchor.  Names and ranks are split once a node, a pair is compared at its first anchor only,
    and ranks are compared before anything nested.
    """
    split = lambda rows: rows.select("id", _split(F.col("item")).alias("own"), F.transform("up", _split).alias("up")).withColumn("names", F.array_distinct(F.transform("up", lambda x: x["name"])))
    none = F.array(F.lit(""))
    left = split(a).select(*[F.col(c).alias(f"a_{c}") for c in ("id", "own", "up", "names")], F.col("own.name").alias("name"), F.explode(F.when(F.col("own.rank") == root, none).otherwise(F.col("names"))).alias("anchor"))
    right = split(b).select("*", F.col("own.name").alias("name"), F.explode(F.concat(none, "names")).alias("anchor"))
    first = (F.col("anchor") == "") | (F.col("anchor") == F.get(F.array_intersect("names", "a_names"), F.lit(0)))
    met = right.join(left, ["name", "anchor"]).where(_ranks_agree(F.col("a_own.rank"), F.col("own.rank")) & first).select("id", "own", "up", "a_id", "a_own", "a_up")
    dealt = met.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # comparing costs more than moving: no task keeps the pairs of a common name
    return dealt.where(_compatible(F.col("a_own"), F.col("a_up"), F.col("own"), F.col("up"), root)).select("id", F.col("a_id").alias("target"))


def align(lv: DataFrame, spine: str, other: str) -> DataFrame:
    """(sig, target, targets): nodes that only the other source has against compatible spine nodes of their name.

    target is set where there is exactly one; several are a disagreement.
    """
    nodes = lv.select("source", F.col("sig").alias("id"), "item", "up").distinct()
    a = nodes.where(F.col("source") == spine).drop("source")
    b = nodes.where(F.col("source") == other).drop("source").join(a.select("id"), "id", "left_anti")
    fit = compatible_pairs(a, b)
    return fit.groupBy(F.col("id").alias("sig")).agg(F.count_distinct("target").alias("targets"), F.min("target").alias("target")).withColumn("target", F.when(F.col("targets") == 1, F.col("target")))


def merging(lv: DataFrame, aligned: DataFrame) -> DataFrame:
    """(sig, target): aligned nodes without a disagreement above them; the others stay where they are."""
    return aligned.where("target is not null").join(below_disagreement(lv, aligned), "sig", "left_anti").select("sig", "target")


def below_disagreement(lv: DataFrame, aligned: DataFrame) -> DataFrame:
    """Signatures with a disagreement among the levels above them: they do not merge either."""
    split = aligned.where("targets > 1").select(F.col("sig").alias("_above"))
    above = _above(lv)
    return above.join(split, "_above", "left_semi").select("sig").distinct()


def _above(lv: DataFrame) -> DataFrame:
    some = lv.where(F.size("up") > 0).select("sig", "up").distinct()
    return some.select("sig", F.explode(F.transform(F.sequence(F.lit(1), F.size("up")), lambda i: F.array_join(F.slice("up", F.lit(1), i), "/"))).alias("_above"))


def redirected(bridge: DataFrame, merged: DataFrame) -> DataFrame:
    """bridge (sig, source, concept) with every merged signature (sig, target) replaced by its target, repeats dropped."""
    return bridge.join(merged, "sig", "left").select(F.coalesce("target", "sig").alias("sig"), "source", "concept").distinct()


def reparented(lv: DataFrame, to: DataFrame) -> DataFrame:
    """(sig, parent) of all nodes after redirects: a node's parent is its parent's target where that was merged.  to: (sig, target)."""
    edges = lv.select("sig", F.when(F.size("up") > 0, F.array_join("up", "/")).alias("parent")).distinct().join(to.select("sig"), "sig", "left_anti")
    up = to.select(F.col("sig").alias("parent"), "target")
    return edges.join(up, "parent", "left").select("sig", F.coalesce("target", "parent").alias("parent")).distinct()


def inherited(paths: DataFrame, attributes: DataFrame) -> DataFrame:
    """(leaf, attributes): those of the leaf's nodes, nearest first, each once.  paths: (leaf, node, depth)."""
    near = paths.join(attributes, "node").groupBy("leaf", "attribute").agg(F.min("depth").alias("depth"))
    return near.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "attribute"))), lambda x: x["attribute"]).alias("attributes"))


def alias_redirects(before: DataFrame, now: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(old, new): nodes that are gone whose concepts (node, concept) all stand under one node now.

    ``earlier``, the redirects (old, new) of former builds, are carried on: to where their target has gone, or to the target
    if it still is a node.  Ids that are nodes again, and redirects that lead nowhere, go.
    """
    nodes = now.select("node").distinct()
    gone = before.join(nodes, "node", "left_anti")
    moved = gone.withColumnRenamed("node", "old").join(now.withColumnRenamed("node", "new"), "concept")
    direct = moved.groupBy("old").agg(F.count_distinct("new").alias("n"), F.min("new").alias("new")).where("n = 1").select("old", "new")
    if earlier is None:
        return direct
    ends = direct.select(F.col("old").alias("via"), "new").unionByName(nodes.select(F.col("node").alias("via"), F.col("node").alias("new")))
    carried = earlier.select("old", F.col("new").alias("via")).join(nodes.select(F.col("node").alias("old")), "old", "left_anti").join(ends, "via").select("old", "new").distinct()
    return direct.join(carried, "old", "left_anti").select("old", "new").unionByName(carried)


def resolve(wanted: DataFrame, nodes: DataFrame, aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, node): the id itself if it is a node, else its alias' node, else the node of its concept."""
    found = wanted.join(nodes.select(F.col("node").alias("id"), F.col("node")), "id").select("id", "node", F.lit(0).alias("p"))
    found = found.unionByName(wanted.join(aliases.select(F.col("old").alias("id"), F.col("new").alias("node")), "id").select("id", "node", F.lit(1).alias("p")))
    found = found.unionByName(wanted.join(concepts.select(F.col("concept").alias("id"), "node"), "id").select("id", "node", F.lit(2).alias("p")))
    return found.groupBy("id").agg(F.min_by("node", F.struct("p", "node")).alias("node"))


def name_search(nodes: DataFrame, query: str, most: int) -> DataFrame:
    """The first nodes whose name holds the query: exact, then prefix, then the rest; by count, name and id."""
    q, low = query.strip().lower(), F.lower("name")
    order = [F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).otherwise(2), F.desc("assertions"), F.asc("name"), F.asc("node")]
    top = nodes.where(F.contains(low, F.lit(q))).orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
