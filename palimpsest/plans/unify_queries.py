"""Two classifications over the given parts, one of which drops a level or its root, and their unification."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import aggregates as agg
from palimpsest.operators import merge as mg
from palimpsest.operators import unify as un
from palimpsest.plans.fixtures import Evidence
from palimpsest.plans.registry import query
from palimpsest.sources.scratch import written


def _paths(e: Evidence) -> DataFrame:
    """Source a: type, brand, name of all parts, and for every third a species.  Source b, small parts: without the brand, or (every fourth) without the type."""
    parts, k, key = e.table("part"), F.col("p_partkey"), F.col("p_partkey").alias("key")
    species = ("species", F.when(k % 3 == 0, F.concat("p_name", F.lit(" "), (F.col("p_size") % 5).cast("string"))))
    full = un.rank_path([("kingdom", F.col("p_type")), ("family", F.col("p_brand")), ("genus", F.col("p_name")), species])
    cut = F.when(k % 4 == 0, un.rank_path([("kingdom", F.lit(" ")), ("family", F.col("p_brand")), ("genus", F.col("p_name")), species])).otherwise(un.rank_path([("kingdom", F.col("p_type")), ("family", F.lit("NO_FAMILY_SPECIFIED")), ("genus", F.col("p_name")), species]))
    a = parts.select(F.lit("a").alias("source"), key, full.alias("path"))
    return a.unionByName(parts.where("p_size <= 25").select(F.lit("b").alias("source"), key, cut.alias("path")))


PATHS_SQL = """paths AS (SELECT source, key, list_concat(path, CASE WHEN key % 3 = 0 THEN ['species=' || p_name || ' ' || p_size % 5] ELSE [] END) AS path FROM (
    SELECT 'a' AS source, p_partkey AS key, p_name, p_size, ['kingdom=' || p_type, 'family=' || p_brand, 'genus=' || p_name] AS path FROM part
    UNION ALL SELECT 'b', p_partkey, p_name, p_size, CASE WHEN p_partkey % 4 = 0 THEN ['family=' || p_brand, 'genus=' || p_name] ELSE ['kingdom=' || p_type, 'genus=' || p_name] END FROM part WHERE p_size <= 25)),
  lv AS (SELECT source, key, i - 1 AS level, path[i] AS item, array_to_string(path[1:i], '/') AS sig, path[1:i-1] AS up FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM paths)),
  amb AS (SELECT source, array_to_string(path, '/') AS sig FROM paths GROUP BY ALL HAVING count(DISTINCT key) > 1),
  known AS (SELECT DISTINCT path[i] AS f, path[i+1] AS s, array_to_string(path[1:i-1], '/') AS prior FROM (SELECT *, unnest(range(1, len(path))) AS i FROM paths WHERE starts_with(path[1], 'kingdom='))),
  uniq AS (SELECT f, s, min(prior) AS prior FROM known GROUP BY f, s HAVING count(*) = 1),
  comp AS (SELECT p.*, CASE WHEN starts_with(path[1], 'kingdom=') OR prior IS NULL THEN '' ELSE prior END AS prefix FROM paths p LEFT JOIN uniq ON path[1] = f AND path[2] = s),
  na AS (SELECT DISTINCT sig, lower(item) AS name, up FROM lv WHERE source = 'a'), nb AS (SELECT DISTINCT sig, lower(item) AS name, up FROM lv WHERE source = 'b' AND sig NOT IN (SELECT sig FROM lv WHERE source = 'a')),
  fit AS (SELECT nb.sig, na.sig AS target FROM nb JOIN na USING (name) WHERE list_has_any(nb.up, na.up) AND len(list_intersect(list_transform(nb.up, lambda x: split_part(x, '=', 1)), list_transform(na.up, lambda x: split_part(x, '=', 1)))) = len(list_intersect(nb.up, na.up))),
  al AS (SELECT sig, count(DISTINCT target) AS targets, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target FROM fit GROUP BY sig),
  stay AS (SELECT DISTINCT lv.sig FROM lv JOIN (SELECT sig FROM al WHERE targets > 1) d ON starts_with(lv.sig, d.sig || '/')), mg AS (SELECT sig, target FROM al WHERE target IS NOT NULL AND sig NOT IN (SELECT sig FROM stay))"""


class Merge:
    """Classifications of source a, and of source b over small parts, with all that keeps nodes apart, and their merge.

    b lacks the brand, or (every fourth part) the type, or has a level above the type (every fifth).  Two brands come with two
    concepts each, and each source qualifies some rows and is at odds with itself about others.
    """

    def __init__(self, e: Evidence):
        k, given = F.col("p_partkey"), lambda rank, name, concept: F.struct(F.concat(F.lit(f"{rank}="), name).alias("item"), F.concat(F.lit(f"{rank[0]}:"), concept).alias("concept"))
        brand = F.concat("p_brand", F.when(F.col("p_brand").isin("Brand#7", "Brand#16"), F.concat(F.lit(":"), (F.col("p_size") % 2).cast("string"))).otherwise(""))
        small = F.concat("p_name", F.lit(" "), (F.col("p_size") % 5).cast("string"))
        kingdom, family, genus, species = given("kingdom", F.col("p_type"), F.col("p_type")), given("family", F.col("p_brand"), brand), given("genus", F.col("p_name"), F.col("p_name")), given("species", small, small)
        low = F.when(k % 3 == 0, F.array(genus, species)).otherwise(F.array(genus))
        a = e.table("part").select(F.lit("a").alias("source"), k.alias("key"), F.concat(F.array(kingdom, family), low).alias("terms"), F.lit(False).alias("rooted"), (k % 29 == 0).alias("qualified"), (k % 31 == 0).alias("unresolved"))
        upper = F.when(k % 4 == 0, F.array(family)).when(k % 5 == 1, F.array(given("clade", F.lit("Life"), F.lit("Life")), kingdom)).otherwise(F.array(kingdom))
        b = e.table("part").where("p_size <= 25").select(F.lit("b").alias("source"), k.alias("key"), F.concat(upper, low).alias("terms"), ((k % 5 == 1) & (k % 4 != 0)).alias("rooted"), (k % 19 == 0).alias("qualified"), (k % 23 == 0).alias("unresolved"))
        self.levels = written(mg.placed_levels(a.unionByName(b), "a"), "levels")
        self.nodes = written(mg.nodes_of(self.levels), "nodes")

    @cached_property
    def found(self) -> DataFrame:
        return written(mg.targets(self.nodes, "a", "b"), "targets")

    @cached_property
    def to(self) -> DataFrame:
        return written(mg.redirects(self.nodes, self.found), "redirects")


MERGE_SQL = """low AS (SELECT p_partkey AS key, p_size, p_type, p_brand, {'item': 'kingdom=' || p_type, 'concept': 'k:' || p_type} AS ki, {'item': 'family=' || p_brand, 'concept': 'f:' || p_brand || CASE WHEN p_brand IN ('Brand#7', 'Brand#16') THEN ':' || p_size % 2 ELSE '' END} AS fa,
    list_concat([{'item': 'genus=' || p_name, 'concept': 'g:' || p_name}], CASE WHEN p_partkey % 3 = 0 THEN [{'item': 'species=' || p_name || ' ' || p_size % 5, 'concept': 's:' || p_name || ' ' || p_size % 5}] ELSE [] END) AS lo FROM part),
  given AS (SELECT 'a' AS source, key, list_concat([ki, fa], lo) AS terms, false AS said, key % 29 = 0 AS qualified, key % 31 = 0 AS unresolved FROM low
    UNION ALL SELECT 'b', key, list_concat(CASE WHEN key % 4 = 0 THEN [fa] WHEN key % 5 = 1 THEN [{'item': 'clade=Life', 'concept': 'c:Life'}, ki] ELSE [ki] END, lo), key % 5 = 1 AND key % 4 <> 0, key % 19 = 0, key % 23 = 0 FROM low WHERE p_size <= 25),
  cutp AS (SELECT source, key, said, qualified, unresolved, array_to_string(list_transform(terms, lambda t: t.item), '/') AS supplied, CASE WHEN unresolved THEN terms[-1:] ELSE terms END AS terms FROM given),
  items AS (SELECT *, list_transform(terms, lambda t: t.item) AS its, said OR starts_with(terms[1].item, 'kingdom=') AS rooted FROM cutp),
  spine AS (SELECT DISTINCT its[i] AS f, its[i+1] AS s, its[1:i-1] AS before FROM (SELECT its, unnest(range(1, len(its))) AS i FROM items WHERE source = 'a' AND starts_with(its[1], 'kingdom=') AND NOT unresolved)),
  one AS (SELECT f, s, any_value(before) AS before FROM spine GROUP BY f, s HAVING count(*) = 1),
  whole AS (SELECT i.* EXCLUDE (rooted), rooted OR len(coalesce(before, [])) > 0 AS rooted, coalesce(before, []) AS before FROM items i LEFT JOIN one ON NOT rooted AND NOT unresolved AND its[1] = f AND its[2] = s),
  lev AS (SELECT source, key, supplied, qualified, unresolved, rooted, len(before) AS borrowed, list_concat(list_transform(before, lambda x: {'item': x, 'concept': x}), terms) AS t FROM whole),
  each AS (SELECT *, t[i].item AS item, t[i].concept AS concept, i > borrowed AS own, i = len(t) AS last, list_transform(t[1:i-1], lambda x: x.item) AS up, array_to_string(list_transform(t[1:i], lambda x: x.item), '/') AS sig FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM lev)),
  several AS (SELECT source, sig FROM each WHERE own GROUP BY ALL HAVING count(DISTINCT concept) > 1),
  st AS (SELECT e.*, CASE WHEN last AND qualified THEN 'qualified' WHEN s.sig IS NOT NULL THEN 'ambiguous' WHEN last AND unresolved THEN 'unresolved' WHEN NOT rooted THEN 'partial' ELSE 'supported' END AS placement FROM each e LEFT JOIN several s ON e.source = s.source AND e.sig = s.sig),
  nd AS (SELECT *, md5(sig || '#' || coalesce(string_agg(CASE WHEN placement IN ('ambiguous', 'qualified', 'unresolved') THEN source || ':' || concept END, '|') OVER (PARTITION BY source, key ORDER BY i), '')) AS node FROM st),
  lvl AS (SELECT *, coalesce(lag(node) OVER w, CASE WHEN NOT rooted THEN md5('container#' || CASE WHEN unresolved THEN 'unresolved' ELSE 'partial' END) END) AS parent, list(node) OVER (PARTITION BY source, key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM nd WINDOW w AS (PARTITION BY source, key ORDER BY i)),
  node AS (SELECT node, min(item) AS item, min(placement) AS placement, min(parent) AS parent, any_value(up) AS up, any_value(above) AS above, coalesce(bool_or(source = 'a' AND own), false) AS in_a, coalesce(bool_or(source = 'b' AND own), false) AS in_b FROM lvl GROUP BY node
    UNION ALL SELECT DISTINCT parent, NULL, 'container', NULL, [], [], false, false FROM lvl WHERE i = 1 AND parent IS NOT NULL),
  fits AS (SELECT b.node, a.node AS target FROM node b JOIN node a ON lower(split_part(a.item, '=', 2)) = lower(split_part(b.item, '=', 2)) AND split_part(a.item, '=', 1) = split_part(b.item, '=', 1)
    WHERE a.in_a AND a.placement = 'supported' AND b.in_b AND NOT b.in_a AND b.placement IN ('supported', 'partial') AND (starts_with(a.item, 'kingdom=') OR list_has_any(a.up, b.up))
      AND len(list_intersect(list_transform(b.up, lambda x: split_part(x, '=', 1)), list_transform(a.up, lambda x: split_part(x, '=', 1)))) = len(list_intersect(b.up, a.up))),
  found AS (SELECT node, count(DISTINCT target) AS targets, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target FROM fits GROUP BY node),
  below AS (SELECT DISTINCT n.node FROM (SELECT node, unnest(above) AS upper FROM node) n JOIN node u ON u.node = n.upper WHERE u.placement IN ('ambiguous', 'qualified', 'unresolved')),
  redir AS (SELECT node, target FROM found WHERE target IS NOT NULL AND node NOT IN (SELECT node FROM below)),
  edge AS (SELECT n.node, item, placement, coalesce(r.target, n.parent) AS parent FROM node n LEFT JOIN redir r ON n.parent = r.node),
  uppers AS (SELECT target, min(parent) AS upper FROM edge JOIN redir USING (node) WHERE parent IS NOT NULL GROUP BY target HAVING count(DISTINCT parent) = 1),
  stays AS (SELECT e.node, item, placement, coalesce(parent, upper) AS parent FROM edge e LEFT JOIN uppers ON e.node = target WHERE e.node NOT IN (SELECT node FROM redir))"""


@query("k01_source_paths", f"WITH {PATHS_SQL} SELECT source, key, level, item, sig FROM lv")
def _(e: Evidence) -> DataFrame:
    return un.levels(_paths(e)).select("source", "key", "level", "item", "sig")


@query("k02_rank_paths", f"WITH {PATHS_SQL} SELECT source, key, array_to_string(path, '/') AS path FROM paths")
def _(e: Evidence) -> DataFrame:
    return _paths(e).withColumn("path", F.array_join("path", "/"))


@query("k03_graph_paths", "WITH up AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), w AS (SELECT node, parent AS nxt, CAST(node AS VARCHAR) AS path FROM up UNION ALL SELECT w.node, u.parent, u.node || '/' || w.path FROM w JOIN up u ON w.nxt = u.node) SELECT node, path, CASE WHEN p_size > 40 THEN 'unresolved' ELSE 'supported' END AS status FROM w JOIN part ON node = p_partkey WHERE nxt IS NULL")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.hierarchy import parent_walk

    k = F.col("p_partkey")
    walked = parent_walk(e.table("part").select(k.alias("node"), F.when(k > 1, F.floor(k / 2)).alias("parent")))
    return walked.join(e.table("part"), F.col("node") == k).select("node", F.array_join(F.reverse(F.col("path").cast("array<string>")), "/").alias("path"), F.when(F.col("p_size") > 40, "unresolved").otherwise("supported").alias("status"))


@query("k04_completed_prefix", f"WITH {PATHS_SQL} SELECT source, key, prefix FROM comp")
def _(e: Evidence) -> DataFrame:
    return un.completed(_paths(e), "kingdom").select("source", "key", F.array_join("prefix", "/").alias("prefix"))


@query("k05_ambiguous", f"WITH {PATHS_SQL} SELECT source, sig FROM amb")
def _(e: Evidence) -> DataFrame:
    return un.ambiguous(_paths(e))


@query("k06_node_identity", f"WITH {MERGE_SQL} SELECT source, key, i - 1 AS level, node, parent, placement FROM lvl")
def _(e: Evidence) -> DataFrame:
    return Merge(e).levels.select("source", "key", "level", "node", "parent", "placement")


@query("k07_placement", f"WITH {PATHS_SQL} SELECT c.source, key, CASE WHEN key % 9 = 0 THEN 'qualified' WHEN amb.sig IS NOT NULL THEN 'ambiguous' WHEN key % 7 = 0 THEN 'unresolved' WHEN NOT starts_with(path[1], 'kingdom=') AND prefix = '' THEN 'partial' ELSE 'supported' END AS status, CASE WHEN NOT starts_with(path[1], 'kingdom=') AND prefix = '' THEN CASE WHEN key % 7 = 0 THEN 'unresolved' ELSE 'partial' END END AS container FROM comp c LEFT JOIN amb ON c.source = amb.source AND array_to_string(path, '/') = amb.sig")
def _(e: Evidence) -> DataFrame:
    return un.placement(un.completed(_paths(e), "kingdom"), "kingdom", F.col("key") % 9 == 0, F.col("key") % 7 == 0)


@query("k08_concept_bridge", f"WITH {MERGE_SQL} SELECT node, source, concept, arg_max(supplied, key) AS supplied FROM lvl WHERE own GROUP BY node, source, concept")
def _(e: Evidence) -> DataFrame:
    return mg.concept_bridge(Merge(e).levels)


@query("k09_leaf_map", f"WITH {PATHS_SQL} SELECT source, key, array_to_string(path, '/') AS leaf FROM paths")
def _(e: Evidence) -> DataFrame:
    return un.levels(_paths(e)).groupBy("source", "key").agg(F.max_by("sig", "level").alias("leaf"))


@query("k10_compatible_pairs", f"WITH {PATHS_SQL} SELECT sig, targets FROM al")
def _(e: Evidence) -> DataFrame:
    return un.align(un.levels(_paths(e)), "a", "b").select("sig", "targets")


@query("k11_aligned", f"WITH {MERGE_SQL} SELECT node, target, targets FROM found")
def _(e: Evidence) -> DataFrame:
    return Merge(e).found


@query("k12_below_disagreement", f"WITH {MERGE_SQL} SELECT node, item, node IN (SELECT node FROM found WHERE target IS NOT NULL) AS held_back FROM node WHERE node IN (SELECT node FROM below)")
def _(e: Evidence) -> DataFrame:
    m = Merge(e)
    would = m.found.where("target is not null").select("node", F.lit(True).alias("held_back"))
    return mg.below_apart(m.nodes).join(m.nodes.select("node", "item"), "node").join(would, "node", "left").na.fill(False)


@query("k13_containment_notes", f"WITH {PATHS_SQL} SELECT DISTINCT al.sig, al.target FROM mg al JOIN lv b ON b.sig = al.sig AND b.source = 'b' JOIN lv a ON a.sig = al.target AND a.source = 'a' WHERE b.up <> a.up")
def _(e: Evidence) -> DataFrame:
    lv = un.levels(_paths(e))
    al = un.merging(lv, un.align(lv, "a", "b"))
    above = lambda s, name: lv.where(F.col("source") == s).select(F.col("sig").alias(name), F.col("up").alias(f"up_{s}")).distinct()
    return al.join(above("b", "sig"), "sig").join(above("a", "target"), "target").where("up_a != up_b").select("sig", "target").distinct()


@query("k14_reparented", f"WITH {MERGE_SQL}, walk AS (SELECT node, placement, parent, CASE WHEN placement = 'container' THEN '' ELSE item END AS path FROM stays WHERE parent IS NULL UNION ALL SELECT s.node, s.placement, s.parent, CASE WHEN w.path = '' THEN s.item ELSE w.path || '/' || s.item END FROM stays s JOIN walk w ON s.parent = w.node) SELECT node, placement, parent, path, node IN (SELECT target FROM redir) AS unified FROM walk")
def _(e: Evidence) -> DataFrame:
    m = Merge(e)
    return mg.unified(mg.rebuilt_paths(mg.reparented(m.nodes, m.to)), m.to).select("node", "placement", "parent", F.array_join("path", "/").alias("path"), "unified")


@query("k15_rewired_concepts", f"WITH {MERGE_SQL}, bridge AS (SELECT node, source, concept, arg_max(supplied, key) AS supplied FROM lvl WHERE own GROUP BY node, source, concept), m AS (SELECT coalesce(target, b.node) AS node, source, concept, supplied, target IS NOT NULL AS moved FROM bridge b LEFT JOIN redir r ON b.node = r.node), last AS (SELECT source, key, arg_max(node, i) AS node FROM lvl GROUP BY source, key) SELECT 'concept' AS part, node, source, concept, arg_max(supplied, (moved, supplied)) AS supplied, bool_or(moved) AS browse_path_adjusted FROM m GROUP BY node, source, concept UNION ALL SELECT 'leaf', coalesce(target, l.node), source, CAST(key AS VARCHAR), '', target IS NOT NULL FROM last l LEFT JOIN redir r ON l.node = r.node")
def _(e: Evidence) -> DataFrame:
    m = Merge(e)
    concepts = mg.rewired(mg.concept_bridge(m.levels), m.to).select(F.lit("concept").alias("part"), "node", "source", "concept", "supplied", "browse_path_adjusted")
    return concepts.unionByName(mg.leaves(m.levels, m.to).select(F.lit("leaf").alias("part"), "node", "source", F.col("key").cast("string").alias("concept"), F.lit("").alias("supplied"), "browse_path_adjusted"))


@query("k16_inherited_attributes", "SELECT taxon_id AS leaf, string_agg(attribute, ',' ORDER BY depth, attribute) AS attributes FROM (SELECT taxon_id, ascii(substr(node, 1, 1)) % 4 AS attribute, min(depth) AS depth FROM closure WHERE ascii(substr(node, 2, 1)) % 2 = 0 GROUP BY ALL) GROUP BY taxon_id")
def _(e: Evidence) -> DataFrame:
    attributes = e.closure.where(F.ascii(F.substring("node", 2, 1)) % 2 == 0).select("node", (F.ascii(F.substring("node", 1, 1)) % 4).alias("attribute")).distinct()
    got = un.inherited(e.closure.select(F.col("taxon_id").alias("leaf"), "node", "depth"), attributes)
    return got.select("leaf", F.array_join(F.col("attributes").cast("array<string>"), ",").alias("attributes"))


def _builds(e: Evidence) -> tuple[DataFrame, DataFrame]:
    """Nodes of an earlier build (type and name) and of this one (type, brand and name), by concept."""
    of = lambda *cols: e.table("part").select(F.md5(F.concat_ws("|", *cols)).alias("node"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("concept"))
    return of("p_type", "p_name"), of("p_type", "p_brand", "p_name")


BUILDS_SQL = "b0 AS (SELECT md5(concat_ws('|', p_type, p_name)) AS node, 'c' || p_partkey AS concept FROM part), b1 AS (SELECT md5(concat_ws('|', p_type, p_brand, p_name)) AS node, 'c' || p_partkey AS concept FROM part), ali AS (SELECT b0.node AS old, min(b1.node) AS new FROM b0 JOIN b1 USING (concept) WHERE b0.node NOT IN (SELECT node FROM b1) GROUP BY b0.node HAVING count(DISTINCT b1.node) = 1)"


@query("k17_alias_redirects", f"WITH {BUILDS_SQL}, prior AS (SELECT DISTINCT 'n' || p_size AS old, md5(concat_ws('|', p_type, p_name)) AS new FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_size)), chained AS (SELECT p.old, coalesce(ali.new, CASE WHEN p.new IN (SELECT node FROM b1) THEN p.new END) AS new FROM prior p LEFT JOIN ali ON p.new = ali.old) SELECT old, new FROM ali UNION ALL SELECT old, new FROM chained WHERE new IS NOT NULL")
def _(e: Evidence) -> DataFrame:
    first = e.table("part").groupBy("p_size").agg(F.min_by(F.md5(F.concat_ws("|", "p_type", "p_name")), "p_partkey").alias("new"))
    return un.alias_redirects(*_builds(e), first.select(F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("old"), "new"))


@query("k20_resolved_ids", f"WITH {BUILDS_SQL}, w AS (SELECT node AS id FROM b0 UNION SELECT node FROM b1 UNION SELECT concept FROM b1) SELECT id, arg_min(node, p) AS node FROM (SELECT id, id AS node, 0 AS p FROM w WHERE id IN (SELECT node FROM b1) UNION ALL SELECT id, new, 1 FROM w JOIN ali ON id = old UNION ALL SELECT id, node, 2 FROM w JOIN b1 ON id = concept) GROUP BY id")
def _(e: Evidence) -> DataFrame:
    before, now = _builds(e)
    wanted = before.select(F.col("node").alias("id")).union(now.select("node")).union(now.select("concept")).distinct()
    return un.resolve(wanted, now.select("node").distinct(), un.alias_redirects(before, now), now)


@query("k22_name_search", "SELECT node, name, assertions, place FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN lower(name) = '1' THEN 0 WHEN starts_with(lower(name), '1') THEN 1 ELSE 2 END, assertions DESC, name, node) AS place FROM (SELECT node, name, count(*) AS assertions FROM catalog JOIN closure USING (taxon_id) GROUP BY node, name) WHERE contains(lower(name), '1')) WHERE place <= 50")
def _(e: Evidence) -> DataFrame:
    nodes = agg.ancestor_rollup(e.catalog, e.closure).select("node", "assertions").join(e.closure.select("node", "name").distinct(), "node").select("node", "name", "assertions")
    return un.name_search(nodes, "1", 50)


@query("k24_node_detail", "SELECT node, rank, name, count(*) AS members, string_agg(taxon_id, ',' ORDER BY taxon_id) FILTER (p <= 10) AS first_members FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY taxon_id) AS p FROM closure) GROUP BY node, rank, name")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.paging import preview

    few = preview(e.closure.select("node", "rank", "name", "taxon_id"), ["node"], [F.asc("taxon_id")], 10)
    return few.groupBy("node", "rank", "name").agg(F.max("group_total").alias("members"), F.array_join(F.array_sort(F.collect_list("taxon_id")).cast("array<string>"), ",").alias("first_members"))


@query("k26_build_fingerprint", f"WITH {PATHS_SQL} SELECT source, CAST(sum(CAST('0x' || substr(md5(s), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM (SELECT source, key || ':' || array_to_string(path, '/') AS s FROM paths) GROUP BY source")
def _(e: Evidence) -> DataFrame:
    leaf = F.concat_ws(":", F.col("key").cast("string"), F.array_join("path", "/"))
    return _paths(e).groupBy("source").agg(agg.content_mark(leaf).alias("fingerprint"))


@query("k18_merged_membership", f"WITH {MERGE_SQL}, last AS (SELECT source, key, arg_max(node, i) AS node FROM lvl GROUP BY source, key) SELECT record_id, coalesce(target, l.node) AS node FROM material JOIN last l ON l.source = 'a' AND key = taxon_id LEFT JOIN redir r ON l.node = r.node")
def _(e: Evidence) -> DataFrame:
    m = Merge(e)
    leaf = mg.leaves(m.levels, m.to).where("source = 'a'").select("key", "node")
    return mg.membership(e.material.select(F.col("record_id").alias("record"), F.col("taxon_id").alias("key")), leaf).withColumnRenamed("record", "record_id")


_MARK = "CAST(sum(CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)) AS VARCHAR)"


@query("k26_merged_fingerprint", f"WITH {MERGE_SQL}, last AS (SELECT source, key, arg_max(node, i) AS node FROM lvl GROUP BY source, key), a AS (SELECT {_MARK.format("concat_ws('|', '=' || p_partkey, '=' || p_name)")} AS snapshot FROM part), b AS (SELECT {_MARK.format("concat_ws('|', '=' || source, '=' || key, '=' || coalesce(target, l.node))")} AS leaves FROM last l LEFT JOIN redir r ON l.node = r.node) SELECT sha256(concat_ws('|', 'rules-2', 'input-7', snapshot, leaves)) AS fingerprint, snapshot, leaves FROM a, b")
def _(e: Evidence) -> DataFrame:
    m = Merge(e)
    return mg.build_fingerprint("rules-2", "input-7", e.table("part").select("p_partkey", "p_name"), mg.leaves(m.levels, m.to).select("source", "key", "node"))
