"""Hierarchies, reconciliation, provenance and audits over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import normalize as nz
from palimpsest.operators import aggregates as agg
from palimpsest.operators import entities as ent
from palimpsest.operators import hierarchy as hi
from palimpsest.operators import provenance as prov
from palimpsest.operators import reconcile as rec
from palimpsest.operators.joins import tasks_for
from palimpsest.plans.catalog_queries import CURRENT_SQL, E03_SQL, OVERLAP_SQL, _current
from palimpsest.plans.fixtures import COUNTS_SQL, Evidence
from palimpsest.plans.registry import query
from palimpsest.sources.scratch import written


def _nodes(e: Evidence) -> DataFrame:
    return hi.nodes_with_parents(e.closure.withColumnRenamed("taxon_id", "leaf"))


NODES_SQL = "nodes AS (SELECT DISTINCT c.node, c.rank, c.name, u.node AS parent FROM closure c LEFT JOIN closure u ON c.taxon_id = u.taxon_id AND u.depth = c.depth + 1)"


@query("g01_prefix_nodes", f"WITH {NODES_SQL} SELECT * FROM nodes")
def _(e: Evidence) -> DataFrame:
    return _nodes(e)


@query("g02_closure", "SELECT taxon_id, node, depth FROM closure")
def _(e: Evidence) -> DataFrame:
    return e.closure.select("taxon_id", "node", "depth")


@query("g03_nearest_rank_parent", "SELECT c.node, arg_min(u.node, u.depth) AS parent FROM closure c JOIN closure u ON c.taxon_id = u.taxon_id AND u.depth > c.depth AND u.rank <> 'genus' GROUP BY c.node")
def _(e: Evidence) -> DataFrame:
    up = e.closure.where("rank != 'genus'").select("taxon_id", F.col("node").alias("above"), F.col("depth").alias("up"))
    return e.closure.join(up, "taxon_id").where("up > depth").groupBy("node").agg(F.min_by("above", "up").alias("parent"))


@query("g04_trail", "SELECT taxon_id, string_agg(name, '<' ORDER BY depth) AS trail FROM closure WHERE depth <= 10 GROUP BY taxon_id")
def _(e: Evidence) -> DataFrame:
    return e.closure.where("depth <= 10").groupBy("taxon_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"]), "<").alias("trail"))


@query("g05_breadcrumbs", "SELECT c.node, string_agg(DISTINCT (9 - u.depth) || u.name, '>' ORDER BY (9 - u.depth) || u.name) AS crumbs FROM closure c JOIN closure u ON c.taxon_id = u.taxon_id AND u.depth >= c.depth WHERE c.rank = 'genus' GROUP BY c.node")
def _(e: Evidence) -> DataFrame:
    up = e.closure.select("taxon_id", F.concat((9 - F.col("depth")).cast("string"), "name").alias("crumb"), F.col("depth").alias("up"))
    return e.closure.where("rank = 'genus'").join(up, "taxon_id").where("up >= depth").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("crumb")), ">").alias("crumbs"))


@query("g06_children", f"WITH {NODES_SQL}, r AS (SELECT node, count(*) AS assertions, count(DISTINCT specimen_id) AS specimens FROM catalog JOIN closure USING (taxon_id) GROUP BY node) SELECT n.parent, n.node, n.name, EXISTS (SELECT 1 FROM nodes k WHERE k.parent = n.node) AS has_children, coalesce(assertions, 0) AS assertions, coalesce(specimens, 0) AS specimens FROM nodes n LEFT JOIN r USING (node)")
def _(e: Evidence) -> DataFrame:
    nodes = _nodes(e)
    parents = nodes.select(F.col("parent").alias("node"), F.lit(True).alias("_kids")).where("node is not null").distinct()
    return nodes.join(agg.ancestor_rollup(e.catalog, e.closure), "node", "left").join(parents, "node", "left").select("parent", "node", "name", F.coalesce("_kids", F.lit(False)).alias("has_children"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("assertions", "specimens")])


def _chain(e: Evidence) -> DataFrame:
    k = F.col("p_partkey")
    parent = F.when(k % 50 == 0, k + 1).when(k % 50 == 1, F.when(k > 1, k - 1)).when(k % 77 == 0, F.lit(10**9)).otherwise(F.floor(k / 2))
    return e.table("part").select(k.alias("node"), F.when(k > 1, parent).alias("parent"))


CHAIN_SQL = "chain AS (SELECT p_partkey AS node, CASE WHEN p_partkey <= 1 THEN NULL WHEN p_partkey % 50 = 0 THEN p_partkey + 1 WHEN p_partkey % 50 = 1 THEN p_partkey - 1 WHEN p_partkey % 77 = 0 THEN 1000000000 ELSE p_partkey // 2 END AS parent FROM part)"


@query("g07_parent_closure", "WITH plain AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), up AS (SELECT node, node AS ancestor, 0 AS depth FROM plain UNION ALL SELECT u.node, p.parent, u.depth + 1 FROM up u JOIN plain p ON u.ancestor = p.node WHERE p.parent IS NOT NULL) SELECT * FROM up")
def _(e: Evidence) -> DataFrame:
    k = F.col("p_partkey")
    return hi.parent_closure(e.table("part").select(k.alias("node"), F.when(k > 1, F.floor(k / 2)).alias("parent")))


@query("g08_parent_walk", f"WITH {CHAIN_SQL}, w AS (SELECT node, parent AS nxt, [node] AS path FROM chain UNION ALL SELECT w.node, c.parent, list_append(w.path, w.nxt) FROM w JOIN chain c ON w.nxt = c.node WHERE NOT list_contains(w.path, w.nxt)) SELECT node, array_to_string(path, '>') AS path, CASE WHEN nxt IS NULL THEN 'complete' WHEN list_contains(path, nxt) THEN 'cycle' ELSE 'missing-parent' END AS reason FROM w WHERE nxt IS NULL OR list_contains(path, nxt) OR nxt NOT IN (SELECT node FROM chain)")
def _(e: Evidence) -> DataFrame:
    return hi.parent_walk(_chain(e)).select("node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "reason")


@query("g09_effective_parent", "SELECT event_id, CASE WHEN user_id % 3 > 0 THEN user_id WHEN event_id > 0 THEN event_id END AS parent FROM events WHERE user_id > 0", base=False)
def _(e: Evidence) -> DataFrame:
    first = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("txn:"), "user_id")).otherwise("txn:0")
    return e.table("events").where("user_id > 0").select("event_id", F.coalesce(nz.typed_id(first, "txn", "var"), nz.typed_id(F.concat(F.lit("var:"), "event_id"), "txn", "var")).alias("parent"))


def _dependencies(e: Evidence) -> DataFrame:
    """event to user to nation to region, as (owner, target)."""
    pair = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("owner"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"))
    return pair(e.table("events"), "e", "event_id", "u", "user_id").unionByName(pair(e.table("customer"), "u", "c_custkey", "n", "c_nationkey")).unionByName(pair(e.table("nation"), "n", "n_nationkey", "r", "n_regionkey"))


DEPS_SQL = "deps AS (SELECT 'e' || event_id AS owner, 'u' || user_id AS target FROM events UNION ALL SELECT 'u' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query("g10_dependency_closure", f"WITH {DEPS_SQL}, rc AS (SELECT DISTINCT owner AS root, owner AS member FROM deps UNION SELECT rc.root, d.target FROM rc JOIN deps d ON rc.member = d.owner) SELECT root, member FROM rc WHERE root <> member")
def _(e: Evidence) -> DataFrame:
    d = _dependencies(e)
    return hi.reachable(d.select(F.col("owner").alias("root")), d)


@query("g11_frontier", f"WITH {DEPS_SQL}, rc AS (SELECT DISTINCT owner AS member FROM deps WHERE owner LIKE 'e%' UNION SELECT d.target FROM rc JOIN deps d ON rc.member = d.owner) SELECT member, member NOT IN (SELECT owner FROM deps) AND NOT starts_with(member, 'r') AS missing FROM rc WHERE NOT starts_with(member, 'e')")
def _(e: Evidence) -> DataFrame:
    d = _dependencies(e)
    found = hi.reachable(d.where("owner like 'e%'").select(F.col("owner").alias("root")), d).select("member").distinct()
    known = d.select(F.col("owner").alias("member"), F.lit(True).alias("_k")).distinct()
    return found.join(known, "member", "left").select("member", (F.col("_k").isNull() & ~F.startswith("member", F.lit("r"))).alias("missing"))


@query("g12_resolvable_edges", f"WITH {CHAIN_SQL} SELECT node, parent AS target, 'parent' AS kind FROM chain WHERE parent IN (SELECT node FROM chain) AND parent <> node UNION ALL SELECT p_partkey, p_size, 'accepted' FROM part WHERE p_size IN (SELECT p_partkey FROM part) AND p_size <> p_partkey")
def _(e: Evidence) -> DataFrame:
    edges = _chain(e).select("node", F.col("parent").alias("target"), F.lit("parent").alias("kind")).unionByName(e.table("part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("bigint").alias("target"), F.lit("accepted").alias("kind")))
    return edges.where("node != target").join(e.table("part").select(F.col("p_partkey").alias("target")), "target", "left_semi").select("node", "target", "kind")


@query("g13_typed_dependencies", """WITH need AS (SELECT 'event#' || event_id AS owner, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, [event_type, CASE WHEN event_id % 7 = 0 THEN 'no such age' WHEN event_id % 11 = 0 THEN ' ' END] AS names, CASE WHEN event_id % 3 = 0 THEN event_id % 40 END AS ref FROM events),
  alias AS (SELECT p_partkey AS alias, p_partkey AS id FROM part UNION SELECT p_size, p_partkey FROM part WHERE p_partkey % 50 = 0),
  ages AS (SELECT DISTINCT event_type AS name, event_type || ' ' || v AS id FROM events, (SELECT unnest(['early', 'late']) AS v) WHERE event_type <> 'view')
  SELECT DISTINCT owner, kind, coalesce(target, asked) AS target, target IS NULL AS missing FROM (
    SELECT owner, 'collection' AS kind, CAST(user_id AS VARCHAR) AS asked, CAST(c_custkey AS VARCHAR) AS target FROM need LEFT JOIN customer ON user_id = c_custkey WHERE user_id IS NOT NULL
    UNION ALL SELECT owner, 'reference', CAST(ref AS VARCHAR), CAST(n_nationkey AS VARCHAR) FROM need LEFT JOIN nation ON ref = n_nationkey WHERE ref IS NOT NULL
    UNION ALL SELECT owner, 'taxon', CAST(k AS VARCHAR), CAST(id AS VARCHAR) FROM need LEFT JOIN alias ON k = alias WHERE k IS NOT NULL
    UNION ALL SELECT owner, 'opinion', CAST(k AS VARCHAR), CAST(s_suppkey AS VARCHAR) FROM need LEFT JOIN (SELECT s_suppkey, s_suppkey * 2 AS about FROM supplier) ON k = about WHERE k IS NOT NULL
    UNION ALL SELECT owner, 'interval', asked, id FROM (SELECT owner, unnest(names) AS asked FROM need) LEFT JOIN ages ON asked = name WHERE trim(asked) <> '')""")
def _(e: Evidence) -> DataFrame:
    k, n = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id")
    need = e.table("events").select(F.concat(F.lit("event#"), n.cast("string")).alias("owner"), "user_id", k.alias("k"), F.when(n % 3 == 0, n % 40).alias("ref"), F.array(F.col("event_type"), F.when(n % 7 == 0, "no such age").when(n % 11 == 0, " ")).alias("names"))
    part = F.col("p_partkey")
    alias = e.table("part").select(part.alias("alias"), part.alias("id")).unionByName(e.table("part").where(part % 50 == 0).select(F.col("p_size").cast("bigint").alias("alias"), part.alias("id")))
    ages = e.table("events").where("event_type != 'view'").select(F.col("event_type").alias("name")).distinct().select("name", F.explode(F.array(*[F.concat("name", F.lit(f" {v}")) for v in ("early", "late")])).alias("id"))
    ids = lambda table, column: e.table(table).select(F.col(column).alias("id"))
    opinions = e.table("supplier").select((F.col("s_suppkey") * 2).alias("alias"), F.col("s_suppkey").alias("id"))
    return hi.typed_edges(need, {"collection": ("user_id", ids("customer", "c_custkey")), "reference": ("ref", ids("nation", "n_nationkey"))}, {"taxon": ("k", alias), "opinion": ("k", opinions)}, ages)


@query("g14_neighbourhood", "SELECT kind, id, label FROM (SELECT DISTINCT 'node' AS kind, node AS id, 'found here' AS label FROM material JOIN closure USING (taxon_id) WHERE locality_id = 's3' UNION SELECT 'collection', collection, 'holds' FROM material WHERE locality_id = 's3' UNION SELECT 'institution', institution, 'keeps' FROM material WHERE locality_id = 's3' UNION SELECT 'specimen', CAST(specimen_id AS VARCHAR), 'from here' FROM material WHERE locality_id = 's3')")
def _(e: Evidence) -> DataFrame:
    here = e.material.where("locality_id = 's3'")
    kinds = [(here.join(e.closure, "taxon_id"), "node", "node", "found here"), (here, "collection", "collection", "holds"), (here, "institution", "institution", "keeps"), (here, "specimen", "specimen_id", "from here")]
    parts = [df.select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("id"), F.lit(t).alias("label")).distinct() for df, k, c, t in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("g15_roots_with_evidence", "SELECT c_custkey, c_custkey IN (SELECT user_id FROM events) AS found FROM customer", base=False)
def _(e: Evidence) -> DataFrame:
    has = e.table("events").select(F.col("user_id").alias("c_custkey"), F.lit(True).alias("_f")).distinct()
    return e.table("customer").join(has, "c_custkey", "left").select("c_custkey", F.coalesce("_f", F.lit(False)).alias("found"))


RULES_SQL = "rules AS (SELECT DISTINCT node, name AS rule, ascii(substr(node, 1, 1)) % 2 = 0 AS inherit, ascii(substr(node, 2, 1)) % 5 = 0 AS neutral FROM closure WHERE ascii(substr(node, 3, 1)) % 3 = 0)"


@query("g16_inherited_rule", f"WITH {RULES_SQL}, fit AS (SELECT taxon_id, rule, neutral, row_number() OVER (PARTITION BY taxon_id ORDER BY depth) AS p FROM closure JOIN rules USING (node) WHERE depth = 0 OR inherit) SELECT taxon_id AS leaf, CASE WHEN NOT neutral THEN rule END AS rule FROM fit WHERE p = 1")
def _(e: Evidence) -> DataFrame:
    rules = e.closure.where(F.ascii(F.substring("node", 3, 1)) % 3 == 0).select("node", F.col("name").alias("rule"), (F.ascii(F.substring("node", 1, 1)) % 2 == 0).alias("inherit"), (F.ascii(F.substring("node", 2, 1)) % 5 == 0).alias("neutral")).distinct()
    return hi.nearest_rule(e.closure.select(F.col("taxon_id").alias("leaf"), "node", "depth"), rules)


# reconciliation


def _subjects(e: Evidence) -> DataFrame:
    """Customers with their identifiers, parsed once for a query, in tasks of so many rows, and written: no step that reads them parses again."""
    if "_subjects" not in vars(e):
        keys = e.table("customer").select("c_custkey")
        e._subjects = written(_parsed(keys.repartition(tasks_for(keys))), "subjects")
    return e._subjects


def _parsed(customers: DataFrame) -> DataFrame:
    n = (F.col("c_custkey") % 100).cast("string")
    label = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("UF VP "), n)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("UF "), n)).otherwise(F.concat(F.lit("UF "), n, F.lit("-"), (F.col("c_custkey") % 100 + 1).cast("string")))
    return customers.select(F.col("c_custkey").alias("subject"), rec.parse_identifier(label, ("UF",)).alias("p")).select("subject", "p.*")


def _targets(e: Evidence) -> DataFrame:
    k = F.col("s_suppkey")
    return e.table("supplier").select(k.alias("specimen"), F.lit("UF").alias("institution"), F.when(k % 2 == 0, "VP").otherwise("PB").alias("collection"), (k % 80).cast("string").alias("number"))


RECON_SQL = """subj AS (SELECT c_custkey AS subject, CASE c_custkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'ambiguous' END AS state, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey % 100 AS VARCHAR) END AS number, CASE WHEN c_custkey % 3 = 0 THEN 'VP' END AS collection FROM customer),
  targ AS (SELECT s_suppkey AS specimen, CASE WHEN s_suppkey % 2 = 0 THEN 'VP' ELSE 'PB' END AS collection, CAST(s_suppkey % 80 AS VARCHAR) AS number FROM supplier),
  edge AS (SELECT subject, specimen, state = 'complete' AS "full" FROM subj JOIN targ USING (number) WHERE state = 'partial' OR subj.collection = targ.collection),
  dec AS (SELECT subject, CASE WHEN state = 'ambiguous' OR n > 1 THEN 'ambiguous' WHEN n = 1 AND f THEN 'deterministic' WHEN n = 1 THEN 'candidate' ELSE 'unresolved' END AS decision FROM subj LEFT JOIN (SELECT subject, count(DISTINCT specimen) AS n, bool_or("full") AS f FROM edge GROUP BY subject) USING (subject))"""


@query("l01_parse_identifier", f"WITH {RECON_SQL} SELECT subject, state, number, collection FROM subj")
def _(e: Evidence) -> DataFrame:
    return _parsed(e.table("customer")).select("subject", "state", "number", "collection")


@query("d11_exact_then_partial", f'WITH {RECON_SQL} SELECT subject, specimen, "full" AS exact FROM edge')
def _(e: Evidence) -> DataFrame:
    return rec.candidates(_subjects(e), _targets(e)).withColumnRenamed("full", "exact")


@query("l02_candidates", f"WITH {RECON_SQL} SELECT subject, count(*) AS candidates FROM edge GROUP BY subject")
def _(e: Evidence) -> DataFrame:
    return rec.candidates(_subjects(e), _targets(e)).groupBy("subject").agg(F.count("*").alias("candidates"))


@query("l03_decisions", f"WITH {RECON_SQL} SELECT subject, decision FROM dec")
def _(e: Evidence) -> DataFrame:
    return rec.decided(_subjects(e), _targets(e)).select("subject", "decision")


@query("l04_diagnostics", f"WITH {RECON_SQL} SELECT subject, specimen, c_nationkey <> s_nationkey AS place_differs, CASE WHEN c_acctbal >= 0 AND s_acctbal >= 0 THEN c_mktsegment <> s_name END AS name_differs FROM edge JOIN customer ON subject = c_custkey JOIN supplier ON specimen = s_suppkey")
def _(e: Evidence) -> DataFrame:
    customers, suppliers = e.table("customer").withColumn("subject", F.col("c_custkey")), e.table("supplier").withColumn("specimen", F.col("s_suppkey"))
    pairs = rec.candidates(_subjects(e).join(customers.select("subject", "c_nationkey", "c_mktsegment", "c_acctbal"), "subject"), _targets(e).join(suppliers.select("specimen", "s_nationkey", "s_name", "s_acctbal"), "specimen"))
    shown = lambda c, by: F.when(F.col(by) >= 0, F.col(c))
    return pairs.select("subject", "specimen", rec.differs(F.col("c_nationkey"), F.col("s_nationkey")).alias("place_differs"), rec.differs(shown("c_mktsegment", "c_acctbal"), shown("s_name", "s_acctbal")).alias("name_differs"))


@query("l04_context_diagnostics", f"WITH {RECON_SQL} SELECT subject, specimen, CASE WHEN trim(c_mktsegment) <> '' AND subject % 5 > 0 THEN lower(c_mktsegment) <> CASE WHEN specimen % 2 = 0 THEN lower(c_mktsegment) ELSE lower(s_name) END END AS name, c_nationkey <> s_nationkey AS locality, CASE WHEN subject % 7 > 0 THEN least(abs(x - y), 360 - abs(x - y)) > 0.01 OR abs(c_nationkey * 3 - s_nationkey * 3) > 0.01 END AS coordinates, CASE WHEN specimen % 3 > 0 THEN subject % 4 <> specimen % 4 END AS stratigraphy, CASE WHEN subject % 6 > 0 THEN subject % 50 + 10 < specimen % 70 OR specimen % 70 + 5 < subject % 50 END AS time FROM (SELECT *, c_nationkey * 15 - 180 AS x, s_nationkey * 15 - 180 AS y FROM edge JOIN customer ON subject = c_custkey JOIN supplier ON specimen = s_suppkey)")
def _(e: Evidence) -> DataFrame:
    a, b = F.col("subject"), F.col("specimen")
    segment, place = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    left = rec.plain_texts({"name": F.when(a % 5 > 0, F.concat(F.lit(" "), segment)), "locality": place, "stratigraphy": (a % 4).cast("string")})
    right = rec.plain_texts({"name": F.col("s_name"), "locality": F.col("s_nationkey").cast("string"), "stratigraphy": F.when(b % 3 > 0, (b % 4).cast("string")).otherwise(" ")})
    echo = rec.plain_texts({"name": F.lower(segment)})["name"]
    customers = e.table("customer").withColumn("subject", F.col("c_custkey")).select("subject", "c_nationkey", echo.alias("echo"), *[c.alias(f"a_{n}") for n, c in left.items()])
    suppliers = e.table("supplier").withColumn("specimen", F.col("s_suppkey")).select("specimen", "s_nationkey", *[c.alias(f"b_{n}") for n, c in right.items()])
    pairs = rec.candidates(_subjects(e).join(customers, "subject"), _targets(e).join(suppliers, "specimen"))
    left = {n: F.col(f"a_{n}") for n in left} | {"lon": F.when(a % 7 > 0, F.col("c_nationkey") * 15 - 180), "lat": F.col("c_nationkey") * 3, "older": F.when(a % 6 > 0, a % 50 + 10), "younger": a % 50}
    right = {n: F.col(f"b_{n}") for n in right} | {"name": F.when(b % 2 == 0, F.col("echo")).otherwise(F.col("b_name")), "lon": F.col("s_nationkey") * 15 - 180, "lat": F.col("s_nationkey") * 3, "older": b % 70 + 5, "younger": b % 70}
    return pairs.select("subject", "specimen", rec.diagnostics(left, right, plain=True).alias("d")).select("subject", "specimen", "d.*")


@query("l05_summary", f"WITH {RECON_SQL} SELECT decision, count(*) AS n FROM dec GROUP BY decision")
def _(e: Evidence) -> DataFrame:
    return rec.decided(_subjects(e), _targets(e)).groupBy("decision").agg(F.count("*").alias("n"))


@query("l06_dataset_state", "SELECT CAST(sum(CAST('0x' || substr(md5(s_suppkey || ':' || s_nationkey), 1, 15) AS BIGINT)) AS VARCHAR) AS state, count(*) AS n FROM supplier", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("supplier").agg(agg.content_mark(F.concat_ws(":", "s_suppkey", "s_nationkey")).alias("state"), F.count("*").alias("n"))


@query("l08_assessments", f"WITH {RECON_SQL} SELECT md5('assessment|' || subject) AS id, subject, decision FROM dec")
def _(e: Evidence) -> DataFrame:
    return rec.decided(_subjects(e), _targets(e)).select(F.md5(F.concat(F.lit("assessment|"), F.col("subject").cast("string"))).alias("id"), "subject", "decision")


@query("l08_recorded", f"WITH {RECON_SQL}, fresh AS (SELECT sha256('assessment|' || subject) AS id, 'assessment' AS kind, subject, NULL::BIGINT AS specimen, decision FROM dec UNION ALL SELECT sha256('edge|' || subject || '|' || specimen), 'edge', subject, specimen, decision FROM (SELECT DISTINCT subject, specimen FROM edge) JOIN dec USING (subject)) SELECT id, kind, subject, specimen, CASE WHEN subject % 4 = 0 THEN 'as decided before' ELSE decision END AS decision FROM fresh")
def _(e: Evidence) -> DataFrame:
    edges, decisions = _edges(e), rec.decided(_subjects(e), _targets(e)).select("subject", "decision")
    nothing = edges.where("false").selectExpr("cast(null as string) as id", "cast(null as string) as kind", "subject", "specimen", "decision")
    before = F.lit("as decided before")
    first = rec.recorded(nothing, decisions.where("subject % 4 = 0").withColumn("decision", before), edges.where("subject % 4 = 0").withColumn("decision", before))
    return rec.recorded(first, decisions, edges)  # a later run decides otherwise, and adds the rest; pairs stay where they were dealt, and none is written


def _edges(e: Evidence) -> DataFrame:
    """(subject, specimen, decision): each pair once, since a customer and a supplier have one identifier each."""
    return rec.candidates(rec.decided(_subjects(e).distinct(), _targets(e)), _targets(e).distinct()).select("subject", "specimen", "decision")


def _reviews(e: Evidence) -> DataFrame:
    return rec.candidates(_subjects(e).distinct(), _targets(e).distinct()).where("(subject + specimen) % 4 < 2").select("subject", "specimen", F.when((F.col("subject") + F.col("specimen")) % 4 == 0, "accepted").otherwise("rejected").alias("verdict"))


@query("l09_current_view", f"WITH {RECON_SQL} SELECT subject, string_agg(specimen, ',' ORDER BY specimen) AS specimens FROM edge GROUP BY subject")
def _(e: Evidence) -> DataFrame:
    return rec.candidates(_subjects(e), _targets(e)).groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("specimen")).cast("array<string>"), ",").alias("specimens"))


_MARK_SQL = "CAST(sum(CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)) AS VARCHAR)"


@query("l06_source_states", "SELECT 'a' AS dataset, " + _MARK_SQL.format("concat_ws('|', '=' || s_suppkey, '=' || s_name)") + " AS state, count(*) AS rows FROM supplier UNION ALL SELECT 'b', " + _MARK_SQL.format("concat_ws('|', '=' || c_custkey, '=' || c_name)") + ", count(*) FROM customer", base=False)
def _(e: Evidence) -> DataFrame:
    return rec.dataset_states(_sources(e), _registered(e))


def _sources(e: Evidence) -> dict[str, DataFrame]:
    return {"a": e.table("supplier").select("s_suppkey", "s_name"), "b": e.table("customer").select("c_custkey", "c_name")}


def _registered(e: Evidence) -> DataFrame:
    """Regions stand for datasets: the first two are sources, the last one is synthetic."""
    key = F.col("r_regionkey")
    return e.table("region").select(F.when(key == 0, "a").when(key == 1, "b").otherwise(F.col("r_name")).alias("dataset"), (key == 4).alias("is_synthetic"))


@query("l09_generations", f"WITH {RECON_SQL}, g AS (SELECT e.subject, e.specimen, decision, CASE WHEN (e.subject + e.specimen) % 4 = 0 THEN 'accepted' WHEN (e.subject + e.specimen) % 4 = 1 THEN 'rejected' END AS verdict FROM edge e JOIN dec USING (subject)), sh AS (SELECT subject, specimen, CASE WHEN verdict = 'rejected' THEN 'rejected' WHEN verdict = 'accepted' AND decision <> 'deterministic' THEN 'accepted-candidate' ELSE decision END AS shown FROM g), v AS (SELECT subject, string_agg(specimen || ':' || shown, ',' ORDER BY specimen) AS edges FROM sh GROUP BY subject), old AS (SELECT subject, string_agg(specimen || ':' || shown, ',' ORDER BY specimen) AS edges FROM sh WHERE specimen % 2 = 0 GROUP BY subject) SELECT 'view' AS shown, 'new' AS generation, subject, edges, true AS current FROM v UNION ALL SELECT 'history', 'new', subject, edges, true FROM v UNION ALL SELECT 'history', 'old', subject, edges, false FROM old")
def _(e: Evidence) -> DataFrame:
    edges = _edges(e)
    now = rec.dataset_states(_sources(e), _registered(e)).select("dataset", "state")
    made = edges.withColumn("generation", F.lit("new")).unionByName(edges.where("specimen % 2 = 0").withColumn("generation", F.lit("old")))
    stored = now.withColumn("generation", F.lit("new")).unionByName(now.withColumns({"generation": F.lit("old"), "state": F.when(F.col("dataset") == "b", F.concat(F.lit("1"), "state")).otherwise(F.col("state"))}))  # one side has changed since
    rows = rec.current_view(made, _reviews(e), stored, now, history=True)  # the view is its current rows, so pairs meet reviews once
    text = F.array_join(F.transform("edges", lambda x: F.concat_ws(":", x["specimen"].cast("string"), x["shown"])), ",")
    rows = rows.select("generation", "subject", text.alias("edges"), "current")
    return rows.select(F.explode(F.when(F.col("current"), F.array(F.lit("view"), F.lit("history"))).otherwise(F.array(F.lit("history")))).alias("shown"), "*")


@query("l10_review", f"WITH {RECON_SQL} SELECT subject, specimen, CASE (subject + specimen) % 4 WHEN 1 THEN 'rejected' WHEN 0 THEN CASE WHEN decision = 'deterministic' THEN decision ELSE 'accepted-candidate' END ELSE decision END AS shown FROM edge JOIN dec USING (subject)")
def _(e: Evidence) -> DataFrame:
    return rec.with_review(_edges(e), _reviews(e)).select("subject", "specimen", "shown")


@query("l11_rebuild", f"WITH {RECON_SQL} SELECT subject, specimen FROM edge WHERE subject % 2 = 0 OR (subject + specimen) % 4 < 2")
def _(e: Evidence) -> DataFrame:
    edges = rec.candidates(_subjects(e), _targets(e)).select("subject", "specimen")
    return rec.rebuilt(edges, _reviews(e), edges.where("subject % 2 = 0"))


# provenance


def _frames(e: Evidence) -> DataFrame:
    """An order's frame: its customer's record and that of the one before, with the hash each had in its last revision."""
    latest = e.revisions.where("is_current").select(F.col("record").alias("member"), "content_hash")
    pairs = e.table("orders").select(F.col("o_orderkey").alias("owner"), F.explode(F.array("o_custkey", F.col("o_custkey") - 1)).alias("member"))
    return pairs.join(latest, "member").select("owner", "member", F.when(F.col("owner") % 13 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))


FRAMES_SQL = "frames AS (SELECT o_orderkey AS owner, m AS member, CASE WHEN o_orderkey % 13 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey - 1]) AS m FROM orders) JOIN revisions ON m = record AND is_current)"


def _state(e: Evidence) -> DataFrame:
    return _current(e).where("is_current")


@query("m01_invalid_owners", f"WITH {FRAMES_SQL}, {CURRENT_SQL} SELECT DISTINCT owner FROM frames f LEFT JOIN (SELECT * FROM cur WHERE is_current) c ON f.member = c.record WHERE c.record IS NULL OR is_synthetic OR c.content_hash <> f.content_hash")
def _(e: Evidence) -> DataFrame:
    return prov.invalid_owners(_frames(e), _state(e))


@query("m02_affected_owners", f"WITH {FRAMES_SQL} SELECT DISTINCT owner FROM frames WHERE member IN (SELECT record FROM revisions WHERE is_current AND event_type = 'click')")
def _(e: Evidence) -> DataFrame:
    return prov.affected_owners(_frames(e), e.revisions.where("is_current and event_type = 'click'"))


@query("m03_frame_union", f"WITH {FRAMES_SQL} SELECT owner, member FROM frames UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 5 = 0")
def _(e: Evidence) -> DataFrame:
    return _frames(e).select("owner", "member").unionByName(e.table("orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("owner"), F.lit(-1).cast("bigint").alias("member")))


@query("m04_freshness", "SELECT event_type AS projection, event_type >= 'p' AS stale FROM events GROUP BY event_type", base=False)
def _(e: Evidence) -> DataFrame:
    of = lambda df: df.groupBy(F.col("event_type").alias("projection")).agg(F.sum(F.xxhash64("event_id", "value").cast("decimal(38,0)")).alias("fingerprint"))
    ev = e.table("events")
    return prov.freshness(of(ev).where("projection < 'p'"), of(ev))


@query("m05_input_fingerprint")
def _(e: Evidence) -> DataFrame:
    return agg.fingerprint(e.table("events"), ["event_id", "user_id", "event_type", "value"]).withColumn("input", F.lit("events")).unionByName(agg.fingerprint(e.table("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"]).withColumn("input", F.lit("orders")))


@query("m06_raw_audit", "SELECT count(*) AS total, count(*) FILTER (seq % 31 <> 0) AS covered, count(*) FILTER (seq % 31 = 0 OR seq % 17 = 0) AS mismatches FROM revisions")
def _(e: Evidence) -> DataFrame:
    stored = e.revisions.withColumn("stored", F.when(F.col("seq") % 31 == 0, F.lit(None)).when(F.col("seq") % 17 == 0, "x").otherwise(F.col("content_hash")))
    return prov.hash_audit(stored, "stored", F.col("content_hash"))


@query("m07_normalization_audit", "SELECT count(*) AS total, count(*) AS covered, count(*) FILTER (o_orderkey % 29 = 0) AS mismatches FROM orders", base=False)
def _(e: Evidence) -> DataFrame:
    owners = e.table("orders").select(F.col("o_orderkey").alias("owner"), F.md5("o_orderstatus").alias("evidence_hash"))
    frames = e.table("lineitem").select(F.col("l_orderkey").alias("owner"), F.md5(F.concat("l_returnflag", "l_linestatus")).alias("dependency"))
    now = ent.normalization_hashes(owners, frames)
    return prov.hash_audit(now.withColumn("stored", F.when(F.col("owner") % 29 == 0, "x").otherwise(F.col("normalization_hash"))), "stored", F.col("normalization_hash"))


@query("m09_proof_check", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 7 = 0", base=False)
def _(e: Evidence) -> DataFrame:
    s = e.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
    proofs = s.where("s_suppkey % 10 != 0").withColumn("s_name", F.when(F.col("s_suppkey") % 7 == 0, "other").otherwise(F.col("s_name")))
    return prov.proof_check(s, proofs, ["s_suppkey"], ["s_name", "s_nationkey"])


@query("m10_unpublished", f"WITH {DEPS_SQL} SELECT (SELECT count(*) FROM (SELECT owner AS k FROM deps UNION SELECT target FROM deps) WHERE k NOT LIKE 'e%' AND k NOT LIKE 'n%' AND k NOT LIKE 'r%' AND substr(k, 2)::BIGINT % 3 = 0) AS unmapped_ends, (SELECT count(*) FROM (SELECT DISTINCT * FROM deps) WHERE (owner LIKE 'u%' AND substr(owner, 2)::BIGINT % 3 = 0) OR (target LIKE 'u%' AND substr(target, 2)::BIGINT % 3 = 0)) AS missing_edges")
def _(e: Evidence) -> DataFrame:
    d = _dependencies(e).distinct()
    keys = d.select(F.col("owner").alias("key")).union(d.select("target")).distinct().where("not (key like 'u%' and cast(substr(key, 2) as bigint) % 3 = 0)")
    return prov.unpublished(d.select(F.col("owner").alias("source"), "target"), keys)


@query("m11_publication_complete", "SELECT event_type AS collection, count(*) AS current, count(c_custkey) AS published, count(*) = count(c_custkey) AS complete FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 40 <> 0 AND NOT (event_type = 'view' AND c_custkey % 9 = 0) GROUP BY event_type")
def _(e: Evidence) -> DataFrame:
    kept = e.occurrence.where("locality_id is not null").withColumn("user", F.substring("locality_id", 2, 20).cast("bigint")).where("user % 40 != 0 and not (collection = 'view' and user % 9 = 0)")  # what a publication that left some out holds
    published, current = kept.groupBy("collection").agg(F.count("*").alias("published")), e.table("events").groupBy(F.col("event_type").alias("collection")).agg(F.count("*").alias("current"))
    both = current.join(published, "collection", "left").na.fill(0, ["published"])
    return both.select("collection", "current", "published", (F.col("current") == F.col("published")).alias("complete"))


@query("m12_stale_equals_live", f"SELECT locality_id, {COUNTS_SQL} FROM catalog GROUP BY locality_id")
def _(e: Evidence) -> DataFrame:
    from palimpsest.sources.scratch import written

    live = e.catalog.groupBy("locality_id").agg(*agg.counts())
    now = agg.fingerprint(e.table("events"), ["event_id", "value"])
    return prov.projected_or_live(written(live, "projection").where("false"), live, now.withColumn("n", F.col("n") + 1), now)


# the unified hierarchy's rollups and reads


@query("k18_membership", "SELECT record_id, node FROM catalog JOIN closure USING (taxon_id) WHERE depth = 0")
def _(e: Evidence) -> DataFrame:
    return e.catalog.join(e.closure.where("depth = 0"), "taxon_id").select("record_id", "node")


@query("k19_node_summary", f"WITH s AS ({E03_SQL}), kids AS (SELECT p.node, count(DISTINCT c.node) AS children FROM closure c JOIN closure p ON p.taxon_id = c.taxon_id AND p.depth = c.depth + 1 GROUP BY p.node) SELECT s.*, coalesce(children, 0) AS children FROM s LEFT JOIN kids USING (node)")
def _(e: Evidence) -> DataFrame:
    kids = _nodes(e).where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    return agg.source_rollup(e.catalog, e.closure).join(kids, "node", "left").withColumn("children", F.coalesce("children", F.lit(0)))


@query("k21_children_in_context", f"WITH {NODES_SQL}, r AS (SELECT node, count(*) AS n FROM catalog JOIN closure USING (taxon_id) WHERE {OVERLAP_SQL} GROUP BY node) SELECT parent, node, name, n FROM nodes JOIN r USING (node)")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.context import Context

    n = Context(interval=(9500, 9000)).apply(e.catalog).join(e.closure.select("taxon_id", "node"), "taxon_id").groupBy("node").agg(F.count("*").alias("n"))
    return _nodes(e).join(n, "node").select("parent", "node", "name", "n")


@query("k23_contextual_recount", "SELECT node, source, count(*) AS n, count(DISTINCT specimen_id) AS specimens FROM catalog JOIN closure USING (taxon_id) WHERE rank = 'family' AND NOT withheld GROUP BY node, source")
def _(e: Evidence) -> DataFrame:
    return e.catalog.where("not withheld").join(e.closure.where("rank = 'family'"), "taxon_id").groupBy("node", "source").agg(F.count("*").alias("n"), F.count_distinct("specimen_id").alias("specimens"))


@query("k25_first_child_pages", f"WITH {NODES_SQL} SELECT parent, node, place, group_total FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name, node) AS place, count(*) OVER (PARTITION BY parent) AS group_total FROM nodes WHERE parent IS NOT NULL) WHERE place <= 5")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.paging import top_per_group

    return top_per_group(_nodes(e).where("parent is not null"), ["parent"], [F.asc("name"), F.asc("node")], 5).select("parent", "node", "place", "group_total")
