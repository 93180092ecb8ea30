"""Filters, joins, aggregations and pages over the evidence catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import aggregates as agg
from palimpsest.operators import context as ctx
from palimpsest.operators import paging
from palimpsest.plans.fixtures import COUNTS_SQL, Evidence
from palimpsest.plans.registry import query

OVERLAP_SQL = "older >= 9000 AND younger <= 9500"


def labels() -> Column:
    """The label columns of a material record as an array of (namespace, term)."""
    return F.array(*[F.struct(F.lit(n).alias("namespace"), F.col(n).alias("term")) for n in ("l_returnflag", "l_linestatus", "p_type")])


def _terms(e: Evidence) -> DataFrame:
    """(record_id, namespace, term): label columns of material records, unpivoted."""
    return e.material.select("record_id", F.explode(labels()).alias("t")).select("record_id", "t.*").where("term is not null")


TERMS_SQL = "terms AS (SELECT record_id, 'l_returnflag' AS namespace, l_returnflag AS term FROM material UNION ALL SELECT record_id, 'l_linestatus', l_linestatus FROM material UNION ALL SELECT record_id, 'p_type', p_type FROM material)"


def _current(e: Evidence) -> DataFrame:
    return e.revisions.select("record", "content_hash", "is_current", (F.col("record") % 11 == 0).alias("is_synthetic"))


CURRENT_SQL = "cur AS (SELECT record, content_hash, is_current, record % 11 = 0 AS is_synthetic FROM revisions)"


@query("c01_eligible", f"WITH {CURRENT_SQL} SELECT record, seq FROM revisions r WHERE EXISTS (SELECT 1 FROM cur WHERE is_current AND NOT is_synthetic AND cur.record = r.record AND cur.content_hash = r.content_hash)")
def _(e: Evidence) -> DataFrame:
    return ctx.eligible(e.revisions, _current(e), ["record", "content_hash"]).select("record", "seq")


@query("c02_eligible_normalized", f"""WITH {CURRENT_SQL} SELECT record, seq FROM revisions r WHERE EXISTS (SELECT 1 FROM cur WHERE is_current AND NOT is_synthetic AND cur.record = r.record AND cur.content_hash = r.content_hash)
  AND EXISTS (SELECT 1 FROM revisions p WHERE p.record = r.record AND p.seq % 3 <> 0 AND md5(p.content_hash) = md5(r.content_hash)) AND NOT EXISTS (SELECT 1 FROM revisions v WHERE v.record = r.record AND v.seq % 97 = 0)""")
def _(e: Evidence) -> DataFrame:
    rows = e.revisions.withColumn("normalization_hash", F.md5("content_hash"))
    pointers = rows.where("seq % 3 != 0").select("record", "normalization_hash").distinct()
    return ctx.eligible_normalized(rows, _current(e), pointers, e.revisions.where("seq % 97 = 0").select("record").distinct(), ["record", "content_hash"]).select("record", "seq")


@query("c03_projected_or_live", f"SELECT 'projected' AS made, locality_id, {COUNTS_SQL} FROM catalog WHERE source = 'a' GROUP BY locality_id UNION ALL SELECT 'live', locality_id, {COUNTS_SQL} FROM catalog WHERE source = 'b' GROUP BY locality_id")
def _(e: Evidence) -> DataFrame:
    """Two projections: that of source a is as its records are, that of source b was made before the clicks came."""
    from palimpsest.operators.provenance import projected_or_live
    from palimpsest.sources.scratch import written

    made = lambda rows, how: rows.groupBy("locality_id").agg(*agg.counts()).withColumn("made", F.lit(how))
    a, b, events = e.catalog.where("source = 'a'"), e.catalog.where("source = 'b'"), e.table("events")
    mark_a, mark_b = agg.fingerprint(e.table("lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"]), agg.fingerprint(events, ["event_id", "value"])
    early = written(made(b.where("collection != 'click'"), "projected"), "projection")
    fresh = projected_or_live(written(made(a, "projected"), "projection"), made(a, "live"), written(mark_a, "mark"), mark_a)
    stale = projected_or_live(early, made(b, "live"), written(agg.fingerprint(events.where("event_type != 'click'"), ["event_id", "value"]), "mark"), mark_b)
    return fresh.unionByName(stale)


@query("c04_direct_keys", "SELECT record_id FROM catalog WHERE collection = '1-URGENT' AND institution = 'O' AND locality_id = 's3'")
def _(e: Evidence) -> DataFrame:
    return ctx.Context(collection="1-URGENT", institution="O", locality="s3").apply(e.catalog).select("record_id")


@query("c05_descendants", "SELECT record_id FROM catalog WHERE taxon_id IN (SELECT taxon_id FROM closure WHERE rank = 'family' AND node = (SELECT min(node) FROM closure WHERE rank = 'family'))")
def _(e: Evidence) -> DataFrame:
    first = e.closure.where("rank = 'family'").agg(F.min("node").alias("node"))
    members = e.closure.join(F.broadcast(first), "node", "left_semi").select("taxon_id")
    return e.catalog.join(members, "taxon_id", "left_semi").select("record_id")


@query("c06_term", f"WITH {TERMS_SQL} SELECT record_id FROM catalog WHERE EXISTS (SELECT 1 FROM terms WHERE terms.record_id = catalog.record_id AND term = 'R')")
def _(e: Evidence) -> DataFrame:
    return ctx.Context(term="R").apply(e.catalog, terms=_terms(e)).select("record_id")


@query("c07_reference_in_frame", "SELECT seq FROM revisions r WHERE EXISTS (SELECT 1 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region g ON n.n_regionkey = g.r_regionkey WHERE c.c_custkey = r.record AND g.r_name = (SELECT min(r_name) FROM region))")
def _(e: Evidence) -> DataFrame:
    region = e.table("region")
    wanted = region.join(region.agg(F.min("r_name").alias("r_name")), "r_name", "left_semi")
    nations = e.table("nation").join(wanted, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    users = e.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return e.revisions.join(users, F.col("record") == F.col("c_custkey"), "left_semi").select("seq")


@query("c08_overlap", f"SELECT record_id, older, younger FROM catalog WHERE {OVERLAP_SQL}")
def _(e: Evidence) -> DataFrame:
    return e.within(9500, 9000).catalog.where(ctx.overlaps(9500, 9000)).select("record_id", "older", "younger")


@query("c09_point", "SELECT record_id FROM catalog WHERE lon = -106 AND lat = -64 AND NOT withheld")
def _(e: Evidence) -> DataFrame:
    return ctx.Context(point=(-106, -64)).apply(e.catalog).select("record_id")


@query("c10_box_antimeridian", "SELECT record_id, lon, lat FROM catalog WHERE (lon >= 100 OR lon <= -100) AND lat BETWEEN -60 AND 60 AND NOT withheld")
def _(e: Evidence) -> DataFrame:
    return ctx.Context(box=(100, -60, -100, 60)).apply(e.catalog).select("record_id", "lon", "lat")


@query("c11_text", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: starts_with(t, 'there'))) > 0 AND len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: starts_with(t, 'wh'))) > 0 OR contains(lower(text), 'there wh')", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("documents").where(ctx.text_matches("there wh", F.col("text"), F.col("text"))).select("doc_id")


@query("c12_text_short_literal", r"SELECT p_partkey FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN regexp_replace(p_name, '^(.).', '\1%') WHEN 1 THEN regexp_replace(p_name, '^(.).', '\1_') ELSE p_name END AS name FROM part) WHERE starts_with(lower(name), 'r%') OR starts_with(lower(name), 'b_')", base=False)
def _(e: Evidence) -> DataFrame:
    k, sign = F.col("p_partkey") % 3, lambda c: F.regexp_replace("p_name", "^(.).", f"$1{c}")
    rows = e.table("part").select("p_partkey", F.when(k == 0, sign("%")).when(k == 1, sign("_")).otherwise(F.col("p_name")).alias("name"))
    return rows.where(ctx.text_matches("r%", F.col("name"), F.col("name")) | ctx.text_matches("b_", F.col("name"), F.col("name"))).select("p_partkey")


@query("c13_source", "SELECT record_id FROM catalog WHERE source = 'b'")
def _(e: Evidence) -> DataFrame:
    return ctx.Context(source="b").apply(e.catalog).select("record_id")


@query("c14_policy", f"WITH {CURRENT_SQL} SELECT record, seq FROM revisions r WHERE seq % 4 + 1 = 2 AND EXISTS (SELECT 1 FROM cur WHERE is_current AND NOT is_synthetic AND cur.record = r.record AND cur.content_hash = r.content_hash)")
def _(e: Evidence) -> DataFrame:
    return ctx.eligible(e.revisions.withColumn("policy_version", F.col("seq") % 4 + 1), _current(e), ["record", "content_hash"], policy=2).select("record", "seq")


@query("c16_node_context", f"SELECT node, count(*) AS records FROM catalog JOIN closure USING (taxon_id) WHERE {OVERLAP_SQL} AND source = 'a' GROUP BY node")
def _(e: Evidence) -> DataFrame:
    return ctx.Context(source="a", interval=(9500, 9000)).apply(e.catalog).join(e.closure, "taxon_id").groupBy("node").agg(F.count("*").alias("records"))


@query("c17_conflicting_focus", "SELECT count(*) AS n FROM catalog WHERE locality_id = 's3' AND locality_id = 's4'")
def _(e: Evidence) -> DataFrame:
    return ctx.Context(locality="s4").apply(ctx.Context(locality="s3").apply(e.catalog)).agg(F.count("*").alias("n"))


# joins


@query("d01_star", "SELECT record_id, specimen_id, taxon_id, locality_id, collection, institution, nation, region, p_type, p_brand FROM material")
def _(e: Evidence) -> DataFrame:
    return e.material.select("record_id", "specimen_id", "taxon_id", "locality_id", "collection", "institution", "nation", "region", "p_type", "p_brand")


@query("d02_left_outer", "SELECT event_id, user_id, c_name, c_nationkey FROM events LEFT JOIN customer ON user_id = c_custkey", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("events").join(e.table("customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", "c_name", "c_nationkey")


@query("d03_version_join", "SELECT r.record, r.seq, i.first_seq FROM revisions r JOIN (SELECT record, content_hash, seq % 3 AS policy, min(seq) AS first_seq FROM revisions GROUP BY ALL) i ON r.record = i.record AND r.content_hash = i.content_hash AND r.seq % 3 = i.policy")
def _(e: Evidence) -> DataFrame:
    rows = e.revisions.withColumn("policy", F.col("seq") % 3)
    first = rows.groupBy("record", "content_hash", "policy").agg(F.min("seq").alias("first_seq"))
    return rows.join(first, ["record", "content_hash", "policy"]).select("record", "seq", "first_seq")


@query("d04_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("customer").join(e.table("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("d05_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0)", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("customer").join(e.table("orders").where("o_orderkey % 3 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("d06_rule_per_combination", "SELECT record_id, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'returned' WHEN l_linestatus = 'O' THEN 'open' ELSE lower(p_type) END AS rule FROM material")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.joins import per_combination

    rule = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "returned").when(F.col("l_linestatus") == "O", "open").otherwise(F.lower("p_type"))
    return per_combination(e.material, ["l_returnflag", "l_linestatus", "p_type"], rule, "rule").select("record_id", "rule")


@query("d07_closure_join", "SELECT record_id, node, depth FROM material JOIN closure USING (taxon_id)")
def _(e: Evidence) -> DataFrame:
    return e.material.join(e.closure, "taxon_id").select("record_id", "node", "depth")


@query("d08_lateral_first", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)", base=False)
def _(e: Evidence) -> DataFrame:
    top = paging.top_per_group(e.table("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    return e.table("customer").join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("d09_totals_beside", "SELECT locality_id, n, (SELECT count(*) FROM catalog) AS total FROM (SELECT locality_id, count(*) AS n FROM catalog GROUP BY locality_id)")
def _(e: Evidence) -> DataFrame:
    return e.catalog.groupBy("locality_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(e.catalog.agg(F.count("*").alias("total"))))


@query("d10_sharing_localities", """WITH lt AS (SELECT DISTINCT locality_id, taxon_id FROM material), pairs AS (SELECT DISTINCT x.locality_id, y.locality_id AS related FROM lt x JOIN lt y ON x.taxon_id = y.taxon_id AND x.locality_id <> y.locality_id)
  SELECT locality_id, related, place FROM (SELECT *, row_number() OVER (PARTITION BY locality_id ORDER BY related) AS place FROM pairs) WHERE place <= 12""")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.joins import first_sharing

    return first_sharing(e.material, "locality_id", "taxon_id", 12)


@query("d12_parent_self_join", "SELECT n.node, n.name, p.name AS parent_name FROM (SELECT DISTINCT c.node, c.name, u.node AS parent FROM closure c LEFT JOIN closure u ON c.taxon_id = u.taxon_id AND u.depth = c.depth + 1) n LEFT JOIN (SELECT DISTINCT node, name FROM closure) p ON n.parent = p.node")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.hierarchy import nodes_with_parents

    nodes = nodes_with_parents(e.closure.withColumnRenamed("taxon_id", "leaf"))
    return nodes.join(nodes.select(F.col("node").alias("parent"), F.col("name").alias("parent_name")), "parent", "left").select("node", "name", "parent_name")


@query("d13_theta", "SELECT c.node, u.node AS above FROM (SELECT DISTINCT taxon_id, node, depth FROM closure) c JOIN closure u ON c.taxon_id = u.taxon_id AND u.depth > c.depth")
def _(e: Evidence) -> DataFrame:
    up = e.closure.select("taxon_id", F.col("node").alias("above"), F.col("depth").alias("up"))
    return e.closure.join(up, "taxon_id").where("up > depth").select("node", "above")


@query("d14_key_mapping", "SELECT e.event_id, c.c_nationkey AS mapped, c.c_custkey IS NULL AS dangling FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey", base=False)
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.joins import map_keys

    mapping = e.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("mapped"))
    return map_keys(e.table("events"), "user_id", mapping).select("event_id", "mapped", "dangling")


# aggregations


@query("e01_counts", f"SELECT locality_id, {COUNTS_SQL} FROM catalog GROUP BY locality_id")
def _(e: Evidence) -> DataFrame:
    return e.catalog.groupBy("locality_id").agg(*agg.counts())


@query("e02_ancestor_rollup", "SELECT node, count(*) AS assertions, count(DISTINCT specimen_id) AS specimens FROM catalog JOIN closure USING (taxon_id) GROUP BY node")
def _(e: Evidence) -> DataFrame:
    return agg.ancestor_rollup(e.catalog, e.closure)


@query("e02_ancestor_rollup_corrected", "SELECT node, count(*) AS assertions, count(DISTINCT specimen_id) AS specimens FROM catalog JOIN closure USING (taxon_id) GROUP BY node")
def _(e: Evidence) -> DataFrame:
    return agg.ancestor_rollup_corrected(e.catalog, e.closure)


E03_SQL = """SELECT node, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS inclusive, count(CASE WHEN depth = 0 THEN 1 END) AS direct, count(DISTINCT specimen_id) AS specimens,
  count(CASE WHEN older IS NOT NULL AND younger IS NOT NULL THEN 1 END) AS known, count(CASE WHEN older IS NULL OR younger IS NULL THEN 1 END) AS unknown, max(CASE WHEN younger IS NOT NULL THEN older END) AS older_bound,
  min(CASE WHEN older IS NOT NULL THEN younger END) AS younger_bound, count(CASE WHEN withheld THEN 1 END) AS withheld, count(lon) AS mapped FROM catalog JOIN closure USING (taxon_id) GROUP BY GROUPING SETS ((node, source), (node))"""


@query("e03_source_rollup", E03_SQL)
def _(e: Evidence) -> DataFrame:
    return agg.source_rollup(e.catalog, e.closure)


@query("e04_direct_inclusive", "SELECT node, count(*) FILTER (depth = 0) AS direct, count(*) AS inclusive FROM catalog JOIN closure USING (taxon_id) GROUP BY node")
def _(e: Evidence) -> DataFrame:
    return e.catalog.join(e.closure, "taxon_id").groupBy("node").agg(F.count(F.when(F.col("depth") == 0, 1)).alias("direct"), F.count("*").alias("inclusive"))


@query("e05_represented_children", "SELECT p.node, source, count(DISTINCT c.node) AS children FROM catalog JOIN closure c USING (taxon_id) JOIN closure p ON p.taxon_id = c.taxon_id AND p.depth = c.depth + 1 GROUP BY p.node, source")
def _(e: Evidence) -> DataFrame:
    pairs = e.closure.join(e.closure.select("taxon_id", F.col("node").alias("parent"), (F.col("depth") - 1).alias("depth")), ["taxon_id", "depth"])
    present = e.catalog.select("taxon_id", "source").distinct().join(pairs, "taxon_id").select(F.col("parent").alias("node"), "source", F.col("node").alias("child")).distinct()
    return present.groupBy("node", "source").agg(F.count("*").alias("children"))


@query("e06_places", "SELECT lon, lat, count(*) AS localities, CAST(sum(records) AS BIGINT) AS records FROM (SELECT locality_id, lon, lat, count(*) AS records FROM catalog WHERE NOT withheld AND lon IS NOT NULL AND locality_id IS NOT NULL GROUP BY ALL) GROUP BY lon, lat")
def _(e: Evidence) -> DataFrame:
    return agg.places(e.catalog)


@query("e06_place_totals", "SELECT count(*) AS records, count(CASE WHEN NOT withheld AND lon IS NOT NULL AND locality_id IS NOT NULL THEN 1 END) AS mapped, count(CASE WHEN coalesce(NOT withheld AND lon IS NOT NULL AND locality_id IS NOT NULL, false) THEN NULL ELSE 1 END) AS unmapped FROM catalog")
def _(e: Evidence) -> DataFrame:
    return agg.place_totals(e.catalog)


@query("e07_sources_resummed", "SELECT lon, lat, CAST(sum(n) AS BIGINT) AS records FROM (SELECT lon, lat, count(*) AS n FROM catalog WHERE source = 'a' GROUP BY ALL UNION ALL SELECT lon, lat, count(*) FROM catalog WHERE source = 'b' GROUP BY ALL) GROUP BY lon, lat")
def _(e: Evidence) -> DataFrame:
    per = [e.catalog.where(F.col("source") == s).groupBy("lon", "lat").agg(F.count("*").alias("n")) for s in ("a", "b")]
    return per[0].unionByName(per[1]).groupBy("lon", "lat").agg(F.sum("n").alias("records"))


@query("e08_any_member", "SELECT lon, lat, bool_or(withheld) AS any_withheld, CASE WHEN bool_or(source = 'a') AND bool_or(source = 'b') THEN 'both' WHEN bool_or(source = 'a') THEN 'a' ELSE 'b' END AS sources FROM catalog GROUP BY lon, lat")
def _(e: Evidence) -> DataFrame:
    a, b = F.bool_or(F.col("source") == "a"), F.bool_or(F.col("source") == "b")
    return e.catalog.groupBy("lon", "lat").agg(F.bool_or("withheld").alias("any_withheld"), F.when(a & b, "both").when(a, "a").otherwise("b").alias("sources"))


@query("e09_ordered_array", "SELECT locality_id, string_agg(term || ':' || n, ',' ORDER BY term) AS terms FROM (SELECT locality_id, l_returnflag AS term, count(*) AS n FROM material GROUP BY ALL) GROUP BY locality_id")
def _(e: Evidence) -> DataFrame:
    per = e.material.groupBy("locality_id", F.col("l_returnflag").alias("term")).agg(F.count("*").alias("n"))
    return per.groupBy("locality_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "n"))), lambda x: F.concat(x["term"], F.lit(":"), x["n"].cast("string"))), ",").alias("terms"))


@query("e10_facets", f"WITH {TERMS_SQL} SELECT namespace, term, count(*) AS n FROM terms GROUP BY ALL")
def _(e: Evidence) -> DataFrame:
    return _terms(e).groupBy("namespace", "term").agg(F.count("*").alias("n"))


@query("e11_several_taxa", "SELECT specimen_id, count(DISTINCT taxon_id) AS taxa FROM material GROUP BY specimen_id HAVING count(DISTINCT taxon_id) > 1")
def _(e: Evidence) -> DataFrame:
    return e.material.groupBy("specimen_id").agg(F.count_distinct("taxon_id").alias("taxa")).where("taxa > 1")


@query("e12_distinct_array", "SELECT taxon_id, string_agg(DISTINCT nullif(trim(collection), ''), ',' ORDER BY nullif(trim(collection), '')) AS collections FROM material GROUP BY taxon_id")
def _(e: Evidence) -> DataFrame:
    return e.material.groupBy("taxon_id").agg(F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("collection"), F.lit("")))), ",").alias("collections"))


@query("e13_dataset_fingerprint", "SELECT record % 16 AS part, CAST(sum(CAST('0x' || substr(md5(content_hash || seq), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM revisions GROUP BY record % 16")
def _(e: Evidence) -> DataFrame:
    return e.revisions.groupBy((F.col("record") % 16).alias("part")).agg(agg.content_mark(F.concat("content_hash", F.col("seq").cast("string"))).alias("fingerprint"))


@query("e14_source_counts", "SELECT count(*) AS total, count(*) FILTER (source = 'a') AS a, count(*) FILTER (source = 'b') AS b FROM catalog")
def _(e: Evidence) -> DataFrame:
    return e.catalog.agg(F.count("*").alias("total"), *[F.count(F.when(F.col("source") == s, 1)).alias(s) for s in ("a", "b")])


@query("e15_dataset_status", "SELECT source, count(*) AS records, count(*) FILTER (NOT withheld AND lon IS NOT NULL) AS mapped, count(*) FILTER (older IS NOT NULL AND younger IS NOT NULL) AS dated, count(DISTINCT collection) AS collections, count(DISTINCT taxon_id) AS taxa FROM catalog GROUP BY source")
def _(e: Evidence) -> DataFrame:
    whole = F.col("older").isNotNull() & F.col("younger").isNotNull()
    return e.catalog.groupBy("source").agg(F.count("*").alias("records"), F.count(F.when(~F.col("withheld") & F.col("lon").isNotNull(), 1)).alias("mapped"), F.count(F.when(whole, 1)).alias("dated"), F.count_distinct("collection").alias("collections"), F.count_distinct("taxon_id").alias("taxa"))


@query("e16_population", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("e17_material_through_frame", "SELECT record, count(l.l_orderkey) AS materials FROM (SELECT DISTINCT record FROM revisions) r LEFT JOIN orders o ON o.o_custkey = r.record LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY record")
def _(e: Evidence) -> DataFrame:
    n = e.table("orders").join(e.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("record")).agg(F.count("*").alias("materials"))
    return e.revisions.select("record").distinct().join(n, "record", "left").select("record", F.coalesce("materials", F.lit(0)).alias("materials"))


@query("e18_completeness", "WITH k AS (SELECT locality_id, count(*) AS n, count(DISTINCT specimen_id) AS s FROM catalog GROUP BY locality_id) SELECT locality_id AS key, 'specimens' AS rule FROM k WHERE locality_id LIKE '%7' UNION ALL SELECT locality_id, 'intervals' FROM k WHERE locality_id LIKE '%3' UNION ALL SELECT '*', 'total' WHERE EXISTS (SELECT 1 FROM k WHERE locality_id LIKE '%7')")
def _(e: Evidence) -> DataFrame:
    summary = e.catalog.groupBy(F.col("locality_id").alias("key")).agg(*agg.counts())
    wrong = F.col("key").like("%7")  # localities that lose all but a record fewer than they have specimens
    broken = summary.withColumn("known", F.when(F.col("key").like("%3"), F.col("known") + 1).otherwise(F.col("known"))).withColumn("assertions", F.when(wrong, F.col("specimens") - 1).otherwise(F.col("assertions")))
    return agg.completeness(broken, e.catalog.count())


# windows, pages, set operations


@query("f01_interleave", "SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS turn FROM (SELECT DISTINCT 'locality' AS kind, locality_id AS id FROM material UNION ALL SELECT DISTINCT 'collection', collection FROM material UNION ALL SELECT DISTINCT 'institution', institution FROM material)")
def _(e: Evidence) -> DataFrame:
    kinds = [e.material.select(F.lit(k).alias("kind"), F.col(c).alias("id")).distinct() for k, c in (("locality", "locality_id"), ("collection", "collection"), ("institution", "institution"))]
    return paging.interleaved(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), "kind", "id")


@query("f02_top_per_group", "SELECT locality_id, taxon_id, n, place, group_total FROM (SELECT *, row_number() OVER (PARTITION BY locality_id ORDER BY n DESC, taxon_id) AS place, count(*) OVER (PARTITION BY locality_id) AS group_total FROM (SELECT locality_id, taxon_id, count(*) AS n FROM material GROUP BY ALL)) WHERE place <= 5")
def _(e: Evidence) -> DataFrame:
    per = e.material.groupBy("locality_id", "taxon_id").agg(F.count("*").alias("n"))
    return paging.top_per_group(per, ["locality_id"], [F.desc("n"), F.asc("taxon_id")], 5)


@query("f03_distinct_on", "SELECT DISTINCT ON (specimen_id) specimen_id, record_id, older FROM material ORDER BY specimen_id, older DESC, record_id")
def _(e: Evidence) -> DataFrame:
    return paging.first_per_group(e.material.select("specimen_id", "record_id", "older"), ["specimen_id"], F.struct(-F.col("older"), F.col("record_id")))


@query("f04_keyset_page", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 26", base=False)
def _(e: Evidence) -> DataFrame:
    c = e.table("customer")
    return paging.keyset_page(c.select("c_custkey", "c_name"), ["c_custkey"], (40,), 25).crossJoin(c.agg(F.count("*").alias("total")))


@query("f05_composite_keyset", "SELECT p_size AS rank, p_type AS kind, p_partkey AS id FROM part WHERE (p_size, p_type, p_partkey) > (10, 'LARGE', 50) ORDER BY 1, 2, 3 LIMIT 31", base=False)
def _(e: Evidence) -> DataFrame:
    return paging.keyset_page(e.table("part").select(F.col("p_size").alias("rank"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("id")), ["rank", "kind", "id"], (10, "LARGE", 50), 30)


@query("f06_offset_page", "SELECT locality_id, n FROM (SELECT locality_id, count(*) AS n FROM catalog GROUP BY locality_id) ORDER BY n DESC, locality_id NULLS LAST LIMIT 20 OFFSET 10")
def _(e: Evidence) -> DataFrame:
    return e.catalog.groupBy("locality_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("locality_id")).offset(10).limit(20)


@query("f07_page_then_expand", "SELECT record_id, node, depth FROM (SELECT record_id, taxon_id FROM material ORDER BY record_id LIMIT 50) JOIN closure USING (taxon_id)")
def _(e: Evidence) -> DataFrame:
    page = e.material.select("record_id", "taxon_id").orderBy("record_id").limit(50)
    return e.closure.join(F.broadcast(page), "taxon_id").select("record_id", "node", "depth")


@query("f09_ranking", "SELECT name, n, in_both, place FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN lower(name) = 'part 1' THEN 0 WHEN starts_with(lower(name), 'part 1') THEN 1 WHEN contains(lower(name), '1') THEN 2 ELSE 3 END, in_both DESC, n DESC, name) AS place FROM (SELECT p_name AS name, count(*) AS n, max(p_size) > 25 AND min(p_size) <= 25 AS in_both FROM part GROUP BY p_name)) WHERE place <= 40", base=False)
def _(e: Evidence) -> DataFrame:
    names = e.table("part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), ((F.max("p_size") > 25) & (F.min("p_size") <= 25)).alias("in_both"))
    low = F.lower("name")
    rank = F.when(low == "part 1", 0).when(F.startswith(low, F.lit("part 1")), 1).when(F.contains(low, F.lit("1")), 2).otherwise(3)
    top = names.orderBy(rank, F.desc("in_both"), F.desc("n"), "name").limit(40)
    return top.withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc("in_both"), F.desc("n"), "name")))


@query("f10_preview", "SELECT collection, specimen_id, has_more FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY specimen_id) AS p, count(*) OVER (PARTITION BY collection) > 10 AS has_more FROM (SELECT DISTINCT collection, specimen_id FROM material)) WHERE p <= 10")
def _(e: Evidence) -> DataFrame:
    return paging.preview(e.material.select("collection", "specimen_id").distinct(), ["collection"], [F.asc("specimen_id")], 10).select("collection", "specimen_id", "has_more")


@query("f11_union_all", f"SELECT source, record_id FROM catalog WHERE source = 'a' AND {OVERLAP_SQL} UNION ALL SELECT source, record_id FROM catalog WHERE source = 'b' AND {OVERLAP_SQL}")
def _(e: Evidence) -> DataFrame:
    plans = [ctx.Context(source=s, interval=(9500, 9000)).apply(e.catalog).select("source", "record_id") for s in ("a", "b")]
    return plans[0].unionByName(plans[1])


@query("f12_union_distinct", "SELECT collection AS id FROM catalog UNION SELECT institution FROM catalog")
def _(e: Evidence) -> DataFrame:
    return e.catalog.select(F.col("collection").alias("id")).union(e.catalog.select("institution")).distinct()


@query("f13_common_path", "SELECT p_brand, string_agg(name, '>' ORDER BY depth DESC) AS common FROM (SELECT p_brand, name, depth, rank FROM part JOIN closure ON p_partkey = taxon_id GROUP BY p_brand, name, depth, rank, node HAVING count(*) = (SELECT count(*) FROM part q WHERE q.p_brand = part.p_brand)) GROUP BY p_brand")
def _(e: Evidence) -> DataFrame:
    parts = e.table("part").select(F.col("p_partkey").alias("taxon_id"), "p_brand")
    sizes = parts.groupBy("p_brand").agg(F.count("*").alias("parts"))
    nodes = parts.join(e.closure, "taxon_id").groupBy("p_brand", "name", "depth", "rank", "node").agg(F.count("*").alias("n"))
    common = nodes.join(sizes, "p_brand").where("n = parts").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name"))).alias("path"))  # a node a depth
    return common.select("p_brand", F.array_join(F.transform("path", lambda x: x["name"]), ">").alias("common"))


@query("f13_common_path_grouped", "WITH g AS (SELECT p_partkey, concat_ws('/', p_type, CASE WHEN p_size > 10 THEN p_brand END) AS grp FROM part), n AS (SELECT grp, count(*) AS parts FROM g GROUP BY grp) SELECT grp, string_agg(name, '>' ORDER BY depth DESC) AS common FROM (SELECT grp, name, depth, rank, count(*) AS c FROM g JOIN closure ON p_partkey = taxon_id GROUP BY grp, name, depth, rank, node) JOIN n USING (grp) WHERE c = parts GROUP BY grp")
def _(e: Evidence) -> DataFrame:
    parts = e.table("part").select(F.col("p_partkey").alias("taxon_id"), F.concat_ws("/", "p_type", F.when(F.col("p_size") > 10, F.col("p_brand"))).alias("grp"))
    sizes = parts.groupBy("grp").agg(F.count("*").alias("parts"))
    nodes = parts.join(e.closure, "taxon_id").groupBy("grp", "name", "depth", "rank", "node").agg(F.count("*").alias("n"))
    common = nodes.join(sizes, "grp").where("n = parts").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name"))).alias("path"))  # a node a depth
    return common.select("grp", F.array_join(F.transform("path", lambda x: x["name"]), ">").alias("common"))


@query("f14_differences", "SELECT id, 'missing' AS side FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events) UNION ALL SELECT id, 'surplus' FROM (SELECT user_id AS id FROM events EXCEPT SELECT c_custkey FROM customer)", base=False)
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.joins import differences

    return differences(e.table("customer").select(F.col("c_custkey").alias("id")), e.table("events").select(F.col("user_id").alias("id")))


@query("f15_nulls_last", "SELECT record_id, younger, place FROM (SELECT record_id, younger, row_number() OVER (PARTITION BY locality_id ORDER BY younger DESC NULLS LAST, record_id) AS place FROM material) WHERE place <= 3")
def _(e: Evidence) -> DataFrame:
    return paging.top_per_group(e.material.select("locality_id", "record_id", "younger"), ["locality_id"], [F.desc_nulls_last("younger"), F.asc("record_id")], 3).select("record_id", "younger", "place")
