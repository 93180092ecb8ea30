"""Discovery reads over the catalogue: listings, searches, dossiers, references, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import aggregates as agg
from palimpsest.operators import details as det
from palimpsest.operators import discover as dis
from palimpsest.operators import paging
from palimpsest.operators.context import Context
from palimpsest.operators.joins import first_sharing, tasks_for
from palimpsest.plans.catalog_queries import OVERLAP_SQL, TERMS_SQL, labels
from palimpsest.plans.fixtures import COUNTS_SQL, Evidence, days_before
from palimpsest.plans.registry import query
from palimpsest.sources.scratch import laid

_INTERVAL = (9500, 9000)


@query("j01_catalog_page", f"SELECT record_id, label, older, younger, (SELECT count(*) FROM catalog WHERE source = 'a' AND {OVERLAP_SQL}) AS total FROM catalog WHERE source = 'a' AND {OVERLAP_SQL} ORDER BY record_id LIMIT 51")
def _(e: Evidence) -> DataFrame:
    rows = Context(source="a", interval=_INTERVAL).apply(e.within(*_INTERVAL).catalog)
    return paging.keyset_page(rows.select("record_id", "label", "older", "younger"), ["record_id"], None, 50).crossJoin(rows.agg(F.count("*").alias("total")))


@query("j02_multi_source", "SELECT record_id, source, label, place, a, b FROM (SELECT record_id, source, label, row_number() OVER (PARTITION BY source ORDER BY record_id) AS place FROM catalog), (SELECT count(*) FILTER (source = 'a') AS a, count(*) FILTER (source = 'b') AS b FROM catalog) WHERE place <= 25")
def _(e: Evidence) -> DataFrame:
    n = e.catalog.agg(*[F.count(F.when(F.col("source") == s, 1)).alias(s) for s in ("a", "b")])
    return paging.top_per_group(e.catalog.select("record_id", "source", "label"), ["source"], [F.asc("record_id")], 25).drop("group_total").crossJoin(F.broadcast(n))


@query("j03_occurrence_page", "SELECT record_id, label, older FROM occurrence WHERE NOT coalesce(withheld, false) ORDER BY record_id LIMIT 51")
def _(e: Evidence) -> DataFrame:
    return paging.keyset_page(e.occurrence.where(~F.coalesce("withheld", F.lit(False))).select("record_id", "label", "older"), ["record_id"], None, 50)


def _entities(e: Evidence) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    kinds = [
        e.table("part").select(F.lit("taxon").alias("kind"), s("p_partkey").alias("id"), F.col("p_name").alias("label"), s("p_partkey").alias("key")),
        e.table("supplier").select(F.lit("locality"), s("s_suppkey"), F.col("s_name"), s("s_suppkey")),
        e.table("customer").select(F.lit("record"), s("c_custkey"), F.col("c_name"), s("c_custkey")),
        e.table("nation").select(F.lit("term"), s("n_nationkey"), F.col("n_name"), s("n_nationkey")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.union(k)
    return out


ENT_SQL = "ent AS (SELECT 'taxon' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS label FROM part UNION ALL SELECT 'locality', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'record', CAST(c_custkey AS VARCHAR), c_name FROM customer UNION ALL SELECT 'term', CAST(n_nationkey AS VARCHAR), n_name FROM nation)"
RANK_SQL = r"CASE WHEN lower(label) = '12' OR regexp_replace(lower(label), '[^\p{L}\p{N}]', '', 'g') = '12' OR id = '12' THEN 0 WHEN kind = 'record' THEN 3 WHEN starts_with(lower(label), '12') THEN 1 ELSE 2 END"


@query("j04_search", f"WITH {ENT_SQL} SELECT kind, id, label, {RANK_SQL} AS rank FROM ent WHERE contains(lower(label), '12') OR id = '12' ORDER BY rank, kind, id LIMIT 101")
def _(e: Evidence) -> DataFrame:
    found = dis.search(_entities(e), "12")
    return paging.keyset_page(found.select("rank", "kind", "id", "label"), ["rank", "kind", "id"], None, 100)


ALL_KINDS_SQL = """names AS (SELECT 'node' AS kind, node AS id, name AS label, name AS key FROM (SELECT DISTINCT node, name FROM closure) UNION ALL SELECT 'locality', CAST(s_suppkey AS VARCHAR), s_name, CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 'record', CAST(c_custkey AS VARCHAR), c_name, CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'term', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT DISTINCT 'collection', o_orderpriority, o_orderpriority, o_orderpriority FROM orders UNION ALL SELECT DISTINCT 'institution', o_orderstatus, o_orderstatus, o_orderstatus FROM orders UNION ALL SELECT 'reference', CAST(r_regionkey AS VARCHAR), r_name, CAST(r_regionkey AS VARCHAR) FROM region)"""


@query("j04_search_all_kinds", rf"""WITH {ALL_KINDS_SQL}, hit AS (SELECT *, CASE WHEN lower(label) = '1' OR regexp_replace(lower(label), '[^\p{{L}}\p{{N}}]', '', 'g') = '1' OR lower(key) = '1' THEN 0 WHEN kind = 'record' THEN 3 WHEN starts_with(lower(label), '1') THEN 1 ELSE 2 END AS rank FROM names WHERE contains(lower(label), '1') OR lower(key) = '1')
  SELECT kind, id, label, rank FROM hit WHERE kind <> 'node' UNION ALL SELECT 'taxon', CAST(taxon_id AS VARCHAR), min(p_name), min(hit.rank) FROM hit JOIN closure ON id = node JOIN part ON taxon_id = p_partkey WHERE kind = 'node' GROUP BY taxon_id""")
def _(e: Evidence) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    of = lambda kind, rows, id_, label: rows.select(F.lit(kind).alias("kind"), id_.alias("id"), label.alias("label"), id_.alias("key"))
    names = of("node", e.closure.select("node", "name").distinct(), F.col("node"), F.col("name")).withColumn("key", F.col("label"))
    for kind, table, id_, label in (("locality", "supplier", "s_suppkey", "s_name"), ("record", "customer", "c_custkey", "c_name"), ("term", "nation", "n_nationkey", "n_name"), ("reference", "region", "r_regionkey", "r_name")):
        names = names.unionByName(of(kind, e.table(table), s(id_), F.col(label)))
    for kind, column in (("collection", "o_orderpriority"), ("institution", "o_orderstatus")):
        names = names.unionByName(of(kind, e.table("orders").select(column).distinct(), F.col(column), F.col(column)))
    taxa = e.table("part").select(F.col("p_partkey").alias("taxon_id"), F.col("p_name").alias("taxon"))
    return dis.search_through(names, e.closure.select("node", "taxon_id"), taxa, "1")


@query("j05_ranking", f"WITH {ENT_SQL} SELECT {RANK_SQL} AS rank, count(*) AS n FROM ent WHERE contains(lower(label), '12') OR id = '12' GROUP BY 1")
def _(e: Evidence) -> DataFrame:
    return dis.search(_entities(e), "12").groupBy("rank").agg(F.count("*").alias("n"))


@query("j06_mentioned_ids", r"SELECT page_id, n AS doc_id, lang FROM (SELECT page_id, TRY_CAST(nullif(regexp_extract(lower(url), '\b(?:en|fr|de|es)[ :/_-]*(\d+)\b', 1), '') AS BIGINT) AS n FROM pages) JOIN documents ON doc_id = n", base=False)
def _(e: Evidence) -> DataFrame:
    named = e.table("pages").select("page_id", dis.mentioned_id(F.col("url"), ("en", "fr", "de", "es")).alias("doc_id"))
    return named.join(e.table("documents").select("doc_id", "lang"), "doc_id").select("page_id", "doc_id", "lang")


@query("j07_source_labels", "SELECT taxon_id, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM catalog GROUP BY taxon_id")
def _(e: Evidence) -> DataFrame:
    return e.catalog.groupBy("taxon_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


@query("j08_places", "SELECT lon, lat, count(*) AS localities, CAST(sum(records) AS BIGINT) AS records FROM (SELECT locality_id, lon, lat, count(*) AS records FROM catalog WHERE NOT withheld AND lon IS NOT NULL AND locality_id IS NOT NULL GROUP BY ALL) GROUP BY lon, lat")
def _(e: Evidence) -> DataFrame:
    return agg.places(e.catalog)


@query("j09_viewport_list", f"SELECT record_id, lon, lat FROM catalog WHERE source = 'b' AND lon BETWEEN -120 AND 60 AND lat BETWEEN -90 AND 70 AND NOT withheld AND older >= 300 AND younger <= 400 ORDER BY record_id LIMIT 201")
def _(e: Evidence) -> DataFrame:
    rows = Context(source="b", box=(-120, -90, 60, 70), interval=(400, 300)).apply(e.within(400, 300).catalog)
    return paging.keyset_page(rows.select("record_id", "lon", "lat"), ["record_id"], None, 200)


def _nested_sql(name: str, rows: str, most: int) -> str:
    """Of rows (key, number, text, body): the first bodies of each key as one text, how many there are, and whether there are more."""
    return f"{name} AS (SELECT key, string_agg(body, ',' ORDER BY p) FILTER (p <= {most}) AS {name}, count(*) AS {name}_total, count(*) > {most} AS {name}_has_more FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY number NULLS LAST, text NULLS LAST, body) AS p FROM ({rows})) GROUP BY key)"


def _children(*names: str) -> str:
    return ", ".join(f"coalesce({n}, '') AS {n}, coalesce({n}_total, 0) AS {n}_total, coalesce({n}_has_more, false) AS {n}_has_more" for n in names)


def _shown(*names: str) -> list:
    return [c for n in names for c in (F.coalesce(det.listed(n), F.lit("")).alias(n), F.coalesce(f"{n}_total", F.lit(0)).alias(f"{n}_total"), F.coalesce(f"{n}_has_more", F.lit(False)).alias(f"{n}_has_more"))]


@query("j10_record_detail", "WITH " + ", ".join([
    _nested_sql("evidence", "SELECT specimen_id AS key, NULL AS number, record_id AS text, concat_ws(':', record_id, label, collection, institution) AS body FROM material", 3),
    _nested_sql("ages", "SELECT DISTINCT specimen_id AS key, -older AS number, NULL AS text, coalesce(CAST(older AS VARCHAR), '-') || ':' || coalesce(CAST(younger AS VARCHAR), '-') AS body FROM material", 3),
    _nested_sql("places", "SELECT DISTINCT specimen_id AS key, NULL AS number, locality_id AS text, locality_id || ':' || CASE WHEN withheld THEN '-' ELSE CAST(lon AS VARCHAR) END || ':' || CASE WHEN withheld THEN '-' ELSE CAST(lat AS VARCHAR) END AS body FROM material", 3),
]) + f", own AS (SELECT specimen_id, min(institution) AS institution, bool_or(withheld) AS withheld FROM material GROUP BY specimen_id) SELECT specimen_id, institution, withheld, {_children('evidence', 'ages', 'places')} FROM own LEFT JOIN evidence ON specimen_id = evidence.key LEFT JOIN ages ON specimen_id = ages.key LEFT JOIN places ON specimen_id = places.key")
def _(e: Evidence) -> DataFrame:
    open_ = lambda c: F.when(~F.col("withheld"), F.col(c)).alias(c)
    rows = e.material_in(tasks_for(e.table("lineitem"))).select("specimen_id", "record_id", "label", "collection", "institution", "older", "younger", "locality_id", "withheld", open_("lon"), open_("lat"))
    text = lambda c: F.col(c).cast("string").asc()
    children = {
        "evidence": (["record_id", "label", "collection", "institution"], [F.asc_nulls_last("record_id"), F.asc("label"), F.asc("collection"), F.asc("institution")], False),
        "ages": (["older", "younger"], [F.desc_nulls_last("older"), text("younger")], True),
        "places": (["locality_id", "lon", "lat"], [F.asc_nulls_last("locality_id"), text("lon"), text("lat")], True),
    }
    own = [F.min("institution").alias("institution"), F.bool_or("withheld").alias("withheld")]
    return det.nested_alike(rows, "specimen_id", children, 3, own).select("specimen_id", "institution", "withheld", *_shown(*children))


@query("j11_entity_detail", f"SELECT institution, {COUNTS_SQL}, count(DISTINCT collection) AS collections, count(*) FILTER (NOT withheld) AS mapped FROM material GROUP BY institution")
def _(e: Evidence) -> DataFrame:
    return e.material.groupBy("institution").agg(*agg.counts(), F.count_distinct("collection").alias("collections"), F.count(F.when(~F.col("withheld"), 1)).alias("mapped"))


@query("j12_localities", f"SELECT locality_id, {COUNTS_SQL} FROM catalog WHERE {OVERLAP_SQL} AND locality_id IS NOT NULL GROUP BY locality_id ORDER BY assertions DESC, locality_id LIMIT 50")
def _(e: Evidence) -> DataFrame:
    rows = Context(interval=_INTERVAL).apply(e.within(*_INTERVAL).catalog).where("locality_id is not null")
    return rows.groupBy("locality_id").agg(*agg.counts()).orderBy(F.desc("assertions"), "locality_id").limit(50)


@query("j13_fauna", f"SELECT locality_id, taxon_id, {COUNTS_SQL.replace('count(DISTINCT taxon_id) AS taxa, ', '')} FROM catalog GROUP BY locality_id, taxon_id")
def _(e: Evidence) -> DataFrame:
    return e.catalog.groupBy("locality_id", "taxon_id").agg(*[c for i, c in enumerate(agg.counts()) if i != 2])


DOSSIER_SQL = f"""WITH {TERMS_SQL}, lt AS (SELECT DISTINCT locality_id, taxon_id FROM material),
  rel AS (SELECT locality_id, string_agg(related, ',' ORDER BY related) AS related FROM (SELECT *, row_number() OVER (PARTITION BY locality_id ORDER BY related) AS p FROM (SELECT DISTINCT x.locality_id, y.locality_id AS related FROM lt x JOIN lt y ON x.taxon_id = y.taxon_id AND x.locality_id <> y.locality_id)) WHERE p <= 12 GROUP BY locality_id),
  trm AS (SELECT locality_id, string_agg(namespace || '=' || term || ':' || n, ',' ORDER BY namespace || '=' || term || ':' || n) AS terms FROM (SELECT locality_id, namespace, term, count(*) AS n FROM material JOIN terms USING (record_id) GROUP BY ALL) GROUP BY locality_id),
  {_nested_sql("intervals", "SELECT locality_id AS key, -older AS number, label AS text, concat_ws(':', label, coalesce(CAST(older AS VARCHAR), '-'), coalesce(CAST(younger AS VARCHAR), '-'), count(*)) AS body FROM material GROUP BY locality_id, label, older, younger", 30)},
  {_nested_sql("custody", "SELECT locality_id AS key, NULL AS number, collection || '/' || institution AS text, concat_ws(':', collection, institution, count(*)) AS body FROM material GROUP BY locality_id, collection, institution", 30)},
  c AS (SELECT locality_id, {COUNTS_SQL} FROM material GROUP BY locality_id) SELECT c.*, terms, related, {_children("intervals", "custody")} FROM c LEFT JOIN trm USING (locality_id) LEFT JOIN rel USING (locality_id) LEFT JOIN intervals ON locality_id = intervals.key LEFT JOIN custody ON locality_id = custody.key"""


def _dossiers(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per locality: counts, facet counts of its terms, the first twelve localities that share a taxon, interpreted intervals and custody."""
    facets = rows.select("locality_id", F.explode(labels()).alias("t")).where("t.term is not null").groupBy("locality_id", "t.namespace", "t.term").agg(F.count("*").alias("n"))
    facet = F.concat_ws(":", F.concat_ws("=", "namespace", "term"), F.col("n").cast("string"))
    listed = facets.groupBy("locality_id").agg(F.array_join(F.array_sort(F.collect_list(facet)), ",").alias("terms"))
    related = pairs.groupBy("locality_id").agg(F.array_join(F.array_sort(F.collect_list("related")), ",").alias("related"))
    intervals = rows.groupBy("locality_id", "label", "older", "younger").agg(F.count("*").alias("n"))
    custody = rows.groupBy("locality_id", "collection", "institution").agg(F.count("*").alias("n"))
    children = det.nested({
        "intervals": det.child(intervals, "locality_id", ["label", "older", "younger", "n"], number=-F.col("older"), text=F.col("label")),
        "custody": det.child(custody, "locality_id", ["collection", "institution", "n"], text=F.concat_ws("/", "collection", "institution")),
    }, 30).withColumnRenamed("key", "locality_id")
    counts = rows.groupBy("locality_id").agg(*agg.counts())
    return counts.join(listed, "locality_id", "left").join(related, "locality_id", "left").join(children, "locality_id", "left").select(*counts.columns, "terms", "related", *_shown("intervals", "custody"))


@query("j14_dossier_live", DOSSIER_SQL + " WHERE locality_id = 's3'")
def _(e: Evidence) -> DataFrame:
    pairs = first_sharing(e.material, "locality_id", "taxon_id", 12).where("locality_id = 's3'")
    return _dossiers(e.material.where("locality_id = 's3'"), pairs)


@query("j15_dossiers", DOSSIER_SQL)
def _(e: Evidence) -> DataFrame:
    tasks = max(tasks_for(e.table("lineitem")), int(e.spark.conf.get("spark.sql.shuffle.partitions")))
    # records are derived once and lie by locality: counts, terms, intervals, custody and what shares a taxon shuffle none of them
    rows = laid(e.material.select("locality_id", "specimen_id", "taxon_id", "collection", "institution", "older", "younger", "label", "l_returnflag", "l_linestatus", "p_type"), "dossiers", "locality_id", tasks)
    return _dossiers(rows, first_sharing(rows, "locality_id", "taxon_id", 12))


@query("j16_taxon_summary", "SELECT node, rank, name, count(*) AS assertions, count(DISTINCT specimen_id) AS specimens FROM catalog JOIN closure USING (taxon_id) GROUP BY node, rank, name")
def _(e: Evidence) -> DataFrame:
    return agg.ancestor_rollup_corrected(e.catalog, e.closure).join(e.closure.select("node", "rank", "name").distinct(), "node")


@query("j17_references", "SELECT 'identification' AS role, o_custkey AS subject, o_orderkey AS reference FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'collection', o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' UNION SELECT 'material', o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'", base=False)
def _(e: Evidence) -> DataFrame:
    o = e.table("orders")
    both = o.join(e.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pick = lambda df, role, ref: df.select(F.lit(role).alias("role"), F.col("o_custkey").alias("subject"), F.col(ref).alias("reference"))
    return pick(o.where("o_orderstatus = 'F'"), "identification", "o_orderkey").union(pick(both.where("l_returnflag = 'A'"), "collection", "l_partkey")).union(pick(both.where("l_returnflag = 'R'"), "material", "l_suppkey")).distinct()


@query("j18_inspection", "WITH " + ", ".join([
    _nested_sql("history", "SELECT record AS key, epoch(seen_at) AS number, NULL AS text, concat_ws(':', event_type, seq) AS body FROM revisions", 20),
    _nested_sql("ages", "SELECT user_id AS key, -max(older) AS number, collection AS text, concat_ws(':', collection, max(older), min(younger)) AS body FROM (SELECT user_id, event_type AS collection, date_diff('day', CAST(ts AS DATE), DATE '2025-01-01') AS older, date_diff('day', CAST(ts AS DATE), DATE '2025-01-01') AS younger FROM events) GROUP BY user_id, collection", 20),
    _nested_sql("materials", "SELECT o_custkey AS key, o_orderkey AS number, l_linenumber AS text, concat_ws(':', o_orderkey, l_linenumber, l_returnflag) AS body FROM orders JOIN lineitem ON o_orderkey = l_orderkey", 20),
    _nested_sql("refs", "SELECT DISTINCT o_custkey AS key, NULL AS number, o_orderpriority AS text, o_orderpriority AS body FROM orders WHERE o_orderstatus = 'F'", 20),
]) + f", own AS (SELECT record, count(*) AS revisions, count(DISTINCT content_hash) AS versions FROM revisions GROUP BY record) SELECT record, revisions, versions, {_children('history', 'ages', 'materials', 'refs')} FROM own LEFT JOIN history ON record = history.key LEFT JOIN ages ON record = ages.key LEFT JOIN materials ON record = materials.key LEFT JOIN refs ON record = refs.key")
def _(e: Evidence) -> DataFrame:
    day = e.table("events").withColumn("days", days_before("ts")).groupBy("user_id", "event_type").agg(F.max("days").alias("older"), F.min("days").alias("younger"))
    orders = e.table("orders").join(e.versions.select("record").distinct(), F.col("o_custkey") == F.col("record"), "left_semi")  # what no record shows meets no lines
    n = tasks_for(e.table("lineitem"))
    lines = orders.repartition(n, "o_orderkey").join(e.table("lineitem").repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    children = det.nested({
        "history": det.child(e.versions, "record", ["event_type", "seq"], number=F.col("seen_at").cast("timestamp").cast("double")), "ages": det.child(day, "user_id", ["event_type", "older", "younger"], number=-F.col("older"), text=F.col("event_type")),
        "materials": det.child(lines, "o_custkey", ["o_orderkey", "l_linenumber", "l_returnflag"], number=F.col("o_orderkey"), text=F.col("l_linenumber")),
        "refs": det.child(orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").distinct(), "o_custkey", ["o_orderpriority"], text=F.col("o_orderpriority")),
    }, 20)
    own = e.versions.groupBy("record").agg(F.count("*").alias("revisions"), F.count_distinct("content_hash").alias("versions"))
    return own.join(children.withColumnRenamed("key", "record"), "record", "left").select("record", "revisions", "versions", *_shown("history", "ages", "materials", "refs"))


@query("j19_place_context", "SELECT locality_id, arg_min(collection, record_id) AS collection, min(record_id) AS record_id FROM catalog GROUP BY locality_id")
def _(e: Evidence) -> DataFrame:
    return e.catalog.groupBy("locality_id").agg(F.min_by("collection", "record_id").alias("collection"), F.min("record_id").alias("record_id"))


@query("j20_places_of_taxon", "SELECT locality_id, count(*) AS records FROM catalog WHERE taxon_id IN (SELECT taxon_id FROM closure WHERE rank = 'kingdom' AND name = (SELECT min(p_type) FROM part)) AND locality_id IS NOT NULL GROUP BY locality_id")
def _(e: Evidence) -> DataFrame:
    first = e.table("part").agg(F.min("p_type").alias("name"))
    members = e.closure.where("rank = 'kingdom'").join(F.broadcast(first), "name", "left_semi").select("taxon_id")
    return e.catalog.where("locality_id is not null").join(members, "taxon_id", "left_semi").groupBy("locality_id").agg(F.count("*").alias("records"))


@query("j21_specimens_of_place", "SELECT DISTINCT specimen_id, collection FROM material WHERE locality_id = 's3'")
def _(e: Evidence) -> DataFrame:
    return Context(locality="s3").apply(e.material).select("specimen_id", "collection").distinct()


@query("j22_grid", "SELECT CAST(floor(lon / 30) AS BIGINT) AS x, CAST(floor(lat / 30) AS BIGINT) AS y, count(*) AS records FROM catalog WHERE lon IS NOT NULL GROUP BY 1, 2")
def _(e: Evidence) -> DataFrame:
    return dis.grid(e.catalog.where("lon is not null"), 30)


@query("j23_viewports", """WITH v AS (SELECT n_nationkey AS id, (n_nationkey*37)%360-180 AS west, -60 AS south, ((n_nationkey*37)%360-180 + 80 + 180) % 360 - 180 AS east, 20 + n_nationkey AS north FROM nation),
  o AS (SELECT *, ((west - 20 + 180) % 360 + 360) % 360 - 180 AS ow, ((east + 20 + 180) % 360 + 360) % 360 - 180 AS oe, greatest(-90, south - (north - south) * 0.25) AS os, least(90, north + (north - south) * 0.25) AS onn FROM v),
  at AS (SELECT lon, lat, count(*) AS n FROM catalog WHERE NOT withheld AND lon IS NOT NULL GROUP BY lon, lat)
  SELECT id, CAST(sum(CASE WHEN lat BETWEEN south AND north AND CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END THEN n ELSE 0 END) AS BIGINT) AS inside, CAST(sum(n) AS BIGINT) AS near FROM o JOIN "at" ON lat BETWEEN os AND onn AND CASE WHEN ow <= oe THEN lon BETWEEN ow AND oe ELSE lon >= ow OR lon <= oe END GROUP BY id""".replace("  at AS", '  "at" AS'))
def _(e: Evidence) -> DataFrame:
    west = (F.col("n_nationkey") * 37) % 360 - 180
    views = e.table("nation").select(F.col("n_nationkey").alias("id"), west.alias("west"), F.lit(-60).alias("south"), ((west + 260) % 360 - 180).alias("east"), (F.col("n_nationkey") + 20).alias("north"))
    return dis.in_viewports(e.catalog, views)
