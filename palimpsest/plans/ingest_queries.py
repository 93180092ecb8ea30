"""Ingestion, normalization, time interpretation and entity assembly over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import intervals as iv
from palimpsest.functions import normalize as nz
from palimpsest.operators import ingest as ing
from palimpsest.operators.aggregates import content_mark
from palimpsest.plans.fixtures import Evidence
from palimpsest.plans.registry import query
from palimpsest.sources.scratch import scratch


@query("a03_count_contract", "SELECT o_orderkey AS file, found, returned, records, CASE WHEN returned <> records THEN 'returned' WHEN found < returned THEN 'found' ELSE 'incomplete' END AS reason FROM (SELECT o_orderkey, max(l_linenumber) AS found, count(DISTINCT l_linenumber) AS returned, count(*) AS records, o_orderstatus = 'O' AS limit_all FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) WHERE returned <> records OR found < returned OR (limit_all AND found <> returned)", base=False)
def _(e: Evidence) -> DataFrame:
    lines = e.table("lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.max("l_linenumber").alias("found"), F.count_distinct("l_linenumber").alias("returned"), F.count("*").alias("n"))
    files = e.table("orders").groupBy(F.col("o_orderkey").alias("file"), (F.col("o_orderstatus") == "O").alias("limit_all")).agg(F.count("*").alias("m"))
    env = files.join(lines, "file").select("file", "limit_all", "found", "returned", (F.col("m") * F.col("n")).alias("records"))
    return ing.count_contract(env).drop("limit_all")


@query("a05_census", "SELECT c_custkey AS id, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT user_id, 'duplicate' FROM events GROUP BY user_id HAVING count(*) > 1", base=False)
def _(e: Evidence) -> DataFrame:
    return ing.census(e.table("customer").select(F.col("c_custkey").alias("id")), e.table("events").select(F.col("user_id").alias("id")))


@query("a06_scope", "SELECT count(*) FILTER (lower(trim(event_type)) = 'click') AS kept, count(*) FILTER (lower(trim(event_type)) <> 'click') AS skipped FROM events", base=False)
def _(e: Evidence) -> DataFrame:
    keep = ing.in_scope(F.col("event_type"), " Click ")
    return e.table("events").agg(F.count(F.when(keep, 1)).alias("kept"), F.count(F.when(~keep, 1)).alias("skipped"))


@query("a07_sample", "SELECT event_id FROM events WHERE value > 10 ORDER BY event_id LIMIT 100", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("events").where("value > 10").orderBy("event_id").limit(100).select("event_id")


_REASON_SQL = "CASE WHEN l_shipdate < o_orderdate THEN 'reversed' WHEN l_quantity > 49 THEN 'quantity' END"


@query("a08_quarantine", f"""WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS id, {_REASON_SQL} AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT (SELECT count(*) FROM m WHERE reason IS NULL) AS accepted, (SELECT count(*) FROM m WHERE reason IS NOT NULL) AS failed, 'partial' AS status,
  (SELECT string_agg(id || ':' || reason, ',' ORDER BY id, reason) FROM (SELECT DISTINCT id, reason FROM m WHERE reason IS NOT NULL ORDER BY id, reason LIMIT 20)) AS messages""", base=True)
def _(e: Evidence) -> DataFrame:
    rows = e.table("lineitem").join(e.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    good, bad = ing.quarantine(rows, F.when(F.col("l_shipdate") < F.col("o_orderdate"), "reversed").when(F.col("l_quantity") > 49, "quantity"))
    shown = ing.run_report(bad.select("id", "reason").distinct(), "id", good)
    return shown.drop("failed").crossJoin(bad.agg(F.count("*").alias("failed"))).select("accepted", "failed", "status", "messages")


@query("a09_first_wins", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS repeat FROM events", base=False)
def _(e: Evidence) -> DataFrame:
    return ing.first_wins(e.table("events"), "user_id", "event_id").select("event_id", "repeat")


@query("a10_conflicts", "SELECT record, count(DISTINCT content_hash) AS versions FROM revisions GROUP BY record HAVING count(DISTINCT content_hash) > 1")
def _(e: Evidence) -> DataFrame:
    return ing.conflicts(e.revisions, "record", "content_hash")


@query("a11_merged_views", "SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS conflict, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS views FROM orders GROUP BY o_custkey", base=False)
def _(e: Evidence) -> DataFrame:
    return ing.merged_views(e.table("orders"), "o_custkey", ["o_orderstatus"], "o_orderpriority").withColumn("views", F.array_join("views", ","))


def _versions(e: Evidence) -> tuple[DataFrame, DataFrame]:
    c = e.table("customer").select("c_custkey", "c_name", "c_nationkey", F.lit(1).alias("first_run"))
    new = c.where("c_custkey % 3 != 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))).withColumn("first_run", F.lit(2))
    return c.where("c_custkey % 4 != 0"), new


_OLD_SQL = "old_v AS (SELECT c_custkey, c_name, c_nationkey, 1 AS first_run FROM customer WHERE c_custkey % 4 <> 0), new_v AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, 2 AS first_run FROM customer WHERE c_custkey % 3 <> 0)"


@query("a12_upsert", f"WITH {_OLD_SQL} SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, coalesce(o.first_run, n.first_run) AS first_run FROM old_v o FULL JOIN new_v n USING (c_custkey)")
def _(e: Evidence) -> DataFrame:
    return ing.upsert(*_versions(e), "c_custkey", keep=("first_run",))


@query("a13_insert_only", f"WITH {_OLD_SQL} SELECT * FROM old_v UNION ALL SELECT * FROM new_v WHERE c_custkey NOT IN (SELECT c_custkey FROM old_v)")
def _(e: Evidence) -> DataFrame:
    return ing.insert_only(*_versions(e), ["c_custkey"])


@query("a14_change_aware", f"WITH {_OLD_SQL} SELECT n.c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'insert' ELSE 'update' END AS action FROM new_v n LEFT JOIN old_v o USING (c_custkey) WHERE o.c_custkey IS NULL OR n.c_name IS DISTINCT FROM o.c_name OR n.c_nationkey IS DISTINCT FROM o.c_nationkey")
def _(e: Evidence) -> DataFrame:
    return ing.changed_rows(*_versions(e), "c_custkey", ignore=("first_run",))


@query("a15_classify", "SELECT record, CASE WHEN b.record IS NULL THEN 'inserted' WHEN b.h = a.h THEN 'unchanged' ELSE 'updated' END AS change FROM (SELECT record, max(content_hash) AS h FROM revisions WHERE seq % 2 = 1 GROUP BY record) a LEFT JOIN (SELECT record, max(content_hash) AS h FROM revisions WHERE seq % 2 = 0 GROUP BY record) b USING (record)")
def _(e: Evidence) -> DataFrame:
    of = lambda k: e.revisions.where(F.col("seq") % 2 == k).groupBy("record").agg(F.max("content_hash").alias("h"))
    return ing.classify(of(0), of(1), "record", "h")


@query("a16_retire", "SELECT c_custkey, c_custkey IN (SELECT user_id FROM events) AS is_current FROM customer", base=False)
def _(e: Evidence) -> DataFrame:
    return ing.retire(e.table("customer").select("c_custkey"), e.table("events").select(F.col("user_id").alias("c_custkey")), "c_custkey", complete=True)


@query("a17_revision_history", "SELECT record, content_hash, min(seq) AS first_seen, max(seq) AS last_seen FROM revisions GROUP BY ALL")
def _(e: Evidence) -> DataFrame:
    return ing.revision_history(e.revisions, "record", "content_hash", "seq")


@query("a18_run_audit", f"""WITH {_OLD_SQL}, o AS (SELECT * FROM old_v WHERE c_custkey % 97 <> 0), n AS (SELECT * FROM new_v WHERE c_custkey % 97 <> 0),
  first AS (SELECT (SELECT count(*) FROM old_v) AS read, (SELECT count(*) FROM o) AS inserted), c AS (SELECT (SELECT count(*) FROM new_v) AS read, count(*) AS accepted, count(*) FILTER (o.c_custkey IS NULL) AS inserted, count(*) FILTER (o.c_custkey IS NOT NULL AND n.c_nationkey <> o.c_nationkey) AS updated, count(*) FILTER (n.c_nationkey = o.c_nationkey) AS unchanged FROM n LEFT JOIN o USING (c_custkey))
  SELECT '1' AS run, read, inserted AS accepted, read - inserted AS failed, inserted, 0 AS updated, 0 AS unchanged, 0 AS skipped, 'partial' AS status FROM first UNION ALL SELECT '2', read, accepted, read - accepted, inserted, updated, unchanged, 0, 'partial' FROM c
  UNION ALL SELECT '3', read, 0, 0, 0, 0, 0, read, 'replayed' FROM c UNION ALL SELECT '4', 0, 0, 0, 0, 0, 0, 0, 'empty'""")
def _(e: Evidence) -> DataFrame:
    path = scratch(e.spark, "audit")
    old, new = (v.select("c_custkey", F.md5(F.col("c_nationkey").cast("string")).alias("h")) for v in _versions(e))
    reason = F.when(F.col("c_custkey") % 97 == 0, "not wanted")
    known = ing.audited_run(path, "1", old.where("false"), old, "c_custkey", "h", reason)
    published = ing.upsert(known, ing.audited_run(path, "2", known, new, "c_custkey", "h", reason), "c_custkey")
    ing.audited_run(path, "3", published, new, "c_custkey", "h", reason)
    ing.audited_run(path, "4", published, new.where("false"), "c_custkey", "h", reason)
    return ing.runs(e.spark, path).drop("digest")


@query("a20_population_control", "SELECT kind, n, declared FROM (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1) FULL JOIN (SELECT event_type AS kind, count(*) AS declared FROM events WHERE event_id % 2 = 0 OR event_type < 'd' GROUP BY 1) USING (kind) WHERE n IS DISTINCT FROM declared", base=False)
def _(e: Evidence) -> DataFrame:
    ev = e.table("events").withColumn("kind", F.col("event_type"))
    return ing.population_control(ev, ev.where("event_id % 2 = 0 or event_type < 'd'").groupBy("kind").agg(F.count("*").alias("declared")))


@query("a21_dimension", "SELECT n_nationkey AS id, n_name AS name, r_name AS parent_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 1000, r_name, NULL FROM region", base=False)
def _(e: Evidence) -> DataFrame:
    r = e.table("region")
    units = e.table("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_name"))
    return units.unionByName(r.select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_name")))


@query("a22_levels", ", up AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), lv AS (SELECT node, 0 AS level FROM up WHERE parent IS NULL UNION ALL SELECT u.node, l.level + 1 FROM up u JOIN lv l ON u.parent = l.node) SELECT up.node, level FROM up LEFT JOIN lv USING (node)")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.hierarchy import levels

    return levels(e.table("part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent")))


@query("a24_exact_replay", "WITH d AS (SELECT record % 8 AS part, count(*) FILTER (is_current) AS n FROM revisions GROUP BY record % 8) SELECT part, part % 2 = 0 AS replayed, CASE WHEN part % 2 = 0 THEN 0 ELSE n END AS mutations FROM d")
def _(e: Evidence) -> DataFrame:
    part = (F.col("record") % 8).alias("part")
    latest = e.revisions.where("is_current").select("record", "content_hash")
    snapshot = latest.withColumn("content_hash", F.when(F.col("record") % 2 == 0, F.col("content_hash")).otherwise(F.md5("content_hash")))  # odd parts have changed
    digest = content_mark(F.concat_ws(":", "record", "content_hash")).alias("digest")
    audit = latest.groupBy(part).agg(digest)  # the digests of the parts that a run has applied
    state = snapshot.groupBy(part).agg(digest).join(audit.withColumn("replayed", F.lit(True)), ["part", "digest"], "left").select("part", F.coalesce("replayed", F.lit(False)).alias("replayed"))
    fresh = snapshot.withColumn("part", part).join(state.where("not replayed"), "part", "left_semi")
    changed = ing.changed_rows(latest, fresh.select("record", "content_hash"), "record").groupBy(part).agg(F.count("*").alias("n"))
    return state.join(changed, "part", "left").select("part", "replayed", F.coalesce("n", F.lit(0)).cast("bigint").alias("mutations"))


# column functions


@query("b01_text_or_null", "SELECT doc_id, nullif(trim(text), '') AS t FROM documents", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("documents").select("doc_id", nz.text_or_null(F.col("text")).alias("t"))


@query("b01_text_or_null_whole", "SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, nullif(trim(text), '') AS t FROM documents)", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("documents").select("doc_id", nz.text_or_null(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("b02_finite", "SELECT event_id, CAST(round(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END * 100) AS BIGINT) AS x FROM events", base=False)
def _(e: Evidence) -> DataFrame:
    raw = F.when(F.col("event_id") % 14 == 0, "NaN").when(F.col("event_id") % 7 == 0, "x1").otherwise(F.col("value").cast("string"))
    return e.table("events").select("event_id", F.round(nz.finite_number(raw) * 100).cast("bigint").alias("x"))


@query("b03_decimal", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS v, event_id % 5 = 0 AND event_id % 10 <> 0 AS invalid FROM events", base=False)
def _(e: Evidence) -> DataFrame:
    raw = F.when(F.col("event_id") % 10 == 0, " ").when(F.col("event_id") % 5 == 0, "true").otherwise(F.get_json_object("props", "$.k"))
    return e.table("events").select("event_id", nz.strict_decimal(raw).alias("d")).select("event_id", F.col("d.value").cast("bigint").alias("v"), F.col("d.invalid").alias("invalid"))


@query("b04_typed_id", "SELECT event_id, CASE WHEN event_id % 3 = 1 OR event_id % 3 = 2 AND user_id % 2 = 0 THEN nullif(user_id, 0) END AS id, event_id % 3 = 0 AS optional_invalid FROM events WHERE user_id > 0", base=False)
def _(e: Evidence) -> DataFrame:
    prefix = F.when(F.col("event_id") % 3 == 1, "txn:").when((F.col("event_id") % 3 == 2) & (F.col("user_id") % 2 == 0), "var:").when(F.col("event_id") % 3 == 0, "col:")
    raw = F.when(prefix.isNull(), "0").otherwise(F.concat(prefix, F.col("user_id").cast("string")))
    got = nz.optional_id(raw, "var", "txn")
    return e.table("events").where("user_id > 0").select("event_id", got["value"].alias("id"), got["invalid"].alias("optional_invalid"))


_STATUS_SQL = "CASE WHEN c_acctbal < 0 THEN 'withheld' WHEN c_nationkey = 3 THEN 'missing' WHEN c_nationkey * 37 - 180 > 180 THEN 'out-of-range' WHEN c_custkey % 5 = 0 THEN 'unsupported-datum' ELSE 'published' END"


@query("b05_position", f"SELECT c_custkey, {_STATUS_SQL} AS status, CASE WHEN {_STATUS_SQL} = 'published' THEN c_nationkey * 37 - 180 END AS lon FROM customer", base=False)
def _(e: Evidence) -> DataFrame:
    lon = F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") * 37 - 180)
    status = nz.position_status(F.col("c_acctbal") < 0, lon, F.lit(0), F.when(F.col("c_custkey") % 5 != 0, "WGS84"))
    return e.table("customer").select("c_custkey", status.alias("status"), F.when(status == "published", lon).alias("lon"))


@query("b06_position_unverified", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'missing' WHEN c_nationkey * 37 - 180 > 180 THEN 'out-of-range' ELSE 'datum-unverified' END AS status FROM customer", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("customer").select("c_custkey", nz.unverified_position(F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") * 37 - 180), F.lit(0)).alias("status"))


@query("b07_warnings", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey > 20 THEN 'remote' END) AS warnings FROM customer", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("customer").select("c_custkey", F.array_join(nz.warnings((F.col("c_acctbal") < 0, "negative"), (F.col("c_nationkey") > 20, "remote")), ",").alias("warnings"))


@query("b08_zoned_time", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS seconds, event_id % 2 = 1 AS verbatim_only FROM events", base=False)
def _(e: Evidence) -> DataFrame:
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    got = nz.zoned_timestamp(raw)
    return e.table("events").select("event_id", F.unix_timestamp(got["value"]).alias("seconds"), got["verbatim_only"].alias("verbatim_only"))


@query("b09_some_keys", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'brand=' || p_brand || ',type=' || p_type ELSE 'type=' || p_type END AS kept FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    m = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" "), F.lit("name"), F.col("p_name"))
    entries = F.array_sort(F.transform(F.map_entries(nz.some_keys(m, ["brand", "type"])), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return e.table("part").select("p_partkey", F.array_join(entries, ",").alias("kept"))


@query("b10_validity", "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND p_type IN ('SMALL', 'LARGE', 'STANDARD')", base=False)
def _(e: Evidence) -> DataFrame:
    ident = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name"))
    return ing.quarantine(e.table("part"), F.when(nz.text_or_null(ident).isNull(), "id").when(~F.col("p_type").isin("SMALL", "LARGE", "STANDARD"), "basis"))[0].select("p_partkey")


@query("b11_content_hash", "SELECT c_custkey, sha256('=' || c_custkey || chr(1) || '=' || c_name || chr(1) || CASE WHEN c_nationkey > 9 THEN '=' || c_nationkey ELSE '-' END) AS content_hash FROM customer", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("customer").select("c_custkey", nz.content_hash(F.col("c_custkey"), F.col("c_name"), F.when(F.col("c_nationkey") > 9, F.col("c_nationkey"))).alias("content_hash"))


def _uuid_sql(h: str) -> str:
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '4' || substr({h}, 14, 3), '8' || substr({h}, 18, 3), substr({h}, 21, 12))"


@query("b12_stable_id", f"SELECT c_custkey, {_uuid_sql('h')} AS id FROM (SELECT c_custkey, sha256('d' || chr(1) || 'customer' || chr(1) || c_custkey) AS h FROM customer)", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("customer").select("c_custkey", nz.stable_id(F.lit("d"), F.lit("customer"), F.col("c_custkey").cast("string")).alias("id"))


@query("b13_text_id", f"SELECT p_partkey, {_uuid_sql('h')} AS id FROM (SELECT p_partkey, md5(p_name) AS h FROM part)", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("part").select("p_partkey", nz.text_id(F.col("p_name")).alias("id"))


@query("b14_path_id", "SELECT count(DISTINCT p_type || chr(1) || p_brand || chr(1) || (p_size % 2)) AS ids FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("part").agg(F.count_distinct(nz.path_id(F.concat_ws("\u0001", "p_type", "p_brand"), (F.col("p_size") % 2).cast("string"))).alias("ids"))


@query("b15_plain_name", r"SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '  X ', '\s+', ' ', 'g'))) AS name FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("part").select("p_partkey", nz.plain_name(F.concat(F.lit("  "), "p_name", F.lit("  X "))).alias("name"))


@query("b15_folded_name", r"SELECT p_partkey, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) || CASE p_partkey % 4 WHEN 0 THEN ' fish' WHEN 1 THEN ' strasse' WHEN 2 THEN ' ab 12' ELSE '' END AS name FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    k = F.col("p_partkey") % 4
    odd = F.when(k == 0, "  \ufb01SH").when(k == 1, " Stra\u00dfe\t").when(k == 2, "\u00a0\uff21\uff22 \u2460\u2461").otherwise(" ")
    rows = e.table("part").select("p_partkey", F.concat("p_name", odd).alias("given"))
    return nz.folded_names(rows, "given", "name").select("p_partkey", "name")


@query("b16_qualified", r"SELECT p_partkey, p_partkey % 3 < 2 AS qualified FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " cf. X").when(F.col("p_partkey") % 3 == 1, "?").otherwise(" spider"))
    return e.table("part").select("p_partkey", nz.is_qualified(name).alias("qualified"))


@query("b17_inferred_rank", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kingdom' WHEN p_partkey % 3 = 1 THEN 'family' END AS rank FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("nothing")
    return e.table("part").select("p_partkey", nz.inferred_rank(name, [("kingdom", F.col("p_type")), ("family", F.col("p_brand"))]).alias("rank"))


@query("b18_display_name", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' (' || p_type || ')' ELSE p_name END AS name FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("part").select("p_partkey", nz.qualified_name(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" ")).alias("name"))


@query("b19_search_text", r"SELECT p_partkey, j || ' ' || regexp_replace(j, '[^\p{L}\p{N}]', '', 'g') AS search FROM (SELECT p_partkey, lower(concat_ws(' ', p_name, p_brand, p_type)) AS j FROM part)", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("part").select("p_partkey", nz.search_text(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("search"))


@query("b20_public_place", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS country, CASE WHEN c_custkey % 7 <> 0 AND c_acctbal >= 0 THEN c_mktsegment END AS county FROM customer JOIN nation ON c_nationkey = n_nationkey", base=False)
def _(e: Evidence) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("county"))))
    got = nz.public_place(raw, F.col("c_acctbal") < 0)
    return e.table("customer").join(F.broadcast(e.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", got["country"].alias("country"), got["county"].alias("county"))


@query("b21_author", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type || ' ' || p_name ELSE p_name END AS author FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("part").select("p_partkey", nz.author(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("  "), F.col("p_name"), F.lit(None).cast("string")).alias("author"))


@query("b22_envelope", "SELECT s_suppkey, concat_ws(',', CASE WHEN s_acctbal < 0 THEN 'negative-older' END, CASE WHEN s_acctbal < 100 * s_nationkey THEN 'reversed' END) AS problems FROM supplier", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("supplier").select("s_suppkey", F.array_join(nz.envelope_problems(F.col("s_acctbal"), F.col("s_nationkey") * 100.0), ",").alias("problems"))


@query("b23_measurements", "SELECT l_orderkey AS specimen, l_linestatus AS kind, CAST(sum(CAST(round(l_quantity*100) AS BIGINT)) AS BIGINT) AS hundredths, count(*) AS n FROM lineitem GROUP BY ALL", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("lineitem").groupBy(F.col("l_orderkey").alias("specimen"), F.col("l_linestatus").alias("kind")).agg(F.sum(F.round(F.col("l_quantity") * 100).cast("bigint")).alias("hundredths"), F.count("*").alias("n"))


_RECORDS_B23 = {
    "measurement": "SELECT 'measurement' AS kind, CASE WHEN l_orderkey > 0 THEN l_orderkey END AS id, CASE WHEN l_linenumber % 5 = 0 THEN 'average=invalid' ELSE 'average=' || CAST(l_quantity AS DECIMAL(18,2)) END || '|max=' || CAST(l_tax AS DECIMAL(18,2)) || '|min=-|' || l_linestatus AS fields, l_linenumber % 5 = 0 OR l_orderkey = 0 AS invalid FROM lineitem",
    "material": "SELECT 'material', CASE WHEN o_orderkey > 0 THEN o_orderkey END, coalesce(CAST(nullif(o_custkey, 0) AS VARCHAR), '-') || '|' || o_orderstatus, o_orderkey = 0 OR o_custkey = 0 FROM orders",
    "opinion": "SELECT 'opinion', CASE WHEN s_suppkey > 0 THEN s_suppkey END, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN CAST(nullif(s_nationkey, 0) AS VARCHAR) END, '-') || '|' || s_name, s_suppkey = 0 FROM supplier",
    "reference": "SELECT 'reference', CASE WHEN n_nationkey > 0 THEN n_nationkey END, n_name || '|Doe|Roe', n_nationkey = 0 FROM nation",
    "taxon": "SELECT 'taxon', CASE WHEN p_partkey > 0 THEN p_partkey END, p_name || '|' || coalesce(CAST(CASE WHEN p_partkey % 3 = 1 THEN p_size END AS VARCHAR), '-'), p_partkey = 0 OR p_partkey % 3 = 2 FROM part",
}


@query("b23_normalized_records", " UNION ALL ".join(_RECORDS_B23.values()), base=False)
def _(e: Evidence) -> DataFrame:
    ident = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))

    def rows(kind: str, table: str, made: Column, fields: Column) -> DataFrame:
        return e.table(table).withColumn("r", made).select(F.lit(kind).alias("kind"), "r.id", fields.alias("fields"), "r.invalid")

    measured = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    value = lambda key: F.when(F.array_contains("r.faults", key), "invalid").otherwise(text(F.col("r.values")[key].cast("decimal(18,2)")))
    out = rows(
        "measurement", "lineitem", nz.measurement_record(ident("mea", "l_orderkey"), ident("spm", "l_orderkey"), F.col("l_linestatus"), {"average": F.when(F.col("l_linenumber") % 5 == 0, "about 3").otherwise(measured("l_quantity")), "max": measured("l_tax"), "min": F.lit(" ")}, F.lit("mm")),
        F.concat(F.lit("average="), value("average"), F.lit("|max="), value("max"), F.lit("|min="), value("min"), F.lit("|"), F.col("r.kind")),
    )
    t = F.col("p_partkey") % 3
    for more in (
        rows("material", "orders", nz.material_record(ident("spm", "o_orderkey"), ident("occ", "o_custkey"), F.lit(None), F.lit("0"), F.col("o_orderstatus"), F.lit("")), F.concat(text(F.col("r.occurrence")), F.lit("|"), F.col("r.label"))),
        rows("opinion", "supplier", nz.opinion_record(ident("opn", "s_suppkey"), F.lit(None), F.lit(None), F.when((F.col("s_nationkey") % 2 == 0) & (F.col("s_nationkey") > 0), ident("txn", "s_nationkey")), F.col("s_name"), F.lit("0")), F.concat(text(F.col("r.parent")), F.lit("|"), F.col("r.status"))),
        rows("reference", "nation", nz.reference_record(ident("ref", "n_nationkey"), F.col("n_name"), F.lit(None), F.lit("1999"), {"author2": F.lit("Roe"), "author1": F.lit("Doe"), "editor": F.lit("x")}), F.concat("r.title", F.lit("|"), F.array_join(F.map_values(F.map_from_entries(F.array_sort(F.map_entries("r.authors")))), "|"))),
        rows("taxon", "part", nz.taxon_name_record(ident("txn", "p_partkey"), F.lit(None), F.when(t == 1, ident("var", "p_size")).when(t == 2, "txn:007"), F.lit("0"), F.col("p_name"), F.lit("genus"), F.lit(None)), F.concat("r.name", F.lit("|"), text(F.col("r.accepted")))),
    ):
        out = out.unionByName(more)
    return out


@query("b24_meaningful", "SELECT p_partkey, p_partkey % 6 IN (3, 5) AS meaningful FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, " N/A").when(k == 1, "Unknown").when(k == 2, " ").when(k == 4, F.concat(F.lit("Default - "), F.col("p_size").cast("string"))).when(k == 5, F.concat(F.lit("none of "), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    return e.table("part").select("p_partkey", nz.is_meaningful(raw).alias("meaningful"))


@query("b25_whitelist", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", base=False)
def _(e: Evidence) -> DataFrame:
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda key, _: key.isin("k", "unused"))
    return e.table("events").select("event_id", kept["k"].alias("k"))


@query("b26_placeholder", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE 'not supplied' END AS v FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("part").select("p_partkey", nz.or_placeholder(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ")).alias("v"))


# time


def _units(e: Evidence) -> DataFrame:
    """Brands as named intervals: bounds from their parts' sizes."""
    return e.table("part").groupBy("p_brand").agg(F.max("p_size").alias("older"), F.min("p_size").alias("younger")).select(F.concat(F.lit("Early "), "p_brand").alias("name"), "older", "younger")


_UNITS_SQL = "units AS (SELECT 'Early ' || p_brand AS name, max(p_size) AS older, min(p_size) AS younger FROM part GROUP BY p_brand)"


def _labelled(e: Evidence) -> DataFrame:
    k = F.col("p_partkey") % 5
    label = F.when(k == 0, F.concat(F.col("p_brand"), F.lit(", Early"))).when(k == 1, F.concat(F.lit(" EARLY  "), "p_brand")).when(k == 2, F.concat("p_brand", F.lit(" or so"))).when(k == 3, F.lit(" ")).otherwise("Nowhere")
    return e.table("part").select("p_partkey", "p_brand", "p_size", label.alias("label"))


@query("h01_finest", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'stage' WHEN p_size > 10 THEN 'epoch' END AS field FROM part", base=False)
def _(e: Evidence) -> DataFrame:
    got = iv.finest(("stage", F.when(F.col("p_size") > 25, F.col("p_name"))), ("epoch", F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(" ")))
    return e.table("part").select("p_partkey", got["field"].alias("field"))


@query("h02_h03_interpret", f"WITH {_UNITS_SQL} SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'mapped' WHEN 1 THEN 'mapped' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'absent' ELSE 'unmapped' END AS status, CASE WHEN p_partkey % 5 < 2 THEN older END AS unit_older FROM part JOIN units ON name = 'Early ' || p_brand")
def _(e: Evidence) -> DataFrame:
    units = _units(e).withColumn("name", F.regexp_replace("name", "[#-]", ""))
    rows = _labelled(e).withColumn("label", F.when(F.col("p_partkey") % 5 < 2, F.regexp_replace("label", "[#-]", "")).otherwise(F.col("label")))
    return iv.interpret(rows, "label", iv.alias_table(units)).select("p_partkey", "status", "unit_older")


@query("h04_effective", f"WITH {_UNITS_SQL} SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size WHEN p_size > 10 THEN u.older END AS older, CASE WHEN p_size > 25 THEN 'numeric' WHEN p_size > 10 THEN 'unit' ELSE 'none' END AS basis FROM part JOIN units u ON name = 'Early ' || p_brand")
def _(e: Evidence) -> DataFrame:
    units = _units(e).select(F.col("name"), F.col("older").alias("uo"), F.col("younger").alias("uy"))
    rows = e.table("part").join(units, F.concat(F.lit("Early "), "p_brand") == F.col("name"))
    got = iv.effective(F.when(F.col("p_size") > 25, F.col("p_size")), F.when(F.col("p_size") > 25, F.col("p_size")), F.when(F.col("p_size") > 10, F.col("uo")), F.when(F.col("p_size") > 10, F.col("uy")))
    return rows.select("p_partkey", got["older"].alias("older"), got["basis"].alias("basis"))


@query("h05_provider_basis", "SELECT CASE WHEN older IS NOT NULL AND younger IS NOT NULL THEN 'provider-envelope' WHEN older IS NOT NULL OR younger IS NOT NULL THEN 'provider-partial' ELSE 'absent' END AS basis, count(*) AS n FROM catalog GROUP BY 1")
def _(e: Evidence) -> DataFrame:
    return e.catalog.groupBy(iv.provider_basis(F.col("older"), F.col("younger")).alias("basis")).agg(F.count("*").alias("n"))


@query("h06_interpretation_history", f"WITH {_OLD_SQL} SELECT c_custkey, policy FROM (SELECT c_custkey, 1 AS policy FROM old_v UNION SELECT c_custkey, 2 FROM new_v UNION SELECT c_custkey, 1 FROM new_v)")
def _(e: Evidence) -> DataFrame:
    old, new = _versions(e)
    history = old.select("c_custkey", F.lit(1).alias("policy"))
    for p in (1, 2):
        history = ing.insert_only(history, new.select("c_custkey", F.lit(p).alias("policy")), ["c_custkey", "policy"])
    return history


@query("h07_biochronology", "SELECT p_type AS label, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'biochronology' ELSE 'stage' END AS namespace, count(*) AS n FROM part GROUP BY ALL", base=False)
def _(e: Evidence) -> DataFrame:
    return e.table("part").groupBy(F.col("p_type").alias("label"), F.when(F.col("p_type").isin("SMALL", "MEDIUM"), "biochronology").otherwise("stage").alias("namespace")).agg(F.count("*").alias("n"))


@query("h08_overview_age", "SELECT record_id, CASE WHEN younger IS NOT NULL AND older >= younger THEN older || '-' || younger END AS age FROM catalog")
def _(e: Evidence) -> DataFrame:
    return e.catalog.select("record_id", F.when(F.col("younger").isNotNull() & (F.col("older") >= F.col("younger")), F.concat_ws("-", "older", "younger")).alias("age"))


@query("h09_disjoint", "SELECT a.taxon_id, CASE WHEN a.o IS NOT NULL AND a.y IS NOT NULL AND b.o IS NOT NULL AND b.y IS NOT NULL THEN a.o < b.y OR b.o < a.y END AS disjoint FROM (SELECT taxon_id, max(older) AS o, min(younger) AS y FROM material GROUP BY 1) a JOIN (SELECT taxon_id, max(older) AS o, min(younger) AS y FROM occurrence GROUP BY 1) b USING (taxon_id)")
def _(e: Evidence) -> DataFrame:
    of = lambda df, s: df.groupBy("taxon_id").agg(F.max("older").alias(f"o{s}"), F.min("younger").alias(f"y{s}"))
    return of(e.material, "a").join(of(e.occurrence, "b"), "taxon_id").select("taxon_id", iv.disjoint(F.col("oa"), F.col("ya"), F.col("ob"), F.col("yb")).alias("disjoint"))


# entities


@query("i03_identification_history", "SELECT record, string_agg(seq, ',' ORDER BY seen_at, seq) AS history, count(*) FILTER (is_current) <> 1 AS broken FROM revisions GROUP BY record")
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.entities import histories

    return histories(e.revisions, "record", ["seen_at", "seq"], "is_current").select("record", F.array_join(F.transform("history", lambda x: x["seq"].cast("string")), ",").alias("history"), "broken")


@query("i04_original_latest", "SELECT record, arg_min(seq, (seen_at, seq)) AS original, arg_max(seq, (seen_at, seq)) AS latest FROM revisions GROUP BY record")
def _(e: Evidence) -> DataFrame:
    return e.revisions.groupBy("record").agg(F.min_by("seq", F.struct("seen_at", "seq")).alias("original"), F.max_by("seq", F.struct("seen_at", "seq")).alias("latest"))


@query("i05_material_members", "SELECT specimen_id, string_agg(DISTINCT taxon_id, ',' ORDER BY CAST(taxon_id AS VARCHAR)) AS members FROM material GROUP BY specimen_id")
def _(e: Evidence) -> DataFrame:
    return e.material.groupBy("specimen_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("taxon_id").cast("string"))), ",").alias("members"))


@query("i06_catalog_material", "SELECT * FROM catalog WHERE source = 'a'")
def _(e: Evidence) -> DataFrame:
    return e.catalog.where("source = 'a'")


@query("i07_catalog_occurrence", "SELECT * FROM catalog WHERE source = 'b'")
def _(e: Evidence) -> DataFrame:
    return e.catalog.where("source = 'b'")


@query("i08_context_terms", f"SELECT DISTINCT {_uuid_sql('h')} AS term_id, namespace, term FROM (SELECT namespace, term, md5(namespace || ':' || term) AS h FROM (SELECT 'returnflag' AS namespace, l_returnflag AS term FROM lineitem UNION ALL SELECT 'linestatus', l_linestatus FROM lineitem))", base=False)
def _(e: Evidence) -> DataFrame:
    t = e.table("lineitem").select(F.explode(F.array(F.struct(F.lit("returnflag").alias("namespace"), F.col("l_returnflag").alias("term")), F.struct(F.lit("linestatus").alias("namespace"), F.col("l_linestatus").alias("term")))).alias("t")).select("t.*").distinct()
    return t.select(nz.text_id(F.concat_ws(":", "namespace", "term")).alias("term_id"), "namespace", "term")


@query("i09_self_hierarchy", "SELECT DISTINCT taxon_id, taxon_id AS node, 0 AS depth FROM occurrence")
def _(e: Evidence) -> DataFrame:
    return e.occurrence.select("taxon_id", F.col("taxon_id").alias("node"), F.lit(0).alias("depth")).distinct()


@query("i10_normalization_hash", "SELECT o_orderkey, sha256(md5(o_orderstatus) || '|' || coalesce(string_agg(d, '' ORDER BY d), '')) AS normalization_hash FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber || md5(l_returnflag || l_linestatus) AS d FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus", base=False)
def _(e: Evidence) -> DataFrame:
    from palimpsest.operators.entities import normalization_hashes

    owners = e.table("orders").select(F.col("o_orderkey").alias("owner"), F.md5("o_orderstatus").alias("evidence_hash"))
    frames = e.table("lineitem").select(F.col("l_orderkey").alias("owner"), F.concat(F.col("l_linenumber").cast("string"), F.md5(F.concat("l_returnflag", "l_linestatus"))).alias("dependency"))
    return normalization_hashes(owners, frames).withColumnRenamed("owner", "o_orderkey")
