"""Work that grows with the rows: what is shuffled, how pairs are dealt out, and the same results as the plainer forms."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import aggregates, catalogue, entities, hierarchy, joins, reconcile
from palimpsest.plans import assembly_queries
from palimpsest.plans.registry import QUERIES
from palimpsest.sources.scratch import laid

DATA = "/root/testdata/sf0.001"


def exchanges(df):
    """The shuffles of a plan, broadcasts not counted."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(" Exchange " in f" {line.strip(' :+-')}" for line in plan.splitlines())


def test_digests_by_record(spark):
    tables = [
        entities.Table("place", (), {"id": F.col("at"), "name": F.col("place")}, ("id",)),
        entities.Table("find", ("find",), {"id": F.col("id"), "at": F.col("at"), "name": F.col("name")}, ("id",), {"at": "place"}),
        entities.Table("note", (), {"id": F.col("id"), "kind": F.col("kind")}, ("id",), {}, F.col("name") == "x"),
    ]
    rows = [("find", 1, "x", 5, "P"), ("find", 1, "x", 5, "P"), ("find", 1, "y", 5, "P"), ("find", 2, None, 5, "P"), ("other", 2, "x", 6, "Q"), ("other", 3, "x", 6, "P")]
    records = spark.createDataFrame(rows, "kind string, id int, name string, at int, place string")
    want = entities.row_digests(entities.assembled(records, tables), tables).collect()
    got = entities.record_digests(entities.counted(records, ["kind", "id"]), tables, ("place",)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_tables_of_records_are_not_shuffled_each(spark):
    assert exchanges(QUERIES["i01_entities"](spark, DATA)) <= 9  # two for each of four shared tables, and one for repeats


def test_records_hold_no_text_of_their_supplier(spark):
    plan = QUERIES["i01_entities"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert any("palimpsest/records-" in line for line in plan.splitlines())
    assert not any("palimpsest/records-" in line and ("s_name" in line or "label" in line) for line in plan.splitlines())
    tables = [entities.Table("place", (), {"id": F.col("at"), "name": F.col("name")}, ("id",)), entities.Table("find", (), {"id": F.col("id"), "at": F.col("at")}, ("id",))]
    records = spark.createDataFrame([(1, 5, "P"), (1, 5, "P"), (2, 5, "P"), (3, 6, "Q")], "id int, at int, name string")
    want = entities.row_digests(entities.assembled(records.withColumn("kind", F.lit("k")), tables), tables).collect()
    got = entities.record_digests(entities.counted(records.select("id", "at", F.lit("k").alias("kind")), ["id"]), tables, apart={"place": records.drop("id")}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


SUBJECT, TARGET = "subject int, state string, institution string, collection string, number string", "institution string, collection string, number string, specimen int"


def pairs_of(spark):
    subjects = [(1, "complete", "UF", "VP", "7"), (2, "partial", "UF", None, "7"), (3, "partial", "UF", None, "8"), (4, "ambiguous", "UF", None, "7"), (5, "complete", "UF", "PB", "8"), (6, "malformed", None, None, None)]
    targets = [("UF", "VP", "7", 1), ("UF", "VP", "7", 1), ("UF", "PB", "7", 2), ("UF", None, "8", 3)]
    return spark.createDataFrame(subjects, SUBJECT), spark.createDataFrame(targets, TARGET)


def test_decisions_without_pairs(spark, monkeypatch):
    subjects, targets = pairs_of(spark)
    want = reconcile.decide(subjects, reconcile.candidates(subjects, targets)).collect()
    got = reconcile.decided(subjects, targets).select("subject", "decision").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    monkeypatch.setattr(reconcile, "candidates", lambda *_: 1 / 0)
    for name in ("l03_decisions", "l05_summary", "l08_assessments"):
        assert QUERIES[name](spark, DATA).count() > 0  # no pair is made


def test_pairs_of_one_key_are_dealt_out_and_stay_with_their_subject(spark, monkeypatch):
    subjects = spark.range(40).selectExpr("cast(id as int) subject", "'partial' state", "'UF' institution", "cast(null as string) collection", "'7' number", "id * 2 as more")
    targets = spark.range(30).selectExpr("'UF' institution", "'VP' collection", "'7' number", "cast(id as int) specimen")
    plain = sorted(map(tuple, reconcile.candidates(subjects, targets).collect()))
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 100)
    dealt = reconcile.candidates(subjects, targets)
    assert sorted(map(tuple, dealt.collect())) == plain and len(plain) == 1200 and plain[-1][3] == 2 * plain[-1][0]
    parts = dealt.withColumn("p", F.spark_partition_id()).groupBy("subject").agg(F.count_distinct("p").alias("n"), F.first("p").alias("p")).collect()
    assert {r.n for r in parts} == {1} and len({r.p for r in parts}) > 5
    edges = dealt.withColumn("decision", F.lit("candidate")).select("subject", "specimen", "decision")
    reviews = dealt.where("specimen < 2").select("subject", "specimen", F.lit("accepted").alias("verdict"))
    for df in (reconcile.with_review(edges, reviews), reconcile.rebuilt(edges, reviews, edges.where("subject = 1"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(subject" in plan and "specimen" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_reviews_beside_edges(spark):
    edges = spark.createDataFrame([(1, 1, "candidate"), (1, 1, "candidate"), (1, 2, "deterministic"), (None, 3, "candidate")], "subject int, specimen int, decision string")
    reviews = spark.createDataFrame([(1, 1, "accepted"), (1, 2, "accepted"), (9, 9, "rejected")], "subject int, specimen int, verdict string")
    got = sorted(map(str, map(tuple, reconcile.with_review(edges, reviews).select("subject", "specimen", "shown").collect())))
    assert got == sorted(map(str, [(1, 1, "accepted-candidate"), (1, 1, "accepted-candidate"), (1, 2, "deterministic"), (None, 3, "candidate")]))
    old = edges.select("subject", "specimen")
    got = [tuple(r) for r in reconcile.rebuilt(old, reviews, old.where("specimen = 2")).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (1, 2)]


def test_recorded_runs_add_only_what_is_new(spark):
    stored = spark.createDataFrame([], "id string, kind string, subject int, specimen int, decision string")
    decisions = spark.createDataFrame([(1, "ambiguous"), (2, "unresolved")], "subject int, decision string")
    edges = spark.createDataFrame([(1, 7), (1, 8), (1, 7)], "subject int, specimen int")
    first = reconcile.recorded(stored, decisions.where("subject = 1"), edges)
    again = reconcile.recorded(first, decisions.withColumn("decision", F.lit("other")), edges).collect()
    assert sorted((r.kind, r.subject, r.specimen or 0, r.decision) for r in again) == [("assessment", 1, 0, "ambiguous"), ("assessment", 2, 0, "other"), ("edge", 1, 7, "ambiguous"), ("edge", 1, 8, "ambiguous")]
    assert len({r.id for r in again}) == 4 and all(len(r.id) == 64 for r in again)


def plan_of_pairs(spark, monkeypatch, name):
    """The plan of a query whose pairs are dealt out to many tasks; pairs that are shuffled again, by both of their ids, stand in it."""
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 2)
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    return plan


def test_recorded_pairs_are_neither_written_nor_shuffled(spark, monkeypatch):
    plan = plan_of_pairs(spark, monkeypatch, "l08_recorded")
    assert "palimpsest/recorded-" not in plan and not re.search(r"hashpartitioning\(subject#\d+L?, specimen", plan)


def test_pairs_of_generations_meet_reviews_once(spark, monkeypatch):
    assert plan_of_pairs(spark, monkeypatch, "l09_generations").count(" Window [") == 1


def test_identifiers_are_parsed_once_for_all_steps(spark):
    for name in ("l08_recorded", "l09_generations", "l10_review"):
        assert "regexp" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()  # they are written by then


def test_recorded_rows_come_once_whatever_is_stored(spark):
    stored = spark.createDataFrame([("i", "edge", 1, 7, "old"), ("i", "edge", 1, 7, "old"), ("j", "edge", 2, 7, "old"), ("k", "assessment", 1, None, "old")], "id string, kind string, subject int, specimen int, decision string")
    edges = spark.createDataFrame([(1, 7, "new"), (1, 8, "new"), (1, 8, "new"), (None, 7, "new")], "subject int, specimen int, decision string")
    got = reconcile.recorded(stored, edges.select("subject", "decision").where("subject = 1"), edges)
    assert sorted((r.kind, r.subject or 0, r.specimen or 0, r.decision) for r in got.collect()) == [("assessment", 1, 0, "old"), ("edge", 0, 7, "new"), ("edge", 1, 7, "old"), ("edge", 1, 7, "old"), ("edge", 1, 8, "new"), ("edge", 2, 7, "old")]


def test_typed_edges_of_a_shared_alias_are_dealt_out(spark, monkeypatch):
    owners = spark.range(60).selectExpr("concat('find#', id div 2) owner", "id % 2 as taxon", "array('Old', 'Older') names")
    taxa = spark.range(20).selectExpr("id % 2 as alias", "id div 2 as id")
    ages = spark.createDataFrame([("i1", "Old"), ("i1", "Older")], "id string, name string")
    edges = lambda: hierarchy.typed_edges(owners, {}, {"taxon": ("taxon", taxa)}, ages)
    plain = sorted(map(tuple, edges().collect()))
    assert len(plain) == 30 * 10 + 30  # both rows of an owner, and both of its names, lead to the same targets
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 50)
    dealt = edges()
    assert sorted(map(tuple, dealt.collect())) == plain
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(owner" in line and "target" in line.split("hashpartitioning")[1] for line in plan.splitlines())


def test_owners_are_dealt_out_once_for_all_kinds(spark, monkeypatch):
    owners = spark.createDataFrame([("a#1", 1, 5, ["Old", "Old", " ", None]), ("a#1", 2, 5, ["New"]), ("a#2", None, 7, None), (None, 1, None, ["Old"])], "owner string, a int, b int, names array<string>")
    ages = spark.createDataFrame([("i1", "Old"), ("i1", "New"), ("i2", "New")], "id string, name string")
    direct, aliased = {"a": ("a", spark.createDataFrame([(1,), (2,), (2,)], "id int"))}, {"b": ("b", spark.createDataFrame([(5, 50), (5, 51), (6, 60)], "alias int, id int"))}
    want = {("a#1", "a", "2", False), ("a#1", "b", "50", False), ("a#1", "b", "51", False), ("a#1", "interval", "i1", False), ("a#1", "interval", "i2", False), ("a#2", "b", "7", True)}
    for most in (joins.BROADCAST_ROWS, 3, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        got = hierarchy.typed_edges(owners, direct, aliased, ages)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert most < 4 or not re.search(r"hashpartitioning\(owner#\d+, [a-z]", plan)  # rows are made distinct where they were dealt


def test_records_are_checked_without_a_pass_over_each_table(spark):
    own = F.col("id")
    tables = [
        entities.Table("place", ("place",), {"id": F.col("id"), "name": F.col("name")}, ("id",)),
        entities.Table("find", ("find",), {"id": own, "at": F.col("at")}, ("id",), {"at": "place"}), entities.Table("link", ("find",), {"find": own, "name": F.col("name")}, ("find", "name"), {"find": "find"}),
    ]
    good = [("place", 1, "A", None), ("place", 1, "A", None), ("find", 7, "x", 1)]
    stored = lambda *more: entities.counted(spark.createDataFrame([*good, *more], "kind string, id int, name string, at int"), ["kind", "id"])
    entities.checked_records(stored(), tables)
    for extra, said in ((("find", 9, "y", 5), "find/at/place/5"), (("place", 1, "B", None), "place/=1/2")):
        with pytest.raises(ValueError, match=said):
            entities.checked_records(stored(extra), tables)
    lost = entities.dangling({"dep": spark.createDataFrame([(8,)], "find int"), "find": spark.createDataFrame([(7,)], "id int")}, [entities.Table("dep", (), {"find": F.col("find")}, ("find",), {"find": "find"}), tables[1]], lambda t, *_: t.name == "find")
    assert [tuple(r) for r in lost.collect()] == [("dep", "find", "find", "8")]


def test_i02_shuffles_no_table_of_records(spark):
    assert exchanges(QUERIES["i02_rows_per_kind"](spark, DATA)) <= 1  # of repeated records; each table was made distinct before


def test_frames_move_as_nodes_and_bytes(spark, monkeypatch):
    kept = {}
    plain = assembly_queries.written
    monkeypatch.setattr(assembly_queries, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    assert QUERIES["i02_rows_per_kind"](spark, DATA).count() > 0
    assert dict(kept["frames"].dtypes) == {"root": "string", "member": "string", "target": "binary"} and "hash" not in kept["plain"].columns


def test_rows_that_may_come_twice(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", "x", 1), (None, "x", 1)], "root string, member string, n int")
    assert sorted(map(tuple, entities.twice(rows, ["root", "member"]).collect())) == [("a", "x", 1), ("a", "x", 2)]


def test_every_owner_is_a_root_where_none_are_given(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("a", "b")], "owner string, target string")
    want = sorted(map(tuple, hierarchy.reachable(edges.select(F.col("owner").alias("root")), edges).collect()))
    assert sorted(map(tuple, hierarchy.reachable(None, edges).collect())) == want and ("d", "c") in want


def test_rows_lie_by_a_column(spark):
    rows = spark.range(100).selectExpr("id % 7 as k", "id % 3 as v").unionByName(spark.createDataFrame([(None, 5)], "k bigint, v bigint"))
    lying = laid(rows, "lying", "k", 5)
    assert sorted(map(str, lying.collect())) == sorted(map(str, rows.collect()))
    sizes = lying.groupBy("k", "v").count()
    assert exchanges(sizes) == 0 and sorted(map(str, sizes.collect())) == sorted(map(str, rows.groupBy("k", "v").count().collect()))


def test_dossiers_are_taken_from_rows_that_lie_by_locality(spark):
    plan = QUERIES["j15_dossiers"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "Bucketed: true" in plan and "hashpartitioning(key" not in plan


def test_rollups_derive_their_rows_once(spark):
    for name in ("e02_ancestor_rollup_corrected", "e03_source_rollup"):
        assert "lineitem" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()  # they are written by then


def test_specimens_of_nodes_with_one_taxon_and_with_several(spark):
    closure = spark.createDataFrame([(1, "s1", 0), (1, "g", 1), (2, "s2", 0), (2, "g", 1), (3, "s3", 0), (3, "h", 1)], "taxon_id int, node string, depth int")
    rows = [("a", 1, 10), ("a", 2, 10), ("b", 1, 10), ("b", 3, 11), ("a", 3, 11), ("a", 3, None), ("b", 9, 12)]
    rows = spark.createDataFrame([(s, t, i, 5, 1, False, 0) for s, t, i in rows], "source string, taxon_id int, specimen_id int, older int, younger int, withheld boolean, lon int")
    want = {("s1", "a", 1, 1), ("s1", "b", 1, 1), ("s1", "all", 2, 1), ("s2", "a", 1, 1), ("s2", "all", 1, 1), ("g", "a", 2, 1), ("g", "b", 1, 1), ("g", "all", 3, 1)} | {(n, s, i, 1) for n in ("s3", "h") for s, i in (("a", 2), ("b", 1), ("all", 3))}
    assert {(r.node, r.source, r.inclusive, r.specimens) for r in aggregates.source_rollup(rows, closure).collect()} == want
    assert {tuple(r) for r in aggregates.ancestor_rollup_corrected(rows, closure).collect()} == {tuple(r) for r in aggregates.ancestor_rollup(rows, closure).collect()}


def test_material_lies_by_specimen(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(QUERIES["e11_several_taxa"](spark, DATA)) == 6  # two for each of three joins, none to group
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_counted_before_they_meet_their_file(spark):
    plan = QUERIES["a03_count_contract"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.split("Join", 1)[1] and "HashAggregate" not in plan.split("Join", 1)[0]


def test_few_offers_are_kept_of_many_shared_values(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("concat('p', id % 40) as spot", "cast(pmod(xxhash64(id), 100) as int) as taxon").unionByName(spark.createDataFrame([("q", 1), ("q", None), ("alone", 999), (None, 3)], "spot string, taxon int"))
    known = {tuple(r) for r in rows.dropna().distinct().collect()}
    at, of = {}, {}
    for p, t in known:
        at.setdefault(t, set()).add(p), of.setdefault(p, set()).add(t)
    meets = {p: sorted(set().union(*(at[t] for t in taxa)) - {p})[:3] for p, taxa in of.items()}
    kept, plain = [], joins.offers
    monkeypatch.setattr(joins, "offers", lambda *a: kept.append((len(a) > 4, plain(*a).count())) or plain(*a))
    got = joins.first_sharing(rows, "spot", "taxon", 3)
    assert {tuple(r) for r in got.collect()} == {(p, q, i + 1) for p, others in meets.items() for i, q in enumerate(others)}
    everything = plain(rows.dropna().distinct(), "spot", "taxon", 3).count()
    assert dict(kept)[True] < everything / 1.5  # offers beyond a place's bound are dropped before they are made distinct


def test_entities_in_many_rows_are_never_gathered(spark, monkeypatch):
    rows = [(i % 7 if i % 5 else None, f"p{i % 3}" if i % 4 else None, f"c{i % 11}", i % 2 if i % 6 else None, i % 13 == 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "a int, b string, c string, lon int, withheld boolean")
    kinds = {"term": "a", "place": "b", "taxon": "c"}
    met, count = {}, {}
    for *ids, lon, withheld in rows:
        own = [(k, str(i)) for k, i in zip(kinds, ids) if i is not None]
        for e in own:
            met.setdefault(e, set()).update(o for o in own if o[0] != e[0])
            n = count.setdefault(e, [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + (lon is not None and not withheld)
    want = {e: (*count[e], [list(o) for o in sorted(met[e], key="/".join)][:4], len(met[e]), len(met[e]) > 4) for e in met}
    described = {k: frame.select(F.col(c).alias("id"), F.col(c).alias("label")).distinct() for k, c in kinds.items()} | {"other": spark.createDataFrame([("x", "X")], "id string, label string")}
    want["other", "x"] = (0, 0, [], 0, False)
    for most, lot in ((10_000, 50_000), (8, 9), (1, 2)):
        monkeypatch.setattr(catalogue, "ROWS_AN_ENTITY", most)
        monkeypatch.setattr(catalogue, "ROWS_AT_ONCE", lot)
        got = catalogue.entity_details(frame, kinds, described, 4).collect()
        assert {(r.kind, r.id): (r.records, r.mapped, r.related, r.related_total, r.related_has_more) for r in got} == want
        assert len(got) == len(want)
    assert {tuple(r) for r in catalogue.entity_details(frame.where("false"), kinds, {"other": described["other"]}).select("id", "records", "related_total").collect()} == {("x", 0, 0)}


def test_what_references_say_is_checked_once(spark, monkeypatch):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    evidence = frame([(1, "x"), (1, "y"), (2, "y"), (None, "y")], "occurrence int, owner string")
    frames = frame([("x", "e", "1"), ("x", "e", "1"), ("y", "r", "1"), ("y", "op", "1"), ("x", "old", "1"), ("y", "none", None)], "owner string, member string, content_hash string")
    records = frame([("e", "1", True), ("e", "2", True), ("r", "1", True), ("op", "1", True), ("old", "1", False), ("none", None, True), ("s", "1", True)], "record string, content_hash string, is_current boolean")
    role = frame([(1, "e", "1", 7), (1, "e", "2", 7), (1, "e", "3", 7), (2, "e", "1", 7), (1, "e", "1", 8), (1, "old", "1", 7), (1, "none", None, 7), (None, "r", "1", 7)], "occurrence int, record string, content_hash string, reference int")
    opinions = frame([("op", "1", 7), ("op", "2", 7), ("s", "1", 7)], "record string, content_hash string, reference int")
    got = catalogue.proven_references(evidence, {"said": role, "again": role.limit(1)}, opinions, frame([(7, "r"), (8, "s")], "reference int, record string"), frames, records)
    assert sorted(map(tuple, got.collect())) == [(1, "again", 7, "e"), (1, "opinion", 7, "op"), (1, "said", 7, "e"), (2, "opinion", 7, "op")]
    assert "lineitem" not in QUERIES["j17_proven_references"](spark, DATA)._jdf.queryExecution().executedPlan().toString()  # it is written by then


def test_record_details_derive_their_material_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_A_TASK", 1000)
    plan = QUERIES["j10_record_detail"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "lineitem" in line for line in plan.splitlines()) == 1
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan  # the specimens' rows stay where they were dealt


def test_inspection_joins_lines_of_records_alone_by_tasks_of_so_many_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(joins, "ROWS_A_TASK", 1000)
    for name in ("orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.union(events.limit(3).withColumn("user_id", F.lit(None).cast("bigint"))).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["j18_inspection"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "REPARTITION_BY_NUM" in plan and "WindowGroupLimit" in plan
    found = {r.record: r for r in got.collect()}
    lines = spark.read.parquet(f"{DATA}/orders.parquet").join(spark.read.parquet(f"{DATA}/lineitem.parquet"), F.expr("o_orderkey = l_orderkey")).groupBy("o_custkey").count().collect()
    sizes = dict(map(tuple, lines))
    assert set(found) == {r.user_id for r in events.select("user_id").distinct().collect()} | {None}
    assert all(r.materials_total == sizes.get(k, 0) and r.materials_has_more == (r.materials_total > 20) for k, r in found.items())
    assert (found[None].revisions, found[None].history, found[None].history_total) == (3, "", 0)


def test_tasks_grow_with_the_rows(spark):
    assert [joins.tasks_for(spark.range(n)) for n in (0, 1, joins.ROWS_A_TASK, joins.ROWS_A_TASK + 1)] == [1, 1, 1, 2]
