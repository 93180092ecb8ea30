"""Assembly of tables, typed edges, run audits and small rules, on invented data."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import intervals, normalize
from palimpsest.operators import discover, entities, hierarchy, ingest, paging
from palimpsest.streaming import revisions


def tables():
    return [
        entities.Table("place", ("place",), {"id": F.col("id"), "name": F.col("name")}, ("id",)),
        entities.Table("find", ("find",), {"id": F.col("id"), "place_id": F.col("at"), "name": F.col("name")}, ("id",), {"place_id": "place"}),
        entities.Table("link", (), {"id": F.col("id"), "kind": F.col("kind")}, ("id", "kind"), {}, F.col("name").isNotNull()),
    ]


RECORD = "kind string, id int, name string, at int"


def test_assembly_finds_lost_targets_and_conflicts(spark):
    good = [("place", 1, "A", None), ("place", 1, "A", None), ("find", 7, "x", 1), ("find", 8, None, None)]
    frames = entities.checked(entities.assembled(spark.createDataFrame(good, RECORD), tables()), tables())
    assert {n: f.count() for n, f in frames.items()} == {"place": 1, "find": 2, "link": 2}
    assert entities.row_digests(frames, tables()).select("digest").distinct().count() == 5
    for extra, said in ((("find", 9, "y", 5), "find/place_id/place/5"), (("place", 1, "B", None), "place/=1/2")):
        frames = entities.assembled(spark.createDataFrame([*good, extra], RECORD), tables())
        with pytest.raises(ValueError, match=said):
            entities.checked(frames, tables())


def test_typed_edges(spark):
    owners = spark.createDataFrame([("find#1", 5, 70, ["Old", " ", None, "Gone"]), ("find#2", None, 71, []), ("place#5", 5, None, None)], "owner string, place int, taxon int, names array<string>")
    places = spark.createDataFrame([(5,)], "id int")
    taxa = spark.createDataFrame([(70, 700), (70, 701)], "alias int, id int")
    ages = spark.createDataFrame([("i1", "Old"), ("i2", "Old"), ("i3", "Young")], "id string, name string")
    got = {tuple(r) for r in hierarchy.typed_edges(owners, {"place": ("place", places)}, {"taxon": ("taxon", taxa)}, ages).collect()}
    assert got == {("find#1", "place", "5", False), ("find#1", "taxon", "700", False), ("find#1", "taxon", "701", False), ("find#1", "interval", "i1", False), ("find#1", "interval", "i2", False), ("find#1", "interval", "Gone", True), ("find#2", "taxon", "71", True)}


def test_runs_are_appended_and_replays_found(spark, tmp_path):
    path, of = f"{tmp_path}/runs", lambda *rows: spark.createDataFrame(rows, "id int, h string")
    reason = F.when(F.col("h") == "bad", "bad")
    assert ingest.runs(spark, path).count() == 0
    first = ingest.audited_run(path, "1", of(), of((1, "a"), (2, "b"), (2, "c"), (3, "bad")), "id", "h", reason)
    assert {tuple(r) for r in first.collect()} == {(1, "a"), (2, "b")}
    ingest.audited_run(path, "2", first, of((1, "bad")), "id", "h", reason)
    ingest.audited_run(path, "3", first, of((1, "bad")), "id", "h", reason)  # a failed run is no state: not a replay
    assert ingest.audited_run(path, "4", first, of((3, "bad"), (2, "c"), (2, "b"), (1, "a")), "id", "h", reason).count() == 0
    ingest.audited_run(path, "5", first, of((1, "z"), (2, "b"), (4, None)), "id", "h", reason)
    got = {r.run: (r.read, r.accepted, r.failed, r.inserted, r.updated, r.unchanged, r.skipped, r.status) for r in ingest.runs(spark, path).collect()}
    assert got == {"1": (4, 2, 1, 2, 0, 0, 1, "partial"), "2": (1, 0, 1, 0, 0, 0, 0, "failed"), "3": (1, 0, 1, 0, 0, 0, 0, "failed"), "4": (4, 0, 0, 0, 0, 0, 4, "replayed"), "5": (3, 3, 0, 1, 1, 1, 0, "success")}


def test_places_within_a_kind_over_many_ranges(spark):
    rows = [("a", k) for k in range(500)] + [("b", k) for k in range(3)] + [(None, 5), (None, 4)]
    got = paging.interleaved(spark.createDataFrame(rows, "kind string, id int").repartition(5), "kind", "id").collect()
    assert {(r.kind, r.id, r.turn) for r in got} == {("a", k, k + 1) for k in range(500)} | {("b", k, k + 1) for k in range(3)} | {(None, 4, 1), (None, 5, 2)}


def test_viewports_on_a_grid_equal_a_plain_test(spark):
    points = [(lon, lat, False) for lon in range(-180, 181, 9) for lat in range(-90, 91, 15)] + [(0, 0, True), (None, 0, False)]
    views = [(1, 170.0, -10.0, -170.0, 10.0), (2, -20.0, 50.0, 20.0, 90.0), (3, -180.0, -90.0, 180.0, 90.0), (4, 5.0, 5.0, 5.5, 5.5), (5, 100.0, -90.0, 20.0, -80.0)]
    frame = spark.createDataFrame(views, "id int, west double, south double, east double, north double")
    got = {r.id: (r.inside, r.near) for r in discover.in_viewports(spark.createDataFrame(points, "lon int, lat int, withheld boolean"), frame, cell=7.0).collect()}
    outer = {r.id: (r.outer_west, r.outer_south, r.outer_east, r.outer_north) for r in discover.buffered(frame).collect()}

    def count(w, s, e, n):
        return sum(s <= y <= n and (w <= x <= e if w <= e else x >= w or x <= e) for x, y, hidden in points if x is not None and not hidden)

    want = {v[0]: (count(*v[1:]), count(*outer[v[0]])) for v in views}
    assert got == {k: v for k, v in want.items() if v[1]}


def test_late_and_repeated_rows_of_a_stream(spark, tmp_path):
    schema = "seq int, record string, h string"
    for k, rows in enumerate(([(1, "r", "x"), (2, "r", "x"), (3, None, "x")], [(5, "r", None), (4, "r", "y"), (6, None, "x")], [(7, "r", None), (8, "s", None)])):
        frame = spark.createDataFrame(rows, schema)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        revisions.track_revisions(spark, str(tmp_path / "in"), frame.schema, "record", "h", "seq", str(tmp_path)).awaitTermination()
    got = {(r.seq, r.record, r.change) for r in spark.read.parquet(str(tmp_path / "changes/*")).collect()}
    assert got == {(1, "r", "inserted"), (2, "r", "unchanged"), (3, None, "inserted"), (4, "r", "updated"), (5, "r", "updated"), (6, None, "unchanged"), (7, "r", "unchanged"), (8, "s", "inserted")}


def test_names_texts_and_stages(spark):
    rows = spark.createDataFrame([("ﬁve   STRASSE ",), ("Straße",), (None,), ("",)], "n string")
    assert {r.f for r in normalize.folded_names(rows, "n", "f").collect()} == {"five strasse", "strasse", None, ""}
    texts = ["Default", " none - 12 ", "n/a", "N/A -3", "none of it", "unspecified\n", "not supplied", "", None, "acid"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize.is_meaningful(F.col("t")).alias("m")).collect()
    assert {r.t for r in got if r.m} == {"none of it", "acid"}
    units = spark.createDataFrame([("Greenlandian", 11, 8), ("Early Miocene", 23, 16)], "name string, older int, younger int")
    assert {(r.alias, r.unit) for r in intervals.alias_table(units).collect()} == {("greenlandian", "Greenlandian"), ("holocene, early", "Greenlandian"), ("early holocene", "Greenlandian"), ("early miocene", "Early Miocene"), ("miocene, early", "Early Miocene")}


def test_records_of_a_provider(spark):
    lit = F.lit
    r = spark.range(1).select(
        normalize.measurement_record(lit("mea:4"), lit("spm:9"), lit("length"), {"average": lit("1.50"), "max": lit("wide"), "min": lit("")}, lit("mm")).alias("m"), normalize.material_record(lit("spm:9"), lit(None), lit("col:1"), lit("0"), lit("x"), lit(None)).alias("s"),
        normalize.taxon_name_record(lit("var:3"), lit("txn:2"), lit(""), lit("txn:x"), lit("N"), lit("genus"), lit(None)).alias("t"), normalize.opinion_record(lit("opn:1"), lit("txn:1"), lit(None), lit("0"), lit("valid"), lit("ref:2")).alias("o"),
        normalize.reference_record(lit("ref:1"), lit("T"), lit(None), lit(" "), {"author1last": lit("Doe"), "pages": lit("2")}).alias("f"),
    ).first()
    assert r.m["values"] == {"average": r.m["values"]["average"], "max": None, "min": None} and float(r.m["values"]["average"]) == 1.5 and r.m.faults == ["max"] and r.m.invalid and r.m.specimen == 9
    assert r.s.invalid and (r.s.id, r.s.occurrence, r.s.collection, r.s.reidentification) == (9, None, 1, None)
    assert r.t.invalid and (r.t.id, r.t.original, r.t.accepted, r.t.parent) == (3, 2, None, None)
    assert not r.o.invalid and (r.o.child, r.o.parent, r.o.reference) == (1, None, 2)
    assert not r.f.invalid and r.f.authors == {"author1last": "Doe"} and r.f.year is None
