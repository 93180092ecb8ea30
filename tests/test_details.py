"""Nested details, search through nodes, and views of a generation, on invented data."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import details, discover, reconcile


def test_arrays_are_sorted_and_cut_and_sizes_are_not(spark):
    rows = spark.createDataFrame([(1, k, f"r{k:03}") for k in range(100)] + [(1, None, "last"), (2, 5, None), (None, 1, "n")], "key int, age int, name string")
    others = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (3, "c")], "key int, name string")
    got = details.nested({"ages": details.child(rows, "key", ["name", "age"], number=-F.col("age")), "names": details.child(others, "key", ["name"], text=F.col("name"))}, 3)
    found = {r.key: r for r in got.collect()}
    assert [tuple(x) for x in found[1].ages] == [("r099", "99"), ("r098", "98"), ("r097", "97")] and (found[1].ages_total, found[1].ages_has_more) == (101, True)
    assert [x[0] for x in found[1].names] == ["a", "a", "b"] and not found[1].names_has_more
    assert found[2].ages == [[None, "5"]] and found[2].names == [] and found[2].names_total == 0
    assert set(found) == {1, 2, 3, None} and "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_nodes_stand_for_the_taxa_below_them(spark):
    names = spark.createDataFrame([("node", "n1", "Cats", "Cats"), ("node", "n2", "cat", "cat"), ("place", "p", "Catskill", "p"), ("record", "r", "cat 5", "r"), ("node", "n3", "dogs", "dogs")], "kind string, id string, label string, key string")
    members = spark.createDataFrame([("n1", 1), ("n2", 1), ("n1", 2), ("n3", 3)], "node string, taxon_id int")
    taxa = spark.createDataFrame([(1, "lion"), (2, "lynx"), (3, "fox")], "taxon_id int, taxon string")
    got = {tuple(r) for r in discover.search_through(names, members, taxa, "cat").collect()}
    assert got == {("taxon", "1", "lion", 0), ("taxon", "2", "lynx", 1), ("place", "p", "Catskill", 1), ("record", "r", "cat 5", 3)}


def test_states_and_generations(spark):
    sources = {"a": spark.createDataFrame([(1, "x"), (2, None)], "id int, v string"), "b": spark.createDataFrame([], "id int")}
    known = spark.createDataFrame([("a", False), ("b", False), ("s", True)], "dataset string, is_synthetic boolean")
    now = reconcile.dataset_states(sources, known)
    assert {r.dataset: r.rows for r in now.collect()} == {"a": 2, "b": 0}
    for name, said in (("s", "synthetic"), ("zz", "not a registered")):
        with pytest.raises(ValueError, match=said):
            reconcile.dataset_states({name: sources["a"]}, known)
    shuffled = reconcile.dataset_states({"a": spark.createDataFrame([(2, None), (1, "x")], "id int, v string"), "b": sources["b"]}, known)
    changed = reconcile.dataset_states({"a": spark.createDataFrame([(2, ""), (1, "x")], "id int, v string"), "b": sources["b"]}, known)
    edges = spark.createDataFrame([("g", 1, 7, "candidate"), ("g", 1, 6, "deterministic"), ("g", 2, 5, "candidate"), ("h", 9, 9, "candidate")], "generation string, subject int, specimen int, decision string")
    reviews = spark.createDataFrame([(1, 7, "accepted"), (1, 6, "rejected")], "subject int, specimen int, verdict string")
    stored = now.select("dataset", "state").withColumn("generation", F.lit("g")).unionByName(now.select("dataset", "state").where("dataset = 'a'").withColumns({"state": F.lit("0"), "generation": F.lit("h")}))
    view = lambda state, **k: {(r.generation, r.subject, tuple(map(tuple, r.edges)), r.current) for r in reconcile.current_view(edges, reviews, stored, state, **k).collect()}
    want = {("g", 1, ((6, "rejected"), (7, "accepted-candidate")), True), ("g", 2, ((5, "candidate"),), True)}
    assert view(now) == view(shuffled) == want and view(changed) == set()
    assert view(now, history=True) == want | {("h", 9, ((9, "candidate"),), False)}
    assert {r[3] for r in view(changed, history=True)} == {False}
    assert view(now.where("dataset = 'b'")) == set()  # a source that is gone


def test_kinds_of_the_same_rows_need_no_shuffle_beyond_the_key(spark):
    rows = spark.createDataFrame([(k % 3 or None, f"r{k % 40:02}", 100 - k % 7 if k % 5 else None, k % 2 == 0) for k in range(120)] + [(9, None, None, None)], "key int, name string, age int, ok boolean")
    old = details.nested({
        "all": details.child(rows, "key", ["name", "age"], text=F.col("name")),
        "ages": details.child(rows.select("key", "age", "ok").distinct(), "key", ["age", "ok"], number=-F.col("age")),
    }, 4).join(rows.groupBy(F.col("key").alias("_k")).agg(F.min("ok").alias("ok")), F.col("key").eqNullSafe(F.col("_k"))).drop("_k")
    ok = F.col("ok").cast("string").asc()
    got = details.nested_alike(rows, "key", {"all": (["name", "age"], [F.asc_nulls_last("name"), F.col("age").cast("string").asc()], False), "ages": (["age", "ok"], [F.desc_nulls_last("age"), ok], True)}, 4, [F.min("ok").alias("ok")])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    found = {tuple(map(repr, r)) for r in got.collect()}
    assert found == {tuple(map(repr, r)) for r in old.select(*got.columns).collect()} and len(found) == 4
