"""The merge of two classifications on small invented paths."""

import pytest

from palimpsest.operators import merge
from palimpsest.sources.scratch import written

SCHEMA = "source string, key int, terms array<struct<item string, concept string>>, rooted boolean, qualified boolean, unresolved boolean"


def graph(spark, *rows):
    """rows: (source, key, path like "kingdom=A/family=B:b2", flags); a level's concept is its item, or what follows a colon."""
    def terms(path):
        return [(t.split(":")[0], t.split(":")[-1]) for t in path.split("/")]

    made = spark.createDataFrame([(s, k, terms(p), "r" in f, "q" in f, "u" in f) for s, k, p, f in rows], SCHEMA)
    levels = written(merge.placed_levels(made.coalesce(1), "a"), "levels")
    return levels, written(merge.nodes_of(levels), "nodes")


def merged(nodes):
    found = written(merge.targets(nodes, "a", "b"), "targets")
    return found, written(merge.redirects(nodes, found), "redirects")


def named(nodes):
    return {r.node: "/".join([*r.up, r.item or "-"]) for r in nodes.collect()}


def test_leaves_below_one_isolated_ancestor_share_it(spark):
    levels, nodes = graph(
        spark, ("a", 1, "kingdom=K/family=F:f1/genus=G", ""), ("a", 2, "kingdom=K/family=F:f1/genus=H", ""), ("a", 3, "kingdom=K/family=F:f2/genus=G", ""), ("a", 4, "kingdom=K/family=F:f1/genus=G", "q"), ("b", 5, "kingdom=K/family=F/genus=G", "")
    )
    at = {(r.key, r.level): (r.node, r.placement) for r in levels.collect()}
    assert at[1, 1] == at[2, 1] != at[3, 1] and at[1, 1][1] == "ambiguous"
    assert at[1, 2][0] != at[3, 2][0] and at[1, 2][1] == "supported"  # its own concept is one; the family's isolation is in its id
    assert at[4, 2] == (at[4, 2][0], "qualified") and at[4, 2][0] != at[1, 2][0]
    assert len({at[k, 0] for k in (1, 2, 3, 4, 5)}) == 1 and at[5, 1][1] == "supported"
    _, to = merged(nodes)
    assert to.collect() == []  # the spine has no supported family F, and its genera stand below isolated ones: b's family is not theirs


def test_rows_at_odds_keep_their_last_term_in_a_container(spark):
    levels, nodes = graph(spark, ("a", 1, "kingdom=K/family=F", ""), ("b", 2, "kingdom=K/family=F/genus=G", "u"), ("b", 3, "order=O/genus=G", ""), ("b", 4, "family=F/genus=G", ""), ("b", 5, "family=F/genus=G", "r"))
    got = {(r.key, r.level): (r.item, r.placement, r.own) for r in levels.collect()}
    assert got[2, 0] == ("genus=G", "unresolved", True) and (2, 1) not in got
    assert got[3, 0] == ("order=O", "partial", True) and got[3, 1][1] == "partial"
    assert [r.placement for r in nodes.where("item is null").collect()] == ["container"] * 2
    assert {r.key: r.parent for r in levels.where("level = 0").collect()}[5] is None
    up = {r.node: r.parent for r in nodes.collect()}
    assert len({up[r.node] for r in levels.where("key in (2, 3) and level = 0").collect()}) == 2


def test_borrowed_levels_assert_nothing(spark):
    levels, nodes = graph(spark, ("a", 1, "kingdom=K/family=F/genus=G", ""), ("b", 2, "family=F/genus=G/species=S", ""))
    assert [(r.item, r.own) for r in levels.where("key = 2").orderBy("level").collect()] == [("kingdom=K", False), ("family=F", True), ("genus=G", True), ("species=S", True)]
    bridge = {(r.source, r.concept): r.supplied for r in merge.concept_bridge(levels).collect()}
    assert ("b", "kingdom=K") not in bridge and bridge["b", "species=S"] == "family=F/genus=G/species=S"
    assert {r.item: r.sources for r in nodes.collect()}["kingdom=K"] == ["a"]


def test_only_supported_spine_nodes_are_targets(spark):
    base = [("a", 1, "kingdom=K/family=F/genus=G", ""), ("b", 2, "kingdom=K/genus=G", "")]
    for more, count in (((), 1), ((("a", 3, "kingdom=K/family=E/genus=G", ""),), 2), ((("a", 3, "kingdom=K/family=E/genus=G", "q"),), 1), ((("a", 3, "kingdom=L/family=E/genus=G", ""),), 1)):
        _, nodes = graph(spark, *base, *more)
        found, to = merged(nodes)
        assert [r.targets for r in found.collect()] == [count]
        assert to.count() == (count == 1)
    _, nodes = graph(spark, base[0], ("b", 2, "kingdom=K/genus=G", "q"))
    assert merged(nodes)[0].collect() == []


def test_nothing_merges_below_what_stands_apart(spark):
    _, nodes = graph(spark, ("a", 1, "kingdom=K/family=F/genus=G/species=S", ""), ("b", 2, "kingdom=K/genus=G:g1/species=S", ""), ("b", 3, "kingdom=K/genus=G:g2/species=S", ""))
    found, to = merged(nodes)
    assert found.where("target is not null").count() == 2 and to.collect() == []


def test_roots_take_the_upper_of_what_joins_them_and_paths_follow(spark):
    levels, nodes = graph(spark, ("a", 1, "kingdom=K/family=F/genus=G", ""), ("b", 2, "clade=Life/kingdom=K/genus=G/species=S", "r"))
    _, to = merged(nodes)
    names = named(nodes)
    assert {(names[r.node], names[r.target]) for r in to.collect()} == {("clade=Life/kingdom=K", "kingdom=K"), ("clade=Life/kingdom=K/genus=G", "kingdom=K/family=F/genus=G")}
    paths = merge.unified(merge.rebuilt_paths(merge.reparented(nodes, to)), to).collect()
    assert {("/".join(r.path), r.unified) for r in paths} == {
        ("clade=Life", False), ("clade=Life/kingdom=K", True), ("clade=Life/kingdom=K/family=F", False), ("clade=Life/kingdom=K/family=F/genus=G", True), ("clade=Life/kingdom=K/family=F/genus=G/species=S", False)
    }
    moved = merge.rewired(merge.concept_bridge(levels), to)
    assert {(r.source, r.concept): r.browse_path_adjusted for r in moved.collect()} == {("a", c): False for c in ("kingdom=K", "family=F", "genus=G")} | {("b", "clade=Life"): False, ("b", "kingdom=K"): True, ("b", "genus=G"): True, ("b", "species=S"): False}
    leaf = {(r.source, r.key): r.node for r in merge.leaves(levels, to).collect()}
    assert names[leaf["a", 1]] == "kingdom=K/family=F/genus=G" and names[leaf["b", 2]] == "clade=Life/kingdom=K/genus=G/species=S"


def test_two_uppers_are_none(spark):
    _, nodes = graph(spark, ("a", 1, "kingdom=K/family=F", ""), ("b", 2, "clade=Life/kingdom=K", "r"), ("b", 3, "clade=Eucarya/kingdom=K", "r"))
    _, to = merged(nodes)
    assert to.count() == 2
    paths = {"/".join(r.path) for r in merge.rebuilt_paths(merge.reparented(nodes, to)).collect()}
    assert paths == {"kingdom=K", "kingdom=K/family=F", "clade=Life", "clade=Eucarya"}


def test_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([("r", "kingdom=K", "supported", None), ("x", "family=X", "supported", "y"), ("y", "family=Y", "supported", "x"), ("z", "genus=Z", "supported", "y")], "node string, item string, placement string, parent string")
    with pytest.raises(ValueError, match="cyclic placement: 3"):
        merge.rebuilt_paths(nodes)
    # the root of the spine joined from below itself
    _, nodes = graph(spark, ("a", 1, "kingdom=K/family=F", ""), ("b", 2, "clade=F/kingdom=K", "r"))
    to = spark.createDataFrame([(n, t) for n, t in ((k, v) for k in (x for x, p in named(nodes).items() if p == "clade=F/kingdom=K") for v in (x for x, p in named(nodes).items() if p == "kingdom=K"))] + [(x, y) for x, p in named(nodes).items() if p == "clade=F" for y, q in named(nodes).items() if q == "kingdom=K/family=F"], "node string, target string")
    with pytest.raises(ValueError, match="cyclic"):
        merge.rebuilt_paths(merge.reparented(nodes, to))


def test_members_are_the_eligible_records(spark):
    records, leaf = spark.createDataFrame([("r", 1), ("s", 1), ("t", 2)], "record string, key int"), spark.createDataFrame([(1, "n"), (2, "m")], "key int, node string")
    assert {tuple(r) for r in merge.membership(records, leaf).collect()} == {("r", "n"), ("s", "n"), ("t", "m")}
    for wrong in (leaf.where("key = 1"), leaf.union(leaf)):
        with pytest.raises(ValueError, match="3 eligible"):
            merge.membership(records, wrong)


def test_fingerprints_tell_all_that_a_build_was_made_of(spark):
    from palimpsest.operators.aggregates import fingerprint

    rows, leaf = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), spark.createDataFrame([(1, "n")], "key int, node string")
    of = lambda *args: merge.build_fingerprint(*args).first().fingerprint
    same = of("v", "r", rows, leaf)
    assert same == of("v", "r", rows.orderBy("b").repartition(2), leaf)
    changed = spark.createDataFrame([(1, "x"), (2, "")], "a int, b string")
    assert len({same, of("w", "r", rows, leaf), of("v", "s", rows, leaf), of("v", "r", changed, leaf), of("v", "r", rows.limit(1), leaf), of("v", "r", rows, leaf.where("false"))}) == 6
    marks = [tuple(fingerprint(f, ["a", "b"]).first()) for f in (rows, rows.orderBy("b").repartition(3), changed, rows.union(rows), rows.where("a = 1"))]
    assert marks[0] == marks[1] and len(set(marks)) == 4
