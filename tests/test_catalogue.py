"""The occurrence source, pages with rights, entity details, proven references, loaded classifications, explicit identifiers."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import catalogue as cat
from palimpsest.operators import reconcile, unify


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture(scope="module")
def records(spark):
    return frame(spark, "record string, content_hash string, is_current boolean", ("o1", "h", True), ("o2", "h", True), ("o3", "h", False), ("c1", "h", True), ("c2", "h", True), ("m1", "h", True), ("m2", "new", True), ("m3", "h", False), ("r1", "h", True), ("r2", "h", True), ("x", None, True))


def test_only_current_members_with_their_hash_stand(spark, records):
    frames = frame(spark, "owner string, member string, content_hash string", ("o1", "m1", "h"), ("o1", "m1", "h"), ("o1", "m2", "h"), ("o1", "m3", "h"), ("o1", "x", None), ("o2", "gone", "h"))
    assert [tuple(r) for r in cat.standing(frames, records).collect()] == [("o1", "m1")]


def test_the_occurrence_source_has_bases_and_proven_materials(spark, records):
    occurrence = "record string, content_hash string, normalization_hash string, external_id int, taxon int, name string, accepted_name string, context string"
    occurrences = frame(spark, occurrence, ("o1", "h", "n", 7, 1, "Felis", None, "k1"), ("o2", "h", "n", 8, 1, "Felis", "Lynx", "k2"), ("o3", "h", "n", 9, 1, "Felis", None, "k1"), ("o1", "other", "n", 7, 1, "Felis", None, "k1"), ("o2", "h", "n", 8, 1, "Felis", None, None))
    contexts = frame(spark, "context string, record string, content_hash string, locality int, place string", ("k1", "c1", "h", 5, "Here"), ("k2", "c2", "h", None, None), ("k3", "c3", "h", 6, "Gone"))
    ages = frame(spark, "record string, content_hash string, policy string, older int, younger int", ("c1", "h", "p", 9, 3), ("c1", "h", "q", 1, 1), ("c2", "h", "p", 9, None))
    materials = frame(spark, "occurrence string, record string, content_hash string", ("o1", "m1", "h"), ("o1", "m2", "h"), ("o1", "m3", "h"), ("o2", "m1", "h"))
    frames = frame(spark, "owner string, member string, content_hash string", ("o1", "m1", "h"), ("o1", "m2", "h"), ("o2", "m1", "stale"))
    got = {r.record: r for r in cat.occurrence_catalogue(occurrences, contexts, ages, materials, frames, records, "p").collect()}
    assert set(got) == {"o1", "o2"}
    assert (got["o1"].materials, got["o1"].older, got["o1"].younger, got["o1"].age_basis, got["o1"].label, got["o1"].locality) == (1, 9, 3, "provider-envelope", "Occurrence 7", 5)
    assert (got["o2"].materials, got["o2"].older, got["o2"].younger, got["o2"].age_basis) == (0, None, None, "provider-partial")
    assert got["o1"].search_text.startswith("7 felis here ") and "lynx" in got["o2"].search_text
    empty = cat.occurrence_catalogue(occurrences.limit(0), contexts, ages, materials, frames, records, "p")
    assert empty.count() == 0


def test_references_need_their_edge_and_their_own_record_in_the_frame(spark, records):
    frames = frame(spark, "owner string, member string, content_hash string", ("o1", "m1", "h"), ("o1", "r1", "h"), ("o1", "c1", "h"), ("o2", "c2", "h"), ("o2", "r2", "stale"))
    evidence = frame(spark, "occurrence int, owner string", (1, "o1"), (2, "o2"))
    edges = "occurrence int, record string, content_hash string, reference int"
    roles = {"material": frame(spark, edges, (1, "m1", "h", 10), (1, "m1", "h", 10), (1, "m1", "old", 10), (1, "m1", "h", 20), (1, "m3", "h", 10)), "collection": frame(spark, edges, (2, "c2", "h", 20), (1, "c2", "h", 10))}
    opinions = frame(spark, "record string, content_hash string, reference int", ("c1", "h", 10), ("c2", "h", 20), ("m1", "old", 10))
    references = frame(spark, "reference int, record string", (10, "r1"), (20, "r2"))
    got = sorted(map(tuple, cat.proven_references(evidence, roles, opinions, references, frames, records).collect()))
    assert got == [(1, "material", 10, "m1"), (1, "opinion", 10, "c1")]


def test_a_page_over_sources_counts_all_and_hides_withheld_places(spark):
    columns = "record_id string, kind string, lon int, lat int, withheld boolean"
    parts = {"a": frame(spark, columns, ("3", "material", 1, 1, False), ("1", "material", 1, 1, True)), "b": frame(spark, columns, ("2", "occurrence", 2, 2, None), ("4", "occurrence", 2, 2, False))}
    rights, kinds = frame(spark, "source string, license string", ("a", "by")), {"m": "material", "o": "occurrence"}
    first = cat.source_page(parts, kinds, rights, size=2).orderBy("record_id").collect()
    assert [(r.record_id, r.source, r.license, r.lon, r.m, r.o, r.total) for r in first] == [("1", "a", "by", None, 2, 2, 4), ("2", "b", None, None, 2, 2, 4), ("3", "a", "by", 1, 2, 2, 4)]
    rest = cat.source_page(parts, kinds, rights, after="2", size=2).orderBy("record_id").collect()
    assert [r.record_id for r in rest] == ["3", "4"] and rest[0].total == 4
    cited = cat.source_page(parts, kinds, rights, citing=frame(spark, "record_id string", ("4",), ("4",), ("9",))).collect()
    assert [(r.record_id, r.m, r.o, r.total) for r in cited] == [("4", 0, 1, 1)]


def test_details_of_entities_of_all_kinds(spark):
    rows = frame(spark, "place string, taxon int, lon int, withheld boolean", ("p", 1, 5, False), ("p", 2, 5, True), ("p", 3, None, False), (None, 1, 5, None), ("p", 1, 5, False))
    described = {"place": frame(spark, "id string, label string, owner string, area int", ("p", "Pond", None, 4), ("q", "Quarry", "x", None)), "taxon": frame(spark, "id int, label string", (1, "one"), (2, "two")), "note": frame(spark, "id int, label string", (1, "n"), (None, "none"))}
    got = {(r.kind, r.id): r for r in cat.entity_details(rows, {"place": "place", "taxon": "taxon"}, described, most=2).collect()}
    assert set(got) == {("place", "p"), ("place", "q"), ("taxon", "1"), ("taxon", "2"), ("note", "1")}
    p = got["place", "p"]
    assert (p.label, p.properties, p.records, p.mapped, p.related, p.related_total, p.related_has_more) == ("Pond", {"area": "4"}, 4, 2, [["taxon", "1"], ["taxon", "2"]], 3, True)
    assert (got["taxon", "1"].records, got["taxon", "1"].mapped, got["taxon", "1"].related) == (3, 2, [["place", "p"]])
    assert (got["note", "1"].records, got["place", "q"].related, got["place", "q"].properties) == (0, [], {"owner": "x"})


def test_walked_classifications_end_in_circles_and_at_their_depth(spark):
    chain = [(100 + i, f"n{i}", "genus", 100 + i - 1 if i else None) for i in range(34)]
    taxa = frame(spark, "id int, name string, rank string, parent int", (1, "Felis", "genus", 2), (2, " felis ", "genus", 3), (3, "Felidae", "family", 77), (4, "a cf. b", None, 5), (5, "c", None, 4), *chain)
    records = frame(spark, "taxon int, qualifier string", (1, "sp."), (1, "aff."), (1, "sp."), (1, ""), (1, None), (4, None), (131, None), (132, None), (133, None), (999, "lost"))
    got = {r.taxon: r for r in unify.walked_classifications(taxa, records).collect()}
    assert set(got) == {1, 4, 131, 132, 133}
    assert (got[1].path, got[1].concepts, got[1].qualifiers, got[1].conflict) == (["family=Felidae", "genus=Felis"], [3, 1], ["aff.", "sp."], False)
    assert (got[4].path, got[4].qualifiers, got[4].conflict) == (["=c", "=a cf. b"], ["qualified source name"], True)
    assert [got[k].conflict for k in (131, 132, 133)] == [False, True, True]
    assert [len(got[k].path) for k in (131, 132, 133)] == [32, 32, 32] and got[133].concepts[0] == 102


def test_supplied_classifications_stop_above_the_leaf(spark):
    rows = frame(spark, "k string, f string, g string, rank string, name string, accepted string", ("K", "F", "G", "genus", "G", " g "), ("K", "NO_FAMILY_SPECIFIED", " ", None, "x sp.", "y"), (None, None, None, "kingdom", "K", None), ("K", "F", "G", "tribe", "t", ""))
    got = rows.select(unify.supplied_classification([(r, F.col(r[0])) for r in ("kingdom", "family", "genus")], F.col("rank"), F.col("name"), F.col("accepted"), [F.lit("q"), F.lit("")]).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [(["kingdom=K", "family=F", "genus=G"], ["q"], False), (["kingdom=K", "=x sp."], ["q", "qualified source name"], True), (["kingdom=K"], ["q"], False), (["kingdom=K", "family=F", "genus=G", "tribe=t"], ["q"], True)]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (("uf:vp:12A", None, None, None), ("complete", "explicit triplet", "UF", "VP", "12A")),
        (("UF 12", None, None, None), ("partial", "missing components", "UF", None, "12")),
        (("UF 1/2", None, None, None), ("ambiguous", "list or range", "UF", None, "1/2")),
        ((None, "uf", "vp", "10 – 12"), ("ambiguous", "list or range", "UF", "VP", "10 – 12")),
        ((None, "uf", "vp", "10-A"), ("complete", "explicit triplet", "UF", "VP", "10-A")),
        ((None, "uf", "vp", "none"), ("malformed", "unsupported format", "UF", "VP", "none")),
        ((None, " Elsewhere ", "vp", "3"), ("complete", "explicit triplet", "Elsewhere", "VP", "3")),
        (("UF VP 3", "UF", "VP", "3"), ("complete", "explicit triplet", "UF", "VP", "3")),
        (("UF VP 3", "UF", "PB", "3"), ("ambiguous", "conflicting components", "UF", "PB", "3")),
        (("UF VP 3", "UF", None, "3"), ("partial", "missing components", "UF", None, "3")),
        (("UF what", "UF", "VP", "3"), ("ambiguous", "conflicting components", "UF", "VP", "3")),
        (("somewhere 3", "UF", "VP", "3"), ("complete", "explicit triplet", "UF", "VP", "3")),
        (("somewhere 3", None, None, None), ("partial", "missing components", None, None, None)),
        (("", "", "", ""), ("partial", "missing components", None, None, None)),
        ((None, None, None, None), ("partial", "missing components", None, None, None)),
    ],
)
def test_explicit_identifiers(spark, given, want):
    row = frame(spark, "l string, i string, c string, n string", given)
    assert tuple(row.select(reconcile.explicit_identifier(F.col("l"), F.col("i"), F.col("c"), F.col("n"), ("UF",), ("VP", "PB")).alias("p")).select("p.*").first()) == want
