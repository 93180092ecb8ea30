"""Quality, whitening and source divergence against brute force, on small tables with nulls, empties, ties and extra columns."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import decontamination, divergence, language, quality, suffixdedup, whitening

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, score string, `a.b` string, chunk string, odds double"
RNG = np.random.default_rng(3)


def corpus():
    words = ["oak", "Oak,", "elm", "ELM.", "ash", "über", "日本", "don't", "x1y", "12", "$$", "a-b-a"]
    texts = [None, "", " \t\n", "$$ 12", "oak" * 3000, "oak " * 4000, "oak\nOak, oak", *[" ".join(RNG.choice(words, RNG.integers(1, 30))) for _ in range(60)]]
    langs, sources = ["en", "de", None, ""], ["s1", "s2", "S3", None, "é"]
    rows = [(k, t, langs[k % 4] if k % 9 else "xx", sources[k % 5], 5, "t", "s", "d", "c", 0.5) for k, t in enumerate(texts)]
    return rows + rows[5:9] + [(None, None, None, None, None, *"tsdc", None)]


def brute_audit(rows, least, smooth=5, top=50):
    occurrences, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        occurrences[lang, source].update(found)
        documents[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in documents[lang].items() if n >= least}
        own = {s: Counter({t: n for t, n in occurrences[lang, s].items() if t in kept}) for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + smooth) // (sum(c.values()) + smooth * len(kept))

        for s, c in own.items():
            pairs = [(-sum(abs(share(c, t) - share(d, t)) for t in kept), o.encode(), o) for o, d in own.items() if o != s]
            marks = [(share(whole, t) - share(c, t), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            out |= {(lang, s, "pair", item, -v, k) for k, (v, _, item) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", item, -v, k) for k, (v, _, item) in enumerate(sorted(marks)[:top], 1)}
    return out


@pytest.mark.parametrize("least", [1, 4, 1000])
def test_divergence(spark, least):
    rows = corpus()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), least_docs=least, top=4, slice_bytes=400, block=2, bucket=3).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_audit(rows, least, top=4)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def covariance_matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 5], [5, 5, 5, 1, 0], [3, 0, 0], [7], [1e6, 1e-3, 1e-4, 2e-4], list(range(1, 41)), [2.0] * 12, [8, 4, 2, 1, 0.5, 0.25], [1e-9, 2e-9]])
def test_leading_eigenpairs(values):
    matrix = covariance_matrix(np.array(values, float))
    matrix = (matrix + matrix.T) / 2
    for wanted in (1, 2, 4):
        got, vectors = whitening.leading(matrix, wanted)
        want = np.sort(values)[::-1][:wanted]
        want = want[want > 1e-11 * max(values)]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12 * max(values))
        assert np.allclose(matrix @ vectors, vectors * got, atol=1e-11 * max(values))
        assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-12)


def test_inertia():
    for seed in range(20):
        values = np.random.default_rng(seed).integers(-3, 4, 9).astype(float) + 0.5
        assert whitening.positive_count(covariance_matrix(values, seed)) == (values > 0).sum()
    assert whitening.positive_count(np.array([[0.0, 1], [1, 0]])) == 1
    assert whitening.positive_count(np.zeros((3, 3))) == 0


VECTORS = "vec_id bigint, embedding array<float>, component string, n string, whitened string, x string"


def test_whitening(spark):
    vectors = [[float(x) for x in v] for v in RNG.normal(0, 1, (40, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]]
    rows = [(k, v, *"abcd") for k, v in enumerate(vectors)] + [(7, vectors[3], *"abcd"), (None, vectors[0], *"abcd")]
    bad = [(90, None, *"abcd"), (91, [1.0, None, *[0.0] * 4], *"abcd"), (92, [float("nan")] * 6, *"abcd"), (93, [float("-inf")] + [0.0] * 5, *"abcd")]
    frame = spark.createDataFrame(rows + bad, VECTORS).repartition(3)
    model = whitening.fit(frame)
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int)
    fitted = np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(axis=0)
    centred = fitted - s / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:4], q[:, ::-1][:, :4]
    got = whitening.whiten(frame, model).collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3, 4}
    assert max(r["identity_error"] for r in got) < 1e-12
    y, dev = (x - s / n) @ q / np.sqrt(values), ((n * x - s) ** 2).sum(axis=1)
    want = sorted((-1 if r[0] is None else r[0], int(d), k + 1, round(abs(y_[k]), 9)) for r, y_, d in zip(rows, y, dev) for k in range(4))
    assert want == sorted((-1 if r["id"] is None else r["id"], r["deviation"], r["component"], round(abs(r["whitened"]), 9)) for r in got)
    assert np.allclose([r["explained"] for r in got if r["id"] == 1], values / np.trace(centred.T @ centred / n), rtol=1e-9)


def test_whitening_of_little(spark):
    of = lambda *vectors: spark.createDataFrame([(k, v, *"abcd") for k, v in enumerate(vectors)], VECTORS)
    for frame in (of(), of(None), of([1.0, 2.0]), of([1.0], [1.0]), of([], [])):
        assert whitening.whiten(frame, whitening.fit(frame)).collect() == []
    line = of([1.0, 1.0], [2.0, 2.0], [3.0, 3.0])
    assert sorted(round(r["whitened"], 6) for r in whitening.whiten(line, whitening.fit(line)).collect()) in ([-1.224745, 0, 1.224745], [-1.224745, -0.0, 1.224745])
    with pytest.raises(ValueError):
        whitening.fit(of([1.0], [1.0, 2.0]))


def test_large_deviations():
    model = whitening.Model(10**9, [3, -5])
    x = np.array([[2, -1], [0, 0]])
    assert model.deviations(x).tolist() == [(2 * 10**9 - 3) ** 2 + (-(10**9) + 5) ** 2, 34]
    with pytest.raises(OverflowError):
        model.deviations(np.array([[10, 10]]))


def test_machine_is_the_sum_over_pairs():
    columns, rows = np.array([0, 3, 4, 1, 2, 4, 0]), np.array([0, 0, 0, 1, 1, 1, 3])
    x, w, v = RNG.normal(size=7), RNG.normal(size=5), RNG.normal(size=(5, 3))
    got, _ = quality.log_odds(0.7, w, v, rows, columns, x, 5)
    for d in range(5):
        own = [(c, a) for c, a, r in zip(columns, x, rows) if r == d]
        pairs = sum(v[c] @ v[e] * a * b for i, (c, a) in enumerate(own) for e, b in own[:i])
        assert np.isclose(got[d], 0.7 + sum(w[c] * a for c, a in own) + pairs)


def test_statistics():
    texts = pa.array(["a A 12 b! b!\nxx", None, "", "ÉÉ $$ ABC"])
    of_doc, buckets, values, s = quality.features(texts)
    at = dict(zip(quality.STATISTICS, s.T))
    assert np.allclose(np.bincount(of_doc, values.astype(float) ** 2, 4), [1, 0, 0, 1]) and buckets.max() < quality.BUCKETS
    assert np.allclose(at["tokens"], np.log1p([6, 0, 0, 3])) and np.allclose(at["capitals"], [1 / 10, 0, 0, 3 / 9]) and np.allclose(at["digits"], [0.2, 0, 0, 0])
    assert np.allclose(at["repeated"], [1 / 6, 0, 0, 0]) and np.allclose(at["distinct"], [5 / 6, 0, 0, 1]) and np.allclose(at["marked"], [2 / 6, 0, 0, 0])
    assert np.allclose(at["other"], [0, 0, 0, 4 / 9]) and np.allclose(at["lone_marks"], [0, 0, 0, 1 / 3]) and np.allclose(at["top"], [2 / 6, 0, 0, 1 / 3]) and np.allclose(at["all_capitals"], [0, 0, 0, 1 / 3])


def labelled(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(40)]
    rows, labels = [], []
    for k in range(400):  # poor: both marks, or neither; a sum of words can't tell
        one, two = k % 2, k // 2 % 2
        text = " ".join([*rng.choice(words, 30), *["left"] * (6 * one), *["right"] * (6 * two)])
        rows.append((k, text, "en", "s", len(text), *"tsdc", 1.0))
        labels.append((k, int(one != two)))
    rows += [(900, None, None, None, None, *"tsdc", None), (901, "", None, None, 0, *"tsdc", None), (902, "left " * 9000, None, None, None, *"tsdc", None), rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels + [(3, 0), (7, None), (None, 1), (5000, 1)], "doc_id bigint, quality int")


def test_quality_learns_an_interaction(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id is null or doc_id < 8 or floor(doc_id / 4) % 4 != 3"), epochs=40)
    got = quality.score(docs, model)
    assert sorted(got.columns) == sorted(docs.columns)
    rows = got.collect()
    assert len(rows) == 404 and all(0 <= r["score"] <= 1 for r in rows) and {r["odds"] for r in rows} == {1.0, None}
    test = [r for r in rows if 8 <= r["doc_id"] < 400 and r["doc_id"] // 4 % 4 == 3]
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 2 != r["doc_id"] // 2 % 2) for r in test]
    assert np.mean(right) > 0.9
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(5), model).collect()}
    assert all(np.isclose(again[r["doc_id"]], r["score"], rtol=1e-6) for r in rows)


def test_quality_without_a_class(spark):
    docs, labels = labelled(spark)
    assert quality.fit(docs, labels.where("quality = 1")) == 1.0 and quality.fit(docs, labels.where("false")) == 0.0
    assert {r["score"] for r in quality.score(docs, 0.25).collect()} == {0.25}
    model = quality.fit(docs, labels)
    assert quality.score(docs.where("false"), model).count() == 0


def test_a_document_that_holds_every_item(spark):
    rng = np.random.default_rng(9)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 5000, 24))) for k in range(120)]
    docs = [(1, " and ".join(t for _, t in items)), (2, items[7][1] + " end"), (3, " ".join(items[8][1].split()[:19])), (None, items[9][1]), (4, None)]
    got = decontamination.contained_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.id, r.item, r.n_shared, r.n_shingles) for r in got.collect()} == {(1, k, 20, 20) for k in range(120)} | {(2, 7, 20, 20), (None, 9, 20, 20)}


def test_splitters_of_a_cut_sample_are_balanced(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 3000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    every, _, _ = suffixdedup._sample(docs, 60, 8)
    few, _, _ = suffixdedup._sample(docs, 60, 8, most=400)
    assert len(few) == len(every) == 7
    first = lambda cuts: [c[:1].decode() for c in cuts]
    assert all(abs(ord(a) - ord(b)) <= 3 for a, b in zip(first(every), first(few)))


def test_language_against_plain_counts(spark):
    """Every word is known to the model, so the prediction is naive Bayes over words; labels repeat and tie, columns clash."""
    rng = np.random.default_rng(8)
    vocabulary = {"aa": ["oak", "elm", "ash", "the"], "bb": ["eiche", "ulme", "die", "the"]}
    rows = [(k, " ".join(rng.choice(vocabulary[lang], 6)), lang, "x", "y") for k, lang in enumerate(["aa"] * 40 + ["bb"] * 40)]
    rows += [rows[0], (200, None, "aa", "x", "y"), (201, "12 !!", "bb", "x", "y"), (202, "the", None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `a.b` string, lang_score string").repartition(3)
    model = language.fit(docs)
    counts, totals = {x: Counter() for x in ("aa", "bb")}, Counter()
    for _, text, lang, *_ in rows:
        if lang and text is not None:
            totals[lang] += 1
            counts[lang].update(w for w in re.findall(r"[^\W\d_]+", text))
    words = set(counts["aa"]) | set(counts["bb"])
    logs = {x: {w: np.log((c[w] + 0.5) / (sum(c.values()) + 0.5 * len(words))) for w in words} for x, c in counts.items()}
    got = language.predict(docs, model)
    assert got.columns.count("lang_score") == 1 and "a.b" in got.columns
    for r in got.collect():
        found = re.findall(r"[^\W\d_]+", r["text"] or "")
        if not found:
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
            continue
        value = {x: np.log(totals[x] / sum(totals.values())) + sum(logs[x][w] for w in found) for x in logs}
        share = {x: np.exp(v - max(value.values())) for x, v in value.items()}
        best = max(sorted(share), key=share.get)
        assert r["lang_pred"] == best and np.isclose(r["lang_score"], share[best] / sum(share.values()))
