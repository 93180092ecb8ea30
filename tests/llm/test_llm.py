"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import bpe, common, decontamination, language, lzfingerprint, ngram, queries, simhash, suffixdedup, tokenstore, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score string, kept string, component string, lang_pred string"
RNG = random.Random(7)
WORDS = ["oak", "elm", "Ash,", "über", "naïve", "don't", "12", "日本", "end.", "The", "the"] + ["".join(RNG.choices("abcdefgh", k=6)) for _ in range(60)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(WORDS, k=n))


PASSAGE, LONG = prose(60), prose(4000)
TEXTS = [
    PASSAGE + " one", "start " + PASSAGE, LONG, None, "", "  \t\n ", "!!! 123", "x" * 5000, "日本" * 90 + PASSAGE[:150], PASSAGE[:99], PASSAGE[:100], PASSAGE[:100] + PASSAGE[:100],
    prose(200), LONG[:9000] + " changed", prose(3), "oak", "<|endoftext|> oak  <|endoftext|>x", "á á\x1c\x85 ​", LONG,
]
ROWS = [(i, t, ("en", "fr", None)[i % 3], "s", 0, "x", "x", "x", "x", "x") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], ROWS[0], (2, "other text for the same id", "en", "s", 0, *"xxxxx"), (None, "a text without id", "en", "s", 0, *"xxxxx"), (None, None, None, None, None, *"xxxxx")]
UNIQUE = [r for r in ROWS[: len(TEXTS)]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame(UNIQUE, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_words(text):
    return (text or "").encode().lower().split()


def brute_simhash(text):
    w = lower_words(text)
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    prints = sorted({brute_simhash(r[1]) for r in ROWS})
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for r in ROWS:
        if r[0] is not None:
            k = top(brute_simhash(r[1]))
            least[k] = min(least.get(k, r[0]), r[0])
    want = Counter((r[0], brute_simhash(r[1]), least.get(top(brute_simhash(r[1])))) for r in ROWS)
    assert Counter((r.id, r.fp & (2**64 - 1), r.component) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_tiles_find_every_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(300)]
    prints = base + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base[:150]] + [0, 1, 3, 7, 2**64 - 1]
    signed = [(x - 2**64 if x >> 63 else x,) for x in set(prints)]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"), 2, tile=16).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() for r in found)
    nodes = [x & (2**64 - 1) for (x,) in signed]
    comp = {x: x for x in nodes}

    def top(p):
        while comp[p] != p:
            p = comp[p]
        return p

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 2:
                comp[max(top(a), top(b))] = min(top(a), top(b))
    want = {frozenset(v) for v in [[x for x in nodes if top(x) == t] for t in {top(x) for x in nodes}] if len(v) > 1}
    roots = common.components(spark.createDataFrame([(r.a, r.b) for r in found], "a bigint, b bigint")).collect()
    groups = defaultdict(set)
    for r in roots:
        groups[r.root].add(r.node & (2**64 - 1))
    assert {frozenset(v) for v in groups.values()} == want


def brute_cut(rows):
    seen, out = set(), {}
    for i, text in rows:
        d = (text or "").encode()
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 99):
            w = d[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        out[i] = (len(d), int(gone.sum()), int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum()), bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


def test_suffix_dedup(unique, docs, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.cut(unique).collect()}
    assert got == brute_cut([(r[0], r[1]) for r in UNIQUE])
    tied = suffixdedup.cut(docs)
    assert tied.count() == len(ROWS) and "source" in tied.columns
    assert len({(r.n_removed, bytes(r.kept)) for r in tied.where("doc_id = 0").collect()}) == 1
    assert suffixdedup.cut(empty).count() == 0


def test_suffix_dedup_over_many_ranges(spark, monkeypatch):
    rng = random.Random(2)
    hot = "".join(rng.choices("abcdef ", k=150))
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    pieces = [" ".join(rng.choices(words, k=40)) for _ in range(25)]
    texts = []
    for i in range(300):
        parts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(3)]
        parts.insert(rng.randrange(4), hot[rng.randrange(30) : rng.randrange(120, 150)] if i % 3 else hot)
        parts.insert(rng.randrange(5), rng.choice(pieces)[rng.randrange(40) :])
        texts.append(" ".join(parts))
    texts += ["z" * 700, "yz" * 300, "z" * 650 + "q", texts[5] * 2, texts[7][:180]]
    rng.shuffle(texts)
    rows = [(3 * i - 200, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id bigint, text string, _doc string, _text string, key string").repartition(5)
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 4000)
    want = brute_cut(rows)
    splitters, often, spread = suffixdedup._sample(table.select("doc_id", "text"), len(rows), 30)
    assert len(splitters) > 10 and len(often) and spread.min() > 1
    got = suffixdedup.cut(table).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert all((r._doc, r._text, r.key) == ("a", "b", "c") for r in got)


def test_suffix_dedup_compares_bytes_where_hashes_agree():
    rng = np.random.default_rng(4)
    strings = [bytes(x) for x in rng.integers(97, 99, (400, 6)).astype(np.uint8)]
    doc, place = rng.integers(0, 50, 400), rng.integers(0, 9, 400)
    data = np.frombuffer(b"".join(strings), np.uint8)
    first = {}
    for s, d, p in zip(strings, doc, place):
        first[s] = min(first.get(s, (d, p)), (d, p))
    want = [first[s] != (d, p) for s, d, p in zip(strings, doc, place)]
    for key in (np.zeros(400, np.uint64), np.array([s[0] for s in strings], np.uint64)):
        assert suffixdedup._repeats(key, doc, place, data, np.arange(400) * 6, np.full(400, 6)).tolist() == want


def test_multikey_order():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = rng.integers(0, 4, (n, 5)).astype(np.uint64)
        assert (keys[suffixdedup.multikey_order(keys)] == keys[np.lexsort(keys.T[::-1])]).all()


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, "oak"), (3, None), (4, ""), (5, prose(40)), (1, PASSAGE), (6, " ".join(PASSAGE.split()[:50] + ["zzz"] * 3))], "item_id bigint, text string")
    got = {(r.id, r.item): (r.n_shared, r.n_shingles) for r in decontamination.contained_items(docs, items).collect()}

    def shingled(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    by_item, by_doc = defaultdict(set), defaultdict(list)
    for i, t in [(r.item_id, r.text) for r in items.collect()]:
        w = decontamination.words_of(t)
        by_item[i] |= shingled(w, min(5, len(w))) if w else set()
    for r in ROWS:
        by_doc[r[0]].append(decontamination.words_of(r[1]))
    want = {}
    for d, many in by_doc.items():
        for i, s in by_item.items():
            shared = {x for x in s if any(x in shingled(w, len(x)) for w in many)}
            if s and len(shared) >= math.ceil(0.8 * len(s) - 1e-9):
                want[d, i] = (len(shared), len(s))
    assert got == want and (0, 1) in got
    assert decontamination.contained_items(empty, items).count() == 0
    assert decontamination.contained_items(docs, items.where("item_id > 99")).count() == 0
    assert decontamination.without_contaminated(docs, items).where("doc_id in (0, 1)").count() == 0


def test_language(spark, docs, empty):
    known = [(i, " ".join(random.Random(i).choices(w, k=30)), lang) for i in range(60) for lang, w in (("en", ["the", "there", "thing", "with"]), ("fr", ["les", "lesquels", "avec", "où"]))]
    model = language.fit(spark.createDataFrame(known, "doc_id bigint, text string, lang string"))
    probe = spark.createDataFrame([(1, "The thing"), (2, "LES lesquelles"), (3, "123 !?"), (4, None), (5, ""), (6, "日本")], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.predict(probe, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "fr", "und", "und", "und"] and got[6][0] in ("en", "fr")
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.predict(docs, model).count() == len(ROWS) and language.predict(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=40) + (["nastyword"] * 3 if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic").where("doc_id % 3 != 1"))
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    held = [(t, got[i]) for i, _, t in rows if i % 3 == 1]
    assert min(s for t, s in held if t) > 0.7 > max(s for t, s in held if not t)
    scored = toxicity.score(docs, model)
    assert scored.count() == len(ROWS) and all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, table.where("toxic = 0").select("doc_id", "toxic"))).collect()} == {0.0}


def test_toxicity_scores_from_dictionary_lengths(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=30) + ["Nastyword", "vile"][: rng.randrange(3)] * (i % 3 == 0)), "x", "y", int(i % 3 == 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, features string, toxic int")
    labels = table.select("doc_id", "toxic").unionByName(table.where("toxic = 1").select("doc_id", F.lit(0).alias("toxic")))  # both labels: 1
    model = toxicity.fit(table, labels)
    assert model.weights.tolist() == toxicity.fit(table, table.select("doc_id", "toxic")).weights.tolist()
    scorer = toxicity.Scorer(model.toxic, model.ordinary)
    for r in toxicity.score(table, model).collect():
        words = "".join(c if not c.isascii() or c.isalnum() else " " for c in r.text).encode().lower().decode().split()
        spared = [len(scorer.ordinary.compress(w)) - len(scorer.toxic.compress(w)) for w in ((" " + x).encode() * 4 + b" " for x in words)]
        sizes = [len(x.encode()) + 1 for x in words]
        counts = [sum(d >= t for d in spared) for t in range(2, 9)] + [sum(d / n >= t for d, n in zip(spared, sizes)) for t in (0.5, 0.75)]
        k = len(words)
        x = [sum(spared) / k, *[10 * c / k for c in counts[:7]], *[math.log1p(c) for c in counts[:7]], *[10 * c / k for c in counts[7:]], *[math.log1p(c) for c in counts[7:]], math.log1p(k) / 10]
        logit = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.spread))
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-9 and (r._text, r.features) == ("x", "y")


def test_toxicity_dictionaries_and_weights(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=20) + ["vile", "nasty", "x" * 70][: rng.randrange(4)] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(table, table.select("doc_id", "toxic"), toxic_bytes=200, ordinary_bytes=40, least_z=3)
    plainly = lambda t: "".join(c if not c.isascii() or c.isalnum() else " " for c in t).encode().lower().decode().split()
    sets = [(set(plainly(t)), y) for _, t, y in rows]
    n1, n0 = sum(y for _, y in sets), sum(1 - y for _, y in sets)
    seen = {w: (sum(w in s for s, y in sets if y), sum(w in s for s, y in sets if not y)) for s, _ in sets for w in s if len(w) <= 64}
    z = {w: (a / n1 - b / n0) / math.sqrt((a + b) / (n1 + n0) * (1 - (a + b) / (n1 + n0)) * (1 / n1 + 1 / n0) + 1e-12) for w, (a, b) in seen.items()}
    toxic = sorted((w for w in z if z[w] > 3 and seen[w][0] >= 3), key=lambda w: (-z[w], w))
    plain = sorted((w for w in z if abs(z[w]) < 1.5), key=lambda w: (-seen[w][1], w))

    def content(words, most):
        out = b" "
        for w in words:
            if len(out) + len(w) + 1 > most:
                break
            out = b" " + w.encode() + out
        return out

    assert {"vile", "nasty"} <= set(toxic) and model.toxic == content(toxic, 200) and model.ordinary == content(plain, 40) and len(model.ordinary) <= 40
    x = toxicity.Scorer(model.toxic, model.ordinary).features(pa.array([t for _, t, _ in rows]))
    y = np.array([t for *_, t in rows], float)
    x = np.column_stack([np.ones(len(x)), (x - model.mean) / model.spread])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ model.weights))) - np.r_[0, model.weights[1:]]  # of the ridge logistic likelihood, all rows drawn
    assert np.abs(slope).max() < 1e-4


def test_lz_fingerprints(unique, docs, empty):
    got = {r.id: r for r in lzfingerprint.edited_fingerprints(unique).collect()}
    order = sorted(UNIQUE, key=lambda r: -r[0])
    for a, b in zip(order, order[1:] + order[:1]):
        s, t = a[1] or "", b[1] or ""
        edited = s[: len(s) - len(s) // 3] + t[: len(s) // 3]
        r = got[a[0]]
        assert (r.n_chars, r.edited_sha256) == (len(s), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lzfingerprint.fingerprint(s), lzfingerprint.fingerprint(edited))
        for near, other in ((r.near_edited, edited), (r.near_next, t)):
            assert abs(near - brute_likeness(s, other)) < 1e-9
    assert got[2].fingerprint == got[18].fingerprint and got[3].fingerprint == got[4].fingerprint == ""
    assert lzfingerprint.edited_fingerprints(docs).count() == len(ROWS) and lzfingerprint.edited_fingerprints(empty).count() == 0


def brute_likeness(s, t):
    """The share of values that both have among the smallest phrase hashes of both, phrases by a plain LZ78 parse."""
    marks, whole = [], 2**64 - 1

    def mark(phrase):
        h = sum((c + 1) * pow(lzfingerprint._BASE, k, 2**64) for k, c in enumerate(phrase)) & whole
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & whole
        return (h ^ h >> 32) >> 32

    for data in (s.encode(), t.encode()):
        seen, phrases, at = set(), set(), b""
        for k in range(len(data)):
            at += data[k : k + 1]
            if at not in seen:
                seen.add(at)
                phrases.add(at)
                at = b""
        if at:
            phrases.add(at)
        marks.append(set(sorted(map(mark, phrases))[: lzfingerprint.SIZE]))
    least = sorted(marks[0] | marks[1])[: lzfingerprint.SIZE]
    return sum(x in marks[0] and x in marks[1] for x in least) / len(least) if least else 1.0


def test_lz_parse_by_hand():
    parse = lzfingerprint.Parse().feed(b"aababcab")  # a, ab, abc, ab left over
    assert parse.ends == [1, 3, 6] and len(parse.signature(b"aababcab")) == 3


def test_bpe_round_trip(docs, empty):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))
    assert bpe.encode(empty, path).count() == 0
    clashing = docs.select("doc_id", F.lit("a").alias("_text"), F.lit("b").alias("slice"), F.lit(1).alias("bucket"), "text")
    small = bpe.encode(clashing, path, slice_bytes=3000, bucket_bytes=500).collect()  # many slices and buckets, a text longer than a slice
    assert len(small) == len(ROWS) and all((r._text, r.slice, r.bucket) == ("a", "b", 1) and r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in small)


def test_bpe_random_text(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(11)
    bits = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "'", "!", "<|endoftext|>", "<", "é", " the", "12", "\x1c", "\x85", "日", "🙂", "\r\n", "_", "İ", "Σς", "​", "word,", " word.", bpe._MARK]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(14)))) for i in range(1500)]
    for r in bpe.encode(spark.createDataFrame(rows, "i int, text string"), path).collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids, repr(r.text)


def test_token_store(spark, unique, docs, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    at = common.scratch(spark, "store")
    tokenstore.write_store(unique, at, path)
    want, start = {}, 0
    for r in UNIQUE:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[r[0]] = (start, ids)
        start += len(ids)
    assert {r.doc_id: r.ids for r in tokenstore.read_documents(spark, at).collect()} == {k: v for k, (_, v) in want.items()}
    for r in tokenstore.document_sums(spark, at).collect():
        ids = np.array(want[r.doc_id][1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (want[r.doc_id][0], len(ids), zlib.crc32(ids.tobytes()))
    chunks = spark.read.parquet(f"{at}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < spark.read.parquet(f"{at}/recipes").agg(F.sum(F.size("digests"))).first()[0]
    bad = common.scratch(spark, "bad")
    chunks.withColumn("ids", F.concat("ids", F.lit(b"\0\0"))).write.parquet(f"{bad}/chunks")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{at}/{name}").write.parquet(f"{bad}/{name}")
    with pytest.raises(Exception, match="differs"):
        tokenstore.document_sums(spark, bad).collect()
    assert tokenstore.store_and_read(docs, path).count() == len(ROWS) and tokenstore.store_and_read(empty, path).count() == 0


def test_near_duplicates_at_jaccard(spark, docs, empty):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{g}x{rng.randrange(10**6)}" for _ in range(120)]
        for e in range(6):
            w = list(base)
            for at in rng.sample(range(120), e):  # an edited word changes five shingles of 116
                w[at] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(None, rows[0][1]), (500, None), (501, "  "), (502, "one two"), (503, "One  two"), (504, "one three")]
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := lower_words(t)) else set() for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    want = Counter((r[0], min(x[0] for x, k in zip(rows, root) if k == root[i] and x[0] is not None)) for i, r in enumerate(rows))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    prints = [brute_simhash(t) for _, t in rows]
    assert max((prints[i] ^ prints[j]).bit_count() for g in range(12) for i in range(6 * g, 6 * g + 6) for j in range(6 * g, 6 * g + 6)) <= 20
    for block in (4, simhash.SETS):
        assert Counter((r.id, r.component) for r in simhash.similar_documents(table, radius=20, block=block).collect()) == want
    sets = [(i, simhash.shingle_set(t)) for i, (_, t) in enumerate(rows[:72])]
    members = [(i, int(np.uint64(prints[i]).view(np.int64)), len(s), simhash.bands(s).tolist()) for i, s in sets]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 20 and min(members[i][2], members[j][2]) >= 0.8 * max(members[i][2], members[j][2])
    linked = {(i, j) for i in range(72) for j in range(i) if set(members[i][3]) & set(members[j][3]) and near(i, j)}
    frame = spark.createDataFrame(members, "key bigint, fp bigint, size bigint, bands array<bigint>")
    for tile in (2, simhash.TILE):  # bands cut into blocks find the same components
        got = [(r.node, r.root) for r in common.components(simhash.banded_links(frame, 20, 0.8, tile)).collect()]
        own = list(range(72))
        for i, j in linked:
            own = [own[j] if r == own[i] else r for r in own]
        assert {(n, min(k for k in range(72) if own[k] == own[n])) for n, _ in got} == set(got)
        assert {n for n, _ in got} == {i for p in linked for i in p}
    assert simhash.similar_documents(docs).count() == len(ROWS) and simhash.similar_documents(empty).count() == 0
    import corpus_pipeline

    kept = corpus_pipeline.near_duplicates(spark, table, "").collect()
    assert {c for _, c in want} | {None} <= {r.doc_id for r in kept} and len(kept) <= 4 + len({c for _, c in want})


def test_ngram_model(docs, empty):
    model = ngram.fit(docs.select("text"), hot_share=0.02)
    got = ngram.score(docs, model).collect()
    texts = [lower_words(r[1]) + [None] for r in ROWS]
    count, pairs = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip([0] + t, t))
    n, v = sum(count.values()), len(count)
    ends, ctx = Counter(b for _, b in pairs), defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in pairs.items():
        ctx[a][0] += c
        ctx[a][min(c, 3)] += 1
    d2, d1 = (ngram._discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (pairs, ends))
    uniform = sum(d1[min(c, 3) - 1] for c in ends.values()) / len(pairs) / (v + 1)
    cut = lambda c, d: c - d[min(c, 3) - 1] if c else 0

    def prob(a, b):
        low = cut(ends[b], d1) / len(pairs) + uniform
        t = ctx[a]
        return cut(pairs[a, b], d2) / t[0] + sum(d2[k] * t[k + 1] for k in range(3)) / t[0] * low

    want = Counter()
    for r, t in zip(ROWS, texts):
        want[(r[0], len(t), sum(w in count for w in t), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6), round(sum(math.log10(prob(a, b)) for a, b in zip([0] + t, t)), 6))] += 1
    assert model.tokens == n and Counter((r.id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert abs(sum(prob("oak".encode(), w) for w in count) + (1 - v / (v + 1)) * 0 + (sum(d2[k] * ctx[b"oak"][k + 1] for k in range(3)) / ctx[b"oak"][0]) * uniform - 1) < 1e-9
    none = ngram.fit(empty.select("text"))
    assert ngram.score(empty, none).count() == 0 and {r.score for r in ngram.score(docs, none).collect()} == {0.0}


def test_ngram_model_of_order_three(docs, empty):
    texts = [lower_words(r[1]) + [None] for r in ROWS]
    threes = Counter(p for t in texts for p in zip([0, 0] + t, [0] + t, t))
    twos = Counter()
    for (_, b, c), n in threes.items():
        twos[b, c] += n if b == 0 else 1
    threes = {k: n for k, n in threes.items() if k[1] != 0}
    ones = Counter(b for _, b in twos)
    words = Counter(w for t in texts for w in t)
    cut = lambda c, d: c - d[min(c, 3) - 1] if c else 0
    d3, d2, d1 = (ngram._discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (threes, twos, ones))
    sums = defaultdict(lambda: [0, 0.0])
    for grams, d in ((threes, d3), (twos, d2)):
        for k, n in grams.items():
            sums[k[:-1]][0] += n
            sums[k[:-1]][1] += d[min(n, 3) - 1]

    def prob(a, b, c):
        p = cut(ones[c], d1) / len(twos) + sum(d1[min(x, 3) - 1] for x in ones.values()) / len(twos) / (len(words) + 1)
        p = (cut(twos[b, c], d2) + sums[(b,)][1] * p) / sums[(b,)][0]
        return (cut(threes.get((a, b, c), 0), d3) + sums[a, b][1] * p) / sums[a, b][0] if (a, b) in sums else p

    want = Counter((r[0], round(sum(math.log10(prob(*p)) for p in zip([0, 0] + t, [0] + t, t)), 6)) for r, t in zip(ROWS, texts))
    for share in (0.02, 0.002, 1.0):
        model = ngram.fit(docs.select("text"), hot_share=share, order=3, passes=3 if share == 0.002 else 1)
        assert Counter((r.id, round(r.score, 6)) for r in ngram.score(docs, model).collect()) == want
    assert {r.score for r in ngram.score(docs, ngram.fit(empty.select("text"), order=3)).collect()} == {0.0}


def test_warc(spark):
    rows = [(3, "http://a/3", "<p>é</p>", "x"), (1, "http://a/1", "<p>é</p>", "x"), (2, None, None, "x"), (5, "http://a\r\nb", "", "x"), (4, "http://a/4", "one\r\n\r\nWARC/1.1\r\n\r\n" * 50, "x"), (None, "n", "<p>é</p>", "x"), (1, "http://a/1", "<p>é</p>", "x")]
    got = warc.deduplicate(spark.createDataFrame(rows, "page_id bigint, url string, html string, type string").repartition(2)).collect()
    assert len(got) == len(rows)
    import base64

    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), digest(h)) for i, _, h, _ in rows)
    kinds = Counter((r.page_id, r.type, r.refers_page) for r in got)
    assert kinds == Counter([(1, "response", None), (1, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (5, "revisit", 2), (4, "response", None)])
    large = warc.deduplicate(spark.createDataFrame(rows, "page_id bigint, url string, html string, type string"), least_bytes=5).collect()
    assert {r.type for r in large if r.page_id in (2, 5)} == {"response"}
    assert warc.deduplicate(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_large_pages_stand_alone(spark):
    big = "é" * warc.LARGE_BYTES
    rows = [(i, f"http://x/{i}", big if i in (3, 7) else f"page {i % 2}") for i in range(1, 9)]
    path = common.scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path, level="BEST_SPEED")
    heads = warc.read_headers(spark, path)
    files = heads.groupBy("file").agg(F.sort_array(F.collect_list("page_id")).alias("ids")).collect()
    assert sorted(r.ids for r in files) == [[1, 2, 4, 5, 6, 8], [3], [7]]
    assert {r.page_id: r.payload_bytes for r in heads.collect()} == {i: len(t.encode()) for i, _, t in rows}
    assert {r.page_id: r.original and r.original.page_id for r in warc.resolve_revisits(heads).collect()} == {1: None, 2: None, 3: None, 4: 2, 5: 1, 6: 2, 7: 3, 8: 2}


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline

    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frames = [table]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(common.written(stage(spark, frames[-1], str(tmp_path)), "stage"))
    assert all(f.columns == table.columns for f in frames[:-1])
    kept = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert kept[1] == {r[0] for r in ROWS if r[1] and any(c.isalpha() for c in r[1])}
    assert 2 in kept[2] and 18 not in kept[2]
    assert kept[3] == kept[2] and 0 not in kept[4] and all(r.round_trip for r in frames[5].collect())
    out = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, out, str(tmp_path)), "stage")
    assert out.count() == 0
