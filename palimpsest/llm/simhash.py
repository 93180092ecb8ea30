"""SimHash fingerprints of word shingles and their exact links within a Hamming radius.

Fingerprints are tiled by the population counts of their four 16-bit blocks.  Two fingerprints at Hamming distance r have
block counts whose differences add up to r at most, so a pair of tiles whose counts differ by more than the radius is
never compared; every other pair of tiles is compared whole with numpy exclusive-or and bit counts.  There are at most
17**4 tiles; a tile of many fingerprints is cut into blocks of TILE rows.  A task that compares two blocks returns a
spanning forest of the links it found, not the links: as many rows as the blocks have at most, and the same components.

With a similarity, candidates come from bands of minima: a set of shingles has BANDS bands of ROWS minimum hashes each, and two
sets of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, which is all but three in a million at 0.8.  Only
documents that share a band are compared, by the same tiles of population counts and the same exclusive-or, and only where their
sets' sizes allow the similarity; those of one component of such links then by the exact Jaccard similarity of their word shingles,
in blocks of SETS documents, each pair of blocks whole.  Again a task returns a spanning forest.  So the work grows with the
documents and with groups of like ones, not with the square of all, and the radius may be wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, components, tidied, written

TILE, SETS = 2048, 256
BANDS, ROWS = 24, 4
_SLICE = 512
#: Odd multipliers, one for each minimum: products of the shingles' hashes order them anew.
_ORDERS = np.random.default_rng(64).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text; zero when it has no word."""
    w = ascii_lower(text).split()
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        stop = len(w) - words + 1
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts[:stop].tolist(), ends[words - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].byteswap().view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row (id, fp) per row of docs.  fp is the fingerprint as a signed long; null and blank texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                part = whole.slice(at, _SLICE)
                fp = np.array([simhash(t.as_py(), words, seed) for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"id {kind}, fp bigint")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the fingerprints of a and b as all links within the radius do, at most one per fingerprint."""
    distinct, same = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b = same[: len(a)], same[len(a) :]
    root = np.arange(len(distinct))
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius)
        i, j = at_a[i + at], at_b[j]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
        while len(i):
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while (root != root[root]).any():
                root = root[root]
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
    member = np.nonzero(root != np.arange(len(root)))[0]
    return distinct[member], distinct[root[member]]


def links(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints in prints.fp with the components of all links within the radius."""
    block = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    code = sum((c * (32**k) for k, c in enumerate(block)), F.lit(0)).cast("int")
    coded = prints.select("fp").withColumn("tile", code)
    sizes = coded.groupBy("tile").agg(F.ceil(F.count("*") / tile).alias("cuts"))  # 17**4 rows at most: a proven bound
    packed = written(
        coded.join(F.broadcast(sizes), "tile").groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("cuts")).alias("cut")).agg(F.collect_list("fp").alias("fps")), "tiles"
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in steps])).alias("d")
    left = packed.select("tile", "cut", "fps", step)
    part = [F.shiftright("tile", 5 * k).bitwiseAND(F.lit(31)) for k in range(4)]
    moved = [x + F.col(f"d.d{k}") for k, x in enumerate(part)]
    inside = moved[0].between(0, 16)
    for m in moved[1:]:
        inside &= m.between(0, 16)
    left = left.where(inside).select(
        F.col("tile").alias("own"), F.col("cut").alias("own_cut"), F.col("fps").alias("a"), sum((m * (32**k) for k, m in enumerate(moved)), F.lit(0)).cast("int").alias("tile")
    )
    pairs = left.join(packed, "tile").where((F.col("own") != F.col("tile")) | (F.col("own_cut") <= F.col("cut"))).select("a", F.col("fps").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x, y in zip(whole.column(0), whole.column(1)):
                a, b = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                u, v = _forest(a, b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])

    return pairs.mapInArrow(tidied(run), "a bigint, b bigint")


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of all words where there are fewer, of none where there is none."""
    w = ascii_lower(text).split()
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), seed)] if w else [], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[i:j], seed) for i, j in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64))


def bands(grams: np.ndarray) -> np.ndarray:
    """BANDS hashes of a set of shingle hashes, each of ROWS minima; none of an empty set."""
    if not len(grams):
        return np.array([], np.int64)
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        np.minimum(least, (grams[at : at + 1024, None] * _ORDERS).min(axis=0), out=least)
    rows = [k.to_bytes(2) + least[k * ROWS : (k + 1) * ROWS].tobytes() for k in range(BANDS)]
    return np.array([xxhash.xxh3_64_intdigest(r) for r in rows], np.uint64).view(np.int64)


def _key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes())


def set_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join the sets as all pairs at the similarity or more do, at most one less than there are sets."""
    sizes = np.array([len(s) for s in sets])
    index = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark = np.zeros(index.max() + 1, bool)
    root, found = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        if (root[i:] == root[i]).all():
            continue
        own = index[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[index[starts[i] :]], starts[i:] - starts[i], dtype=np.int64)
        mark[own] = False
        near = np.nonzero(both >= similarity * (sizes[i:] + sizes[i] - both) - 1e-9)[0] + i
        for j in near.tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                found.append((i, j))
    return found


def _close(fp: np.ndarray, size: np.ndarray, cut: int, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join members before ``cut`` with those from it on, or all with each other where cut is their number.

    They join the members as all pairs within the radius whose sizes allow the similarity do, at most one less than there are members.
    """
    ones = np.bitwise_count(fp).astype(np.int64)
    left = np.argsort(ones[:cut], kind="stable")
    right = np.argsort(ones[cut:], kind="stable") + cut if cut < len(fp) else left
    counts, root, found = ones[right], np.arange(len(fp)), []
    for at in range(0, len(left), 64):
        i = left[at : at + 64]
        lo, hi = np.searchsorted(counts, ones[i[0]] - radius, "left"), np.searchsorted(counts, ones[i[-1]] + radius, "right")
        j = right[lo:hi]  # the others' population counts differ beyond the radius
        near = np.bitwise_count(fp[i][:, None] ^ fp[j]) <= radius
        near &= np.minimum.outer(size[i], size[j]) >= similarity * np.maximum.outer(size[i], size[j]) - 1e-9
        u, v = np.nonzero(near)
        u, v = i[u], j[v]
        while len(u := u[open_ := root[u] != root[v]]):
            v = v[open_]
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while (root != root[root]).any():
                root = root[root]
    member = np.nonzero(root != np.arange(len(root)))[0]
    return member, root[member]


def banded_links(sets: DataFrame, radius: int, similarity: float, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over the keys of sets (key, fp, size, bands) with the components of all links between sets that share a band.

    A link is between fingerprints within the radius whose sets' sizes allow the similarity.  A band that many share is cut into
    blocks of ``tile`` members or so, and each pair of blocks is one row of work.
    """
    member = sets.select(F.explode("bands").alias("band"), "key", "fp", "size")
    sizes = member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / tile).alias("cuts"))
    shared = member.join(sizes, "band")
    packs = shared.groupBy("band", "cuts", F.pmod(F.xxhash64("key", "fp"), F.col("cuts")).alias("cut")).agg(F.collect_list(F.struct("key", "fp", "size")).alias("p"))
    packs = written(packs, "bands")
    alone = packs.where("cuts = 1").select(F.col("p").alias("a"), F.array().cast(packs.schema["p"].dataType).alias("b"))
    left = packs.where("cuts > 1").select("band", F.col("cut").alias("own"), F.col("p").alias("a"), F.explode(F.sequence("cut", F.col("cuts") - 1)).alias("cut"))
    both = left.join(packs.where("cuts > 1").select("band", "cut", F.col("p").alias("b")), ["band", "cut"])
    both = both.select("a", F.when(F.col("own") < F.col("cut"), F.col("b")).otherwise(F.array().cast(packs.schema["p"].dataType)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = []
            for side in (0, 1):
                flat = whole.column(side).flatten()
                ends = np.cumsum(np.concatenate(([0], whole.column(side).value_lengths().to_numpy(zero_copy_only=False))))
                parts.append((ends, *(flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))))
            (at, keys, fps, sizes), (to, *others) = parts
            twos = (np.diff(at) == 2) & (np.diff(to) == 0)
            i = at[:-1][twos]  # most bands are shared by two: all of them at once
            x, y = fps[i].view(np.uint64), fps[i + 1].view(np.uint64)
            near = (np.bitwise_count(x ^ y) <= radius) & (np.minimum(sizes[i], sizes[i + 1]) >= similarity * np.maximum(sizes[i], sizes[i + 1]) - 1e-9)
            a, b = [keys[i][near]], [keys[i + 1][near]]
            for k in np.nonzero(~twos)[0].tolist():
                key, fp, size = (np.concatenate([p[at[k] : at[k + 1]], q[to[k] : to[k + 1]]]) for p, q in zip((keys, fps, sizes), others))
                u, v = _close(fp.view(np.uint64), size, int(at[k + 1] - at[k]), radius, similarity)
                a.append(key[u])
                b.append(key[v])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    return alone.unionByName(both).mapInArrow(tidied(run), "a bigint, b bigint")


def _set_links(clusters: DataFrame, docs: DataFrame, words: int, seed: int, similarity: float, block: int) -> DataFrame:
    """Edges (a, b) over the keys of clusters (cluster, key, least) at the similarity; docs (id, text) has the texts."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster", F.ceil(F.col("n") / block).alias("cuts"))
    members = written(clusters.join(sizes, "cluster").select("cluster", "cuts", "key", "least", F.pmod(F.xxhash64("key"), F.col("cuts")).alias("cut")), "members")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                sets = [shingle_set(t.as_py(), words, seed) for t in whole.column(0).slice(at, 64)]
                keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "grams"])

    texts = docs.join(members.select("least"), F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text")
    sets = texts.mapInArrow(tidied(grams), "key bigint, grams binary").dropDuplicates(["key"])
    packs = written(members.join(sets, "key").groupBy("cluster", "cuts", "cut").agg(F.collect_list(F.struct("key", "grams")).alias("p")), "packs")  # SETS rows or so each
    left = packs.select("cluster", F.col("cut").alias("own"), F.col("p").alias("a"), F.explode(F.sequence("cut", F.col("cuts") - 1)).alias("cut"))
    pairs = left.join(packs.select("cluster", "cut", F.col("p").alias("b")), ["cluster", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for same, x, y in zip(whole.column(0), whole.column(1), whole.column(2)):
                rows = [v for part in ((x,) if same.as_py() else (x, y)) for v in part.as_py()]
                found = set_forest([np.frombuffer(r["grams"], np.uint64) for r in rows], similarity)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i]["key"] for i, _ in found], pa.int64()), pa.array([rows[j]["key"] for _, j in found], pa.int64())], names=["a", "b"])

    return pairs.select((F.col("own") == F.col("cut")).alias("same"), "a", "b").mapInArrow(tidied(run), "a bigint, b bigint")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 24, shingle_words: int = 5, similarity: float = 0.8, block: int = SETS
) -> DataFrame:
    """One row (id, fp, component) per row of docs; component is the smallest id reachable over links.

    Two documents are linked when they share a band of minima, or a chain of fingerprints within the radius that do joins them,
    and the Jaccard similarity of their sets of runs of ``shingle_words`` words is ``similarity`` or more.  Equal sets are always linked; null and blank texts have
    the empty set and are linked to each other only.  Repeated rows stay repeated.  A null id keeps its row and is never the
    name of a component that has another id.  Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                part = whole.slice(at, _SLICE)
                texts = part.column(1).to_pylist()
                fp = np.array([simhash(t, words, seed) for t in texts], np.uint64).view(np.int64)
                sets = [shingle_set(t, shingle_words, seed) for t in texts]
                keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["id", "fp", "key", "size", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = written(texts.mapInArrow(tidied(run), f"id {kind}, fp bigint, key bigint, size bigint, bands array<bigint>"), "fingerprints")
    # texts of one set may have several fingerprints, as repeated shingles count
    sets = written(own.where("size > 0").groupBy("key", "fp").agg(F.first("size").alias("size"), F.first("bands").alias("bands")), "sets")
    coarse = components(banded_links(sets, radius, similarity))
    classes = own.where("size > 0").groupBy("key").agg(F.min("id").alias("least"))
    clusters = written(coarse.select(F.col("node").alias("key"), F.col("root").alias("cluster")).join(classes, "key").select("cluster", "key", "least"), "clusters")
    roots = components(_set_links(clusters, texts, shingle_words, seed, similarity, block))
    rooted = own.groupBy("key").agg(F.min("id").alias("least")).join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return own.select("id", "fp", "key").join(written(rooted.select("key", "root").join(names, "root").select("key", "component"), "named"), "key").select("id", "fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row (id, fp, component) per row of docs; component is the smallest id reachable over links.

    Null and blank texts have fingerprint zero, which links like any other.  Repeated rows stay repeated.  A null id keeps
    its row and is never the name of a component that has another id.  Other columns of docs are not read.
    """
    own = written(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    prints = written(own.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    roots = components(links(prints, radius))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = written(rooted.select("fp", "root").join(names, "root").select("fp", "component"), "classes")
    return own.join(classes, "fp").select("id", "fp", "component")
