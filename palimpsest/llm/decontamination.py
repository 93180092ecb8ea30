"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size, the floor of log2 of their distinct shingles.  An item's sketch is its smallest shingle
hashes, as many as an item of its partition's largest size may miss at the threshold, and one more.  A document that
contains the item at the threshold therefore holds at least one hash of the sketch, so the MinHash search loses nothing.
Documents too small for a partition skip it.  Hashes found in a sketch are joined to it by the shingle itself and give the
candidate pairs of document and item; only for those are the other shingles of the item counted, exactly.

Two bitmaps of fixed size (BITS) reach the executors; they filter hashes and never decide.  The item shingles are
broadcast up to BROADCAST_ROWS rows and shuffled beyond that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, tidied, written

BITS = 1 << 23
BROADCAST_ROWS = 200_000
_PUNCTUATION = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space and punctuation, A-Z in lower case."""
    return ascii_lower(text).translate(_PUNCTUATION).split()


def shingles(w: list[bytes], k: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and the start and end in it of each run of k words."""
    if len(w) < k:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return b" ".join(w), starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()


def _item_rows(items: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """One row per distinct shingle of an item: (item, n, k, part, h, shingle, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "n", "k", "part", "h", "shingle", "sketch"]
        for batch in batches:
            for i in range(batch.num_rows):
                w = words_of(batch.column(1)[i].as_py())
                k = min(words, len(w))
                joined, starts, ends = shingles(w, k) if k else (b"", [], [])
                found = sorted({(xxhash.xxh64_intdigest(joined[a:b], 42), joined[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(starts, ends)})
                n = len(found)
                if not n:
                    continue
                part = n.bit_length() - 1
                largest = (2 << part) - 1
                kept = largest - math.ceil(threshold * largest - 1e-9) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, batch.column(0).type), pa.array([n] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(np.array([h for h, _ in found], np.uint64).view(np.int64)), pa.array([s for _, s in found]), pa.array([j < kept for j in range(n)])],
                    names=names,
                )

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), f"item {kind}, n int, k int, part int, h bigint, shingle string, sketch boolean")


def _bitmap(rows: DataFrame) -> np.ndarray:
    """The hashes' places among BITS bits; BITS / 64 rows reach the driver at most."""
    place = F.pmod("h", F.lit(BITS))
    found = rows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) & 63 as int))")).alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for r in found:
        out[r["at"]] = r["bits"]
    return out.view(np.uint64)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h % np.uint64(BITS)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", words: int = 5, threshold: float = 0.8
) -> DataFrame:
    """One row (id, item, n_shared, n_shingles, containment) per item that a document contains at the threshold.

    Containment is the share of the item's distinct shingles of ``words`` words that the document has.  An item of fewer
    words is one shingle, its whole sequence.  Items without a word and null texts are in nothing and contain nothing.
    Rows that share an id count as one document or one item.  Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    rows = written(_item_rows(items, id_col=item_id_col, text_col=item_text_col, words=words, threshold=threshold), "items")
    parts = rows.groupBy("k", "part").agg(F.count("*").alias("rows")).collect()  # words * 31 rows at most
    least = {k: min(math.ceil(threshold * (1 << r["part"]) - 1e-9) for r in parts if r["k"] == k) for k in {r["k"] for r in parts}}
    every = spark.sparkContext.broadcast(_bitmap(rows))
    sketch = spark.sparkContext.broadcast(_bitmap(rows.where("sketch")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            ids, hashes, strings = [], [], []
            for i, text in enumerate(batch.column(1)):
                w = words_of(text.as_py())
                for k, few in least.items():
                    joined, starts, ends = shingles(w, k)
                    if len(starts) < few:
                        continue
                    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))
                    if not _has(sketch.value, h).any():
                        continue
                    seen = {}
                    for j in np.nonzero(_has(every.value, h))[0].tolist():
                        seen[joined[starts[j] : ends[j]]] = h[j]
                    ids += [i] * len(seen)
                    strings += [s.decode("utf-8", "surrogatepass") for s in seen]
                    hashes += list(seen.values())
            if ids:
                h = np.array(hashes, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(h.view(np.int64)), pa.array(strings), pa.array(_has(sketch.value, h))], names=["id", "h", "shingle", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    hits = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(tidied(run), f"id {kind}, h bigint, shingle string, sketch boolean")
    hits = written(hits.dropDuplicates(["id", "shingle"]), "hits")
    side = rows.select("item", "h", "shingle", "sketch").distinct()
    small = sum(r["rows"] for r in parts) <= BROADCAST_ROWS
    within = F.broadcast if small else (lambda df: df)
    pairs = hits.where("sketch").join(within(side.where("sketch").select("item", "h", "shingle")), ["h", "shingle"]).select("id", "item").distinct()
    sizes = rows.groupBy("item").agg(F.countDistinct("shingle").alias("n_shingles"))
    wanted = pairs.join(within(side.select("item", "h", "shingle")), "item")  # a pair meets its item's shingles alone, whatever else the document holds
    same = F.col("p.id").eqNullSafe(F.col("hits.id")) & (F.col("p.h") == F.col("hits.h")) & (F.col("p.shingle") == F.col("hits.shingle"))
    found = wanted.alias("p").join(hits.alias("hits"), same).groupBy("p.id", "p.item").agg(F.count("*").alias("n_shared"))
    found = found.join(sizes, "item").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return found.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9)).select("id", "item", "n_shared", "n_shingles", "containment")


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that contain no item; all their columns.  A row with a null id stays."""
    bad = written(contained_items(docs, items, id_col, **options).select(F.col("id").alias(id_col)).distinct(), "contaminated")
    return docs.join(bad, id_col, "left_anti")
