"""A content-addressed store of token ids.

A document's ids are cut where a rolling hash of the last WINDOW ids has its low bits zero, so equal passages give equal
chunks wherever they stand; no chunk is longer than LONGEST ids.  Files below the store's path:

* ``chunks/``   one row per distinct chunk: digest (SHA-256), ids (little-endian, ``width`` bytes each).
* ``recipes/``  one row per document in ascending id order: part, at (its place in the part), doc_id, n_tokens, the
  digests of its chunks, and root, the Merkle root over them.
* ``manifest/`` one row per part of the recipes: part, documents, n_tokens, width (bytes of an id), and root, the Merkle
  root over the documents' roots.

Readers check each chunk against its digest, each document against its root and each part against the manifest.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import coder, read_spec, slices, space_units, vocabulary
from palimpsest.llm.common import dropped, scratch, tidied, written

WINDOW, MEAN_BITS, LONGEST = 16, 8, 2048


def cuts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of the id streams that lie one after the other between the bounds."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.cumsum(mixed, dtype=np.uint64)
    rolled = total.copy()
    rolled[WINDOW:] -= total[:-WINDOW]
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.nonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0)[0] + 1
    ends = ends[ends - bounds[np.searchsorted(bounds, ends) - 1] >= WINDOW]  # windows within one stream
    ends = np.unique(np.concatenate((ends, bounds[1:][np.diff(bounds) > 0])))
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
    long = np.nonzero(ends - starts > LONGEST)[0]
    if len(long):
        ends = np.unique(np.concatenate([ends, *[np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in long]]))
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """The root over SHA-256 leaves; an odd node moves up as it is, no leaf has the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a longer string in which ``after`` bytes follow its own."""
    out = crc.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        on = np.nonzero((after >> k) & 1)[0]
        c = out[on]
        t = _SHIFTS[k]
        out[on] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return out


def _shift_tables() -> list[list[np.ndarray]]:
    """For each k and each of the four bytes of a CRC-32, what 2**k zero bytes make of the byte's values."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    one = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    for _ in range(3):
        one = [times(one, x) for x in one]
    tables = [one]
    for _ in range(47):
        tables.append([times(tables[-1], x) for x in tables[-1]])
    byte_of = lambda m, b: np.array([times(m[8 * b : 8 * b + 8] + [0] * 24, v) for v in range(256)], np.uint32)
    return [[byte_of(m, b) for b in range(4)] for m in tables]


_SHIFTS = _shift_tables()


def _tokenized(docs: DataFrame, spec: str, end_id: int | None, wide: bool, id_col: str, text_col: str) -> DataFrame:
    """Per document its recipe, with those of its chunks that are new to the slice of documents it stands in."""
    kind, dtype = docs.schema[id_col].dataType.simpleString(), "<u4" if wide else "<u2"
    spec_b = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                ids, bounds = coder(spec_b.value).documents(space_units(part.column(1)))
                if end_id is not None:
                    flat, bounds = ids, bounds + np.arange(len(bounds))
                    ids, inner = np.full(len(flat) + len(bounds) - 1, end_id, np.uint32), np.ones(len(flat) + len(bounds) - 1, bool)
                    inner[bounds[1:] - 1] = False
                    ids[inner] = flat
                ends = cuts(ids, bounds)
                raw, width = ids.astype(dtype).tobytes(), 4 if wide else 2
                digests, fresh, data, start, seen = [], np.zeros(len(ends) + 1, np.int64), [], 0, set()
                for k, end in enumerate((ends * width).tolist(), 1):
                    chunk = raw[start:end]
                    digest = hashlib.sha256(chunk).digest()
                    digests.append(digest)
                    if digest not in seen:
                        seen.add(digest)
                        fresh[k] = 1
                        data.append(chunk)
                    start = end
                of = np.searchsorted(ends, bounds, side="right")
                roots = [merkle(digests[a:b]) for a, b in zip(of.tolist(), of[1:].tolist())]
                first = np.nonzero(fresh[1:])[0]
                listed = pa.array(digests, pa.binary())
                new = pa.StructArray.from_arrays([listed.take(pa.array(first)), pa.array(data, pa.binary())], names=["digest", "ids"])
                lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds)), lists(of, listed), pa.array(roots, pa.binary()), lists(np.cumsum(fresh)[of], new)], names=["doc_id", "n_tokens", "digests", "root", "new"]
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, n_tokens bigint, digests array<binary>, root binary, new array<struct<digest:binary,ids:binary>>")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of all documents' ids below path; ``end_id`` is appended to each document.

    The tokenizer (JSON) must drop white space.  Null and empty texts have only the end id.  Rows with one id follow each
    other in the order of their content; rows with a null id come first.
    """
    spark, spec = docs.sparkSession, read_spec(tokenizer)
    wide = max(vocabulary(json.loads(spec))) > 0xFFFF or (end_id or 0) > 0xFFFF
    raw = written(_tokenized(docs, spec, end_id, wide, id_col, text_col), "tokenized")
    chunks = raw.select(F.explode("new").alias("c")).select("c.*").dropDuplicates(["digest"])
    written(chunks, "chunks", to=f"{path}/chunks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = raw.select("doc_id", "n_tokens", "digests", "root").repartitionByRange(parts, F.asc_nulls_first("doc_id"), "root").sortWithinPartitions(F.asc_nulls_first("doc_id"), "root")
    recipes = recipes.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    recipes = written(recipes.select("part", "at", "doc_id", "n_tokens", "digests", "root"), "recipes", to=f"{path}/recipes")
    written(_manifest(recipes).withColumn("width", F.lit(4 if wide else 2)), "manifest", to=f"{path}/manifest")
    dropped(raw)


def _manifest(recipes: DataFrame) -> DataFrame:
    """Documents, ids and Merkle root of each part, from sums of blocks of documents so that no part meets in one row."""
    block = recipes.select("part", (F.col("at") / 4096).cast("bigint").alias("block"), "at", "root", "n_tokens")
    leaf = block.groupBy("part", "block").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda x: F.hex(x["root"]))), 256).alias("leaf"))
    return leaf.groupBy("part").agg(F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "leaf"))), lambda x: x["leaf"])), 256).alias("root"))


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("chunks", "recipes", "manifest"))


def verify(spark: SparkSession, path: str) -> None:
    """Raises unless recipes and manifest agree."""
    _, recipes, manifest = _stored(spark, path)
    both = _manifest(recipes).join(manifest.withColumnsRenamed({"root": "said", "documents": "d", "n_tokens": "n"}), "part", "full")
    wrong = both.where(~(F.col("root").eqNullSafe(F.col("said")) & F.col("documents").eqNullSafe(F.col("d")) & F.col("n_tokens").eqNullSafe(F.col("n")))).count()
    if wrong:
        raise ValueError(f"{wrong} parts of {path} differ from the manifest")


def _id_type(manifest: DataFrame) -> str:
    first = manifest.select("width").first()
    return "<u4" if first and first["width"] == 4 else "<u2"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row (doc_id, ids) per document, put together from its chunks; chunks and documents are verified."""
    chunks, recipes, manifest = _stored(spark, path)
    dtype = _id_type(manifest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for root, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = [p["ids"] for p in parts]
                if any(x is None for x in data) or merkle([hashlib.sha256(x).digest() for x in data]) != root:
                    raise ValueError("a document of the store differs from its root")
                ids.append(np.frombuffer(b"".join(data), dtype).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    placed = recipes.select("part", "at", "doc_id", "root", F.posexplode_outer("digests").alias("pos", "digest")).join(chunks, "digest", "left")
    whole = placed.groupBy("part", "at").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "ids")))).alias("chunks"))
    return whole.select("doc_id", "root", "chunks").mapInArrow(tidied(run), f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all before it), n_tokens, and the CRC-32 of its ids as 32-bit little-endian integers.

    Chunks are read and verified where they lie; only their lengths and CRCs travel, and a document's CRC is combined from
    those of its chunks.
    """
    verify(spark, path)
    chunks, recipes, manifest = _stored(spark, path)
    dtype = _id_type(manifest)

    def chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, crcs = [], []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError("a chunk of the store differs from its digest")
                ids = np.frombuffer(data, dtype).astype("<u4")
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "size", "crc"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            inner = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
            bounds = bounds - bounds[0]
            if inner.field("size").null_count:
                raise ValueError("a chunk of the store is missing")
            digests = inner.field("digest").to_pylist()
            for root, a, b in zip(batch.column(3).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                if merkle(digests[a:b]) != root:
                    raise ValueError("a document of the store differs from its root")
            size = inner.field("size").to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(size)))
            after = 4 * (np.repeat(ends[bounds[1:]], np.diff(bounds)) - ends[1:])
            part = crc_shift(inner.field("crc").to_numpy(zero_copy_only=False), after)
            doc = np.repeat(np.arange(len(lists)), np.diff(bounds))
            crcs = np.zeros(len(lists), np.uint32)
            np.bitwise_xor.at(crcs, doc, part)
            sizes, crcs = ends[bounds[1:]] - ends[bounds[:-1]], crcs.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "at", "doc_id", "n_tokens", "ids_crc32"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    sums = chunks.mapInArrow(tidied(chunk_sums), "digest binary, size bigint, crc bigint")
    placed = recipes.select("part", "at", "doc_id", "root", F.posexplode_outer("digests").alias("pos", "digest")).join(sums, "digest", "left")
    grouped = placed.groupBy("part", "at").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", "size", "crc")))).alias("chunks"))
    per = written(grouped.select("part", "at", "doc_id", "root", "chunks").mapInArrow(tidied(combine), f"part int, at bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint"), "sums")
    totals = per.groupBy("part").agg(F.sum("n_tokens").alias("all"))  # a row per part: as few as the store has files
    before = totals.withColumn("before", F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store into the shared folder and returns document_sums of its files."""
    path = scratch(docs.sparkSession, "store")
    write_store(docs, path, tokenizer, end_id, id_col, text_col)
    return document_sums(docs.sparkSession, path)
