"""Lempel-Ziv phrase fingerprints: the LZ78 phrases of a text, hashed, as a bottom-k MinHash signature.

Two texts that share passages share phrases, so the likeness of signatures estimates the Jaccard similarity of the phrase
sets, as a compressor that saw one text before the other would notice.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import slices
from palimpsest.llm.common import tidied, written

SIZE = 128
SLICE, RANGE_BYTES = 8 << 20, 16 << 20
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        most = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(most, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


class Parse:
    """An LZ78 parse that can be continued, and forked before it is."""

    def __init__(self) -> None:
        self.nodes: dict[int, int] = {}
        self.node, self.length, self.ends = 0, 0, []

    def fork(self) -> Parse:
        other = Parse()
        other.nodes, other.node, other.length, other.ends = self.nodes.copy(), self.node, self.length, self.ends.copy()
        return other

    def feed(self, data: bytes) -> Parse:
        nodes, node, ends, count = self.nodes, self.node, self.ends, len(self.nodes) + 1
        get, place = nodes.get, iter(data)
        left, whole = place.__length_hint__, self.length + len(data)
        for byte in place:
            key = (node << 8) | byte
            found = get(key)
            if found is None:
                nodes[key] = count
                count += 1
                node = 0
                ends.append(whole - left())
            else:
                node = found
        self.node, self.length = node, whole
        return self

    def signature(self, data: bytes) -> np.ndarray:
        """The smallest SIZE hashes of the phrases of data, which is all that was fed; a last unfinished phrase counts."""
        if not data:
            return np.zeros(0, np.uint32)
        ends = np.array(self.ends if self.ends and self.ends[-1] == len(data) else [*self.ends, len(data)], np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        up, down = _powers(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.unique((h >> np.uint64(32)).astype(np.uint32))[:SIZE]


def encode(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smallest SIZE hashes of either that both have; 1 for two empty signatures."""
    both = np.union1d(a, b)[:SIZE]
    if not len(both):
        return 1.0
    return float((np.isin(both, a) & np.isin(both, b)).sum() / len(both))


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text; null is the empty text, whose fingerprint is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return encode(Parse().feed(data).signature(data))


class _Row:
    """A document on its way: parsed up to its last third, and whole."""

    def __init__(self, doc_id: object, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.n = len(self.text)
        self.head, tail = self.text[: self.n - self.n // 3].encode("utf-8", "surrogatepass"), self.text[self.n - self.n // 3 :].encode("utf-8", "surrogatepass")
        self.parse = Parse().feed(self.head)
        self.signature = self.parse.fork().feed(tail).signature(self.head + tail)

    def beside(self, following: str, signature: np.ndarray) -> tuple:
        """The result row, given the next document's text and signature."""
        tail = following[: self.n // 3].encode("utf-8", "surrogatepass")
        edited = self.parse.feed(tail).signature(self.head + tail)
        return (self.doc_id, self.n, hashlib.sha256(self.head + tail).hexdigest(), encode(self.signature), encode(edited), likeness(self.signature, edited), likeness(self.signature, signature))


_RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _packed(rows: DataFrame, splitters: list[int]) -> DataFrame:
    """Rows (bucket, pack): the documents of a slice whose ids fall into one range, as compressed Arrow; null ids in range -1."""
    cuts = np.array(splitters, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for part in slices(whole, 1, SLICE):
                ids = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False)
                bucket = np.where(part.column(0).is_null().to_numpy(zero_copy_only=False), -1, np.searchsorted(cuts, ids, side="left"))
                for b in np.unique(bucket):
                    sink = pa.BufferOutputStream()
                    some = part.take(pa.array(np.nonzero(bucket == b)[0]))
                    with pa.ipc.new_stream(sink, some.schema) as out:
                        out.write_batch(some)
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int64()), pa.array([press.compress(sink.getvalue().to_pybytes())], pa.binary())], names=["bucket", "pack"])

    return rows.mapInArrow(tidied(run), "bucket bigint, pack binary")


def _result_table(schema: str, id_type: pa.DataType, rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.string(), id_type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types))})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness (see the columns of _RESULT after the id).

    The edited text has its last third replaced by as many first characters of the next document in descending id order;
    after the last comes the first.  Ids are whole numbers.  Documents meet in ranges of ids of about RANGE_BYTES of text;
    only the last document of a range waits for the first of the next one, and these pairs, as many as there are ranges,
    are finished apart.  Null texts are empty, null ids come last, rows with one id follow each other by their text.  Other
    columns are not read.
    """
    schema = f"bucket bigint, role string, id bigint, text string, {_RESULT}"
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    splitters = (rows.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 100_000)).first()[0] or []) if ranges > 1 else []
    blank = (None,) * 6

    def run(table: pa.Table) -> pa.Table:
        bucket, packs = table.column("bucket")[0].as_py(), table.column("pack").to_pylist()
        open_pack = zstandard.ZstdDecompressor()
        parts = [pa.ipc.open_stream(open_pack.decompress(p)).read_all() for p in packs]
        whole = pa.concat_tables(parts).sort_by([("id", "descending"), ("text", "ascending")])
        out, before = [], None
        for doc_id, text in zip(whole.column("id").to_pylist(), whole.column("text")):
            row = _Row(doc_id, text.as_py())
            if before:
                found = before.beside(row.text, row.signature)
                out.append((bucket, "done", found[0], None, *found[1:]))
            else:
                out.append((bucket, "first", row.doc_id, row.text, *blank))
            before = row
        out.append((bucket, "last", before.doc_id, before.text, *blank))
        return _result_table(schema, pa.int64(), out)

    packed = _packed(rows, splitters).repartition(min(2 * ranges, 20_000), "bucket")
    got = written(packed.groupBy("bucket").applyInArrow(run, schema), "fingerprints")
    ends = got.where("role != 'done'").select("bucket", "role", "id", "text")
    firsts = ends.where("role = 'first'").select("bucket", F.col("text").alias("following"))
    order = Window.orderBy(F.desc("bucket"))  # a row per range
    ring = ends.select("bucket").distinct().withColumn("after", F.coalesce(F.lead("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    open_rows = ends.where("role = 'last'").join(ring, "bucket").join(firsts.withColumnRenamed("bucket", "after"), "after").select("id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, following in zip(*[c.to_pylist() for c in batch.columns]):
                data = (following or "").encode("utf-8", "surrogatepass")
                found = _Row(doc_id, text).beside(following or "", Parse().feed(data).signature(data))
                out.append((0, "done", found[0], None, *found[1:]))
            yield from _result_table(schema, pa.int64(), out).to_batches()

    names = [F.col("id").cast(kind).alias("id"), *[x.split()[0] for x in _RESULT.split(", ")]]
    return got.where("role = 'done'").select(*names).unionByName(open_rows.mapInArrow(tidied(finish), schema).select(*names))
