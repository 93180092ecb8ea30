"""Removal of passages that occur earlier: exact, on bytes, by sorting sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (a smaller document id, or the same document
further left).  Not every suffix is sorted.  An anchor is the place of the smallest K-byte hash within a window of LENGTH
bytes, the leftmost of equals; so each window has one, and windows with equal bytes have it at the same place.  About one
suffix in forty is an anchor's, and every repeated window is found through the suffixes that start at its anchor.

1. A suffix at an anchor travels with its context, the bytes of all windows that have the anchor, to a range of its leading K
   bytes; splitters come from a bounded sample.  Of equal contexts within a slice of documents only the first one travels.
2. A range sorts its suffixes by multikey quicksort, eight bytes a character: leading bytes, then the context.  Of equal
   contexts all but the first are removed whole.  Where one leading string has different contexts, the windows of the first of
   each are compared, and all but the first of equal windows are removed.
3. A leading string that is frequent in the sample is spread over as many ranges as its share asks for, by context and
   partition.  What would have met across those boundaries meets afterwards: the windows of the contexts that are left over.
4. Spans are merged by document and cut out.

Hashes only bring bytes together: whatever is removed has been compared byte by byte with what it repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.bpe import pack, ragged, slices, unpack
from palimpsest.llm.common import dropped, free_name, tidied, written

LENGTH, K = 100, 24
SLICE, BUCKET_BYTES = 2 << 20, 6 << 20
SAMPLE_DOCS, LEAST_SHARE = 2_000, 2e-5
_WINDOWS = 300_000
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Text:
    """The bytes of some documents one after the other, with hashes of any stretch of them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        n = len(data)
        if len(_POWERS[0]) <= n:
            for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                x = np.full(n + 1, b, np.uint64)
                x[0] = 1
                _POWERS[k] = np.multiply.accumulate(x)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], dtype=np.uint64, out=self.sums[1:])

    @staticmethod
    def of(texts: pa.Array) -> Text:
        texts = pc.fill_null(texts, "")
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        return Text(np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8), bounds - bounds[0])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _POWERS[1][start])

    def anchors(self) -> tuple[np.ndarray, ...]:
        """For each anchor: its document's index and place, and the first and last window that it is the anchor of."""
        n, w = len(self.data), LENGTH - K + 1
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 4
        places = np.arange(n - K + 1, dtype=np.uint64)
        keys = (self.hashes(places.astype(np.int64), places.astype(np.int64) + K) & np.uint64(0xFFFFFFFF00000000)) | places
        span, least = 1, keys
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(keys) - w + 1], least[w - span : w - span + len(keys) - w + 1])
        doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[: len(least)]
        valid = np.arange(len(least)) + LENGTH <= self.bounds[1:][doc]
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at[~valid] = -1
        edges = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1))
        last = np.concatenate((edges[1:], [len(at)])) - 1
        real = at[edges] >= 0
        edges, last = edges[real], last[real]
        return doc[edges], at[edges], edges, last

    def leading(self, at: np.ndarray) -> np.ndarray:
        """The K bytes from each place, as rows of big-endian numbers of eight bytes."""
        return self.data[at[:, None] + np.arange(K)].view(">u8").astype(np.uint64)


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """The order of the rows of keys (a number is one character) by three-way radix quicksort; equal rows in any order."""
    out = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == keys.shape[1]:
            continue
        rows = out[a:b]
        if b - a <= 256:
            out[a:b] = rows[np.lexsort(keys[rows, depth:].T[::-1])]
            continue
        own = keys[rows, depth]
        few = np.sort(own[:: len(own) // 31])
        pivot = few[len(few) // 2]
        less, more = own < pivot, own > pivot
        same = ~(less | more)
        n, m = int(less.sum()), int(same.sum())
        out[a:b] = np.concatenate([rows[less], rows[same], rows[more]])
        todo += [(a, a + n, depth), (a + n, a + n + m, depth + 1), (a + n + m, b, depth)]
    return out


class Contexts:
    """Anchors with their contexts: document, place of the anchor, bytes before it, windows after the first, bytes."""

    def __init__(self, doc: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray, data: np.ndarray):
        self.doc, self.place, self.before, self.after = (x.astype(np.int64) for x in (doc, place, before, after))
        self.data = data
        self.size = self.after + LENGTH
        self.at = np.cumsum(self.size) - self.size

    def take(self, rows: np.ndarray) -> Contexts:
        return Contexts(self.doc[rows], self.place[rows], self.before[rows], self.after[rows], ragged(self.data, self.at[rows], self.size[rows]))

    def packed(self) -> bytes:
        low = int(self.doc.min(initial=0))
        return pack((self.doc - low).view(np.uint64), np.array([low], np.int64).view(np.uint64), self.place, self.before, self.after, self.data.tobytes())

    @staticmethod
    def unpacked(packs: list[bytes]) -> Contexts:
        parts = []
        for raw in packs:
            doc, low, place, before, after, data = unpack(raw)
            parts.append((doc.astype(np.int64) + low.astype(np.uint64).view(np.int64)[0], place, before, after, np.frombuffer(data, np.uint8)))
        return Contexts(*map(np.concatenate, zip(*parts))) if parts else Contexts(*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint8))

    def leading(self) -> np.ndarray:
        return self.data[(self.at + self.before)[:, None] + np.arange(K)].view(">u8").astype(np.uint64)

    def characters(self) -> np.ndarray:
        """Rows that are equal where contexts are: the leading bytes, the two numbers of windows, the bytes filled up with zeros."""
        width = -(-(2 * LENGTH - K) // 8) * 8
        flat = np.zeros((len(self.doc), width), np.uint8)
        row = np.repeat(np.arange(len(self.doc)), self.size)
        flat[row, np.arange(len(self.data)) - np.repeat(self.at, self.size)] = self.data
        return np.concatenate([self.leading(), (self.before * 256 + self.after).astype(np.uint64)[:, None], flat.view(">u8").astype(np.uint64)], axis=1)

    def spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = self.place[rows] - self.before[rows]
        return self.doc[rows], start, start + self.size[rows]


def _joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans sorted by document and place, those that touch or overlap made one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    turn = np.concatenate(([True], doc[1:] != doc[:-1]))
    far = stop + np.cumsum(turn) * (int(stop.max()) + 1)  # a running maximum that begins anew with each document
    reach = np.maximum.accumulate(far) - np.cumsum(turn) * (int(stop.max()) + 1)
    fresh = turn | np.concatenate(([True], start[1:] > reach[:-1]))
    first = np.nonzero(fresh)[0]
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def _repeats(key: np.ndarray, doc: np.ndarray, place: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which strings (size bytes of data from at) equal one of the same key that stands earlier, by their bytes.

    Strings of one key that differ, as a hash may have it, are looked at again among themselves.
    """
    out, left = np.zeros(len(key), bool), np.arange(len(key))
    while len(left):
        order = left[np.lexsort((place[left], doc[left], size[left], key[left]))]
        new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (size[order][1:] != size[order][:-1])))
        head = order[np.nonzero(new)[0][np.cumsum(new) - 1]]
        rest, head = order[~new], head[~new]
        same = np.zeros(len(rest), bool)
        for i in range(0, len(rest), 20_000):
            r, h = rest[i : i + 20_000], head[i : i + 20_000]
            n = size[r]
            differ = ragged(data, at[r], n) != ragged(data, at[h], n)
            same[i : i + 20_000] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
        twice = (doc[rest] == doc[head]) & (place[rest] == place[head])  # one document given twice
        out[rest[same & ~twice]] = True
        left = rest[~same]
    return out


_ROWS = "kind string, doc bigint, start int, stop int, bucket bigint, pack binary"


def _span_table(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, buckets: int = 1) -> pa.Table:
    n = len(doc)
    return pa.table({"kind": pa.array(["r"] * n, pa.string()), "doc": pa.array(doc.astype(np.int64)), "start": pa.array(start.astype(np.int32)), "stop": pa.array(stop.astype(np.int32)), "bucket": pa.array(doc.astype(np.int64) % buckets), "pack": pa.nulls(n, pa.binary())})


def _pack_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    n = len(rows)
    return pa.table({"kind": pa.array(["p"] * n, pa.string()), "doc": pa.nulls(n, pa.int64()), "start": pa.nulls(n, pa.int32()), "stop": pa.nulls(n, pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int64()), "pack": pa.array([p for _, p in rows], pa.binary())})


def _by_bucket(contexts: Contexts, bucket: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.concatenate(([0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    return [(int(bucket[order[a]]), contexts.take(order[a:b]).packed()) for a, b in zip(edges, edges[1:])]


def _bytes_of(leads: np.ndarray) -> np.ndarray:
    return leads.astype(">u8").view(f"S{K}").ravel()


def _sample(docs: DataFrame, total: int, buckets: int, most: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splitters of the leading bytes, and the sorted frequent ones with the number of ranges that each is spread over.

    The sample is drawn row by row, so that copies count as often as they stand in the table.  Of more than ``most`` distinct
    leading strings the frequent ones are taken, and of those that are equally frequent some by hash, wherever they sort.
    """
    some = docs.sample(min(1.0, SAMPLE_DOCS / max(1, total)), seed=42)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1, SLICE):
                text = Text.of(part.column(1))
                _, at, _, _ = text.anchors()
                at = at[:: max(1, len(at) // 20_000)]
                raw = text.data[at[:, None] + np.arange(K)].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + K] for i in range(0, len(raw), K)], pa.binary())], names=["lead"])

    got = some.mapInArrow(tidied(run), "lead binary").groupBy("lead").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.xxhash64("lead")).limit(most).collect()
    if not got:
        return np.zeros(0, f"S{K}"), np.zeros(0, f"S{K}"), np.zeros(0, np.int64)
    leads, n = np.array([bytes(r["lead"]) for r in got], f"S{K}"), np.array([r["n"] for r in got], np.int64)
    order = np.argsort(leads, kind="stable")
    leads, n = leads[order], n[order]
    share = n / n.sum()
    hot = (n > 3) & (share > max(LEAST_SHARE, 0.5 / buckets))
    ends = np.cumsum(np.where(hot, 0, n))
    cuts = np.unique(leads[np.minimum(np.searchsorted(ends, np.arange(1, buckets) * ends[-1] / buckets), len(leads) - 1)]) if ends[-1] else leads[:0]
    return cuts, leads[hot], np.array([max(2, math.ceil(2 * x * buckets)) for x in share[hot]], np.int64)


def _is_hot(leads: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The place of each leading string among the hot ones, or -1."""
    if not len(hot) or not len(leads):
        return np.full(len(leads), -1)
    at = np.minimum(np.searchsorted(hot, leads), len(hot) - 1)
    return np.where(hot[at] == leads, at, -1)


def _suffixes(docs: DataFrame, buckets: int, splitters: np.ndarray, hot: np.ndarray, spread: np.ndarray) -> DataFrame:
    """Contexts by range, packed, and spans that repeat within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for whole in batches:
            for part in slices(whole, 1, SLICE):
                text = Text.of(part.column(1))
                of, at, first, last = text.anchors()
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[of]
                place, size = at - text.bounds[of], last - first + LENGTH
                hashes = _mix(text.hashes(first, first + size) + ((at - first) * 256 + last - first).astype(np.uint64))
                again = _repeats(hashes, ids, place, text.data, first, size)
                yield from _span_table(*_joined(ids[again], (place - at + first)[again], (place - at + first + size)[again]), buckets).to_batches()
                keep = np.nonzero(~again)[0]
                if not len(keep):
                    continue
                leads = _bytes_of(text.leading(at[keep]))
                which = _is_hot(leads, hot)
                bucket = np.searchsorted(splitters, leads, side="right")
                own = which >= 0
                bucket[own] = (bucket[own] + task % spread[which[own]] + (hashes[keep][own] % np.uint64(buckets)).astype(np.int64)) % buckets
                found = Contexts(ids[keep], place[keep], (at - first)[keep], (last - first)[keep], ragged(text.data, first[keep], size[keep]))
                yield from _pack_table(_by_bucket(found, bucket)).to_batches(256)

    return docs.mapInArrow(tidied(run), _ROWS)


def _window_repeats(heads: Contexts, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the windows of the contexts (sorted by group) that equal an earlier one of their group."""
    n = heads.after + 1
    found = [(np.zeros(0, np.int64),) * 3]
    ends = np.nonzero(np.concatenate((group[1:] != group[:-1], [True])))[0] + 1 if len(group) else np.zeros(0, np.int64)
    total, a = np.concatenate(([0], np.cumsum(n))), 0
    while a < len(group):
        b = int(ends[max(np.searchsorted(ends, a, side="right"), np.searchsorted(total[ends], total[a] + _WINDOWS, side="right") - 1)])
        some = heads.take(np.arange(a, b))
        text, m = Text(some.data, np.concatenate((some.at, [len(some.data)]))), n[a:b]
        of = np.repeat(np.arange(b - a), m)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        at = some.at[of] + inner
        h = _mix(text.hashes(at, at + LENGTH) + (group[a:b][of] * 256 + some.before[of] - inner).astype(np.uint64))
        place = some.place[of] - some.before[of] + inner
        again = _repeats(h, some.doc[of], place, some.data, at, np.full(len(of), LENGTH))
        found.append(_joined(some.doc[of][again], place[again], place[again] + LENGTH))
        a = b
    return tuple(map(np.concatenate, zip(*found)))


def _compare(table: pa.Table, hot: np.ndarray, buckets: int) -> pa.Table:
    """Spans that repeat within a range, and the windows of hot leading strings, packed by a hash of theirs; spans found before."""
    known, table = (table.filter(pc.equal(table.column("kind"), k)) for k in ("r", "p"))
    if not table.num_rows:
        return known
    contexts = Contexts.unpacked(table.column("pack").to_pylist())
    leads = contexts.leading()
    order = multikey_order(leads)
    new = np.concatenate(([True], (leads[order][1:] != leads[order][:-1]).any(axis=1)))
    runs = np.diff(np.concatenate((np.nonzero(new)[0], [len(order)])))
    is_hot = _is_hot(_bytes_of(leads[order]), hot) >= 0
    kept = order[(np.repeat(runs, runs) > 1) | is_hot]
    if not len(kept):
        return known
    some = contexts.take(kept)
    keys = some.characters()
    order = multikey_order(keys)
    keys = keys[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
    kind = np.cumsum(new) - 1
    order = order[np.lexsort((some.place[order], some.doc[order], kind))]
    head = order[np.nonzero(new)[0]][kind]
    again = ~new & ((some.doc[order] != some.doc[head]) | (some.place[order] != some.place[head]))
    spans = [_joined(*some.spans(order[again]))]
    heads = some.take(order[new])
    lead = keys[new][:, :3]
    fresh = np.concatenate(([True], (lead[1:] != lead[:-1]).any(axis=1)))
    group = np.cumsum(fresh) - 1
    hot_ones = _is_hot(_bytes_of(lead), hot) >= 0
    several = np.nonzero((np.bincount(group)[group] > 1) & ~hot_ones)[0]
    spans.append(_window_repeats(heads.take(several), group[several]))
    tables = [known, _span_table(*map(np.concatenate, zip(*spans)))]
    apart = np.nonzero(hot_ones)[0]
    for i in range(0, len(apart), 2_000):  # each window as a context of its own
        part = heads.take(apart[i : i + 2_000])
        m = part.after + 1
        of = np.repeat(np.arange(len(m)), m)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        at = part.at[of] + inner
        windows = Contexts(part.doc[of], part.place[of] - part.before[of] + inner, np.zeros(len(of)), np.zeros(len(of)), ragged(part.data, at, np.full(len(of), LENGTH)))
        h = Text(part.data, part.at).hashes(at, at + LENGTH)
        tables.append(_pack_table(_by_bucket(windows, (h % np.uint64(buckets)).astype(np.int64))))
    return pa.concat_tables(tables)


def _later(table: pa.Table) -> pa.Table:
    """Spans of all windows but the first of equal ones."""
    w = Contexts.unpacked(table.column("pack").to_pylist())
    h = Text(w.data, w.at).hashes(w.at, w.at + LENGTH)
    again = _repeats(h, w.doc, w.place, w.data, w.at, w.size)
    return _span_table(*_joined(w.doc[again], w.place[again], w.place[again] + LENGTH))


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """docs with a number of its own for each document, in order: the id itself where ids are whole numbers, unique and not null.

    Otherwise documents are numbered by id, then by a hash of the text (nulls first); rows with one id and one text are one
    document.
    """
    found = docs.agg(F.count("*").alias("n"), F.count_distinct(F.col(f"`{id_col}`")).alias("ids")).first()
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int") and found["n"] == found["ids"]:
        return docs.withColumn(key, F.col(f"`{id_col}`").cast("bigint"))
    mark = free_name(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    order = (F.asc_nulls_first("_id"), F.asc("_mark"))
    keys = marked.select(F.col(f"`{id_col}`").alias("_id"), F.col(mark).alias("_mark")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    keys = written(keys.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "keys")
    sizes = keys.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = keys.join(F.broadcast(sizes), "_part").select("_id", "_mark", (F.col("_at") + F.col("_before")).alias("_key"))  # sizes: a row a partition
    left, right = marked.alias("l"), keys.alias("r")
    both = left.join(right, F.col(f"l.`{id_col}`").eqNullSafe(F.col("r._id")) & (F.col(f"l.`{mark}`") == F.col("r._mark")))
    return both.select(*[F.col(f"l.`{c}`").alias(c) for c in docs.columns], F.col("r._key").alias(key))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (id, spans: sorted array of (start, stop) bytes) per document that loses bytes; ids are whole and unique."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(4, -(-(total["bytes"] or 0) // BUCKET_BYTES))
    parts = min(buckets, 20_000)
    splitters, hot, spread = _sample(rows, total["n"], buckets)
    suffixes = _suffixes(rows, buckets, splitters, hot, spread).repartition(parts, "bucket")
    found = written(suffixes.groupBy("bucket").applyInArrow(lambda t: _compare(t, hot, buckets), _ROWS), "repeats")
    later = found.where("kind = 'p'").repartition(parts, "bucket").groupBy("bucket").applyInArrow(_later, _ROWS)
    spans = found.where("kind = 'r'").unionByName(later).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    spans = written(spans.withColumnRenamed("doc", "id"), "spans")
    dropped(found)
    return spans


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept, the remaining bytes.

    Null texts are empty and lose nothing; texts shorter than LENGTH lose nothing.  Repeated rows (one id, one text) are one
    document, each with its result; rows that share an id but not the text are ordered by a hash of it.  Null ids come
    first.  Columns of docs with these four names are replaced, the others stay.  With ``whole_characters`` a character goes
    with all its bytes where a cut goes through it, and the numbers count them.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    keep = [c for c in docs.columns if c not in names]
    key = free_name(docs, "key")
    keyed = _keyed(docs.select(*[F.col(f"`{c}`") for c in keep]), id_col, text_col, key)
    spans = repeated_spans(keyed, key, text_col)
    left, right = keyed.alias("l"), spans.alias("r")
    whole = left.join(right, F.col(f"l.`{key}`") == F.col("r.id"), "left").select(*[F.col(f"l.`{c}`").alias(c) for c in keep], F.col(f"l.`{text_col}`"), F.col("r.spans")).toDF(*[f"c{i}" for i in range(len(keep) + 2)])
    out = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, T.LongType()) for n in names[:3]], T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for part in slices(whole_batch, len(keep)):
                n_bytes, n_removed, n_spans, kept = [], [], [], []
                for text, spans_of in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist()):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    merged: list[list[int]] = []
                    for s in spans_of or ():
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["stop"])
                        else:
                            merged.append([s["start"], s["stop"]])
                    if whole_characters:
                        for m in merged:
                            while m[0] > 0 and m[0] < len(data) and data[m[0]] & 0xC0 == 0x80:
                                m[0] -= 1
                            while m[1] < len(data) and data[m[1]] & 0xC0 == 0x80:
                                m[1] += 1
                    at, pieces = 0, []
                    for a, b in merged:
                        pieces.append(data[at : max(at, a)])
                        at = max(at, b)
                    pieces.append(data[at:])
                    kept.append(b"".join(pieces))
                    n_bytes.append(len(data))
                    n_removed.append(len(data) - len(kept[-1]))
                    n_spans.append(len(merged))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=[*keep, *names])

    return whole.mapInArrow(tidied(run), out)
