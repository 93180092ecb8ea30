"""Source divergence audit: how differently the sources of a language use its terms.

Chunk factorization: a task counts the white-space chunks of each of its documents, slice by slice; a slice leaves one row for
each of its distinct chunks, and one pack with the counts by document, which name chunks by their number in the slice.  Each
globally distinct chunk is tokenized once, its terms are joined back to the slices that hold it, and there become documents and
occurrences by term.  Only sums leave a slice.  Chunks never cut a term: white space is no part of any.

Smoothed shares are whole numbers (billionths), by decimal division, so all is exact.  Distances between sources are summed
over tiles: a block of sources by a block of sources by a bucket of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import gathered, tidied, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text in a slice; sources in a block and terms in a bucket of a tile.
SLICE_BYTES, BLOCK, BUCKET = 32 << 20, 256, 4_096
UNIT = 1_000_000_000
#: Rows up to which a table that has been counted is broadcast; a larger one is shuffled.
SMALL = 200_000


def terms(text: Column) -> Column:
    """The terms of a text in order: runs of letters of ASCII and of characters beyond it, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _if_small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has SMALL rows at most."""
    return F.broadcast(df) if df.count() <= SMALL else df


def chunk_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Slices of docs (text, lang, source, none of them null), as a written table of rows of two kinds.

    ``chunk``: a distinct chunk of a slice and its number there (slice, at, chunk).  ``pack``: a slice's distinct pairs of
    language and source, and as compressed arrays each document's pair, where its chunks begin, their numbers and counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, 0, slice_bytes):
            lists = pc.ascii_split_whitespace(batch.column(0))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            chunks, n = coded.dictionary, max(1, len(coded.dictionary))
            pairs = np.repeat(np.arange(batch.num_rows) * n, np.diff(offsets))
            pairs += coded.indices.to_numpy(zero_copy_only=False)
            del lists, coded
            pairs.sort()
            first = _starts(pairs)
            pairs, counts = pairs[first], np.diff(first, append=len(pairs))
            begins = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * n)
            pairs %= n
            steps = np.diff(pairs, prepend=0)  # small within a document
            group = _pairs(batch.column(1), batch.column(2))
            firsts = np.unique(group, return_index=True)[1]
            data = b"".join(x.astype(np.int32).tobytes() for x in (np.array([batch.num_rows, len(pairs)]), group, begins, steps, counts))
            empty, m = pa.nulls(1, pa.string()), len(chunks)
            strings = lambda k: pa.array([batch.column(k).take(pa.array(firsts)).to_pylist()], pa.list_(pa.string()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(["pack"]), pa.array([number]), pa.nulls(1, pa.int32()), empty, strings(1), strings(2), pa.array([zstandard.compress(data, 1)])], names=names)
            lists_none, none = pa.nulls(m, pa.list_(pa.string())), pa.nulls(m, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * m, pa.string()), pa.array(np.full(m, number)), pa.array(np.arange(m, dtype=np.int32)), chunks, lists_none, lists_none, none], names=names)
            number += 1

    names = ["kind", "slice", "at", "chunk", "langs", "sources", "data"]
    made = docs.select("text", "lang", "source").mapInArrow(tidied(run), "kind string, slice bigint, at int, chunk string, langs array<string>, sources array<string>, data binary")
    return written(made, "chunks", by="kind")


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.concatenate(([len(ordered) > 0], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _pairs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """A number for each distinct pair of values, from 0 on."""
    a, b = a.dictionary_encode(), b.dictionary_encode()
    both = a.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy(zero_copy_only=False)
    return np.unique(both, return_inverse=True)[1]


def _slice_terms(pack: pa.Table, found: pa.Table) -> pa.Table:
    """(lang, term, docs, sources, counts) of a slice, from its pack and the terms of its chunks."""
    langs, sources = (pack.column(c)[0].as_py() for c in ("langs", "sources"))
    data = np.frombuffer(zstandard.decompress(pack.column("data")[0].as_py()), np.int32).astype(np.int64)
    rows, n = int(data[0]), int(data[1])
    group, begins, steps, counts = np.split(data[2:], np.cumsum([rows, rows + 1, n]))
    chunk, doc = np.cumsum(steps), np.repeat(np.arange(rows), np.diff(begins))
    lists = pc.ascii_split_whitespace(pa.concat_arrays([*found.column("terms").chunks, pa.array([], pa.string())]))
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    # the terms of chunk k: index[first[k] : first[k] + size[k]]
    at, sizes = found.column("at").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    first, size = np.zeros((2, max(int(chunk.max(initial=-1)), int(at.max(initial=-1))) + 1), np.int64)
    first[at], size[at] = np.cumsum(sizes) - sizes, sizes
    each = size[chunk]
    term = index[np.arange(each.sum()) + np.repeat(first[chunk] - np.cumsum(each) + each, each)].astype(np.int64)
    # groups by language and documents by group, so that one order has terms, their languages, groups and documents
    lang_of = pa.array(langs, pa.string()).dictionary_encode()
    lang = lang_of.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.argsort(lang, kind="stable")
    placed = np.empty_like(groups)
    placed[groups] = np.arange(len(groups))
    docs = np.argsort(placed[group], kind="stable")
    turn = np.empty_like(docs)
    turn[docs] = np.arange(rows)
    term *= max(1, rows)
    term += np.repeat(turn[doc], each)
    order = np.argsort(term)
    key, counts = term[order], np.repeat(counts, each)[order]
    held = _starts(key)  # a document that holds a term
    occurrences, key = np.add.reduceat(counts, held) if len(held) else counts, key[held]
    which, own = key // max(1, rows), placed[group][docs][key % max(1, rows)]
    pairs = _starts(which * len(groups) + own)  # a group that does
    occurrences = np.add.reduceat(occurrences, pairs) if len(pairs) else occurrences
    in_docs, which, own = np.diff(pairs, append=len(key)), which[pairs], own[pairs]
    of = lang[groups][own]
    starts = _starts(which * len(lang_of.dictionary) + of)  # a language that does
    ends = pa.array(np.append(starts, len(own)).astype(np.int32))
    totals = np.add.reduceat(in_docs, starts) if len(starts) else in_docs
    source = pa.array(sources, pa.string()).take(pa.array(groups[own]))
    return pa.table({
        "lang": lang_of.dictionary.take(pa.array(of[starts])), "term": words.take(pa.array(which[starts])), "docs": pa.array(totals.astype(np.int64)),
        "sources": pa.ListArray.from_arrays(ends, source), "counts": pa.ListArray.from_arrays(ends, pa.array(occurrences.astype(np.int64))),
    })


def slice_terms(slices: DataFrame) -> DataFrame:
    """(lang, term, docs, sources, counts) by slice: documents that hold the term, and its occurrences in each source."""
    rows = slices.where("kind = 'chunk'").select("slice", "at", "chunk")
    known = rows.select("chunk").distinct().select("chunk", F.array_join(terms(F.col("chunk")), " ").alias("terms")).where("terms != ''")
    found = rows.join(known, "chunk").select("slice", "at", "terms")
    packs = slices.where("kind = 'pack'").select(F.col("slice").alias("of"), "langs", "sources", "data")

    def run(pack: pa.Table, own: pa.Table) -> pa.Table:
        return _slice_terms(pack, own)

    return packs.groupBy("of").cogroup(found.groupBy("slice")).applyInArrow(run, "lang string, term string, docs bigint, sources array<string>, counts array<bigint>")


def _share(count: Column | str, total: str, kept: str, smooth: int) -> Column:
    """1 + floor(UNIT * (count + smooth) / (total + smooth * kept)), exactly, for decimals of 20 digits."""
    count = F.col(count) if isinstance(count, str) else count
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = (wide(count) + F.lit(smooth)) * F.lit(UNIT).cast("decimal(10,0)"), wide(F.col(total)) + wide(F.col(kept)) * F.lit(smooth)
    return F.lit(1).cast("bigint") + F.call_function("div", above, below)


def kept_counts(docs: DataFrame, least_docs: int = 30, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (text, lang, source): kept terms (lang, term, all), their counts by source (lang, source, term, n), and all groups (lang, source).

    A language keeps the terms that at least ``least_docs`` of its documents hold; ``all`` is the term's count in it.
    """
    by_slice = written(slice_terms(chunk_counts(docs, slice_bytes)), "terms")
    kept = written(by_slice.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"), "kept")
    each = by_slice.join(_if_small(kept), ["lang", "term"]).select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    counts = written(each.groupBy("lang", F.col("e.sources").alias("source"), "term").agg(F.sum("e.counts").alias("n")), "counts")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("all")), "kept")
    return kept, counts, docs.select("lang", "source").distinct()


def _tile(own: pa.Table, sources: pa.Table, block: int) -> pa.Table:
    """Sums over a bucket's terms of the distance of shares, for every two sources of a tile: (lang, one, two, f), one before two."""
    place, none = sources.column("place").to_numpy(), sources.column("none").to_numpy()
    order = np.argsort(place)
    place, none = place[order], none[order]
    coded = own.column("term").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    shares = np.repeat(none[:, None], len(coded.dictionary), axis=1)
    shares[np.searchsorted(place, own.column("place").to_numpy()), coded.indices.to_numpy(zero_copy_only=False)] = own.column("p").to_numpy()
    missing = (int(sources.column("terms")[0].as_py()) - len(coded.dictionary)) * np.abs(none[:, None] - none[None, :])  # terms that none of the tile has
    a, b = (int(sources.column(c)[0].as_py()) for c in ("a", "b"))
    ones = np.flatnonzero(place // block == a)
    one, two, f = [], [], []
    for k in ones:
        others = np.flatnonzero((place // block == b) & (place > place[k]))
        f.append(np.abs(shares[others] - shares[k]).sum(axis=1) + missing[k, others])
        one.append(np.full(len(others), place[k]))
        two.append(place[others])
    lists = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (one, two, f)]
    return pa.table({"lang": pa.array([sources.column("lang")[0].as_py()] * len(lists[0]), pa.string()), **dict(zip(("one", "two", "f"), map(pa.array, lists)))})


def source_distances(counts: DataFrame, groups: DataFrame, buckets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways: the sum of |p - q| over all kept terms.

    counts: (lang, source, term, p); groups: (lang, source, none), the share of a term that a group does not have; buckets:
    (lang, bucket, terms, buckets), how many kept terms are in each.
    """
    placed = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1)
    most = placed.groupBy("lang").agg(F.floor(F.max("place") / block).alias("last"))
    placed = written(placed.join(most, "lang").join(buckets.select("lang", "buckets").distinct(), "lang"), "sources")
    own_block, other = F.floor(F.col("place") / block), F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("other")

    def tiled(rows: DataFrame, *columns: str) -> DataFrame:
        """Each row for every tile that its block of sources takes part in."""
        return rows.select("lang", "bucket", "place", *columns, other).withColumns({"a": F.least(own_block, "other"), "b": F.greatest(own_block, "other")}).drop("other")

    of_bucket = F.pmod(F.xxhash64("term"), F.col("buckets"))
    keys = ["lang", "bucket", "a", "b"]
    left = tiled(counts.join(_if_small(placed.drop("none")), ["lang", "source"]).withColumn("bucket", of_bucket), "term", "p")
    right = tiled(placed.drop("buckets").join(buckets.drop("buckets"), "lang"), "none", "terms").select(*[F.col(c).alias(c) for c in [*keys, "place", "none", "terms"]])

    def run(own: pa.Table, sources: pa.Table) -> pa.Table:
        return _tile(own, sources, block)

    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "lang string, one bigint, two bigint, f bigint").groupBy("lang", "one", "two").agg(F.sum("f").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("one", "two"), F.struct(F.col("two").alias("one"), F.col("one").alias("two")))).alias("e"), "value").select("lang", "e.one", "e.two", "value")
    name = lambda place, to: placed.select("lang", F.col("place").alias(place), F.col("source").alias(to))
    return both.join(name("one", "source"), ["lang", "one"]).join(name("two", "item"), ["lang", "two"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, smooth: int = 5, top: int = 50, slice_bytes: int = SLICE_BYTES, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are from each other, and what marks each.

    A group's share of a kept term is p = 1 + floor(10^9 (count + smooth) / (N + smooth V)), N being the counts' sum over the V
    terms that its language keeps.  Part ``pair``: every other source of the language, value the sum of the distances of all
    shares.  Part ``term``: the ``top`` terms that a group has and whose share there is above that in the whole language,
    value the difference.  Ranks from 1, by falling value, then item.  ``slice_bytes``, ``block`` (sources) and ``bucket`` (terms)
    bound what a task holds at once, and change no result.

    Every row is a document; null texts, languages and sources count as empty ones.  A language that keeps no term has pairs of
    value 0 and no terms; one with a single source has no pairs.  Other columns play no part; an empty table gives no rows.
    """
    whole = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to) for c, to in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    kept, counts, groups = kept_counts(whole, least_docs, slice_bytes)
    langs = written(groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total")), "lang", "left").na.fill(0), "langs")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang"), "groups")
    full = counts.join(_if_small(groups), ["lang", "source"]).withColumn("p", _share("n", "total", "kept", smooth))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    above = full.join(_if_small(kept), ["lang", "term"]).withColumn("value", F.col("p") - _share("all", "lang_total", "kept", smooth)).where("value > 0")
    marks = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    sizes = langs.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("kept") / bucket)).cast("bigint")).select("lang", "buckets")
    in_bucket = kept.join(_if_small(sizes), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket")).agg(F.count("*").alias("terms"))
    buckets = sizes.select("lang", "buckets", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket")).join(in_bucket, ["lang", "bucket"], "left").na.fill(0, ["terms"])
    none = F.when(F.col("kept") > 0, _share(F.lit(0), "total", "kept", smooth)).otherwise(0)
    far = source_distances(full.select("lang", "source", "term", "p"), groups.select("lang", "source", none.alias("none")), buckets, block)
    pairs = far.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(marks)
