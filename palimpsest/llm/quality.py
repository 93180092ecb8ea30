"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

A document's features are in three blocks.  Hashed words: each white-space chunk as its lower-case word and as its shape
(letters, capitals, digits and marks in runs), by the root of its share in the text, so the block has length one whatever the
text's length is.  Structure statistics: shares of character classes, repetition, line and word lengths.  Metadata: numeric
columns of the table, as a logarithm or as missing.  Statistics and metadata are one-hot, by quantiles of the sample.

Every two features interact by the product of their factors.  The sum over all pairs costs as much as a sum over features:
sum over i < j of <v_i, v_j> x_i x_j = 1/2 sum over f of ((sum over i of v_if x_i)^2 - sum over i of v_if^2 x_i^2).

The classifier is fitted on a bounded sample of labelled documents: ``max_docs`` of each class at most, by a hash of their id,
with the intercept set back to the classes' true shares.  Scoring is over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import free_name, gathered, tidied, written

MAX_DOCS, BUCKETS, FACTORS, BINS = 3_000, 1 << 16, 8, 10
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-4
SLICE_BYTES = 8 << 20
STATISTICS = ("tokens", "token_length", "capitals", "digits", "marks", "other", "all_capitals", "marked", "lone_marks", "distinct", "repeated", "top", "lines", "line_length", "sentences")
#: Classes of bytes: letters a-z and beyond ASCII, capitals, digits, marks.
_CLASS = np.array([3 if 33 <= c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 127 else 2 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 4 if c > 127 else 0 for c in range(256)])


def _hashed(words: pa.Array, salt: int) -> np.ndarray:
    """A bucket for each word; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    buckets = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass"), salt) % BUCKETS for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return buckets[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)


def _classes(words: pa.Array) -> np.ndarray:
    """Bytes of each class in each word: a row a word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    word = np.repeat(np.arange(len(words)), np.diff(offsets))
    return np.bincount(word * 5 + _CLASS[data], minlength=5 * len(words)).reshape(-1, 5).astype(np.float64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, buckets, values) of the hashed words, and a row of STATISTICS per text; null is empty."""
    texts, n = pc.fill_null(texts, ""), len(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[index] if len(words) else np.zeros(0, bool)
    doc, index = np.repeat(np.arange(n), np.diff(offsets))[real], index[real]
    number = np.bincount(doc, minlength=n)
    each = np.maximum(number, 1.0)
    pairs, counts = np.unique(doc * max(1, len(words)) + index, return_counts=True)
    in_doc, word = pairs // max(1, len(words)), pairs % max(1, len(words))

    bare = pc.replace_substring_regex(pc.ascii_lower(words), r"[!-/:-@\[-`{-~]+", "")
    shape = words
    for pattern, to in ((r"[a-z]+|[^\x00-\x7f]+", "a"), (r"a+", "a"), (r"[A-Z]+", "A"), (r"[0-9]+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, to)
    buckets = np.concatenate([_hashed(bare, 1)[word], _hashed(shape, 2)[word]])
    keys, back = np.unique(np.tile(in_doc, 2) * BUCKETS + buckets, return_inverse=True)
    sums = np.bincount(back, np.tile(counts, 2), len(keys))
    of_doc = keys // BUCKETS
    values = np.sqrt(sums / (2 * each[of_doc])).astype(np.float32)

    kinds = _classes(words)
    length = kinds.sum(axis=1)
    total = lambda x: np.bincount(in_doc, (x[word] * counts), n)
    letters = kinds[:, 0] + kinds[:, 1] + kinds[:, 4]
    bytes_ = np.maximum(total(length), 1.0)
    again = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (index[1:] == index[:-1])], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, in_doc, counts)
    newlines = pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False) + 1.0
    ends = pc.match_substring_regex(words, r"[.!?]$").to_numpy(zero_copy_only=False).astype(np.float64)
    marked = (kinds[:, 3] > 0) & (letters > 0)
    statistics = np.stack([
        np.log1p(number), total(length) / each, total(kinds[:, 1]) / bytes_, total(kinds[:, 2]) / bytes_, total(kinds[:, 3]) / bytes_, total(kinds[:, 4]) / bytes_,
        total(((kinds[:, 1] > 1) & (kinds[:, 0] == 0)).astype(float)) / each, total(marked.astype(float)) / each, total(((kinds[:, 3] > 0) & (letters == 0)).astype(float)) / each,
        np.bincount(in_doc, minlength=n) / each, again / each, top / each, np.log1p(newlines), np.log1p(bytes_ / newlines), total(ends) / each,
    ], axis=1)
    return of_doc, keys % BUCKETS, values, statistics


@dataclass
class Model:
    """Weights of single features, factors (a row a feature) and the edges of the statistics' bins (a row a statistic)."""

    intercept: float
    weights: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def columns(self, numbers: np.ndarray) -> np.ndarray:
        """The one-hot features of rows of statistics and metadata: a bin each, the last one for missing numbers."""
        width = self.edges.shape[1] + 2
        bins = np.stack([np.searchsorted(e, numbers[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)
        return BUCKETS + np.arange(len(self.edges)) * width + np.where(np.isnan(numbers), width - 1, bins)


def log_odds(intercept: float, weights: np.ndarray, factors: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value for each of n rows, whose features are (rows, columns, values), rows in order; and sum of v_if x_i by row and factor."""
    begins = np.searchsorted(rows, np.arange(n))
    full = np.flatnonzero(np.bincount(rows, minlength=n))

    def by_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, *x.shape[1:]), np.float64)
        if len(full):
            out[full] = np.add.reduceat(x, begins[full], axis=0)
        return out

    v = factors[columns] * values[:, None]
    sums = by_row(v)
    return intercept + by_row(weights[columns] * values) + ((sums**2).sum(axis=1) - by_row((v**2).sum(axis=1))) / 2, sums


def _with_bins(model: Model, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all blocks, rows in order; a bin has the value that makes its block as long as that of the words."""
    bins = model.columns(numbers)
    n, k = bins.shape
    rows, columns = np.concatenate([rows, np.repeat(np.arange(n), k)]), np.concatenate([columns, bins.ravel()])
    values = np.concatenate([values, np.full(n * k, k**-0.5, np.float32)])
    order = np.argsort(rows, kind="stable")
    return rows[order], columns[order], values[order]


def trained(model: Model, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """The model after so many passes of Adam over the rows, on the logistic loss with weights decayed."""
    random, n = np.random.default_rng(seed), len(labels)
    params = [np.array([model.intercept]), model.weights.copy(), random.normal(0, 0.1, model.factors.shape)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    begins = np.searchsorted(rows, np.arange(n + 1))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for part in np.array_split(random.permutation(n), max(1, n // BATCH)):
            sizes = begins[part + 1] - begins[part]
            at = np.repeat(begins[part], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own, x, row = columns[at], values[at].astype(np.float64), np.repeat(np.arange(len(part)), sizes)
            odds, sums = log_odds(params[0][0], params[1], params[2], row, own, x, len(part))
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[part]) / len(part)
            touched, back = np.unique(own, return_inverse=True)
            pull = error[row] * x
            v = params[2][own]
            slopes = pull[:, None] * (sums[row] - v * x[:, None])
            gradients = [np.array([error.sum()]), np.bincount(back, pull, len(touched)), np.stack([np.bincount(back, slopes[:, f], len(touched)) for f in range(v.shape[1])], axis=1)]
            step += 1
            for k, (p, g) in enumerate(zip(params, gradients)):
                where = touched if k else slice(None)
                g = g + DECAY * p[where] if k else g
                first[k][where] = 0.9 * first[k][where] + 0.1 * g
                second[k][where] = 0.999 * second[k][where] + 0.001 * g * g
                p[where] -= rate * (first[k][where] / (1 - 0.9**step)) / (np.sqrt(second[k][where] / (1 - 0.999**step)) + 1e-8)
    return Model(float(params[0][0]), params[1], params[2], model.edges)


def _numbers(batch: pa.RecordBatch, statistics: np.ndarray, first: int) -> np.ndarray:
    """Statistics with the metadata beside them: the logarithm of a number's size, NaN where it is missing or not finite."""
    rest = [pc.fill_null(batch.column(k).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for k in range(first, batch.num_columns)]
    return np.column_stack([statistics, *[np.where(np.isfinite(x), np.sign(x) * np.log1p(np.abs(np.nan_to_num(x))), np.nan) for x in rest]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",), max_docs: int = MAX_DOCS, factors: int = FACTORS, epochs: int = EPOCHS) -> Model | float:
    """A model from the labelled rows (label 1: good, 0: poor), or the share of label 1 where a class has no row.

    An id with both labels has label 1; other labels, null ids and ids without a document are left out.  The sample, about
    ``max_docs`` documents a class, is all that reaches the driver: its features, packed.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_label").alias("_label"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return float(totals.get(1, 0) > 0)
    draw = F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("_label") == 1, max_docs / totals[1]).otherwise(max_docs / totals[0])
    drawn = known.where(draw < share)  # about 2 * max_docs rows
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("c0"), *[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(metadata, 2)])
    sample = written(rows.join(F.broadcast(drawn), "_id").select("c0", F.col("_label").alias("c1"), *[f"c{k}" for k in range(2, len(metadata) + 2)]), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 0, SLICE_BYTES):
            of_doc, columns, values, statistics = features(batch.column(0))
            numbers = _numbers(batch, statistics, 2)
            bounds = np.searchsorted(of_doc, np.arange(batch.num_rows + 1))
            packed = [[x[a:b].astype(t).tobytes() for a, b in zip(bounds, bounds[1:])] for x, t in ((columns, np.int32), (values, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary()), pa.array([x.tobytes() for x in numbers], pa.binary())], names=["label", "columns", "values", "numbers"])

    got = sample.mapInArrow(tidied(run), "label int, columns binary, values binary, numbers binary").collect()
    y = np.array([r["label"] for r in got], np.float64)
    if len(set(y)) < 2:
        return totals[1] / sum(totals.values())
    order = np.lexsort(([zlib.crc32(r["columns"]) for r in got], y))  # whatever order Spark gives
    got, y = [got[k] for k in order], y[order]
    numbers = np.array([np.frombuffer(r["numbers"], np.float64) for r in got])
    edges = np.nan_to_num(np.array([np.quantile(x[~np.isnan(x)], np.arange(1, BINS) / BINS) if (~np.isnan(x)).any() else np.zeros(BINS - 1) for x in numbers.T]))
    size = BUCKETS + len(edges) * (BINS + 1)
    model = Model(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(size), np.zeros((size, factors)), edges)
    parts = [[np.frombuffer(r[c], t) for r in got] for c, t in (("columns", np.int32), ("values", np.float32))]
    rows_of = np.repeat(np.arange(len(got)), [len(c) for c in parts[0]])
    model = trained(model, *_with_bins(model, rows_of, np.concatenate(parts[0]).astype(np.int64), np.concatenate(parts[1]), numbers), y, epochs)
    model.intercept += float(np.log(totals[1] / totals[0]) - np.log(y.mean() / (1 - y.mean())))
    model.weights, model.factors = model.weights.astype(np.float32), model.factors.astype(np.float32)
    return model


def score(docs: DataFrame, model: Model | float, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), score_col: str = "score") -> DataFrame:
    """docs with the probability of label 1 by text and metadata.

    Null and empty texts are scored as texts without words, null metadata as missing.  A model that is a mere share gives every
    row that share.  A column named like score_col is replaced; other columns and repeated rows stay.
    """
    if isinstance(model, float):
        return docs.withColumn(score_col, F.lit(model))
    keep = [c for c in docs.columns if c != score_col]
    name, k = free_name(docs, "odds"), len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in gathered(batches, k, SLICE_BYTES):
            of_doc, columns, values, statistics = features(batch.column(k))
            own = _with_bins(m, of_doc, columns, values, _numbers(batch, statistics, k + 1))
            odds, _ = log_odds(m.intercept, m.weights, m.factors, *own, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(odds)], names=out.names)

    given = docs.select(*[F.col(f"`{c}`") for c in [*keep, text_col]], *[F.col(f"`{c}`").cast("double") for c in metadata]).toDF(*[f"c{i}" for i in range(k + 1 + len(metadata))])
    return given.mapInArrow(tidied(run), out).withColumn(score_col, 1 / (1 + F.exp(-F.col(f"`{name}`")))).drop(name)
