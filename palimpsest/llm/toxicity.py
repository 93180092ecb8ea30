"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text than of ordinary text.

A window is one word between spaces, repeated REPEATS times: so short a text alone is stored as it is, repeated it is not,
and its length tells what the dictionary spared.  Dictionaries from zstandard's own trainer over windows of running text don't
give right results: README has the figures.  The two dictionaries, of TOXIC_BYTES and ORDINARY_BYTES at most, are therefore made of the words whose share of documents differs
most between the classes, and of the commonest words of ordinary text.  Each distinct word of a slice is compressed once.

The classifier is fitted on a bounded sample of labelled documents: MAX_DOCS of each class at most, by a hash of their id.
Its last step is a logistic regression over a document's spared bytes (counts above thresholds and their shares), with the
intercept set back to the classes' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.bpe import slices
from palimpsest.llm.common import free_name, tidied, written

MAX_DOCS, TOXIC_BYTES, ORDINARY_BYTES = 6_000, 8_192, 8_192
REPEATS, LONGEST, LEVEL, LEAST_Z, CACHE = 4, 64, 9, 4.5, 300_000
_TABLE = np.array([32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def plain_words(texts: pa.Array) -> pa.ListArray:
    """Words of ASCII letters and digits and of other characters, A-Z in lower case; null is empty."""
    texts = pc.fill_null(texts, "")
    data = texts.buffers()[2]
    if data is None or not data.size:
        return pc.ascii_split_whitespace(texts)
    mapped = pa.py_buffer(_TABLE[np.frombuffer(data, np.uint8)].tobytes())
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, texts.buffers()[1], mapped], offset=texts.offset))


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


class Scorer:
    """Compression lengths with both dictionaries; lives in a Python worker."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=params)

        self.toxic, self.ordinary, self.cache = compressor(toxic), compressor(ordinary), {}

    def spared(self, word: str) -> int:
        """Bytes by which the word's window is shorter with the toxic dictionary."""
        raw, out = word.encode("utf-8", "surrogatepass"), 0
        for at in range(0, len(raw), LONGEST):
            window = (b" " + raw[at : at + LONGEST]) * REPEATS + b" "
            out += len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row of features per text."""
        lists = plain_words(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        cache = self.cache
        if len(cache) + len(words) > CACHE:
            cache.clear()
        d = np.zeros(len(words))
        for i, w in enumerate(words):
            got = cache.get(w)
            if got is None:
                got = cache[w] = self.spared(w)
            d[i] = got
        size = np.array([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words], np.float64)
        real = np.array([bool(w) for w in words], np.float64)
        doc, n = np.repeat(np.arange(len(texts)), np.diff(offsets)), len(texts)
        total = lambda x: np.bincount(doc, (x * real)[index], n)
        number = total(np.ones(len(words)))
        each = np.maximum(number, 1)
        counts = [total((d >= t).astype(np.float64)) for t in range(2, 9)]
        shares = [total((d / size >= t).astype(np.float64)) for t in (0.5, 0.75)]
        return np.stack([total(d) / each, *[10 * c / each for c in counts], *[np.log1p(c) for c in counts], *[10 * c / each for c in shares], *[np.log1p(c) for c in shares], np.log1p(number) / 10], axis=1)


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, intercept first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty + 1e-9 * np.eye(len(b)), x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-7:
            break
    return b


def _words_by_class(sample: DataFrame, text_col: str) -> DataFrame:
    """Documents of each class that hold a word: (word, toxic, plain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 0, 8 << 20):
                lists = plain_words(part.column(0))
                doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                coded = lists.values.slice(lists.offsets[0].as_py(), len(doc)).dictionary_encode()
                pairs = np.unique(doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False))
                doc, word = pairs // max(1, len(coded.dictionary)), pairs % max(1, len(coded.dictionary))
                toxic = part.column(1).to_numpy(zero_copy_only=False)[doc] == 1
                yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(np.bincount(word[k], minlength=len(coded.dictionary)).astype(np.int64)) for k in (toxic, ~toxic)]], names=["word", "toxic", "plain"])

    return sample.select(text_col, "_label").mapInArrow(tidied(run), "word string, toxic bigint, plain bigint").where("word != ''").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, toxic_bytes: int = TOXIC_BYTES, ordinary_bytes: int = ORDINARY_BYTES, least_z: float = LEAST_Z) -> Model | float:
    """A model from the labelled rows (label 1: toxic, 0: ordinary), or the share of label 1 where a class has no row.

    An id with both labels has label 1; other labels, null ids and ids without a document are left out.  ``toxic_bytes`` and
    ``ordinary_bytes`` bound the dictionaries, whose foremost words stay where not all fit (words longer than a window are in
    none); a toxic word is in at least three toxic documents of the sample and has a z-score above ``least_z``.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_label").alias("_label"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return float(totals.get(1, 0) > 0)
    draw = F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("_label") == 1, max_docs / totals[1]).otherwise(max_docs / totals[0])
    drawn = known.where(draw < share)  # about 2 * max_docs rows
    sample = written(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_words")).join(F.broadcast(drawn), "_id").select("_words", "_label"), "labelled")
    got = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(got) < 2:
        return totals[1] / sum(totals.values())
    words = written(_words_by_class(sample, "_words"), "words")
    a, b = F.col("toxic") / got[1], F.col("plain") / got[0]
    p = (F.col("toxic") + F.col("plain")) / (got[0] + got[1])
    z = (a - b) / F.sqrt(p * (1 - p) * (1 / got[0] + 1 / got[1]) + 1e-12)
    few = words.where(F.octet_length("word") <= LONGEST).withColumn("z", z)  # no window holds a longer one
    toxic = few.where((F.col("z") > least_z) & (F.col("toxic") >= 3)).orderBy(F.desc("z"), "word").limit(toxic_bytes // 2).collect()
    plain = few.where(F.abs("z") < 1.5).orderBy(F.desc("plain"), "word").limit(ordinary_bytes // 2).collect()  # no more words than bytes allow

    def content(rows: list, most: int) -> bytes:
        """The words, the foremost last, where matches cost least."""
        out = b" "
        for r in rows:
            w = r["word"].encode()
            if len(out) + len(w) + 1 > most:
                break
            out = b" " + w + out
        return out

    model = Model(content(toxic, toxic_bytes) or b" ", content(plain, ordinary_bytes) or b" ", np.zeros(0), np.zeros(0), np.zeros(0))
    rows = _features(sample, model, "_words", ["_label"], "_features").collect()  # about 2 * max_docs short rows
    x, y = np.array([r["_features"] for r in rows]), np.array([r["_label"] for r in rows], np.float64)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _regression((x - model.mean) / model.spread, y)
    model.weights[0] += np.log(totals[1] / totals[0]) - np.log(got[1] / got[0])
    return model


def _features(docs: DataFrame, model: Model, text_col: str, keep: list[str], name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.toxic, model.ordinary))
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for whole in batches:
            for part in slices(whole, len(keep), 8 << 20):
                x = scorer.features(part.column(len(keep)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], names=[*keep, name])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`")).toDF(*[f"c{i}" for i in range(len(keep) + 1)]).mapInArrow(tidied(run), out)


def score(docs: DataFrame, model: Model | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the probability of label 1 by the text alone.

    Null and empty texts are scored as texts without words.  A model that is a mere share gives every row that share.  A
    column named like score_col is replaced; other columns and repeated rows stay.
    """
    if isinstance(model, float):
        return docs.withColumn(score_col, F.lit(model))
    keep = [c for c in docs.columns if c != score_col]
    weights = model.weights[1:] / model.spread
    name = free_name(docs, "features")
    logit = F.aggregate(F.zip_with(name, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(float(model.weights[0] - weights @ model.mean)), lambda acc, v: acc + v)
    return _features(docs, model, text_col, keep, name).withColumn(score_col, 1 / (1 + F.exp(-logit))).drop(name)
