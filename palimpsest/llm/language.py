"""Language identification: word frequencies first, then ever shorter character n-grams for words not known.

The model is a classifier fitted on a bounded sample: about MAX_DOCS labelled documents of each language, drawn row by row
(copies count as often as they stand there), from which Spark counts words and n-grams by language.  It keeps the MAX_WORDS commonest words and the MAX_GRAMS
commonest n-grams over all languages together, so what reaches driver and executors has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.bpe import slices
from palimpsest.llm.common import tidied, written

MAX_DOCS, MAX_WORDS, MAX_GRAMS, MAX_LANGS = 2_000, 60_000, 40_000, 1_000
LONGEST = 5


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between ^ and $, and where each begins and ends."""
    marked = [f"^{w}$" for w in words]
    ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
    return np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], ends))


def _gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n code points from each place."""
    h = np.zeros(max(0, len(points) - n + 1), np.uint64)
    for k in range(n):
        h = (h + points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


class Model:
    """Log frequencies by language of words and n-grams, and the scores they give."""

    def __init__(self, langs: list[str], prior: np.ndarray, words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.langs, self.prior = langs, prior
        self.words, self.word_logs = list(words), np.array([*words.values(), np.zeros(len(langs))], np.float64)
        self.grams = {}
        for n in range(1, LONGEST + 1):
            own = [g for g in grams if len(g) == n]
            if own:
                h = np.concatenate([_gram_hashes(np.frombuffer(g.encode("utf-32-le"), np.uint32), n) for g in own])
                order = np.argsort(h)
                self.grams[n] = h[order], np.array([grams[g] for g in own], np.float64)[order]

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """A row per word: its log frequency in each language, or the mean of its longest n-grams that are known, or zeros."""
        at = pc.index_in(words, value_set=pa.array(self.words, pa.string()))
        known = pc.fill_null(at, len(self.words)).to_numpy(zero_copy_only=False)
        out = self.word_logs[known]
        left = np.nonzero(known == len(self.words))[0]
        for n in range(LONGEST, 0, -1):
            if not len(left) or n not in self.grams:
                continue
            points, bounds = _code_points(words.take(pa.array(left)).to_pylist())
            places = np.repeat(np.arange(len(left)), np.diff(bounds))
            h = _gram_hashes(points, n)
            inside = np.arange(len(h)) + n <= bounds[1:][places[: len(h)]]
            h, places = h[inside], places[: len(h)][inside]
            keys, logs = self.grams[n]
            found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[found] == h
            places, found = places[hit], found[hit]
            hits = np.bincount(places, minlength=len(left))
            some = hits > 0
            for k in range(len(self.langs)):
                out[left[some], k] = np.bincount(places, logs[found, k], len(left))[some] / hits[some]
            left = left[~some]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        letters = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}]+", " ")
        parts = pc.ascii_split_whitespace(letters)
        part_offsets = parts.offsets.to_numpy()
        words = parts.values.dictionary_encode()
        which = words.indices.to_numpy(zero_copy_only=False)
        scores = self.word_scores(words.dictionary) if self.langs else np.zeros((len(words.dictionary), 0))
        real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)
        token = np.repeat(np.arange(len(coded.dictionary)), np.diff(part_offsets))
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        lettered = np.bincount(doc, (np.bincount(token, real[which], len(coded.dictionary)) > 0)[index], len(texts)) > 0
        total = np.tile(self.prior, (len(texts), 1))
        for k in range(len(self.langs)):
            of_token = np.bincount(token, (scores[:, k] * real)[which], len(coded.dictionary))
            total[:, k] += np.bincount(doc, of_token[index], len(texts))
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, share, 0.0)


def _log_table(rows: list, at: dict[str, int], sums: np.ndarray) -> dict[str, np.ndarray]:
    """Add-a-half smoothed log frequencies by language of each key."""
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["k"], np.zeros(len(at)))[at[r["lang"]]] += r["n"]
    return {k: np.log((c + 0.5) / (sums + 0.5 * max(1, len(counts)))) for k, c in counts.items()}


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """A model from the rows whose language is not null."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(totals) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    sample = rows.sampleBy("lang", {x: min(1.0, max_docs / n) for x, n in totals.items()}, seed=42) if totals else rows
    word = F.explode(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}]+", " ")), " ")).alias("k")
    counts = written(sample.select("lang", word).where("k != ''").groupBy("lang", "k").agg(F.count("*").alias("n")), "words")
    marked = F.concat(F.lit("^"), F.col("k"), F.lit("$"))
    gram = F.explode(F.flatten(F.array(*[
        F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i, n=n: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        for n in range(1, LONGEST + 1)
    ]))).alias("k")
    grams = written(counts.select("lang", "n", gram).groupBy("lang", "k").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(totals)
    at = {x: i for i, x in enumerate(langs)}

    def logs(df: DataFrame, most: int) -> dict[str, np.ndarray]:
        top = df.groupBy("k").agg(F.sum("n").alias("all")).where(F.col("all") > 1).orderBy(F.desc("all"), "k").limit(most)
        sums = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        return _log_table(df.join(top.select("k"), "k").collect(), at, np.array([float(sums.get(x, 0)) for x in langs]))

    prior = np.array([totals[x] for x in langs], np.float64)
    return Model(langs, np.log(prior / max(1.0, prior.sum())), logs(counts, max_words), logs(grams, max_grams))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score: a learned language, or ``und`` and 0 where the text is null or has no letter.

    The score is the language's posterior share.  Equal posteriors go to the first language in order.  Empty tables stay
    empty; without any labelled row all is ``und``.  Columns of docs with these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    rest = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    at = rest.index(text_col)
    out = T.StructType([*[docs.schema[c] for c in rest], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, at, 8 << 20):
                lang, score = shared.value.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=out.names)

    return docs.select(*[F.col(f"`{c}`") for c in rest]).toDF(*[f"c{i}" for i in range(len(rest))]).mapInArrow(tidied(run), out)
