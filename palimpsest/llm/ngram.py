"""An interpolated modified Kneser-Ney model of order 2 or more: counted in Spark, stored as sorted hash arrays, mapped by workers.

Counting: a task counts the n-grams of a slice of documents with numpy and packs them by bucket; a bucket merges its packs and
writes its n-grams, and the sums of its contexts, as files of sorted hashes with their counts.  Buckets go by the words between
the first and the last, so that both an n-gram's context and its ending, all its words but the first, are whole within a bucket
(a bigram's bucket goes by its first word).  The bucket passes on one count of the ending for every n-gram kind (all its counts
where only the begin of the text stands before it), and these are the n-grams of the order below, down to the bigrams.  From
there every word's sums meet by word: the tokens and kinds of bigram that it begins, and how many kinds it ends.

Words or contexts that are frequent in a bounded sample of documents are spread over as many buckets as their share asks for,
by the context or by the whole n-gram, and their sums are added afterwards, so that no bucket grows with one word.  The sample
only says where an n-gram is counted.  The n-grams of the highest order are counted in PASSES parts, one after the other, so
that only one part stands in shuffle files at once.

Scoring: workers map the files from the shared folder (read into an unlinked temporary file first where it is not a mounted
one) and look the distinct words and bigrams of a slice up by binary search.  Nothing of the model passes through the driver
but counts of counts and a bit for each file; a file that a worker cannot see is an error, never an unknown word.

Words are known by whole 64-bit hashes.  N-grams and contexts are kept by KEY_BITS bits of theirs within a bucket: an n-gram
that was never seen is taken for one that was in about one case in a million.  Those seen once are keys alone.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import listed, pack, slices, unpack
from palimpsest.llm.common import dropped, gathered, scratch, tidied, written

SLICE, SCORED = 12 << 20, 4 << 20
KEY_BITS = 40
BUCKET_BYTES, PASSES = 12 << 20, 2
SAMPLE_DOCS, HOT_SHARE = 2_000, 0.002
BEGIN, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
OPEN_FILES = 2_000
_FIELDS = ("count", "kinds_before", "total", "n1", "n2", "n3")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, each text ended by END, and where each text begins and ends among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = values.dictionary_encode()
    words = listed(coded.dictionary)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) if w else 0 for w in words], np.uint64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    blank = np.array([not w for w in words], bool)[index] if words else np.zeros(0, bool)
    if blank.any():  # white space at the ends of a text gives empty strings
        kept = np.concatenate(([0], np.cumsum(~blank)))
        index, offsets = index[~blank], kept[offsets]
    n = len(offsets) - 1
    bounds = offsets + np.arange(n + 1)
    flat = np.empty(len(index) + n, np.uint64)
    inner = np.ones(len(flat), bool)
    inner[bounds[1:] - 1] = False
    flat[inner] = hashes[index] if len(index) else hashes[:0]
    flat[~inner] = END
    return flat, bounds


def before(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each token, BEGIN for the first of a text."""
    left = np.empty_like(flat)
    left[1:] = flat[:-1]
    left[bounds[:-1]] = BEGIN
    return left


def contexts(flat: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """The order - 1 tokens before each token, the farthest first, BEGIN where the text has none."""
    found = [before(flat, bounds)]
    for _ in range(order - 2):
        found.insert(0, before(found[0], bounds))
    return found


def folded(words: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of words; of one word the word itself."""
    h = words[0]
    for w in words[1:]:
        h = pair(h, w)
    return h


def pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of each bigram."""
    h = (u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + v * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: Sorted hashes of frequent contexts, and over how many buckets each is spread.
Hot = tuple[np.ndarray, np.ndarray]


def _offset(keys: np.ndarray, by: np.ndarray, hot: Hot) -> np.ndarray:
    """How many buckets further a row goes, by the hashes ``by``, because its key is hot."""
    if not len(hot[0]):
        return np.zeros(len(keys), np.uint64)
    at = np.minimum(np.searchsorted(hot[0], keys), len(hot[0]) - 1)
    return np.where(hot[0][at] == keys, (by >> np.uint64(20)) % hot[1][at], np.uint64(0))


def _route(words: list[np.ndarray], h: np.ndarray | None, hots: dict[int, Hot], buckets: int) -> np.ndarray:
    """The bucket of each n-gram, given its context's words and its hash (None: of the context itself)."""
    context, middle = folded(words), folded(words[1:] or words)
    place = middle * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)
    if len(words) > 1:
        place = place + _offset(middle, context, hots[len(words)])
    if h is not None:
        place = place + _offset(context, h, hots[len(words) + 1])
    return (place % np.uint64(buckets)).astype(np.int32)


def _word_bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    return ((w * np.uint64(0xA0761D6478BD642F) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all; a task that runs twice writes the same bytes twice."""
    if "://" not in path or path.startswith("file:"):
        local = path.removeprefix("file://")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as f:
            f.write(data)


def _map(path: str) -> np.ndarray:
    """The file's bytes, mapped; raises where this worker can't see it."""
    if "://" not in path or path.startswith("file:"):
        return np.memmap(path.removeprefix("file://"), np.uint8, "r")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with tempfile.NamedTemporaryFile() as f, store.open_input_stream(inner) as src:
        while block := src.read(1 << 22):
            f.write(block)
        f.flush()
        return np.memmap(f.name, np.uint8, "r")


def _narrow(most: int) -> type:
    return next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)


def _packed(words: list[np.ndarray], n: np.ndarray) -> bytes:
    """Grams and their counts, compressed: the pack's own words, then narrow indices of them and narrow counts."""
    own, index = np.unique(np.concatenate(words), return_inverse=True)
    return pack(own, *np.split(index, len(words)), n)


def _unpacked(packs: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    words, counts = [[np.zeros(0, np.uint64)] for _ in range(order)], [np.zeros(0, np.int64)]
    for raw in packs:
        own, *index, n = unpack(raw)
        for w, i in zip(words, index):
            w.append(own.astype(np.uint64)[i])
        counts.append(n.astype(np.int64))
    return [np.concatenate(w) for w in words], np.concatenate(counts)


def _gathered(words: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted hashes of the distinct grams, their words and the sums of their counts."""
    h = folded(words)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.nonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))[0]
    return h[first], [w[order[first]] for w in words], np.add.reduceat(n, first) if len(h) else n


def _by_bucket(words: list[np.ndarray], n: np.ndarray, hots: dict[int, Hot], buckets: int, part: int = 0, parts: int = 1) -> list[tuple[str, int, bytes]]:
    """Rows (kind, bucket, pack) of the grams whose bucket belongs to the part."""
    bucket = _route(words[:-1], folded(words), hots, buckets)
    if parts > 1:
        own = bucket % parts == part
        words, n, bucket = [w[own] for w in words], n[own], bucket[own]
    order = np.lexsort((words[0], words[len(words) > 2], bucket))
    edges = np.concatenate(([0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(order)])) if len(order) else [0]
    return [("b", int(bucket[order[a]]), _packed([w[order[a:b]] for w in words], n[order[a:b]])) for a, b in zip(edges, edges[1:])]


def _filed(keys: np.ndarray, fields: list[np.ndarray]) -> bytes:
    """A file of whole keys: the width of a field's numbers, the sorted keys, the fields one after the other."""
    kind = _narrow(max((int(f.max(initial=0)) for f in fields), default=0))
    return b"".join([np.uint64(np.dtype(kind).itemsize).tobytes(), keys.tobytes(), *[f.astype(kind).tobytes() for f in fields]])


#: What an n-gram, or a context by its (total, n1, n2, n3), has that was seen once.
_ONCE = {1: (1,), 4: (1, 1, 0, 0)}


def _padded(x: np.ndarray) -> bytes:
    return x.tobytes() + bytes(-x.nbytes % 8)


def _short_filed(keys: np.ndarray, fields: list[np.ndarray]) -> bytes:
    """A file of keys cut to KEY_BITS: those seen once, then the others with their fields; parts begin at multiples of eight."""
    once = fields[0] == 1
    kind = _narrow(max((int(f.max(initial=0)) for f in fields), default=0))
    out = [np.array([once.sum(), len(keys) - once.sum(), np.dtype(kind).itemsize], np.int64).tobytes()]
    for some in (once, ~once):
        k = keys[some]
        out += [_padded((k >> np.uint64(32)).astype(np.uint32)), _padded((k >> np.uint64(64 - KEY_BITS)).astype(np.uint8))]
    return b"".join([*out, *[_padded(f[~once].astype(kind)) for f in fields]])


def _place(high: np.ndarray, low: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands among the cut ones, or -1."""
    out = np.full(len(keys), -1)
    if len(high):
        own, rest = (keys >> np.uint64(32)).astype(np.uint32), (keys >> np.uint64(64 - KEY_BITS)).astype(np.uint8)
        at = np.searchsorted(high, own)
        left = np.arange(len(keys))
        while len(left):  # as often as cut keys agree in 32 bits
            left = left[at[left] < len(high)]
            left = left[high[at[left]] == own[left]]
            hit = low[at[left]] == rest[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
    return out


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys and the sums of each column by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.nonzero(np.concatenate(([True], k[1:] != k[:-1])))[0] if len(k) else np.zeros(0, np.int64)
    return k[first], [np.add.reduceat(c[order].astype(np.int64), first) if len(k) else c[:0].astype(np.int64) for c in columns]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the kinds seen once to four times; fixed ones where a kind is missing."""
    n1, n2, n3, n4 = n
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.0), k) for k, x in enumerate(d, 1))


@dataclass
class Level:
    """What is shared of the grams of an order above 2; sums has (total, n1, n2, n3) of each hot context."""

    order: int
    discounts: tuple[float, float, float]
    sums: np.ndarray


@dataclass
class Model:
    """Where the files are, and the few numbers that all of them share."""

    path: str
    buckets: int
    hots: dict[int, Hot]
    tokens: int
    kinds: int
    bigram_kinds: int
    d1: tuple[float, float, float]
    d2: tuple[float, float, float]
    ended: tuple[int, int, int]
    upper: tuple[Level, ...] = ()
    files: dict[str, np.ndarray] = field(default_factory=dict)

    def has(self, kind: str, bucket: int) -> bool:
        """Whether the bucket wrote a file of the kind."""
        return bool(self.files[kind][bucket >> 3] >> (bucket & 7) & 1) if kind in self.files else False

    def uniform(self) -> float:
        """What each word gets below the unigrams, unknown ones included."""
        if not self.bigram_kinds:
            return 1.0 / (self.kinds + 1)
        return sum(d * n for d, n in zip(self.d1, self.ended)) / self.bigram_kinds / (self.kinds + 1)


class Lookup:
    """Mapped files of a model; lives in a Python worker."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def _file(self, kind: str, k: int) -> np.ndarray | None:
        if not self.model.has(kind, k):
            return None
        if (kind, k) not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.clear()
            self.open[kind, k] = _map(f"{self.model.path}/{kind}-{k:06d}")
        return self.open[kind, k]

    def _find(self, kind: str, keys: np.ndarray, bucket: np.ndarray, fields: int) -> np.ndarray:
        """The fields of each key, zeros where it is unknown."""
        out = np.zeros((fields, len(keys)), np.int64)
        order = np.lexsort((keys, bucket))
        edges = np.concatenate(([0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(edges, edges[1:]):
            at = order[a:b]
            raw = self._file(kind, int(bucket[at[0]]))
            if raw is not None and kind == "words":
                self._whole(raw, keys, at, out)
            elif raw is not None:
                self._short(raw, keys, at, out)
        return out

    @staticmethod
    def _whole(raw: np.ndarray, keys: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        width = int(raw[:8].view(np.uint64)[0])
        n = (len(raw) - 8) // (8 + width * len(out))
        if not n:
            return
        known = raw[8 : 8 * n + 8].view(np.uint64)
        place = np.minimum(np.searchsorted(known, keys[at]), n - 1)
        hit = known[place] == keys[at]
        for f in range(len(out)):
            start = 8 + 8 * n + width * n * f
            column = raw[start : start + width * n].view(f"u{width}")
            out[f, at[hit]] = column[place[hit]]

    @staticmethod
    def _short(raw: np.ndarray, keys: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        once, more, width = raw[:24].view(np.int64).tolist()
        start = 24

        def part(n: int, kind: str) -> np.ndarray:
            nonlocal start
            size = n * int(kind[1:])
            start += size + -size % 8
            return raw[start - size - -size % 8 :][:size].view(kind)

        place = _place(part(once, "u4"), part(once, "u1"), keys[at])
        for f, x in enumerate(_ONCE[len(out)]):
            out[f, at[place >= 0]] = x
        place = _place(part(more, "u4"), part(more, "u1"), keys[at])
        hit = place >= 0
        for f in range(len(out)):
            out[f, at[hit]] = part(more, f"u{width}")[place[hit]]

    def words(self, w: np.ndarray) -> np.ndarray:
        return self._find("words", w, _word_bucket(w, self.model.buckets), len(_FIELDS))

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score."""
        m = self.model
        flat, bounds = tokens(texts)
        left = before(flat, bounds)
        distinct, back = np.unique(flat, return_inverse=True)
        own = self.words(distinct)
        base = np.log10((own[0] + 0.5) / (m.tokens + 0.5 * (m.kinds + 1)))
        lefts, left_back = np.unique(left, return_inverse=True)
        context = self.words(lefts)
        low = (own[1] - np.array([0.0, *m.d1])[np.minimum(own[1], 3)]) / max(1, m.bigram_kinds) + m.uniform()
        total = np.maximum(context[2], 1)
        gamma = np.where(context[2] > 0, (m.d2[0] * context[3] + m.d2[1] * context[4] + m.d2[2] * context[5]) / total, 1.0)
        h = pair(left, flat)
        bigrams, first, h_back = np.unique(h, return_index=True, return_inverse=True)
        seen = self._find("bigrams", bigrams, _route([left[first]], bigrams, m.hots, m.buckets), 1)[0]
        high = (seen - np.array([0.0, *m.d2])[np.minimum(seen, 3)]) / total[left_back[first]]
        p = (high + gamma[left_back[first]] * low[back[first]])[h_back]
        for level in m.upper:
            p = self._raised(level, flat, bounds, p)
        p = np.log10(p)
        starts = bounds[:-1]
        return {
            "n_tokens": np.diff(bounds), "n_known": np.add.reduceat((own[0] > 0).astype(np.int64)[back], starts), "base_score": np.add.reduceat(base[back], starts), "score": np.add.reduceat(p, starts),
        }


    def _raised(self, level: Level, flat: np.ndarray, bounds: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The probability of each token by the level's grams; that of the order below where it is too near the begin."""
        m = self.model
        words = contexts(flat, bounds, level.order)
        far = np.nonzero(words[1] != BEGIN)[0]
        words = [w[far] for w in words]
        left = folded(words)
        h, first, back = np.unique(pair(left, flat[far]), return_index=True, return_inverse=True)
        seen = self._find(f"grams{level.order}", h, _route([w[first] for w in words], h, m.hots, m.buckets), 1)[0][back]
        c, first, c_back = np.unique(left, return_index=True, return_inverse=True)
        known = self._find(f"contexts{level.order}", c, _route([w[first] for w in words], None, m.hots, m.buckets), 4)
        hot = m.hots[level.order][0]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, c), len(hot) - 1)
            known = np.where(hot[at] == c, level.sums[at].T, known)
        total, n1, n2, n3 = known[:, c_back]
        d = np.array([0.0, *level.discounts])
        p = low.copy()
        had = total > 0
        p[far] = np.where(had, (seen - d[np.minimum(seen, 3)] + (d[1] * n1 + d[2] * n2 + d[3] * n3) * low[far]) / np.maximum(total, 1), low[far])
        return p


def _hot(docs: DataFrame, text_col: str, share: float, order: int, buckets: int) -> Hot:
    """The words, or contexts of order - 1 words, that make more than ``share`` of a bounded sample's tokens: 1 / share at most."""
    some = docs.sample(min(1.0, SAMPLE_DOCS / max(1, docs.count())), seed=42)  # by row, so that copies count as often as they stand there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 0, SLICE):
                flat, bounds = tokens(part.column(0))
                w, n = np.unique(folded(contexts(flat, bounds, order)), return_counts=True)
                often = n > share * len(flat) / 4
                yield pa.RecordBatch.from_arrays([pa.array(w[often].view(np.int64)), pa.array(n[often]), pa.array([len(flat)] + [0] * (int(often.sum()) - 1), pa.int64()) if often.any() else pa.array([], pa.int64())], names=["w", "n", "all"])

    got = some.select(text_col).mapInArrow(tidied(run), "w bigint, n bigint, all bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).collect()
    tokens_seen = sum(r["all"] for r in got)
    often = sorted((r["w"] % (1 << 64), r["n"] / tokens_seen) for r in got if r["n"] > share * tokens_seen)
    return np.array([w for w, _ in often], np.uint64), np.array([max(1, math.ceil(2 * x * buckets)) for _, x in often], np.uint64)


def _bits(rows: DataFrame, buckets: int) -> np.ndarray:
    """A bit for each bucket that rows name: eight buckets a byte in the driver."""
    found = rows.groupBy(F.shiftright("bucket", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, bucket & 7)")).alias("bits")).toPandas()
    out = np.zeros(-(-buckets // 8), np.uint8)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    return out


def _summary(rows: DataFrame, level: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the kinds seen once to four times, and which buckets wrote a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x, np.int64) for b in batches for x in b.column(0).to_pylist()), np.zeros(4, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], names=[f"n{k}" for k in range(4)])

    got = rows.where(F.col("kind") == f"c{level}").select("pack").mapInArrow(tidied(run), "n0 bigint, n1 bigint, n2 bigint, n3 bigint").agg(*[F.sum(f"n{k}") for k in range(4)]).first()
    return np.array([x or 0 for x in got], np.int64), _bits(rows.where(F.col("kind") == f"f{level}").select("bucket"), buckets)


def _hot_sums(rows: DataFrame, hot: np.ndarray, level: int) -> np.ndarray:
    """(total, n1, n2, n3) of each hot context, added up over the buckets: a row a context in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(x, np.int64).reshape(5, -1)], names=["key", "n0", "n1", "n2", "n3"])

    out = np.zeros((len(hot), 4), np.int64)
    if len(hot):
        found = rows.where(F.col("kind") == f"h{level}").select("pack").mapInArrow(tidied(run), "key bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
        for r in found.groupBy("key").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]).collect():
            out[np.searchsorted(hot, np.array([r["key"]], np.int64).view(np.uint64))[0]] = r["n0"], r["n1"], r["n2"], r["n3"]
    return out


def fit(docs: DataFrame, text_col: str = "text", hot_share: float = HOT_SHARE, order: int = 2, passes: int = PASSES) -> Model:
    """The model of all texts of docs, with order - 1 words of context."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    path = scratch(spark, "ngram")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(4, -(-size // BUCKET_BYTES))
    files: dict[str, np.ndarray] = {}
    share = min(hot_share, max(1e-5, 0.5 / buckets))
    hots = {k: _hot(docs, text_col, share, k, buckets) for k in range(2, order + 1)}

    def count(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        """Packed counts by bucket: grams of the part, and in the first one words (w, n)."""
        for texts in gathered(batches, 0, SLICE):
            flat, bounds = tokens(texts.column(0))
            words = [*contexts(flat, bounds, order), flat]
            _, first, n = np.unique(folded(words), return_index=True, return_counts=True)
            rows = _by_bucket([w[first] for w in words], n, hots, buckets, part, passes)
            for i in range(0, len(rows), 64):
                kinds, at, packs = zip(*rows[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(at, pa.int32()), pa.array(packs, pa.binary())], names=["kind", "bucket", "pack"])
            del words, rows, first, n
            if part:
                continue
            w, c = np.unique(flat, return_counts=True)
            wb = _word_bucket(w, buckets)
            by = np.argsort(wb, kind="stable")
            wb, w, c = wb[by], w[by], c[by].astype(np.uint32)
            for kind, keys, columns in (("w", wb, (w, c)),):
                edges = np.concatenate(([0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]))
                for i in range(0, len(edges) - 1, 64):
                    spans = list(zip(edges[i : i + 64], edges[i + 1 : i + 65]))
                    packs = [b"".join(x[a:b].tobytes() for x in columns) for a, b in spans]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(spans)), pa.array([int(keys[a]) for a, _ in spans], pa.int32()), pa.array(packs, pa.binary())], names=["kind", "bucket", "pack"])

    schema = "kind string, bucket int, pack binary"
    parts = min(buckets, 20_000)

    def columns_of(packs: list[bytes], kinds: list[type]) -> list[np.ndarray]:
        width = sum(np.dtype(k).itemsize for k in kinds)
        out: list[list[np.ndarray]] = [[] for _ in kinds]
        for raw in packs:
            n, at = len(raw) // width, 0
            for c, k in zip(out, kinds):
                c.append(np.frombuffer(raw, k, n, at))
                at += n * np.dtype(k).itemsize
        return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds)]

    def merge_grams(level: int) -> Callable[[pa.Table], pa.Table]:
        """Writes a bucket's grams and contexts; passes on counts, the sums of hot contexts, and the grams one shorter."""

        def merge(table: pa.Table) -> pa.Table:
            of, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
            packs = table.column("pack").to_pylist()
            if of == "w":
                w, c = columns_of(packs, [np.uint64, np.uint32])
                w, (c,) = _sums(w, [c])
                rows = [("w", bucket, w.tobytes() + c.astype(np.uint32).tobytes())]
            else:
                h, words, n = _gathered(*_unpacked(packs, level))
                real = words[1] != BEGIN
                _put(f"{path}/grams{level}-{bucket:06d}", _short_filed(h[real], [n[real]]))
                context, m = folded(words[:-1])[real], n[real]
                context, sums = _sums(context, [m, m == 1, m == 2, m >= 3])
                spread = np.isin(context, hots[level][0])
                _put(f"{path}/contexts{level}-{bucket:06d}", _short_filed(context[~spread], [x[~spread] for x in sums]))
                rows = [(f"f{level}", bucket, b""), (f"c{level}", -1, np.array([(m == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes())]
                if spread.any():
                    rows.append((f"h{level}", -1, np.array([context[spread].view(np.int64), *[x[spread] for x in sums]], np.int64).tobytes()))
                _, words, n = _gathered(words[1:], np.where(real, 1, n))
                rows += _by_bucket(words, n, hots, buckets)
            return pa.table({"kind": [r[0] for r in rows], "bucket": pa.array([r[1] for r in rows], pa.int32()), "pack": pa.array([r[2] for r in rows], pa.binary())})

        return merge

    def merge_bigrams(table: pa.Table) -> pa.Table:
        """Writes a bucket's bigrams; passes on counts, and what it knows of first and last words, by their buckets."""
        of = table.column("kind")[0].as_py()
        bucket = table.column("bucket")[0].as_py()
        packs = table.column("pack").to_pylist()
        rows: list[tuple[str, int, bytes]] = []

        def sent(kind: str, w: np.ndarray, *fields: np.ndarray) -> None:
            wb = _word_bucket(w, buckets)
            order = np.argsort(wb, kind="stable")
            wb = wb[order]
            edges = np.concatenate(([0], np.nonzero(np.diff(wb))[0] + 1, [len(wb)])) if len(wb) else [0]
            for a, b in zip(edges, edges[1:]):
                at = order[a:b]
                rows.append((kind, int(wb[a]), b"".join([w[at].tobytes(), *[f[at].tobytes() for f in fields]])))

        if of == "w":
            w, c = columns_of(packs, [np.uint64, np.uint32])
            w, (c,) = _sums(w, [c])
            sent("w", w, c)
        else:
            h, (u, v), n = _gathered(*_unpacked(packs, 2))
            _put(f"{path}/bigrams-{bucket:06d}", _short_filed(h, [n]))
            rows.append(("f2", bucket, b""))
            rows.append(("c2", -1, np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()))
            begun, sums = _sums(u, [n, n == 1, n == 2, n >= 3])
            sent("first", begun, *sums)
            ended, (kinds,) = _sums(v, [np.ones(len(v), np.int64)])
            sent("last", ended, kinds.astype(np.uint32))
        return pa.table({"kind": [r[0] for r in rows], "bucket": pa.array([r[1] for r in rows], pa.int32()), "pack": pa.array([r[2] for r in rows], pa.binary())})

    def merge_words(table: pa.Table) -> pa.Table:
        """Writes what is known of a bucket's words (_FIELDS); passes on sums over them."""
        bucket, packs = table.column("bucket")[0].as_py(), {}
        for kind, pack in zip(table.column("kind").to_pylist(), table.column("pack").to_pylist()):
            packs.setdefault(kind, []).append(pack)
        w, count = columns_of(packs.get("w", []), [np.uint64, np.int64])
        first, *begun = columns_of(packs.get("first", []), [np.uint64, *[np.int64] * 4])
        last, kinds = columns_of(packs.get("last", []), [np.uint64, np.uint32])
        pad = [np.zeros(len(x), np.int64) for x in (w, last, first)]
        w, fields = _sums(
            np.concatenate([w, last, first]), [np.concatenate([count, pad[1], pad[2]]), np.concatenate([pad[0], kinds.astype(np.int64), pad[2]]), *[np.concatenate([pad[0], pad[1], x]) for x in begun]]
        )
        _put(f"{path}/words-{bucket:06d}", _filed(w, fields))
        predicted = w != BEGIN
        ends = fields[1][predicted]
        got = np.array([fields[0].sum(), (fields[0] > 0).sum(), ends.sum(), *[(ends == k).sum() for k in (1, 2, 3, 4)], (ends >= 3).sum()], np.int64)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "sums": pa.array([got.tolist()], pa.list_(pa.int64()))})

    def merged_by(rows: DataFrame, merge: Callable[[pa.Table], pa.Table], name: str) -> DataFrame:
        return written(rows.repartition(parts, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(merge, schema), name)

    upper, texts, merged = [], docs.select(text_col), None
    first = merge_grams(order) if order > 2 else merge_bigrams
    for part in range(passes):
        got = merged_by(texts.mapInArrow(tidied(partial(count, part=part)), schema), first, f"ngram-{order}")
        merged = merged.unionByName(got) if merged else got
    for level in range(order, 2, -1):
        counted = merged
        kinds, files[f"grams{level}"] = _summary(counted, level, buckets)
        files[f"contexts{level}"] = files[f"grams{level}"]
        upper.insert(0, Level(level, _discounts(kinds.tolist()), _hot_sums(counted, hots[level][0], level)))
        merged = merged_by(counted.where("kind in ('b', 'w')"), merge_grams(level - 1) if level > 3 else merge_bigrams, f"ngram-{level - 1}")
        dropped(counted)
    n, files["bigrams"] = _summary(merged, 2, buckets)
    words = written(merged.where("kind not in ('c2', 'f2')").repartition(parts, "bucket").groupBy("bucket").applyInArrow(merge_words, "bucket int, sums array<bigint>"), "ngram-sums")
    s = [x or 0 for x in words.agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(8)]).first()]
    files["words"] = _bits(words.select("bucket"), buckets)
    dropped(merged)
    return Model(path, int(buckets), hots, s[0], s[1], s[2], _discounts(s[3:7]), _discounts(n[:4].tolist()), (s[3], s[4], s[7]), tuple(upper), files)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_tokens, n_known, base_score, score) per row of docs.

    Tokens are runs without ASCII white space, A-Z in lower case, and one end.  score is the model's log10 probability,
    base_score that of add-a-half unigrams.  Null and blank texts have the end alone.  Without training text every
    probability is 1.  Repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for whole in batches:
            for part in slices(whole, 1, SCORED):
                got = lookup.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, got.values())], names=["id", *got])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
