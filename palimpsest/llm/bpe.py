"""BPE encoding through a table of distinct words, and decoding through the id-to-piece table.

A text is split into units at places where the tokenizer always splits, whatever stands around: a unit's ids are the same
alone as in its text, so each distinct unit needs encoding only once and a text's ids are its units' ids in order.

* Byte-level tokenizers: a space before a letter or visible ASCII character (``<`` apart: it may open a special token).
* Tokenizers that drop white space: runs of ASCII white space.

``encode`` runs in three steps over the whole corpus, with no bound on the number of units:

1. Slices of documents (SLICE_BYTES of text) are split; a slice keeps its positions, each the number of a distinct unit, and
   hands its distinct units on in one pack per bucket, by a hash of the unit.
2. A bucket holds all packs with a unit, so each distinct unit of the corpus is encoded once, there.  It answers each pack
   with the ids of its units in the same order.  A slice names a unit once, so no bucket grows with a frequent unit.
3. Positions and answers meet by slice, and the ids are joined back by position.

Positions and packs leave the splitting in one exchange, which steps 2 and 3 both read.  A slice's name is its partition and
number, so a task that runs again gives the same ones; should its rows have come in another order, the answers' marks differ
and the job fails instead of mixing them up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import gathered, tidied

CACHE, SLICE_BYTES, BUCKET_BYTES = 200_000, 8 << 20, 12 << 20
_JOINED = 20_000
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = "\U0010fffe"  # never a character of a text; texts that hold it all the same are split one by one
_SPLIT = r" ([!-;=-~\p{L}])"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: visible ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(spec: dict) -> dict[int, str]:
    """Piece by id, special tokens included."""
    return {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def piece_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; ids without a piece have none."""
    alphabet, pieces = byte_alphabet(), vocabulary(spec)
    plain = {p: bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode() for p in pieces.values()}
    return [plain.get(pieces.get(i, ""), b"") for i in range(max(pieces) + 1)]


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def listed(words: pa.Array) -> list[str]:
    """The strings as a list, by way of numpy, which makes them many times faster."""
    return words.to_numpy(zero_copy_only=False).tolist()


class Units:
    """Encodes unit lists with the tokenizers library; lives in a Python worker, for all its tasks (``coder``).

    Words of ASCII letters are encoded many at a time by the vocabulary's own merges, split at spaces alone; other words of
    letters many at a time by the whole tokenizer; all else one by one.  A word begins, or ends, where its piece says so.
    The first CACHE words that it meets are remembered.
    """

    def __init__(self, spec_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(spec_json)
        self.tokenizer = Tokenizer.from_str(spec_json)
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        for t in (self.tokenizer, self.bare):
            t.no_truncation()
            t.no_padding()
        pieces, suffix = vocabulary(spec), spec["model"].get("end_of_word_suffix")
        size = max(pieces) + 1
        self.lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        if suffix:  # a word of letters ends with the only piece that has the suffix
            self.plain, self.ascii, self.last = f"[{_LATIN}]+", "[a-z]+" if self.lowers else "[A-Za-z]+", True
            self.edge = np.array([pieces.get(i, "").endswith(suffix) for i in range(size)])
        else:  # a space and letters begin with the only piece that has the space
            self.plain, self.ascii, self.last = f" [{_LATIN}]+", " [A-Za-z]+", False
            self.edge = np.array([pieces.get(i, "").startswith("Ġ") for i in range(size)])
        self.memory: dict[str, int] = {}
        self.known_flat, self.known_start, self.known_size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, words: pa.Array, remember: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some distinct words: those of word i are flat[start[i] : start[i] + size[i]]."""
        start, size, left = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        flats, filled = [self.known_flat], len(self.known_flat)
        if remember:
            at = np.fromiter(map(self.memory.get, listed(words), repeat(-1)), np.int64, len(words))
            hit = at >= 0
            start[hit], size[hit] = self.known_start[at[hit]], self.known_size[at[hit]]
            left = np.nonzero(~hit)[0]
        some = words.take(pa.array(left))
        is_ascii, is_plain = (pc.match_substring_regex(some, f"^{x}$").to_numpy(zero_copy_only=False) for x in (self.ascii, self.plain))
        for mask, many in ((is_ascii, self._bare), (is_plain & ~is_ascii, self._joined), (~(is_plain | is_ascii), None)):
            whole = left[mask]
            for k in range(0, len(whole), _JOINED):
                index = whole[k : k + _JOINED]
                texts = listed(words.take(pa.array(index)))
                ids, edges = many(texts) if many else (None, None)
                if ids is None or len(edges) != len(index):
                    found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                    ids, sizes = np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))
                else:
                    sizes = np.diff(np.concatenate(([-1], edges)) if self.last else np.concatenate((edges, [len(ids)])))
                start[index], size[index] = filled + np.cumsum(sizes) - sizes, sizes
                flats.append(ids)
                filled += len(ids)
        flat = np.concatenate(flats)
        room = CACHE - len(self.memory)
        if remember and room > 0 and len(left):
            fresh = left[:room]
            self.memory.update(zip(listed(words.take(pa.array(fresh))), range(len(self.memory), len(self.memory) + len(fresh))))
            own = size[fresh]
            self.known_start = np.concatenate([self.known_start, len(self.known_flat) + np.cumsum(own) - own])
            self.known_size = np.concatenate([self.known_size, own])
            self.known_flat = np.concatenate([self.known_flat, ragged(flat, start[fresh], own)])
        return flat, start, size

    def _edges(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        got = np.array(ids, "<u4")
        return got, np.nonzero(self.edge[got])[0]

    def _bare(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = " ".join(texts) if self.last else "".join(texts).replace(" ", " Ġ")
        return self._edges(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._edges(self.tokenizer.encode_batch_fast([(" " if self.last else "").join(texts)], add_special_tokens=False)[0].ids)

    def documents(self, units: pa.ListArray, remember: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the unit lists in order, and where each list's ids begin and end.

        A unit of letters and closing punctuation is its letters' ids and then the punctuation's; letters are looked up in
        lower case where the tokenizer lowers them anyway.
        """
        offsets = units.offsets.to_numpy().astype(np.int64)
        coded = units.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        distinct, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        found = pc.extract_regex(distinct, f"^(?P<w>{self.plain})(?P<p>[.,;:!?]*)$")
        stems, tails, parted = found.field("w"), found.field("p"), found.is_valid()
        if self.lowers:
            stems = pc.utf8_lower(stems)
        parts = [pc.if_else(parted, stems, distinct).dictionary_encode(), pc.if_else(parted, tails, "").dictionary_encode()]
        starts, sizes, flats, before = [], [], [], 0
        for p in parts:
            ids, start, n = self.words(p.dictionary, remember)
            of = p.indices.to_numpy(zero_copy_only=False)[index]
            starts.append(start[of] + before)
            sizes.append(n[of])
            flats.append(ids)
            before += len(ids)
        size = np.stack(sizes, axis=1).ravel()
        flat = ragged(np.concatenate(flats), np.stack(starts, axis=1).ravel(), size)
        ends = np.concatenate(([0], np.cumsum(size)))
        return flat, ends[2 * offsets]


_CODERS: dict[str, Units] = {}


def coder(spec: str) -> Units:
    """The worker's own Units of a tokenizer, made once."""
    if spec not in _CODERS:
        _CODERS.clear()
        _CODERS[spec] = Units(spec)
    return _CODERS[spec]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings take about ``most`` bytes at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes.astype(np.int64)) // most
    bounds = [0, *(np.nonzero(np.diff(run))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def byte_units(texts: pa.Array) -> pa.ListArray:
    """The units of texts for byte-level tokenizers; null is empty."""
    texts = pc.fill_null(texts, "")
    marked = pc.match_substring(texts, _MARK)
    if pc.any(marked).as_py():
        import regex

        cut = regex.compile(f"(?={_SPLIT.replace('(', '').replace(')', '')})")
        return pa.array([cut.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.split_pattern(pc.replace_substring_regex(texts, _SPLIT, _MARK + r" \1"), _MARK)


def space_units(texts: pa.Array) -> pa.ListArray:
    """The units of texts for tokenizers that drop white space; null is empty."""
    return pc.ascii_split_whitespace(pc.fill_null(texts, ""))


def read_spec(path: str) -> str:
    """A tokenizer's JSON from the given path, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """The words' sizes in bytes and their bytes."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return np.diff(bounds), data[int(bounds[0]) : int(bounds[-1])].to_pybytes() if data is not None else b""


def _strings(sizes: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(data)])


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max))


def pack(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    """Arrays of whole numbers at their least width, or bytes, compressed in one piece."""
    parts = [x if isinstance(x, bytes) else _narrow(x) for x in arrays]
    head = np.array([y for x in parts for y in ((0, len(x)) if isinstance(x, bytes) else (x.itemsize, len(x)))], "<i8")
    data = head.tobytes() + b"".join(x if isinstance(x, bytes) else np.frombuffer(x.tobytes(), np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in parts)
    return np.int64(len(data)).tobytes() + np.int64(len(parts)).tobytes() + pa.Codec("zstd", level).compress(data, asbytes=True)


def unpack(raw: bytes) -> list[np.ndarray | bytes]:
    size, n = np.frombuffer(raw, "<i8", 2).tolist()
    data = pa.decompress(raw[16:], size, "zstd", asbytes=True)
    out, at = [], 16 * n
    for width, count in np.frombuffer(data, "<i8", 2 * n).reshape(n, 2).tolist():
        if width:
            planes = np.frombuffer(data, np.uint8, width * count, at).reshape(width, count)
            out.append(np.frombuffer(planes.T.tobytes(), f"<u{width}"))
        else:
            out.append(data[at : at + count])
        at += max(width, 1) * count
    return out


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with ids, an array of the tokenizer's ids of the text as its library gives them without added tokens.

    For byte-level tokenizers (JSON at ``path``).  Null and empty texts have an empty array; strings of special tokens inside
    a text are those tokens, as in the library.  A column of docs named like ids_col is replaced; all other columns, or
    those named by ``keep``, and repeated rows stay.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    rest = [c for c in (docs.columns if keep is None else keep) if c != ids_col]
    kept = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(rest)])
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = max(4, -(-size // bucket_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each slice its positions, bucket -1 with the documents' other columns, and a pack of units per bucket."""
        task = TaskContext.get().partitionId()
        for number, part in enumerate(gathered(batches, len(rest), slice_bytes)):
            units = byte_units(part.column(len(rest)))
            offsets = units.offsets.to_numpy().astype(np.int64)
            coded = units.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            words = coded.dictionary
            digest = xxhash.xxh3_64_intdigest
            bucket = np.array([digest(w) for w in listed(words)], np.uint64) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.concatenate(([0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
            ordered = words.take(pa.array(order))
            asked = [(int(bucket[order[a]]), pack(*_bytes_of(ordered.slice(a, b - a))), part.slice(0, 0)) for a, b in zip(edges.tolist(), edges[1:].tolist())]
            index = coded.indices.to_numpy(zero_copy_only=False)
            by_count = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[by_count] = np.arange(len(words))
            rows = [(-1, pack(rank[index], np.diff(offsets), rank[order], np.array([digest(p) for _, p, _ in asked], np.uint64), level=9), part), *asked]
            name = f"{task}-{number}"
            for i in range(0, len(rows), 256):
                at, packs, others = zip(*rows[i : i + 256])
                values = pa.StructArray.from_arrays([pa.chunked_array([o.column(k) for o in others]).combine_chunks() for k in range(len(rest))], fields=list(inner)) if rest else pa.array([{}] * sum(o.num_rows for o in others), pa.struct([]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([o.num_rows for o in others]))), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([name if b < 0 else f"{b}" for b in at]), pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(packs, pa.binary()), lists], names=["key", "slice", "bucket", "pack", "rows"])

    from pyspark.sql.pandas.types import to_arrow_schema

    inner = to_arrow_schema(kept)
    sliced = T.StructType([*[T.StructField(n, T.StringType()) for n in ("key", "slice")], T.StructField("bucket", T.LongType()), T.StructField("pack", T.BinaryType()), T.StructField("rows", T.ArrayType(kept))])

    def answer(table: pa.Table) -> pa.Table:
        """The ids of a bucket's distinct units, each encoded once, for each pack of them."""
        if table.column("bucket")[0].as_py() < 0:
            return answers.empty_table()
        asked = table.column("pack").to_pylist()
        many = [_strings(*unpack(p)) for p in asked]
        coded = pa.chunked_array(many).combine_chunks().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat, ends = coder(spec.value).documents(pa.ListArray.from_arrays(pa.array(np.arange(len(coded.dictionary) + 1, dtype=np.int32)), coded.dictionary), remember=False)
        sizes, packs, at = np.diff(ends), [], 0
        for m in many:
            own = index[at : at + len(m)]
            at += len(m)
            packs.append(pack(sizes[own], ragged(flat, ends[own], sizes[own])))
        marks = pa.array(np.array([xxhash.xxh3_64_intdigest(p) for p in asked], np.uint64).view(np.int64))
        return pa.table({"key": table.column("slice"), "bucket": table.column("bucket"), "pack": pa.array(packs, pa.binary()), "mark": marks})

    answers = pa.schema([("key", pa.string()), ("bucket", pa.int64()), ("pack", pa.binary()), ("mark", pa.int64())])

    def join(held: pa.Table, found: pa.Table) -> pa.Table:
        """The documents of a slice with their ids."""
        if not held.num_rows or held.column("bucket")[0].as_py() >= 0:
            return pa.schema([*inner, ("ids", pa.list_(pa.int32()))]).empty_table()
        index, lengths, order, marks = unpack(held.column("pack")[0].as_py())
        found = found.sort_by("bucket")
        if held.num_rows > 1 or found.column("mark").to_pylist() != marks.view(np.int64).tolist():
            raise ValueError("a slice of documents was split again in another order")
        found = [unpack(p) for p in found.column("pack").to_pylist()]
        size, start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        size[order] = np.concatenate([np.zeros(0, np.int64), *[s.astype(np.int64) for s, _ in found]])
        start[order] = np.cumsum(size[order]) - size[order]
        flat = np.concatenate([np.zeros(0, np.int32), *[i.astype(np.int32) for _, i in found]])
        ids = ragged(flat, start[index], size[index])
        ends = np.concatenate(([0], np.cumsum(size[index])))[np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))]
        values = held.column("rows")[0].values if len(rest) else None
        whole = values.flatten() if values is not None else []
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        return pa.table([*whole, lists], names=[*inner.names, "ids"])

    parts = min(max(buckets, -(-size // slice_bytes)), 20_000)
    split = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`")).toDF(*inner.names, "t").mapInArrow(tidied(cut), sliced).repartition(parts, "key")
    answered = split.groupBy("key").applyInArrow(answer, "key string, bucket bigint, pack binary, mark bigint").repartition(parts, "key")
    out = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return split.groupBy("key").cogroup(answered.groupBy("key")).applyInArrow(join, out).toDF(*rest, ids_col)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """coded with the text of its ids, joined to their pieces by id; bytes that are not UTF-8 become U+FFFD.

    Null ids give null, ids outside the vocabulary nothing.  A column named like text_col is replaced.
    """
    pieces = coded.sparkSession.sparkContext.broadcast(piece_bytes(json.loads(read_spec(path))))
    rest = [c for c in coded.columns if c != text_col]
    at = rest.index(ids_col)
    out = T.StructType([*[coded.schema[c] for c in rest], T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([*pieces.value, b""], pa.binary())
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                part = whole.slice(first, 1000)
                lists = part.column(at)
                bounds = lists.offsets.to_numpy()
                ids = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False)
                ids = np.where((ids >= 0) & (ids < len(table) - 1), ids, len(table) - 1).astype(np.int64)
                joined = table.take(pa.array(ids))
                data = joined.buffers()[2] if len(joined) else None
                ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1) if len(joined) else np.zeros(1, np.int32)
                raw = memoryview(data) if data is not None else memoryview(b"")
                cut = ends[bounds - bounds[0]]
                valid = lists.is_valid().to_pylist()
                texts = [bytes(raw[a:b]).decode("utf-8", "replace") if ok else None for a, b, ok in zip(cut.tolist(), cut[1:].tolist(), valid)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*rest, text_col])

    return coded.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(tidied(run), out)
