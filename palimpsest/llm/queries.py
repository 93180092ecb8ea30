"""The registered queries of the training-data operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe as _bpe
from palimpsest.llm import decontamination as _decontamination
from palimpsest.llm import divergence as _divergence
from palimpsest.llm import language as _language
from palimpsest.llm import lzfingerprint as _lzfingerprint
from palimpsest.llm import ngram as _ngram
from palimpsest.llm import quality as _quality
from palimpsest.llm import simhash as _simhash
from palimpsest.llm import suffixdedup as _suffixdedup
from palimpsest.llm import tokenstore as _tokenstore
from palimpsest.llm import toxicity as _toxicity
from palimpsest.llm import warc as _warc
from palimpsest.llm import whitening as _whitening
from palimpsest.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _warc.deduplicate(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = _toxicity.fit(docs, _table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1))
    return _toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_lzfingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lzfingerprint.edited_fingerprints(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    told = _language.predict(docs, _language.fit(docs.where("not held_out")))
    return told.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _suffixdedup.cut(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokenstore.store_and_read(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    coded = _bpe.encode(_table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    return _bpe.decode(coded, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op10_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 5) == 1).alias("held_out"))
    model = _ngram.fit(docs.where("not held_out").select("text"), order=3)
    scored = _ngram.score(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"), (crc_mod("id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = _quality.fit(docs, _table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    return _quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return _whitening.whiten(rows, _whitening.fit(rows, components=4)).withColumnRenamed("id", "vec_id")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence.audit(_table(spark, sf_dir, "documents"), least_docs=30, smooth=5, top=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_lzfingerprint": op4_lzfingerprint,
    "op5_simhash": op5_simhash,
    "op6_suffixdedup": op6_suffixdedup,
    "op7_tokens": op7_tokens,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_ngram": op10_ngram,
    "op11_quality": op11_quality,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D!-/:-@\[-`{{-~]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_decontamination"] = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
item_shingles AS (
  SELECT DISTINCT item_id, len(s) AS k, array_to_string(s, ' ') AS shingle FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: list_slice(w, i, i + 4))) AS s FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM item_shingles),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(s, ' ') AS shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS s FROM doc_words, ks WHERE len(w) >= k)),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9)
"""

_HEX5 = "list_transform(range(0, 8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::BIGINT)"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUAD = " || ".join(f"substr('{_B32}', 1 + ((v >> {s}) & 31)::BIGINT, 1)" for s in (15, 10, 5, 0))
ORACLE_SQL["op2_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform({_HEX5}, lambda v: {_QUAD}), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM d
"""

_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * v::HUGEINT)"
ORACLE_SQL["op13_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest({_TERMS}) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM t GROUP BY lang, term HAVING count(*) >= 30),
c AS (SELECT lang, source, term, sum(n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
g AS (SELECT lang, source, v, lang_total, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, ({_SHARE.format('coalesce(n, 0)', 'total')})::BIGINT AS p, ({_SHARE.format('lang_n', 'lang_total')})::BIGINT AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y USING (lang, term) GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 50
"""
