"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  ``run``
writes what a stage returns as Parquet into the shared folder and gives it to the next.  Rows with null or repeated ids,
null and empty texts and empty tables pass as each stage's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontamination, language, simhash, suffixdedup
from palimpsest.llm.common import crc_mod, written
from palimpsest.llm.queries import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
#: The posterior share that a document's language must have.
LEAST = 0.5
#: Whether SQL can say what run() returns: language identification, and all that follows it, it can't.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told, with ``lang`` as the text says.

    Those without a letter, null texts included, go, and those whose language has less than LEAST of the posterior: their words
    speak for several languages alike.  ``lang`` is the predicted language, whatever stood there.  The model learns from the
    documents' own labels, but for the fifth that is held out in op8; without any label no document is rejected but those
    without a letter, and ``lang`` stays.
    """
    model = language.fit(docs.where(crc_mod("doc_id", 5) != 0))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST))
    return told.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard 0.8 or more of five-word shingles: the one with the smallest id.

    Bands of minima say who is compared by SimHash, within 24 bits, and the exact similarity decides; README has the share of pairs
    at 0.8 that this finds.  Documents that share an id count as one, and rows without an id stay.
    """
    groups = simhash.similar_documents(docs, radius=24, shingle_words=5, similarity=0.8)
    gone = groups.groupBy("id").agg(F.max(F.col("component") == F.col("id")).alias("stays")).where("id is not null and not stays")
    return docs.join(gone.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that an earlier passage of 100 bytes covers.

    A character goes whole where a cut goes through it; what else stands in a text stays as it is.
    """
    cut = suffixdedup.cut(docs, whole_characters=True)
    text = cut.withColumn("text", F.when(F.col("text").isNotNull(), F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))))
    return text.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item at 0.8 of its five-word shingles."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_contaminated(docs, items).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids, and round_trip: whether the ids decode to the text (null: empty)."""
    path = tokenizer_path(TOKENIZER)
    marked = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    coded = written(bpe.encode(marked, path, keep=["doc_id", "lang", "source", "n_chars", "_hash"]), "ids")
    both = bpe.decode(coded, path)
    return both.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.xxhash64("decoded") == F.col("_hash")).alias("round_trip"))


STAGES = [
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
