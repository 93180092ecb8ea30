"""What the training-data operators share: scratch tables, components, SQL fragments.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, the one folder that a cluster shares
between driver and executors.  A written table cuts the lineage and survives the loss of any executor.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; a temporary one is set only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def setting(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots written as double underscores) for the jobs started inside the block."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, to: str | None = None, by: str | None = None) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder; shuffle files of the write go when it ends.

    With ``by``, a folder for each value of that column.
    """
    spark = df.sparkSession
    path = to or scratch(spark, name)
    with setting(spark, **{_CLEANUP.replace(".", "__"): "true"}):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch files that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def release() -> None:
    """Gives back to the system what this Python worker has freed; workers live on, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose strings of a column take about ``most`` bytes; a longer text stands alone."""
    held, size = [], 0
    for whole in batches:
        bytes_of = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(bytes_of):
            n = int(np.searchsorted(np.cumsum(bytes_of[at:]), most - size, side="right"))
            n = max(n, 0 if held else 1)
            if n:
                held.append(whole.slice(at, n))
                size += int(bytes_of[at : at + n].sum())
                at += n
            if at < len(bytes_of):
                yield _one(held)
                held, size = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def tidied(run: Callable) -> Callable:
    """A function of Arrow batches that gives its memory back when it ends.

    It also sets the session to hand over batches of BATCH_BYTES at most: by default a batch is 10,000 rows however long
    their texts are, and is held in the executor and in the Python worker alike.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def crc_mod(column: str, by: int) -> F.Column:
    """crc32 of the id written as text, modulo by: the fold of a document."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(by).cast("bigint"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the edges (a, b): one row (node, root) for each node that has an edge.

    Large-star and small-star steps alternate until the edge set is a forest of stars (Kiveris et al. 2014).  Each
    round is written to the shared folder, so neither lineage nor driver memory grows, and only two sums of it reach the
    driver.  Hot centres are safe: minima are pre-aggregated and the join that follows is one that AQE may split.
    """
    now = written(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        tied = down.join(least, "a")
        small = tied.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.where(F.col("a") != F.col("b")).distinct(), "small")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
