"""Structured Streaming jobs: resumable staged loading, and continuous revision tracking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType


def staged_load(spark: SparkSession, source: str, schema: StructType, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Loads what is new below source into target once each: rows with the same keys are one, across restarts too.

    The checkpoint remembers files and keys; it runs until all that is there has been read.
    """
    rows = spark.readStream.schema(schema).parquet(source).dropDuplicates(keys)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def classify_changes(known: DataFrame | None, batch: DataFrame, key: str, hashed: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(changes, latest) after a batch: each row is inserted, updated or unchanged against the one before it by ``order``."""
    rows = batch.select(key, hashed, order, F.lit(True).alias("_new"))
    if known is not None:
        rows = rows.unionByName(known.select(key, hashed, order, F.lit(False).alias("_new")))
    before = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(hashed).over(before).isNull(), "inserted").when(F.lag(hashed).over(before) == F.col(hashed), "unchanged").otherwise("updated")
    marked = rows.withColumn("change", change)
    latest = rows.groupBy(key).agg(F.max_by(hashed, order).alias(hashed), F.max(order).alias(order))
    return marked.where("_new").select(key, order, "change"), latest


class LatestHash(StatefulProcessor):
    """Keeps the content hash of each key's last row, and says of every row what it changes."""

    def __init__(self, hashed: str, order: str, state: StructType, key_name: str):
        self.hashed, self.order, self.state, self.key_name = hashed, order, state, key_name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        batch = pd.concat(list(rows)).sort_values([self.order, self.hashed], kind="stable")
        before = batch[self.hashed].shift(1)
        known = pd.Series([False, *[True] * (len(batch) - 1)], index=batch.index)
        if self.last.exists():
            known.iloc[0], before.iloc[0] = True, self.last.get()[0]
        same = before.eq(batch[self.hashed]) | (before.isna() & batch[self.hashed].isna())
        change = ["inserted" if not k else "unchanged" if e else "updated" for k, e in zip(known, same)]
        self.last.update((batch[self.hashed].iloc[-1],))
        yield pd.DataFrame({self.key_name: [key[0]] * len(batch), self.order: batch[self.order].to_numpy(), "change": change})

    def close(self) -> None:
        pass


def track_revisions(spark: SparkSession, source: str, schema: StructType, key: str, hashed: str, order: str, path: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Appends the change class (key, order, change) of every row read below source to path/changes/rows.

    Rows of a batch are taken in their order against the key's last row of earlier batches: inserted, updated or unchanged.
    The last hash of each key is keyed state in the checkpoint, whose log takes the keys that a batch touches, not all that were
    ever seen; a restart goes on where the last committed batch ended.  A batch's rows of one key are held together in one task.
    """
    state, kind = StructType([schema[hashed]]), {f.name: f for f in schema}
    out = StructType([kind[key], kind[order], StructField("change", StringType())])
    reader = spark.readStream.schema(schema)
    rows = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(source)
    marked = rows.select(key, hashed, order).groupBy(key).transformWithStateInPandas(LatestHash(hashed, order, state, key), out, "Append", "None")
    stream = marked.writeStream.format("parquet").option("path", f"{path}/changes/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True)
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return stream.start()  # the query keeps the settings that it started with
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
