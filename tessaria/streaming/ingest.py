"""Streaming ingest check and first-seen filter (STR)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import dedup as D
from ..operators import similarity as S
from ..sources.shared import small_batches

_DOCS = "doc_id long, hash string, body string, n int, sketch binary, batch long"
_BUCKETS = "band int, bucket long, doc_id long, n int, batch long"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _sizes(threshold: float) -> Column:
    """Whether sets of n and m grams can have this Jaccard similarity."""
    least = threshold * (1 - S.SLACK)
    return (F.col("n") * least <= F.col("m")) & (F.col("m") * least <= F.col("n"))


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, other, similarity): the smallest `other` whose grams overlap enough. Sketches leave out what can't, so few pairs carry texts."""
    side = lambda x, y, *c: docs.select(F.col("doc_id").alias(x), *(F.col(k).alias(f"{k}_{y}") for k in c))
    both = pairs.join(side("doc_id", "x", "n", "sketch"), "doc_id").join(side("other", "y", "n", "sketch"), "other")
    both = both.filter(S.may_reach(F.col("sketch_x"), F.col("n_x"), F.col("sketch_y"), F.col("n_y"), threshold)).select("doc_id", "other")
    both = both.join(side("doc_id", "x", "body"), "doc_id").join(side("other", "y", "body"), "other")
    both = both.select("doc_id", "other", S.text_jaccard("body_x", "body_y").alias("similarity")).filter(F.col("similarity") >= threshold)
    return both.groupBy("doc_id").agg(F.min(F.struct("other", "similarity")).alias("best")).select("doc_id", "best.*")


def check_batch(now: DataFrame, docs: DataFrame, buckets: DataFrame, threshold: float) -> DataFrame:
    """STR-1: (doc_id, hash, duplicate_of, similarity) of the documents of a batch.

    now and docs are (doc_id, hash, body, n, sketch), docs with all documents up to this batch, this one's included; buckets is
    (band, bucket, doc_id, n) of the first document of each text. duplicate_of is the smallest earlier document with the
    same text. Where there is none, it is the smallest similar one among the first documents of its buckets, which
    settles crowds of near copies without listing their pairs; only where none of these is similar, all documents of
    its buckets are compared. Documents are earlier by their id, so neither batches nor their order within change a row.
    """
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first"))
    exact = now.join(first, "hash").select("doc_id", "hash", F.when(F.col("first") < F.col("doc_id"), F.col("first")).alias("copy_of"))
    open_ = exact.filter("copy_of is null").select("doc_id")
    own = buckets.join(open_, "doc_id", "left_semi")
    sized = _sizes(threshold)
    lead = buckets.groupBy("band", "bucket").agg(F.min(F.struct("doc_id", "n")).alias("x")).select("band", "bucket", F.col("x.doc_id").alias("other"), F.col("x.n").alias("m"))
    near = _verified(own.join(lead, ["band", "bucket"]).filter(sized & (F.col("other") < F.col("doc_id"))).select("doc_id", "other").distinct(), docs, threshold)
    rest = own.join(near.select("doc_id"), "doc_id", "left_anti")
    # Steps of size within the key, and the two beside each, so that a bucket meets only what its size allows.
    step = F.floor(F.log(F.col("n").cast("double")) / max(-math.log(max(threshold, 1e-9) * (1 - S.SLACK)), 1e-6)).cast("long")
    others = buckets.select("band", "bucket", F.col("doc_id").alias("other"), F.col("n").alias("m"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    pairs = rest.withColumn("step", step).join(others, ["band", "bucket", "step"]).filter(sized & (F.col("other") < F.col("doc_id"))).select("doc_id", "other").distinct()
    near = near.unionByName(_verified(pairs, docs, threshold))
    return exact.join(near, "doc_id", "left").select("doc_id", "hash", F.coalesce("copy_of", "other").alias("duplicate_of"), F.when(F.col("copy_of").isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"))


def ingest(stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.9) -> StreamingQuery:
    """STR-1: starts a query that checks the documents (doc_id, text) of every micro-batch against all before them and appends what it decides to
    path/decisions; path/docs and path/buckets are the index. Tables are written by batch, so a batch that is run again after a failure replaces
    itself. Every batch reads the index by columns, so batches should be large; an id comes once."""

    def table(spark: SparkSession, name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        # A batch of Arrow rows holds texts, and a worker a batch at a time; the session is the query's own.
        small_batches(spark)
        p = D.profiles(batch).select("doc_id", F.col("text_hash").alias("hash"), "body", S.sized_sketch(F.col("body")).alias("x"))
        write(p.select("doc_id", "hash", "body", "x.n", "x.sketch"), "docs")
        docs = table(spark, "docs", _DOCS).filter(F.col("batch") <= number)
        now = docs.filter(F.col("batch") == number)
        firsts = docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).join(now.select("doc_id", "body", "n"), "doc_id")
        write(firsts.select("doc_id", "n", F.explode(S.buckets(S.minima(S.gram_ids(F.col("body"))))).alias("x")).select("x.band", "x.bucket", "doc_id", "n"), "buckets")
        buckets = table(spark, "buckets", _BUCKETS).filter(F.col("batch") <= number).drop("batch")
        write(check_batch(now.drop("batch"), docs.drop("batch"), buckets, threshold), "decisions")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _FirstSeen(StatefulProcessor):
    """Of each key, the time of the row that passed last; a timer clears it when the watermark has passed its lifetime."""

    def __init__(self, lifetime: int) -> None:
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.passed = handle, handle.getValueState("passed", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = pd.concat(list(rows)).sort_values("tessaria_at", kind="stable")
        at = rows["tessaria_at"].to_numpy(np.int64)
        before = self.passed.get()[0] if self.passed.exists() else None
        kept, k = [], 0 if before is None else int(np.searchsorted(at, before + self.lifetime))
        while k < len(at):
            kept.append(k)
            k = int(np.searchsorted(at, at[k] + self.lifetime))
        if kept:
            if before is not None:
                self.handle.deleteTimer(_ends(before, self.lifetime))
            self.passed.update((int(at[kept[-1]]),))
            self.handle.registerTimer(_ends(int(at[kept[-1]]), self.lifetime))
        yield rows.iloc[kept].drop(columns="tessaria_at")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.passed.clear()
        return iter([])

    def close(self) -> None:
        pass


def _ends(at: int, lifetime: int) -> int:
    """When a row's lifetime has ended, in milliseconds, rounded up."""
    return -(-(at + lifetime) // 1000)


def first_seen(stream: DataFrame, keys: list[str], time: str, lifetime_seconds: int, late: str = "1 day") -> DataFrame:
    """STR-2: the rows whose key has not passed within the lifetime before them; a row seen again after that passes and starts a new one.

    Rows of a key are taken in order of time within a micro-batch, batches as they come; a row that comes late within
    its key's lifetime, or before the row that passed, doesn't pass. Rows without a time, or later than `late` behind
    the stream, are dropped. One key's rows of one micro-batch are held in memory: bound a batch by the source's rate.
    Restarting from the checkpoint goes on with the stored state.
    """
    at = stream.filter(F.col(time).isNotNull()).withWatermark(time, late).withColumn("tessaria_at", F.unix_micros(F.col(time).cast("timestamp")))
    return at.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_FirstSeen(lifetime_seconds * 1_000_000), outputStructType=stream.schema, outputMode="Append", timeMode="eventTime")


def start_with_state(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends stateful rows to a table until all that is there has been read. Its state lies in RocksDB; the session's own setting is put back."""
    conf, (name, value) = rows.sparkSession.conf, _PROVIDER
    own = conf.get(name, None)
    conf.set(name, value)
    try:
        return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(name) if own is None else conf.set(name, own)


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the parquet files that arrive under path (a folder, or a pattern that names files or folders)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
