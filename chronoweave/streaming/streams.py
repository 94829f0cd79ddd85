"""Structured Streaming forms of the batch rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_dir
from ..operators.temporal import BUCKET_DAYS
from ..sources.rules import accepted, rejected, validated

LATE = "1 hour"
#: Fixed value: the reason for a repeated id.
REPEATED = "Duplicate transaction id"
#: State beyond an executor's memory.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, path: str, mode: str = "append", conf: Mapping[str, str] | None = None) -> None:
    """Process all that is there and stop; progress is kept beside the output, so a restart goes on where it stopped.

    ``conf`` holds for the query's start, which fixes it; the session has its own values back afterwards.
    """
    held = stream.sparkSession.conf
    former = {k: held.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        held.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").outputMode(mode).trigger(availableNow=True).start()
    finally:
        for k, v in former.items():
            held.unset(k) if v is None else held.set(k, v)
    query.awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], path: str, mode: str = "append") -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}-progress").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def validated_ingest(raw: DataFrame, mapping: Mapping[str, str], path: str) -> None:
    """Rows of a stream to ``path/accepted`` and ``path/rejected``, by the same rules as the batch import, repeated ids included.

    Each micro-batch is written under its own number, so one that is repeated after a failure replaces itself. Its ids go to
    ``path/ids`` under that number, in ranges; an id that a batch of a lower number has (accepted there or not) is a repeat. A batch reads of
    that index only what lies between its own least and greatest id, and only the id, and once. A batch's rows are dealt over
    all cores first, as its files may be few and large.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = validated(rows.repartition(spark.sparkContext.defaultParallelism), mapping).persist()
        ids = rows.select("id").filter("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
        ids.write.mode("overwrite").parquet(f"{path}/ids/batch={batch}")
        ends = spark.read.schema("id string").parquet(f"{path}/ids/batch={batch}").agg(F.min("id"), F.max("id")).first()
        before = spark.read.schema("id string, batch long").parquet(f"{path}/ids").filter((F.col("batch") < batch) & F.col("id").between(*ends))
        known = before.select("id").distinct().withColumn("__known", F.lit(True))
        why = F.when(F.col("__known") & ~F.array_contains("reasons", REPEATED), F.array_append("reasons", F.lit(REPEATED))).otherwise(F.col("reasons"))
        judged = rows.join(known, "id", "left").withColumn("reasons", why).select(rows.columns).persist()
        accepted(judged).write.mode("overwrite").parquet(f"{path}/accepted/batch={batch}")
        rejected(judged).write.mode("overwrite").parquet(f"{path}/rejected/batch={batch}")
        judged.unpersist()
        rows.unpersist()

    run_batches(raw, write, path)


def once(rows: DataFrame, key: str, at: str, late: str = LATE) -> DataFrame:
    """Rows without repeats of a key within the watermark (bounded memory, so weaker than the batch rule)."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def revisions_append(revisions: DataFrame, path: str) -> None:
    """Late evidence is data: rows are appended as they come and become visible by their recorded time, read by the batch as-of."""
    run_to_end(revisions.withColumn("bucket", F.floor(F.unix_timestamp(F.col("valid_start").cast("timestamp")) / (BUCKET_DAYS * 86400))), path)


def windowed_indicators(rows: DataFrame, account: str, other: str, amount: str, at: str, size: str = "3 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    """Per account and sliding window: rows, sum, distinct counterparties (approximate, as streams allow), round amounts."""
    w = F.window(at, size, slide)
    grouped = rows.withWatermark(at, late).groupBy(w, F.col(account).alias("account"))
    out = grouped.agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.approx_count_distinct(other).alias("others"), F.count_if((F.col(amount) > 0) & (F.col(amount) % 50 == 0)).alias("round_rows"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "account", "n", "total", "others", "round_rows")


def consumed_once(rows: DataFrame, key: str, at: str, expires_at: str, id_col: str, late: str = LATE) -> DataFrame:
    """``key, id, fresh`` of each row of a stream: whether it consumes its key.

    A row whose own expiry is not after its time is refused; so is one whose key a former row holds, which it does until
    that row's expiry. Rows of a key are judged by time, then id; the micro-batches must come in time order, but for ``late``, beyond which rows are
    dropped, as are rows without key, time, expiry or id. A key's state is one number, which a timer at its expiry
    removes, so the state holds the keys in force and no others. To be run with ``run_to_end(..., conf=ROCKSDB)``.
    """

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        every = pd.concat(parts).sort_values(["at_us", "id"], kind="stable")
        fresh = []
        for now, until in zip(every["at_us"].tolist(), every["until_us"].tolist(), strict=True):
            ok = until > now and (held is None or held <= now)
            held = until if ok else held
            fresh.append(ok)
        if held is not None:
            if (ends := -(-held // 1000)) > state.getCurrentWatermarkMs():
                state.update((held,))
                state.setTimeoutTimestamp(ends)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"key": key[0], "id": every["id"], "fresh": fresh})

    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keyed = rows.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(at).cast("timestamp").alias("at"), us(at).alias("at_us"), us(expires_at).alias("until_us")).dropna()
    return keyed.withWatermark("at", late).groupBy("key").applyInPandasWithState(judge, "key string, id long, fresh boolean", "held long", "append", "EventTimeTimeout")


def output_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
