"""Streaming queries: a table read as a stream to its end, and what it left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as s
from .registry import query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return s.file_stream(spark, sf, "events").withColumns({"at": F.col("ts").cast("timestamp"), "other": F.get_json_object("props", "$.k")})


@query(
    "select cast(event_id as varchar) as id, case when event_id % 7 = 0 then 'Invalid timestamp or missing explicit timezone' else '' end || case when event_id % 7 = 0 and event_id % 3 = 0 then ',' else '' end || case when event_id % 3 = 0 then 'Unsupported currency: XYZ' else '' end as reasons from events"
)
def s1_validated_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted and rejected rows of a stream, with the batch rules' reasons."""
    raw = s.file_stream(spark, sf, "events").select(
        F.col("event_id").alias("row_no"),
        F.concat(F.lit("id"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_id") % 7 == 0, "soon").otherwise("2024-01-01T00:00:00Z").alias("at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("origin"),
        F.lit("shop-1").alias("destination"),
        F.lit("10").alias("amount"),
        F.when(F.col("event_id") % 3 == 0, "xyz").otherwise("usd").alias("currency"),
        F.col("event_type").alias("type"),
    )
    path = s.output_path(spark, "ingest")
    s.validated_ingest(raw, {k: k for k in ("id", "at", "origin", "destination", "amount", "currency", "type")}, path)
    both = spark.read.parquet(f"{path}/accepted").unionByName(spark.read.parquet(f"{path}/rejected"))
    return both.select(F.substring("id", 3, 20).alias("id"), F.array_join("reasons", ",").alias("reasons"))


@query(
    "select event_id, '' as reasons from events where event_id % 4 <> 0 union all select event_id, case when event_id % 4 <> 0 then 'Duplicate transaction id' else '' end from events"
)
def s1_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Events that come again in later micro-batches are rejected by the stored index of ids."""
    folder, path = s.output_path(spark, "sent"), s.output_path(spark, "ingest")
    sent = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("row_no"),
        F.concat(F.lit("id"), F.col("event_id").cast("string")).alias("id"),
        F.lit("2024-01-01T00:00:00Z").alias("at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("origin"),
        F.lit("shop-1").alias("destination"),
        F.lit("10").alias("amount"),
        F.lit("usd").alias("currency"),
        F.col("event_type").alias("type"),
    )
    sent.filter("row_no % 4 <> 0").write.parquet(folder)
    sent.write.mode("append").parquet(folder)
    raw = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    s.validated_ingest(raw, {k: k for k in ("id", "at", "origin", "destination", "amount", "currency", "type")}, path)
    both = spark.read.parquet(f"{path}/accepted").unionByName(spark.read.parquet(f"{path}/rejected"))
    return both.select(F.substring("id", 3, 20).cast("long").alias("event_id"), F.array_join("reasons", ",").alias("reasons"))


@query("select cast(event_id as varchar) as event_id from events")
def s2_deduplicated_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each event sent twice leaves one."""
    path = s.output_path(spark, "once")
    twice = _events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    s.run_to_end(s.once(twice, "event_id", "at").select(F.col("event_id").cast("string").alias("event_id")), path)
    return spark.read.parquet(path)


@query("select event_id from events where ts <= timestamp '2024-01-02 00:00:00'")
def s3_late_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Appended as it came; what is known at an instant is a batch read."""
    path = s.output_path(spark, "late")
    s.revisions_append(_events(spark, sf).select("event_id", F.col("ts").alias("valid_start"), F.col("ts").alias("recorded_start")), path)
    return spark.read.parquet(path).filter(F.col("recorded_start") <= F.lit("2024-01-02").cast("timestamp_ntz")).select("event_id")


@query(
    "select w as window_start, user_id as account, count(*) as n, round(sum(value), 4) as total from (select *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour, date_trunc('hour', ts) - interval 2 hour]) as w from events) x group by 1, 2 having w + interval 3 hour <= (select max(ts) - interval 1 hour from events)"
)
def s4_windowed_indicators(spark: SparkSession, sf: str) -> DataFrame:
    path = s.output_path(spark, "windows")
    s.run_to_end(s.windowed_indicators(_events(spark, sf), "user_id", "other", "value", "at"), path)
    return spark.read.parquet(path).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "account", "n", F.round("total", 4).alias("total"))


@query(
    """with recursive ev as (select event_id, user_id, ts, ts + to_hours(cast((event_id % 5 - 1) * 12 as int)) as until from events),
    walk as (select user_id, min(ts) as ts, arg_min(event_id, row(ts, event_id)) as event_id, arg_min(until, row(ts, event_id)) as until from ev where until > ts group by 1
        union all select e.user_id, min(e.ts), arg_min(e.event_id, row(e.ts, e.event_id)), arg_min(e.until, row(e.ts, e.event_id)) from walk w join ev e on e.user_id = w.user_id and e.until > e.ts and e.ts >= w.until group by 1)
    select event_id, event_id in (select event_id from walk) as fresh from events"""
)
def s5_consumed_once(spark: SparkSession, sf: str) -> DataFrame:
    """Which events consume their user, each for an expiry of its own; some have expired when they come."""
    path = s.output_path(spark, "consumed")
    sent = _events(spark, sf).withColumn("until", F.expr("at + make_dt_interval(0, cast((event_id % 5 - 1) * 12 as int))"))
    s.run_to_end(s.consumed_once(sent, "user_id", "at", "until", "event_id"), path, conf=s.ROCKSDB)
    return spark.read.parquet(path).select(F.col("id").alias("event_id"), "fresh")
