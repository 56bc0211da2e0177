"""Streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import instant
from tidewatch.storage import table
from tidewatch.streaming import incremental as I


def stream_first_events(spark: SparkSession, folder: str) -> DataFrame:
    """Users seen per day, each once, from the event stream."""
    rows = I.file_stream(spark, f"{folder}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("-", F.col("user_id"), F.to_date("ts")).alias("key"))
    out = I.drained(I.first_by_id(rows, "key", "ts", "2 days"), "append")
    return out.groupBy(F.split("key", "-")[0].cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("days"))


def stream_weekly(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.file_stream(spark, f"{folder}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    log = I.drained(I.weekly_counts(rows, "ts", "event_type", "value"), "update")
    out = I.last_state(log.withColumn("week_start", F.date_format("w.start", "yyyy-MM-dd")).drop("w"), ["week_start", "event_type"])
    return out.withColumn("total", F.round("total", 4))


def collector_state(spark: SparkSession, folder: str) -> DataFrame:
    """State per source and platform after two halves of the collections, the second upserted on the first."""
    raw = table(spark, folder, "raw_reddit_posts").withColumn("a", instant(F.col("collected_at")))
    audit = raw.groupBy("source", "sub_source", "ingestion_run_id").agg(
        F.count(F.lit(1)).alias("new_records"), F.when(F.count("a") == F.count(F.lit(1)), "success").otherwise("partial").alias("status"), F.max("a").alias("at")
    )
    audit = audit.withColumn("ordinal", F.col("ingestion_run_id"))
    cut = "run_20260410"
    empty = audit.limit(0).select("source", "sub_source", F.lit(0).cast("long").alias("records"), "status", F.col("at").alias("last_success"))
    keys = ["source", "sub_source"]
    first = I.upserted(empty, audit.where(F.col("ordinal") < cut), keys)
    out = I.upserted(first, audit.where(F.col("ordinal") >= cut), keys)
    return out.withColumn("last_success", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {f.__name__: f for f in (stream_first_events, stream_weekly, collector_state)}
_TS = """CASE WHEN regexp_matches(trim(collected_at), '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}') THEN try_cast(CASE WHEN regexp_matches(trim(collected_at),
  '(?i)(z|[+-]\\d{2}:?\\d{2})$') THEN trim(collected_at) ELSE trim(collected_at) || 'Z' END AS timestamptz) AT TIME ZONE 'UTC' END"""
SQL = {
    "stream_first_events": "SELECT user_id, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1",
    "stream_weekly": """SELECT strftime(ts::DATE - CAST((isodow(ts) + 5) % 7 AS INTEGER), '%Y-%m-%d') AS week_start, event_type, count(*) AS rows, round(sum(value), 4) AS total
    FROM events GROUP BY 1, 2""",
    "collector_state": f"""WITH r AS (SELECT source, sub_source, ingestion_run_id, {_TS} AS a FROM raw_reddit_posts),
    u AS (SELECT source, sub_source, ingestion_run_id, count(*) AS n, count(a) = count(*) AS ok, max(a) AS seen FROM r GROUP BY ALL)
    SELECT source, sub_source, CAST(sum(n) AS BIGINT) AS records, CASE WHEN arg_max(ok, ingestion_run_id) THEN 'success' ELSE 'partial' END AS status,
      strftime(max(seen) FILTER (WHERE ok), '%Y-%m-%d %H:%M:%S') AS last_success FROM u GROUP BY 1, 2""",
}
