"""Streams that replace re-reading: duplicates dropped by id, weekly windows, and keyed state by upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.storage import delete, exists, scratch
from tidewatch.streaming.late_events import WEEK, WEEK_OFFSET


def file_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A parquet table, file or folder, as a stream with the table's schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path[:-1] + "[" + path[-1] + "]")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream to the end of its input; in append mode gives all rows, in update mode the rows of the last state by
    the sink's batch number in ``_batch``."""
    spark = stream.sparkSession
    out, marks = scratch(spark, "stream-out"), scratch(spark, "stream-marks")

    def sink(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/part={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    delete(spark, marks)
    names = stream.columns
    if not exists(spark, out):  # an empty input makes no batch
        return spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0))
    return spark.read.parquet(out).select(*names, "_batch")


def batch_counters(stream: DataFrame, id_column: str, time: str) -> DataFrame:
    """Audit of a stream to its end: per micro-batch records seen, distinct ids, rows without id, unreadable times."""
    spark = stream.sparkSession
    out, marks = scratch(spark, "stream-audit"), scratch(spark, "stream-marks")

    def sink(rows: DataFrame, batch: int) -> None:
        counted = rows.agg(
            F.count(F.lit(1)).alias("records_seen"), F.countDistinct(id_column).alias("ids"), F.count_if(F.col(id_column).isNull()).alias("without_id"),
            F.count_if(F.col(time).isNull()).alias("unreadable"),
        )
        counted.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/part={batch}")

    stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    delete(spark, marks)
    schema = "records_seen bigint, ids bigint, without_id bigint, unreadable bigint, batch int"
    return spark.read.schema(schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], schema)


def rescanned(stream: DataFrame, key: str, time: str, as_of: Column, days: int) -> DataFrame:
    """A run over the last ``days`` days: rows of the window, each id once within it. ``time`` is an instant."""
    start = as_of - F.expr(f"INTERVAL {days} DAYS")
    return stream.where((F.col(time) >= start) & (F.col(time) <= as_of)).withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark([key])


def first_by_id(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose id wasn't seen within the watermark; which of several copies stays is the stream's choice."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def weekly_counts(stream: DataFrame, time: str, key: str, value: str) -> DataFrame:
    """Weeks of the metric calendar with counts and sums per key, in update mode."""
    return stream.groupBy(F.window(time, WEEK, WEEK, WEEK_OFFSET).alias("w"), key).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))


def last_state(log: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch."""
    rest = [c for c in log.columns if c not in (*keys, "_batch")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("s"))
    return last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def upserted(state: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """State per source and community after some audit rows (ordinal, status, new_records, at): sums grow, the last
    status counts, and a failure keeps the time of the last success."""
    ok = F.col("status") == "success"
    delta = audit.groupBy(*keys).agg(
        F.sum("new_records").alias("added"), F.max_by("status", "ordinal").alias("new_status"), F.max(F.when(ok, F.col("at"))).alias("new_success")
    )
    both = state.join(delta, keys, "full")
    return both.select(
        *keys,
        (F.coalesce("records", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("records"),
        F.coalesce("new_status", "status").alias("status"),
        F.greatest("last_success", "new_success").alias("last_success"),
    )
