"""Arrivals that repeat the accepted history or earlier arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.segment_index import rejected
from tidewatch.storage import table


def _rejected(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(table(spark, folder, "clean_reddit_posts"), table(spark, folder, "incoming_posts"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _rejected(spark, folder).select("arrival_id")


def p4_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch: arrivals, and those rejected by the first reason that applies."""
    arrivals = table(spark, folder, "incoming_posts").select("arrival_id", "batch_no")
    rows = arrivals.join(_rejected(spark, folder), "arrival_id", "left")
    return rows.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("arrivals"),
        *[F.count_if(F.col("reason") == r).alias(f"by_{r}") for r in ("hash", "id", "text")],
    )


QUERIES = {"p4_found": p4_found, "p4_batches": p4_batches}
SQL: dict[str, str] = {}
