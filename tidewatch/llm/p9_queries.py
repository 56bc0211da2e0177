"""Documents that contain passages of the evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.leaks import found_in
from tidewatch.storage import table


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select("item_id", "suite", "text")
    return found_in(table(spark, folder, "documents"), items)


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items by suite: how many there are, how many leaked, and into how many documents."""
    items = table(spark, folder, "eval_items").select("item_id", "suite")
    leaks = p9_found(spark, folder).groupBy("item_id").agg(F.count("doc_id").alias("documents"))
    rows = items.join(leaks, "item_id", "left")
    return rows.groupBy("suite").agg(
        F.count("item_id").alias("items"),
        F.count("documents").alias("leaked"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("places"),
    )


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
