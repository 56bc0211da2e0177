"""Documents packed into containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.packing import CAPACITY, packed, sized
from tidewatch.storage import table


def p8_places(spark: SparkSession, folder: str) -> DataFrame:
    return packed(sized(table(spark, folder, "documents")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents the packing had to cut."""
    return p8_places(spark, folder).where("part > 0").select("doc_id").distinct()


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, tokens in them, the least number that could do, and the share of room left unused."""
    used = p8_places(spark, folder).where("container > 0")
    loads = used.groupBy("container").agg(F.sum("tokens").alias("load"))
    total = loads.agg(
        F.count("container").alias("containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"), F.max("load").alias("fullest")
    )
    return total.select(
        "containers",
        "tokens",
        "fullest",
        F.ceil(F.col("tokens") / CAPACITY).alias("least"),
        F.round(1 - F.col("tokens") / (F.greatest("containers", F.lit(1)) * CAPACITY), 6).alias("unused"),
    )


QUERIES = {"p8_found": p8_found, "p8_places": p8_places, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
