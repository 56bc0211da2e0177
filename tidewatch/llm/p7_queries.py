"""Brand names as people typed them, mapped to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.canonical_values import mapped, names_of
from tidewatch.storage import pinned, table


def _mapped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "entity_mentions").where("trim(candidate_text) <> ''")
    rows = rows.select("mention_id", "candidate_text")
    names = pinned(names_of(table(spark, folder, "brand_registry")), "names")
    values = rows.select(F.col("candidate_text").alias("value"))
    return rows, mapped(values, names).withColumnRenamed("value", "candidate_text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, found = _mapped(spark, folder)
    return (
        rows.join(found.where("entry is not null"), "candidate_text")
        .select("mention_id", "candidate_text", F.col("entry").alias("brand_norm"))
        .distinct()
    )


def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, with their rows and the best score they reached."""
    rows, found = _mapped(spark, folder)
    counts = rows.groupBy("candidate_text").agg(F.count(F.lit(1)).alias("mentions"))
    joined = counts.join(found, "candidate_text", "left").where("entry is null")
    return joined.select("candidate_text", "mentions", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("best_score"))


QUERIES = {"p7_found": p7_found, "p7_unmatched": p7_unmatched}
SQL: dict[str, str] = {}
