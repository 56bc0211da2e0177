"""Text stored in other characters than those it shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.lookalikes import KINDS, consistent, script_scores
from tidewatch.storage import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "clean_reddit_posts").select(
        F.lit("text_raw").alias("field_name"), F.col("mention_id").alias("record_key"), F.col("text_raw").alias("text")
    )
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("week_start", "cluster_id", "brand_display")]
    brands = table(spark, folder, "weekly_cluster_brand_mentions").select(
        F.lit("brand_display").alias("field_name"),
        F.concat_ws("|", *parts).alias("record_key"),
        F.col("brand_display").alias("text"),
    )
    return posts.unionByName(brands)


def p6_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Each record that needed it, with its consistent form and what was wrong."""
    texts = _texts(spark, folder)
    scores = script_scores(texts.select("text"))
    found = consistent(texts, "text", ["field_name", "record_key"], scores).where("kinds > 0").distinct()
    names = F.filter(
        F.array(*[F.when(F.col("kinds").bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(KINDS)]),
        lambda x: x.isNotNull(),
    )
    return found.select("field_name", "record_key", "form", F.array_join(names, ",").alias("found"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_forms(spark, folder).select("field_name", "record_key").distinct()


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms}
SQL: dict[str, str] = {}
