"""Abusive, hateful or sexual posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.abuse import background, kept_model, scored
from tidewatch.storage import table


def _scored(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    posts = table(spark, folder, "clean_reddit_posts")
    return scored(posts, list(keys), "text_clean", kept_model(spark, background(posts, "mention_id", "text_clean")))


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder, "mention_id")
    return rows.groupBy("mention_id").agg(F.max("score").alias("score"), F.max("flagged").alias("flagged"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, "mention_id").where("flagged").select("mention_id").distinct()


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Posts and share of flagged posts per subreddit; rows without one count under an empty name."""
    rows = _scored(spark, folder, "subreddit")
    key = F.coalesce(F.trim("subreddit"), F.lit("")).alias("subreddit")
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if("flagged").alias("flagged"),
        F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"),
    )


QUERIES = {"p3_found": p3_found, "p3_scores": p3_scores, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
