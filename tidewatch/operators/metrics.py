"""Weekly metrics of brands, clusters and terms, from entities and posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.rows import distribution, first_values, growth_on_previous_row, most_common, top_counts


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def base_measures(sentiment: str = "sentiment_compound") -> list[Column]:
    label = F.coalesce("sentiment_label", F.lit(""))
    return [
        F.count("mention_id").alias("mentions"),
        F.countDistinct("mention_id").alias("unique_posts"),
        F.round(F.avg(sentiment), 9).alias("avg_sentiment"),
        F.round(share(label == "positive"), 9).alias("positive_share"),
        F.round(share(label == "negative"), 9).alias("negative_share"),
    ]


def weekly(rows: DataFrame, keys: Sequence[str], growth_keys: Sequence[str], ties: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Measures per week and key with growth of mentions on the key's previous row."""
    out = rows.groupBy("week_start", *keys).agg(*base_measures(), *extra)
    grown = growth_on_previous_row(out, growth_keys, "week_start", "mentions", ties)
    return grown.withColumn("wow_growth", F.round("wow_growth", 9))


def engagement() -> list[Column]:
    return [
        F.countDistinct("subreddit").alias("unique_subreddits"),
        F.round(F.sum("engagement"), 4).alias("engagement_sum"),
        F.round(F.avg("engagement"), 9).alias("engagement_avg"),
    ]


def with_lists(
    metrics: DataFrame, rows: DataFrame, keys: Sequence[str], modes: dict[str, str], order: Sequence[Column], sample: str = "mention_id"
) -> DataFrame:
    """Adds to ``metrics`` per key the most frequent values (out name to column), the top 20 subreddits, the distribution
    of tiers and the first ten ids in order."""
    keys = ["week_start", *keys]
    parts = [most_common(rows, keys, column, out) for out, column in modes.items()]
    parts.append(top_counts(rows, keys, "subreddit", 20, "top_subreddits"))
    parts.append(distribution(rows, keys, "cluster_usage_tier", "tiers"))
    parts.append(first_values(rows, keys, sample, order, 10, "sample_post_ids"))
    out = metrics
    for p in parts:
        renamed = p.withColumnsRenamed({k: f"_{k}" for k in keys})
        condition = None
        for k in keys:
            one = out[k].eqNullSafe(renamed[f"_{k}"])
            condition = one if condition is None else condition & one
        out = out.join(renamed, condition, "left").drop(*[f"_{k}" for k in keys])
    return out


def confidence_floor(confidence: Column, tier: Column) -> Column:
    """Whether a brand mention's assignment is sure enough: 0.30, or 0.25 where weak matches are let in."""
    return confidence >= F.when(tier == "weak_match", 0.25).otherwise(0.30)


def tier_gate(rows: DataFrame, weak: bool = False, least: float = 0.0) -> DataFrame:
    """Rows with a cluster of a usable tier (weak ones on demand) and at least some confidence."""
    tiers = ["strong_match", "usable_match"] + ["weak_match"] * weak
    return rows.where((F.trim("cluster_id") != "") & F.col("cluster_usage_tier").isin(tiers) & (F.col("assignment_confidence") >= least))
