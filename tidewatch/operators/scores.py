"""Trend scores per week and cluster: volume, growth on the previous week, reach, engagement and sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.rows import average_rank, with_previous_week


def rounded(c: Column, digits: int) -> Column:
    """Half to even on the scaled value."""
    return F.rint(c * 10**digits) / 10**digits


def bucket(percentile: Column) -> Column:
    out = F.lit(1)
    for edge, b in ((0.2, 2), (0.4, 3), (0.6, 4), (0.8, 5)):
        out = F.when(percentile >= edge, F.lit(b)).otherwise(out)
    return out


def sentiment_score(value: Column) -> Column:
    """3 for none; +0.70 and more is 5, -0.35 and less is 1, linear between."""
    up, down = 3.0 + 2.0 * (F.least(value, F.lit(0.70)) / 0.70), 3.0 - 2.0 * (F.least(F.abs(value), F.lit(0.35)) / 0.35)
    return F.when(value.isNull(), 3.0).otherwise(rounded(F.when(value >= 0, up).otherwise(down), 2))


def capped(score: Column, *limits: tuple[Column, int]) -> Column:
    for condition, most in limits:
        score = F.when(condition, F.least(score, F.lit(most))).otherwise(score)
    return score


def weekly_base(posts: DataFrame) -> DataFrame:
    """Posts (week, cluster_id, mention_id, subreddit, engagement, sentiment) per week and cluster. Rows without a week
    are left out; engagement below 0 counts as 0; null sentiments count nowhere."""
    return posts.where(F.col("week").isNotNull()).groupBy("week", "cluster_id").agg(
        F.countDistinct("mention_id").alias("current_week_posts"),
        F.countDistinct("subreddit").alias("unique_subreddits"),
        F.avg("sentiment").alias("avg_sentiment"),
        F.avg(F.log1p(F.greatest("engagement", F.lit(0.0)))).alias("avg_log_engagement"),
    )


def trend_scores(base: DataFrame) -> DataFrame:
    out = with_previous_week(base, "week", ["cluster_id"], "current_week_posts", "previous_week_posts")
    delta = F.col("current_week_posts") - F.col("previous_week_posts")
    # means are rounded before they are ranked, so that the order of summing makes no tie
    out = out.withColumns(
        {
            "absolute_delta": delta,
            "growth_rate": delta / F.greatest("previous_week_posts", F.lit(1)),
            "avg_log_engagement": F.round("avg_log_engagement", 9),
            "avg_sentiment": F.round("avg_sentiment", 9),
        }
    )
    ranks = {"volume": "current_week_posts", "spike": "growth_rate", "cross_community": "unique_subreddits", "engagement": "avg_log_engagement"}
    for name, c in ranks.items():
        out = out.withColumn(f"{name}_percentile", average_rank(c, ["week"]))
    n, subs = F.col("current_week_posts"), F.col("unique_subreddits")
    few = n < 3
    new = (F.col("previous_week_posts") == 0) & (n < 5)
    out = out.withColumns(
        {
            "volume_bucket": bucket(F.col("volume_percentile")),
            "spike_bucket": capped(bucket(F.col("spike_percentile")), (few, 2), (new, 3)),
            "cross_community_score": capped(bucket(F.col("cross_community_percentile")), (few, 2), (subs == 1, 2), (subs == 2, 3)),
            "engagement_score": capped(bucket(F.col("engagement_percentile")), (few, 2)),
            "sentiment_score": sentiment_score(F.col("avg_sentiment")),
        }
    )
    out = out.withColumn("momentum_score", rounded(0.60 * F.col("volume_bucket") + 0.40 * F.col("spike_bucket"), 2))
    trend = 0.40 * F.col("momentum_score") + 0.20 * F.col("sentiment_score") + 0.20 * F.col("cross_community_score") + 0.20 * F.col("engagement_score")
    out = out.withColumn("trend_score", rounded(trend, 2))
    return out.withColumn("trend_score_100", rounded(F.col("trend_score") * 20, 1))
