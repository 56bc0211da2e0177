"""Queries of the weekly document and of what its readers compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import bundle as B
from tidewatch.operators.rows import bands
from tidewatch.plans.metric_queries import SQL as METRIC_SQL
from tidewatch.plans.metric_queries import weekly_trend_score
from tidewatch.storage import table


def _brands(spark: SparkSession, folder: str) -> DataFrame:
    return B.prepared(table(spark, folder, "weekly_cluster_brand_mentions").distinct())


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "weekly_cluster_discussion_terms").distinct()
    return rows.where("mentions is not null and trim(cluster_id) <> ''")


def canonical_brands(spark: SparkSession, folder: str) -> DataFrame:
    return B.canonical(_brands(spark, folder))


def brand_signals(spark: SparkSession, folder: str) -> DataFrame:
    return B.signals(_brands(spark, folder), ["norm"])


def cluster_signals(spark: SparkSession, folder: str) -> DataFrame:
    return B.signals(_brands(spark, folder), ["cluster_id", "norm"])


def weeks_shown(spark: SparkSession, folder: str) -> DataFrame:
    return B.full_weeks(_terms(spark, folder))


def week_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Scalars per week: brands, pairs of cluster and brand, brands by kind of their canonical row."""
    rows = _brands(spark, folder)
    counts = rows.groupBy("week_start").agg(
        F.countDistinct("cluster_id").alias("clusters"), F.countDistinct("norm").alias("brands"), F.countDistinct("cluster_id", "norm").alias("signals")
    )
    kinds = B.canonical(rows).groupBy("week_start").agg(*[F.count_if(F.col("brand_signal_type") == k).alias(k) for k in B.PRIORITY])
    return counts.join(kinds, "week_start")


def top_keywords(spark: SparkSession, folder: str, n: int = 120) -> DataFrame:
    """The most mentioned terms of every week."""
    w = Window.partitionBy("week_start").orderBy(F.desc("mentions"), F.desc("unique_posts"), "term_norm", "entity_type", "cluster_id", "term")
    ranked = _terms(spark, folder).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
    return ranked.select("week_start", "position", "term_norm", "entity_type", "cluster_id", "mentions")


def merged_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a week whatever their case: mentions and sentiment weighted by them."""
    rows = _terms(spark, folder)
    weight = F.greatest("mentions", F.lit(1))
    return rows.groupBy("week_start", F.lower("term").alias("term")).agg(
        F.sum("mentions").alias("mentions"), F.round(F.sum(F.col("avg_sentiment") * weight) / F.sum(weight), 9).alias("sentiment")
    )


def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return B.histogram(weekly_trend_score(spark, folder), "trend_score")


def top_clusters(spark: SparkSession, folder: str, n: int = 40) -> DataFrame:
    """The best clusters over all weeks by score, then posts, with the momentum percentile the chart uses."""
    rows = weekly_trend_score(spark, folder)
    momentum = F.round(0.60 * F.col("volume_percentile") + 0.40 * F.col("spike_percentile"), 9)
    top = rows.orderBy(F.desc("trend_score"), F.desc("current_week_posts"), "week", "cluster_id").limit(n)
    return top.select("week", "cluster_id", "trend_score", "current_week_posts", momentum.alias("momentum_percentile"))


def latest_posts(spark: SparkSession, folder: str, n: int = 120) -> DataFrame:
    rows = table(spark, folder, "clean_reddit_posts").dropDuplicates(["mention_id"])
    return rows.orderBy(F.desc("published_at"), "mention_id").limit(n).select("mention_id", "subreddit", F.unix_micros("published_at").alias("published"))


def daily_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Posts and mean score per day with the day's share of its week."""
    rows = table(spark, folder, "clean_reddit_posts").select(F.to_date("published_at").alias("day"), "mention_id", "score")
    days = rows.groupBy("day").agg(F.countDistinct("mention_id").alias("posts"), F.round(F.avg("score"), 6).alias("score"))
    week = Window.partitionBy(F.trunc("day", "week"))
    return days.withColumn("share", F.round(F.col("posts") / F.sum("posts").over(week), 9))


def price_bands(spark: SparkSession, folder: str) -> DataFrame:
    return bands(table(spark, folder, "lineitem"), "l_quantity", [0, 5, 10, 20, 30, 40, 60], ["a", "b", "c", "d", "e", "f"])


def brand_search(spark: SparkSession, folder: str) -> DataFrame:
    """Readers' filters: trusted brands whose name or any alias holds a text, tagged by their status."""
    rows = table(spark, folder, "brand_registry")
    hit = F.contains(F.lower("brand_display"), F.lit("br")) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lit("br")))
    tag = F.when(F.col("is_whitelist_brand"), "trusted").when(F.col("in_platform_brand"), "known").otherwise("new")
    return rows.where(F.coalesce(hit, F.lit(False))).select("brand_norm", tag.alias("tag"), F.upper(F.substring("brand_norm", 1, 2)).alias("initials"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_brands, brand_signals, cluster_signals, weeks_shown, week_meta, top_keywords, merged_terms, score_histogram, top_clusters, latest_posts,
        daily_activity, price_bands, brand_search,
    )
}

_BRANDS = """WITH d AS (SELECT DISTINCT * FROM weekly_cluster_brand_mentions),
f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(nullif(brand_norm, ''), nullif(brand_display, ''), nullif(candidate_text, ''), '')),
  '[^\\p{L}\\p{N}\\p{M}_\\s-]+', ' ', 'g'), '[\\s_-]+', ' ', 'g')) AS norm FROM d),
br AS (SELECT *, trim(coalesce(nullif(brand_display, ''), nullif(candidate_text, ''), norm)) AS display,
  CASE brand_signal_type WHEN 'confirmed_whitelist_brand' THEN 0 WHEN 'catalog_known_brand' THEN 1 WHEN 'candidate_non_whitelist_brand' THEN 2 ELSE 3 END AS priority
  FROM f WHERE norm <> ''),
ca AS (SELECT week_start, norm, coalesce(nullif(trim(regexp_replace(display, '[^\\p{L}\\p{N}\\p{M}_)&+''®™]+$', '')), ''), display) AS display, brand_signal_type FROM br
  QUALIFY row_number() OVER (PARTITION BY week_start, norm ORDER BY priority, unique_posts DESC NULLS LAST, mentions DESC NULLS LAST, display, brand_signal_type) = 1)
"""


def _signals(keys: str) -> str:
    return f"""{_BRANDS} SELECT week_start, {keys}, CAST(sum(mentions) AS BIGINT) AS mentions, max(unique_posts) AS unique_posts, count(DISTINCT cluster_id) AS clusters,
    round(sum(avg_sentiment * greatest(mentions, 1)) / sum(greatest(mentions, 1)), 9) AS avg_sentiment,
    round(sum(positive_share * greatest(mentions, 1)) / sum(greatest(mentions, 1)), 9) AS positive_share,
    coalesce(array_to_string(list_sort(list(DISTINCT trim(display)) FILTER (WHERE trim(display) <> '')), '|'), '') AS spellings FROM br GROUP BY ALL"""


_TERMS = "WITH t AS (SELECT DISTINCT * FROM weekly_cluster_discussion_terms WHERE mentions IS NOT NULL AND trim(cluster_id) <> '')"
_SCORES = METRIC_SQL["weekly_trend_score"].rsplit("SELECT *, round_even", 1)

SQL = {
    "canonical_brands": _BRANDS + "SELECT * FROM ca",
    "brand_signals": _signals("norm"),
    "cluster_signals": _signals("cluster_id, norm"),
    "weeks_shown": _TERMS + " SELECT week_start, count(DISTINCT cluster_id) AS clusters FROM t GROUP BY 1 HAVING count(DISTINCT cluster_id) >= 20",
    "week_meta": _BRANDS
    + """, c AS (SELECT week_start, count(DISTINCT cluster_id) AS clusters, count(DISTINCT norm) AS brands,
      count(DISTINCT (cluster_id, norm)) FILTER (WHERE cluster_id IS NOT NULL) AS signals FROM br GROUP BY 1),
    k AS (SELECT week_start, count(*) FILTER (WHERE brand_signal_type = 'confirmed_whitelist_brand') AS confirmed_whitelist_brand,
      count(*) FILTER (WHERE brand_signal_type = 'catalog_known_brand') AS catalog_known_brand,
      count(*) FILTER (WHERE brand_signal_type = 'candidate_non_whitelist_brand') AS candidate_non_whitelist_brand FROM ca GROUP BY 1)
    SELECT * FROM c JOIN k USING (week_start)""",
    "top_keywords": _TERMS
    + """ SELECT week_start, row_number() OVER (PARTITION BY week_start ORDER BY mentions DESC, unique_posts DESC NULLS LAST, term_norm NULLS FIRST,
      entity_type NULLS FIRST, cluster_id NULLS FIRST, term NULLS FIRST) AS position, term_norm, entity_type, cluster_id, mentions FROM t QUALIFY position <= 120""",
    "merged_terms": _TERMS
    + """ SELECT week_start, lower(term) AS term, CAST(sum(mentions) AS BIGINT) AS mentions,
      round(sum(avg_sentiment * greatest(mentions, 1)) / sum(greatest(mentions, 1)), 9) AS sentiment FROM t GROUP BY 1, 2""",
    "score_histogram": _SCORES[0]
    + """SELECT band, count(b4.trend_score) AS count FROM (VALUES ('1-2', -0.1, 2.0), ('2-2.5', 2.0, 2.5), ('2.5-3', 2.5, 3.0), ('3-3.5', 3.0, 3.5), ('3.5-4', 3.5, 4.0),
      ('4-4.5', 4.0, 4.5), ('4.5-5', 4.5, 5.01)) v(band, lo, hi) LEFT JOIN b4 ON trend_score > lo AND trend_score <= hi GROUP BY band""",
    "top_clusters": _SCORES[0]
    + """SELECT week, cluster_id, trend_score, current_week_posts, round(0.60::DOUBLE * volume_percentile + 0.40::DOUBLE * spike_percentile, 9) AS momentum_percentile
      FROM b4 ORDER BY trend_score DESC, current_week_posts DESC, week, cluster_id LIMIT 40""",
    "latest_posts": """SELECT DISTINCT mention_id, subreddit, epoch_us(published_at) AS published FROM clean_reddit_posts ORDER BY published DESC, mention_id LIMIT 120""",
    "daily_activity": """WITH d AS (SELECT (published_at AT TIME ZONE 'UTC')::DATE AS day, count(DISTINCT mention_id) AS posts, round(avg(score), 6) AS score FROM clean_reddit_posts GROUP BY 1)
    SELECT *, round(posts::DOUBLE / sum(posts) OVER (PARTITION BY date_trunc('week', day)), 9) AS share FROM d""",
    "price_bands": """SELECT band, count(l_quantity) AS count FROM (VALUES ('a', -0.1, 5), ('b', 5, 10), ('c', 10, 20), ('d', 20, 30), ('e', 30, 40), ('f', 40, 60)) v(band, lo, hi)
    LEFT JOIN lineitem ON l_quantity > lo AND l_quantity <= hi GROUP BY band""",
    "brand_search": """SELECT brand_norm, CASE WHEN is_whitelist_brand THEN 'trusted' WHEN in_platform_brand THEN 'known' ELSE 'new' END AS tag, upper(substr(brand_norm, 1, 2)) AS initials
    FROM brand_registry WHERE contains(lower(brand_display), 'br') OR len(list_filter(coalesce(aliases, []), lambda a: contains(lower(a), 'br'))) > 0""",
}
