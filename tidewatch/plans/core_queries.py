"""Queries of the two general data problems (late events, hot keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.hot_keys import dense_totals, heavy_keys
from tidewatch.storage import table
from tidewatch.streaming.late_events import LateEvents, Results


def _late(spark: SparkSession, folder: str) -> Results:
    return LateEvents().run(spark, f"{folder}/raw_reddit_posts.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _late(spark, folder).only_late()


def p1_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return _late(spark, folder).weeks()


def p1_late_report(spark: SparkSession, folder: str) -> DataFrame:
    return _late(spark, folder).late_report()


def p1_set_aside(spark: SparkSession, folder: str) -> DataFrame:
    """Records that don't count, by reason."""
    return _late(spark, folder).reasons()


HOT = {
    "clean_reddit_posts.subreddit": ("score", "num_comments"),
    "weekly_cluster_brand_mentions.brand_norm": ("mentions", "unique_posts"),
}


def _each_hot(spark: SparkSession, folder: str, one) -> DataFrame:
    out = None
    for field, measures in HOT.items():
        name, column = field.split(".")
        part = one(table(spark, folder, name), F.col(column), measures).select(
            F.lit(field).alias("field_name"), "*"
        )
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _each_hot(spark, folder, lambda df, key, _: heavy_keys(df, key))
    return found.select("field_name", "key_value")


def p2_key_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _each_hot(
        spark, folder, lambda df, key, m: dense_totals(df, key, {"total_a": F.col(m[0]), "total_b": F.col(m[1])})
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_weekly": p1_weekly,
    "p1_late_report": p1_late_report,
    "p1_set_aside": p1_set_aside,
    "p2_found": p2_found,
    "p2_key_totals": p2_key_totals,
}

_INSTANT = """CASE WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN
  try_cast(CASE WHEN regexp_matches(trim({0}), '(?i)(z|[+-]\\d{{2}}:?\\d{{2}})$') THEN trim({0})
           ELSE trim({0}) || 'Z' END AS timestamptz) END"""
_RECORDS = f"""WITH parsed AS (
  SELECT mention_id, epoch_us({_INSTANT.format("published_at")}) AS e, epoch_us({_INSTANT.format("collected_at")}) AS a,
         coalesce(trim(community), '') AS community, coalesce(engagement_score, 0) AS engagement
  FROM raw_reddit_posts WHERE mention_id IS NOT NULL AND trim(mention_id) <> '' AND lower(trim(mention_id)) <> 'nan'),
weeks AS (
  SELECT *, ((e // 86400000000 - 5) // 7) * 7 + 5 AS day FROM parsed WHERE e IS NOT NULL AND a IS NOT NULL),
records AS (
  SELECT *, a >= (day + 14) * 86400000000 AS late,
         strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS week_start FROM weeks),
posts AS (
  SELECT week_start, mention_id, count(*) FILTER (WHERE NOT late) AS records, count(*) FILTER (WHERE late) AS late_records
  FROM records GROUP BY ALL),
kept AS (
  SELECT week_start, mention_id, engagement, community FROM records WHERE NOT late
  QUALIFY row_number() OVER (PARTITION BY week_start, mention_id ORDER BY a DESC, engagement DESC, community DESC) = 1)
"""

SQL = {
    "p1_found": _RECORDS + "SELECT mention_id FROM posts GROUP BY mention_id HAVING sum(records) = 0",
    "p1_weekly": _RECORDS
    + """SELECT week_start, community, count(*) AS posts, CAST(sum(records) AS BIGINT) AS records,
         round(avg(engagement), 6) AS avg_engagement FROM posts JOIN kept USING (week_start, mention_id) GROUP BY ALL""",
    "p1_late_report": _RECORDS
    + """SELECT week_start, CAST(sum(late_records) AS BIGINT) AS late_records, count(*) AS posts_with_late,
         count(*) FILTER (WHERE records = 0) AS posts_only_late FROM posts WHERE late_records > 0 GROUP BY week_start""",
    "p1_set_aside": _RECORDS
    + """SELECT CASE WHEN e IS NULL OR a IS NULL THEN 'unreadable' ELSE 'late' END AS reason, count(*) AS records, count(DISTINCT mention_id) AS posts
         FROM parsed WHERE e IS NULL OR a IS NULL OR a >= (((e // 86400000000 - 5) // 7) * 7 + 19) * 86400000000 GROUP BY 1""",
    "p2_found": """
WITH s AS (SELECT subreddit AS k, count(*) AS n, sum(count(*)) OVER () AS total FROM clean_reddit_posts GROUP BY 1),
     b AS (SELECT brand_norm AS k, count(*) AS n, sum(count(*)) OVER () AS total FROM weekly_cluster_brand_mentions GROUP BY 1)
SELECT 'clean_reddit_posts.subreddit' AS field_name, k AS key_value FROM s WHERE trim(k) <> '' AND n >= 0.03 * total
UNION ALL
SELECT 'weekly_cluster_brand_mentions.brand_norm', k FROM b WHERE trim(k) <> '' AND n >= 0.03 * total""",
    "p2_key_totals": """
SELECT 'clean_reddit_posts.subreddit' AS field_name, subreddit AS key_value, count(*) AS n_rows,
       coalesce(sum(CAST(score AS DOUBLE)), 0) AS total_a, coalesce(sum(CAST(num_comments AS DOUBLE)), 0) AS total_b
FROM clean_reddit_posts WHERE trim(subreddit) <> '' GROUP BY 2
UNION ALL
SELECT 'weekly_cluster_brand_mentions.brand_norm', brand_norm, count(*), coalesce(sum(CAST(mentions AS DOUBLE)), 0),
       coalesce(sum(CAST(unique_posts AS DOUBLE)), 0)
FROM weekly_cluster_brand_mentions WHERE trim(brand_norm) <> '' GROUP BY 2""",
}
