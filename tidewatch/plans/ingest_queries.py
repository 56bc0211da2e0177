"""Queries over raw batches and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import ids
from tidewatch.functions.times import instant, iso_date_text, iso_week_label, week_start
from tidewatch.operators import posts as P
from tidewatch.operators.rows import keep_first_by_either, keep_one
from tidewatch.storage import table

AS_OF = "2026-05-20 00:00:00"


def _as_of():
    return F.to_timestamp(F.lit(AS_OF + "+00:00"))


def merged_posts(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.merged(table(spark, folder, "raw_reddit_posts"), _as_of())
    return rows.select("dedupe_key", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("published"), "title", "community")


def merge_report(spark: SparkSession, folder: str) -> DataFrame:
    return P.merge_report(table(spark, folder, "raw_reddit_posts"), _as_of())


def raw_keep_last(spark: SparkSession, folder: str) -> DataFrame:
    """One row per id, the last in order of arrival."""
    raw = table(spark, folder, "raw_reddit_posts").withColumn("t", instant(F.col("collected_at")))
    columns = ["title", "text", "url", "ingestion_run_id"]
    last = keep_one(raw, ["mention_id"], [F.desc_nulls_last("t"), *[F.desc_nulls_last(c) for c in columns]])
    return last.select("mention_id", "ingestion_run_id", "title")


def event_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per event date, ISO week, metric week and ingestion date, unreadable times under empty names."""
    moment = instant(F.col("published_at"))
    rows = table(spark, folder, "raw_reddit_posts").select(
        iso_date_text(F.col("published_at")).alias("event_date"),
        F.coalesce(iso_week_label(moment), F.lit("")).alias("iso_week"),
        F.coalesce(week_start(moment).cast("string"), F.lit("")).alias("week_start"),
        F.coalesce(week_start(moment, "mon").cast("string"), F.lit("")).alias("monday"),
        iso_date_text(F.col("collected_at")).alias("ingestion_date"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"))


def made_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids made from what a record holds, by each rung of the ladder, and the merge key."""
    c = F.col
    post = ids.post_id(c("url"), F.lit(""))
    address = ids.canonical_url(c("url"), c("community"), post)
    return table(spark, folder, "raw_reddit_posts").select(
        post.alias("post_id"),
        address.alias("canonical_url"),
        ids.mention_id(c("source"), post, address, c("title"), c("text")).alias("made_id"),
        ids.mention_id(c("source"), F.lit(""), F.lit(""), c("title"), c("text")).alias("content_id"),
        ids.merge_key(c("mention_id"), c("title"), c("text"), c("community"), c("published_at")).alias("merge_key"),
    )


def metrics_unpacked(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("metrics_json", "score double, num_comments double, upvote_ratio double")
    rows = table(spark, folder, "raw_reddit_posts").select("source", parsed.alias("m"), "engagement_score")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("m.score").alias("with_score"),
        F.round(F.coalesce(F.sum("m.score"), F.lit(0.0)), 4).alias("score"),
        F.round(F.coalesce(F.sum("m.num_comments"), F.lit(0.0)), 4).alias("comments"),
        F.round(F.sum(P.number(F.col("engagement_score"))), 4).alias("engagement"),
    )


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    rows = table(spark, folder, "clean_reddit_posts").select("mention_id", "title_raw", "text_raw", "title_clean", "text_clean", "author", "subreddit")
    return rows.withColumns(P.flags(c("title_raw"), c("text_raw"), c("title_clean"), c("text_clean"), c("author")))


def post_flags(spark: SparkSession, folder: str) -> DataFrame:
    names = ["is_english", "is_deleted", "is_bot", "is_spam_like", "is_megathread", "text_length", "is_valid_text"]
    return _flagged(spark, folder).select("mention_id", *names)


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return P.quality_report(_flagged(spark, folder))


def first_by_id_and_content(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col(c) for c in ("published_at", "mention_id", "content_hash", "url", "text_raw")]
    rows = table(spark, folder, "clean_reddit_posts")
    return keep_first_by_either(rows, ["mention_id", "content_hash"], order).select("mention_id", "content_hash", "subreddit")


def cleaned_posts(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cleaning stage over the raw batches."""
    latest = F.coalesce(-F.unix_micros(instant(F.col("collected_at"))), F.lit(1 << 62))
    order = [latest, F.col("title_raw"), F.col("text_raw"), F.col("url")]
    rows = P.clean_posts(table(spark, folder, "raw_reddit_posts"), order)
    return rows.select("mention_id", "title_clean", "text_clean", "subreddit", "score", "num_comments", "content_hash", "text_length")


def day_window(spark: SparkSession, folder: str) -> DataFrame:
    """Posts per subreddit of a window of days closed on both ends (to the second), and of the half-open week."""
    t = F.unix_timestamp("published_at")
    start, end = 1775001600, 1775606399  # 2026-04-01 00:00:00 to 2026-04-07 23:59:59 UTC
    rows = table(spark, folder, "clean_reddit_posts")
    return rows.groupBy("subreddit").agg(
        F.count_if(t.between(start, end)).alias("in_window"),
        F.count_if((F.col("published_at") >= F.timestamp_seconds(F.lit(start))) & (F.col("published_at") < F.timestamp_seconds(F.lit(start + 7 * 86400)))).alias("in_week"),
        F.count(F.lit(1)).alias("posts"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        merged_posts, merge_report, raw_keep_last, event_dates, made_ids, metrics_unpacked, post_flags, quality_report,
        first_by_id_and_content, cleaned_posts, day_window,
    )
}

_TS = """CASE WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN
  try_cast(CASE WHEN regexp_matches(trim({0}), '(?i)(z|[+-]\\d{{2}}:?\\d{{2}})$') THEN trim({0})
           ELSE trim({0}) || 'Z' END AS timestamptz) AT TIME ZONE 'UTC' END"""
_SQ = "lower(trim(regexp_replace(coalesce({0}, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))"
_KEY = f"""CASE WHEN mention_id IS NULL OR trim(mention_id) IN ('', 'nan', 'None') THEN 'hash_' || substr(sha256(
  {_SQ.format("title")} || '||' || {_SQ.format("text")} || '||' || {_SQ.format("community")} || '||' || {_SQ.format("published_at")}), 1, 24)
  ELSE trim(mention_id) END"""
_RAW = f"""WITH raw AS (SELECT * REPLACE (coalesce(community, '') AS community),
  {_TS.format("published_at")} AS e, {_TS.format("collected_at")} AS a FROM raw_reddit_posts),
  keyed AS (SELECT *, {_KEY} AS dedupe_key, e >= TIMESTAMP '{AS_OF}' - INTERVAL 42 DAYS AS inside FROM raw)
"""
_FLAGS = """WITH joined AS (SELECT *, trim(coalesce(title_clean, '') || '. ' || coalesce(text_clean, '')) AS b FROM clean_reddit_posts),
flags AS (SELECT *, length(b) AS text_length,
  trim(b) <> '' AND (len(regexp_extract_all(substr(b, 1, 1200), '[A-Za-z]'))::DOUBLE
    / greatest(len(regexp_extract_all(substr(b, 1, 1200), '[\\p{L}\\p{N}\\p{M}_]')), 1) > 0.55) AS is_english,
  lower(trim(coalesce(text_raw, ''))) IN ('[deleted]','[removed]','deleted','removed','nan','none','null')
    OR lower(trim(coalesce(title_raw, ''))) IN ('[deleted]','[removed]','deleted','removed','nan','none','null') AS is_deleted,
  regexp_matches(coalesce(author, ''), '(?i)bot$|automod|auto[_-]?moderator|moderator') AS is_bot,
  regexp_matches(b, '(?i)\\b(i am a bot|beep boop|automatically removed|message the moderators)\\b') AS is_spam_like,
  regexp_matches(coalesce(title_clean, ''), '(?i)\\b(daily|weekly|monthly)\\s+(discussion|megathread|thread)|megathread\\b') AS is_megathread
  FROM joined),
valid AS (SELECT *, is_english AND NOT is_deleted AND NOT is_bot AND NOT is_spam_like AND text_length >= 20 AS is_valid_text FROM flags)
"""
SQL = {
    "merged_posts": _RAW
    + """SELECT dedupe_key, strftime(e, '%Y-%m-%d %H:%M:%S') AS published, title, community FROM keyed WHERE inside
    QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY a DESC NULLS LAST, title DESC NULLS LAST, text DESC NULLS LAST,
                               published_at DESC NULLS LAST) = 1""",
    "merge_report": _RAW
    + """SELECT count(*) AS raw_rows, count(*) FILTER (WHERE e IS NULL) AS undated, count(*) FILTER (WHERE NOT inside) AS out_of_window,
    count(DISTINCT dedupe_key) FILTER (WHERE inside) AS kept,
    count(*) FILTER (WHERE inside) - count(DISTINCT dedupe_key) FILTER (WHERE inside) AS duplicates,
    strftime(min(e) FILTER (WHERE inside), '%Y-%m-%d %H:%M:%S') AS first_event,
    strftime(max(e) FILTER (WHERE inside), '%Y-%m-%d %H:%M:%S') AS last_event,
    count(DISTINCT community) FILTER (WHERE inside) AS communities FROM keyed""",
    "raw_keep_last": f"""SELECT mention_id, ingestion_run_id, title FROM raw_reddit_posts
    QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY {_TS.format("collected_at")} DESC NULLS LAST, title DESC NULLS LAST,
      text DESC NULLS LAST, url DESC NULLS LAST, ingestion_run_id DESC NULLS LAST) = 1""",
    "event_dates": f"""WITH t AS (SELECT {_TS.format("published_at")} AS e, {_TS.format("collected_at")} AS a FROM raw_reddit_posts)
    SELECT coalesce(strftime(e, '%Y-%m-%d'), '') AS event_date, coalesce(strftime(e, '%G-W%V'), '') AS iso_week,
      coalesce(strftime(e::DATE - CAST((isodow(e) + 5) % 7 AS INTEGER), '%Y-%m-%d'), '') AS week_start,
      coalesce(strftime(date_trunc('week', e), '%Y-%m-%d'), '') AS monday,
      coalesce(strftime(a, '%Y-%m-%d'), '') AS ingestion_date, count(*) AS rows FROM t GROUP BY ALL""",
    "made_ids": f"""WITH p AS (SELECT *, regexp_extract(coalesce(url, ''), '(?i)/r/[^/]+/comments/([a-z0-9]+)', 1) AS post_id FROM raw_reddit_posts),
    u AS (SELECT *, CASE WHEN post_id <> '' THEN 'https://www.reddit.com/r/' ||
       coalesce(nullif(regexp_replace(trim(coalesce(community, '')), '^r/', ''), ''), 'unknown') || '/comments/' || post_id || '/'
      WHEN trim(coalesce(url, '')) <> '' THEN 'https://www.reddit.com' || regexp_replace(regexp_replace(regexp_replace(trim(url),
        '(?i)^https?://[^/?#]*', ''), '[?#].*$', ''), '/+$', '/') ELSE '' END AS canonical_url FROM p),
    h AS (SELECT *, 'hash_' || substr(sha256(coalesce(source, '') || '||' || coalesce(title, '') || '||' || {_SQ.format("text")}), 1, 24) AS content_id FROM u)
    SELECT post_id, canonical_url, CASE WHEN post_id <> '' THEN 'reddit_submission_' || post_id
      WHEN canonical_url <> '' THEN 'url_' || substr(sha256(canonical_url), 1, 24) ELSE content_id END AS made_id, content_id, {_KEY} AS merge_key FROM h""",
    "metrics_unpacked": """SELECT source, count(*) AS rows, count(try_cast(json_extract_string(metrics_json, '$.score') AS DOUBLE)) AS with_score,
    round(coalesce(sum(try_cast(json_extract_string(metrics_json, '$.score') AS DOUBLE)), 0), 4) AS score,
    round(coalesce(sum(try_cast(json_extract_string(metrics_json, '$.num_comments') AS DOUBLE)), 0), 4) AS comments,
    round(sum(coalesce(engagement_score, 0)), 4) AS engagement FROM raw_reddit_posts GROUP BY source""",
    "post_flags": _FLAGS
    + "SELECT mention_id, is_english, is_deleted, is_bot, is_spam_like, is_megathread, text_length, is_valid_text FROM valid",
    "quality_report": _FLAGS
    + """SELECT count(*) AS rows, count(*) FILTER (WHERE is_valid_text) AS valid, count(*) FILTER (WHERE NOT is_english) AS non_english,
    count(*) FILTER (WHERE is_deleted) AS deleted, count(*) FILTER (WHERE is_bot) AS bots, count(*) FILTER (WHERE is_spam_like) AS spam,
    count(*) FILTER (WHERE is_megathread) AS megathreads, count(*) FILTER (WHERE text_length < 20) AS short,
    round(avg(text_length), 4) AS mean_length, median(text_length) AS median_length FROM valid""",
    "first_by_id_and_content": """SELECT DISTINCT mention_id, content_hash, subreddit FROM (SELECT *,
      rank() OVER (PARTITION BY mention_id ORDER BY published_at, mention_id, content_hash, url, text_raw) AS a,
      rank() OVER (PARTITION BY content_hash ORDER BY published_at, mention_id, content_hash, url, text_raw) AS b
      FROM clean_reddit_posts) WHERE a = 1 AND b = 1""",
    "day_window": """SELECT subreddit, count(*) FILTER (WHERE epoch(published_at) >= 1775001600 AND epoch(published_at) < 1775606400) AS in_window,
    count(*) FILTER (WHERE epoch(published_at) >= 1775001600 AND epoch(published_at) < 1775606400) AS in_week, count(*) AS posts
    FROM clean_reddit_posts GROUP BY subreddit""",
}
