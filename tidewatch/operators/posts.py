"""From raw batches to clean posts: merging recent batches, cleaning, validity, duplicates, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ids, text
from tidewatch.functions.times import instant, iso_date_text
from tidewatch.operators.rows import keep_first_by_either, keep_one, resolve

# What marks bots, templates and megathreads.
BOT = r"(?i)bot$|automod|auto[_-]?moderator|moderator"
MEGATHREAD = r"(?i)\b(daily|weekly|monthly)\s+(discussion|megathread|thread)|megathread\b"
SPAM = r"(?i)\b(i am a bot|beep boop|automatically removed|message the moderators)\b"


def with_event_time(raw: DataFrame) -> DataFrame:
    """``event_ts`` (published, else created), its date, and ``arrival_ts``; the community under one name."""
    created = resolve(raw, "created_at", default=None).cast("string")
    return raw.withColumns(
        {
            "event_ts": F.coalesce(instant(F.col("published_at")), instant(created)),
            "arrival_ts": instant(F.col("collected_at")),
            "community": F.coalesce(resolve(raw, "subreddit", "community"), F.lit("")),
        }
    ).withColumn("event_day", F.to_date("event_ts"))


def recent_window(raw: DataFrame, as_of: Column, weeks: int) -> DataFrame:
    """Dated rows from ``as_of`` minus ``weeks`` on; there is no upper bound."""
    return raw.where(F.col("event_ts") >= as_of - F.expr(f"INTERVAL {7 * weeks} DAYS"))


def merged(raw: DataFrame, as_of: Column, weeks: int = 6) -> DataFrame:
    """The latest collected version of every post of the window. Ties of the arrival go to the larger title, then text;
    rows whose arrival can't be read come last."""
    rows = recent_window(with_event_time(raw), as_of, weeks)
    key = ids.merge_key(F.col("mention_id"), F.col("title"), F.col("text"), F.col("community"), F.col("published_at"))
    order = [F.desc_nulls_last("arrival_ts"), F.desc_nulls_last("title"), F.desc_nulls_last("text"), F.desc_nulls_last("published_at")]
    return keep_one(rows.withColumn("dedupe_key", key), ["dedupe_key"], order)


def merge_report(raw: DataFrame, as_of: Column, weeks: int = 6) -> DataFrame:
    rows = with_event_time(raw)
    inside = F.col("event_ts") >= as_of - F.expr(f"INTERVAL {7 * weeks} DAYS")
    key = ids.merge_key(F.col("mention_id"), F.col("title"), F.col("text"), F.col("community"), F.col("published_at"))
    keys = rows.withColumn("k", F.when(inside, key))
    return keys.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("event_ts").isNull()).alias("undated"),
        F.count_if(~inside).alias("out_of_window"),
        F.countDistinct("k").alias("kept"),
        (F.count("k") - F.countDistinct("k")).alias("duplicates"),
        F.date_format(F.min(F.when(inside, F.col("event_ts"))), "yyyy-MM-dd HH:mm:ss").alias("first_event"),
        F.date_format(F.max(F.when(inside, F.col("event_ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_event"),
        F.countDistinct(F.when(inside, F.col("community"))).alias("communities"),
    )


def record(source: str, platform: str, run: str, raw: DataFrame) -> DataFrame:
    """The raw contract's record of every answer of a source (reddit_id, title, text, author, community, published_at, url,
    engagement, collected_at, metrics as a struct): deleted texts blank, one address, id, days and full text."""
    c = F.col
    body = F.when(c("text").isin("[deleted]", "[removed]"), "").otherwise(F.coalesce("text", F.lit("")))
    title = F.coalesce("title", F.lit(""))
    post = ids.post_id(c("url"), c("reddit_id"))
    address = ids.canonical_url(c("url"), c("community"), post)
    scores = {n: F.lit(0.0) for n in ("semantic_relevance_score", "tiktok_relevance_score", "collector_priority_score")}
    return raw.select(
        F.lit(run).alias("ingestion_run_id"), F.lit(source).alias("source"), F.lit(platform).alias("platform"), F.concat(F.lit("r/"), c("community")).alias("sub_source"),
        post.alias("reddit_id"), F.when(post != "", post).otherwise(address).alias("source_record_id"),
        ids.mention_id(F.lit(source), post, address, title, body).alias("mention_id"), address.alias("canonical_url"), "url", title.alias("title"), body.alias("text"),
        F.trim(F.concat(title, F.lit(" "), body)).alias("full_text"), "author", "community", "published_at", "collected_at",
        iso_date_text(c("published_at")).alias("event_date"), iso_date_text(c("collected_at")).alias("ingestion_date"), number(c("engagement").cast("string")).alias("engagement_score"),
        *[v.alias(n) for n, v in scores.items()], F.lit("").alias("business_context_label"), F.coalesce(F.to_json("metrics"), F.lit("{}")).alias("metrics_json"),
    )


def new_records(batch: DataFrame, known: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a batch whose id isn't known yet, the first of each id by ``order``. Null ids are never known."""
    fresh = batch.join(known.select("mention_id").where("mention_id is not null").distinct(), "mention_id", "left_anti")
    return keep_one(fresh.where("mention_id is not null"), ["mention_id"], order)


def audit(batch: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of a collection per ``keys``: records seen, new (not known, each id once), duplicate, unreadable times."""
    seen = batch.join(known.select("mention_id", F.lit(True).alias("_known")).where("mention_id is not null").distinct(), "mention_id", "left")
    fresh = F.when(F.col("_known").isNull(), F.col("mention_id"))
    out = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records_seen"), F.countDistinct(fresh).alias("records_new"), F.count_if(instant(F.col("published_at")).isNull()).alias("unreadable"),
        F.min("collected_at").alias("started_at"), F.max("collected_at").alias("finished_at"),
    )
    status = F.when(F.col("unreadable") == 0, "success").otherwise("partial")
    return out.withColumns({"records_duplicate": F.col("records_seen") - F.col("records_new"), "status": status})


def chosen_text(df: DataFrame) -> Column:
    main, other = resolve(df, "text"), resolve(df, "selftext")
    return F.coalesce(F.when(F.trim(main) != "", main), other, F.lit(""))


def flags(title_raw: Column, text_raw: Column, title: Column, body: Column, author: Column) -> dict[str, Column]:
    """Validity flags of a post; megathreads are flagged but stay valid."""
    both = F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(body, F.lit(""))))
    deleted = F.lower(F.trim(F.coalesce(text_raw, F.lit("")))).isin(text.DELETED) | F.lower(
        F.trim(F.coalesce(title_raw, F.lit("")))
    ).isin(text.DELETED)
    language = text.language(both)
    bot = F.coalesce(author, F.lit("")).rlike(BOT)
    spam = both.rlike(SPAM)
    return {
        "combined": both,
        "language": language,
        "is_english": language == "en",
        "is_deleted": deleted,
        "is_bot": bot,
        "is_spam_like": spam,
        "is_megathread": F.coalesce(title, F.lit("")).rlike(MEGATHREAD),
        "text_length": F.length(both),
        "is_valid_text": (language == "en") & ~deleted & ~bot & ~spam & (F.length(both) >= 20),
    }


def number(c: Column) -> Column:
    """Numeric value, 0 where there is none or it isn't a number."""
    value = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def flagged_posts(raw: DataFrame) -> DataFrame:
    """All posts with readable texts, flags, hash and metrics (score and comments from their columns or the metrics
    JSON); before duplicates and invalid posts go."""
    metrics = resolve(raw, "metrics_json", default=None).cast("string")
    base = raw.select(
        "*",
        F.coalesce(resolve(raw, "title"), F.lit("")).alias("title_raw"),
        chosen_text(raw).alias("text_raw"),
    )
    base = base.withColumns({"title_clean": text.readable(F.col("title_raw")), "text_clean": text.readable(F.col("text_raw"))})
    made = flags(F.col("title_raw"), F.col("text_raw"), F.col("title_clean"), F.col("text_clean"), resolve(raw, "author"))
    out = base.withColumns(made)
    score = F.coalesce(resolve(raw, "score", default=None).try_cast("double"), F.get_json_object(metrics, "$.score").try_cast("double"), resolve(raw, "engagement_score", default=0).try_cast("double"))
    comments = F.coalesce(resolve(raw, "num_comments", default=None).try_cast("double"), F.get_json_object(metrics, "$.num_comments").try_cast("double"))
    return out.withColumns(
        {
            "content_hash": text.content_hash(F.col("title_clean"), F.col("text_clean")),
            "subreddit": F.coalesce(resolve(raw, "subreddit", "community"), F.lit("")),
            "event_ts": instant(F.col("published_at").cast("string")),
            "score": number(score),
            "num_comments": number(comments),
            "text_for_display": F.col("combined"),
            "text_for_tokenization": text.token_form(F.col("combined")),
        }
    )


def clean_posts(raw: DataFrame, order: list[Column]) -> DataFrame:
    """Valid posts that come first, in ``order`` (ascending values), under their id and under their content."""
    rows = flagged_posts(raw).withColumn(
        "mention_id",
        ids.filled_mention_id(F.col("mention_id"), F.col("title_raw"), F.col("text_raw"), F.xxhash64("collected_at", "published_at", "url")),
    )
    return keep_first_by_either(rows, ["mention_id", "content_hash"], order).where("is_valid_text")


def quality_report(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_valid_text")).alias("valid"),
        F.count_if(~F.col("is_english")).alias("non_english"),
        F.count_if(F.col("is_deleted")).alias("deleted"),
        F.count_if(F.col("is_bot")).alias("bots"),
        F.count_if(F.col("is_spam_like")).alias("spam"),
        F.count_if(F.col("is_megathread")).alias("megathreads"),
        F.count_if(F.col("text_length") < 20).alias("short"),
        F.round(F.avg("text_length"), 4).alias("mean_length"),
        F.median("text_length").alias("median_length"),
    )
