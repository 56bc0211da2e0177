"""Queries for weekly metrics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import week_start
from tidewatch.operators import entities as E
from tidewatch.operators import metrics as M
from tidewatch.operators import scores as S
from tidewatch.operators.language import sentiment
from tidewatch.operators.rows import average_rank, distribution, first_values, top_counts, with_previous_week
from tidewatch.plans.cluster_queries import ASSIGN_SQL, assignments
from tidewatch.plans.entity_queries import _post_side
from tidewatch.plans.text_queries import SENTIMENT_SQL, combined, posts
from tidewatch.storage import pinned, table


def post_base(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with week, engagement, sentiment and assignment."""
    p = sentiment(posts(spark, folder), combined()).select(
        "mention_id", "subreddit", "title_clean", "published_at", "url", week_start(F.col("published_at")).alias("week_start"),
        (F.coalesce("score", F.lit(0.0)) + F.coalesce("num_comments", F.lit(0.0))).alias("engagement"), "sentiment_compound", "sentiment_label",
    )
    a = assignments(spark, folder).select(
        "mention_id", F.col("final_cluster_id").alias("cluster_id"), "assignment_confidence", "assignment_status", "cluster_usage_tier"
    )
    return p.join(a, "mention_id", "left")


def _indexed(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.evidence(table(spark, folder, "entity_mentions"), _post_side(spark, folder)).select("brand_norm", "brand_display", "in_platform_brand", "mention_id")
    return rows.join(post_base(spark, folder), "mention_id", "left")


def weekly_brand_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return M.weekly(_indexed(spark, folder), ["brand_norm", "brand_display", "in_platform_brand"], ["brand_norm"], ["brand_display", "in_platform_brand"], M.engagement())


def weekly_cluster_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = post_base(spark, folder).where("trim(cluster_id) <> '' and assignment_status <> 'unassigned'")
    return M.weekly(rows, ["cluster_id"], ["cluster_id"], [], M.engagement())


def weekly_cluster_metrics_all(spark: SparkSession, folder: str) -> DataFrame:
    """As ``weekly_cluster_metrics``, with the posts of no cluster under one name instead of left out."""
    known = (F.trim("cluster_id") != "") & (F.col("assignment_status") != "unassigned")
    rows = post_base(spark, folder).withColumn("cluster_id", F.when(known, F.col("cluster_id")).otherwise("UNASSIGNED"))
    return M.weekly(rows, ["cluster_id"], ["cluster_id"], [], M.engagement())


def weekly_trend_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "entity_mentions").select("mention_id", "entity_text", "entity_norm", "entity_type", "matched_cluster_id")
    rows = terms.join(post_base(spark, folder).select("mention_id", "week_start", "sentiment_compound", "sentiment_label"), "mention_id", "left")
    keys = ["entity_text", "entity_norm", "entity_type", "matched_cluster_id"]
    return M.weekly(rows, keys, ["entity_norm", "entity_type"], ["entity_text", "matched_cluster_id"])


def _joined(spark: SparkSession, folder: str, weak: bool = True) -> DataFrame:
    entities = table(spark, folder, "entity_mentions").select(
        "mention_id", "entity_text", "entity_norm", "entity_type", "brand_signal_type", "brand_norm", "brand_display", "in_platform_brand", "matched_cluster_id"
    )
    gated = M.tier_gate(post_base(spark, folder), weak=weak)
    return pinned(entities.join(gated, "mention_id"), "gated-entities")


def cluster_discussion_terms(spark: SparkSession, folder: str, weak: bool = True) -> DataFrame:
    rows = _joined(spark, folder, weak)
    keys = ["cluster_id", "entity_type", "entity_norm"]
    metrics = rows.groupBy("week_start", *keys).agg(*M.base_measures(), F.round(F.avg("assignment_confidence"), 9).alias("avg_assignment_confidence"))
    modes = {"term": "entity_text", "entity_matched_cluster_id": "matched_cluster_id"}
    out = M.with_lists(metrics, rows, keys, modes, [F.col("mention_id")])
    return _flat(out)


def strict_discussion_terms(spark: SparkSession, folder: str) -> DataFrame:
    """As ``cluster_discussion_terms``, without posts of a weak match."""
    return cluster_discussion_terms(spark, folder, weak=False)


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as text."""
    pair = lambda a, b: F.concat(a, F.lit(":"), b.cast("string"))
    return df.withColumns(
        {
            "top_subreddits": F.array_join(F.transform("top_subreddits", lambda x: pair(x["value"], x["count"])), "|"),
            "tiers": F.array_join(F.array_sort(F.transform(F.map_entries("tiers"), lambda x: pair(x["key"], x["value"]))), "|"),
            "sample_post_ids": F.array_join("sample_post_ids", "|"),
        }
    )


def cluster_brand_mentions(spark: SparkSession, folder: str) -> DataFrame:
    sure = M.confidence_floor(F.col("assignment_confidence"), F.col("cluster_usage_tier"))
    rows = _joined(spark, folder).where("entity_type in ('brand', 'unknown_candidate')").where(sure)
    known = F.col("brand_signal_type").isin("confirmed_whitelist_brand", "catalog_known_brand")
    rows = rows.withColumn("identity_key", F.when(known, F.col("brand_norm")).otherwise(F.col("entity_norm")))
    keys = ["cluster_id", "brand_signal_type", "identity_key"]
    metrics = rows.groupBy("week_start", *keys).agg(*M.base_measures(), F.bool_or("in_platform_brand").alias("in_platform_brand"))
    modes = {"brand_norm": "brand_norm", "candidate_text": "entity_text"}
    out = M.with_lists(metrics, rows, keys, modes, [F.col("mention_id")])
    blank = F.lit("")
    return _flat(out.withColumns({"candidate_text": F.when(known, blank).otherwise(F.col("candidate_text")), "brand_norm": F.when(known, F.col("brand_norm")).otherwise(blank)}))


def high_precision_posts(spark: SparkSession, folder: str) -> DataFrame:
    rows = post_base(spark, folder).where("assignment_status = 'confident' and trim(cluster_id) <> ''")
    return rows.select("mention_id", "cluster_id", "assignment_confidence", "subreddit", "url")


def cluster_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Per cluster its posts and nested lists: top terms, brands, candidates and subreddits, tiers, statuses, first titles."""
    rows = pinned(M.tier_gate(post_base(spark, folder), weak=True), "quality")
    entities = table(spark, folder, "entity_mentions").select("mention_id", "entity_norm", "entity_type", "brand_norm").join(rows.select("mention_id", "cluster_id"), "mention_id")
    keys = ["cluster_id"]
    out = rows.groupBy(*keys).agg(F.countDistinct("mention_id").alias("posts"), F.round(F.avg("assignment_confidence"), 9).alias("confidence"))
    tops = {
        "top_subreddits": (rows, "subreddit"), "top_terms": (entities, "entity_norm"), "top_brands": (entities.where("entity_type = 'brand'"), "brand_norm"),
        "top_candidates": (entities.where("entity_type = 'unknown_candidate'"), "entity_norm"),
    }
    parts = [top_counts(df, keys, value, 10, name) for name, (df, value) in tops.items()]
    parts += [distribution(rows, keys, c, name) for name, c in (("tiers", "cluster_usage_tier"), ("statuses", "assignment_status"))]
    parts.append(first_values(rows, keys, "title_clean", [F.col("mention_id")], 10, "sample_titles"))
    for p in parts:
        out = out.join(p, keys, "left")
    pair = lambda a, b: F.concat(a, F.lit(":"), b.cast("string"))
    flat = {c: F.array_join(F.transform(c, lambda x: pair(x["value"], x["count"])), "|") for c in tops}
    flat |= {c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: pair(x["key"], x["value"]))), "|") for c in ("tiers", "statuses")}
    return out.withColumns(flat | {"sample_titles": F.array_join("sample_titles", "|")})


def weekly_cluster_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.tier_gate(post_base(spark, folder), weak=True)
    base = S.weekly_base(rows.select(F.col("week_start").alias("week"), "cluster_id", "mention_id", "subreddit", "engagement", F.col("sentiment_compound").alias("sentiment")))
    return S.trend_scores(base)


def _event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        week_start(F.col("ts")).alias("week"), F.col("event_type").alias("cluster_id"), F.col("event_id").alias("mention_id"), F.col("user_id").alias("subreddit"),
        F.col("value").alias("engagement"), (F.round(F.col("value") / 100, 6) - 0.5).alias("sentiment"),
    )


def weekly_trend_score(spark: SparkSession, folder: str) -> DataFrame:
    """The trend score over the event table (type for cluster, user for community)."""
    return S.trend_scores(S.weekly_base(_event_rows(spark, folder)))


def weekly_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per week and priority with their average-rank percentiles and the previous week's number."""
    weeks = table(spark, folder, "orders").groupBy(week_start(F.col("o_orderdate")).alias("week"), "o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price")
    )
    out = with_previous_week(weeks, "week", ["o_orderpriority"], "orders", "previous")
    return out.withColumns({"orders_rank": average_rank("orders", ["week"]), "price_rank": average_rank("price", ["week"])})


QUERIES = {
    f.__name__: f
    for f in (
        weekly_brand_metrics, weekly_cluster_metrics, weekly_cluster_metrics_all, strict_discussion_terms, weekly_trend_terms, cluster_discussion_terms, cluster_brand_mentions, high_precision_posts,
        cluster_quality, weekly_cluster_scores, weekly_trend_score, weekly_percentiles,
    )
}

_WEEK = "{0}::DATE - CAST((isodow({0}) + 5) % 7 AS INTEGER)"
BASE_SQL = (
    ASSIGN_SQL
    + ",\n"
    + SENTIMENT_SQL.split("\n", 2)[2]
    + f""",
base AS (SELECT s.mention_id, s.subreddit, s.title_clean, s.published_at, s.url,
  {_WEEK.format("(s.published_at AT TIME ZONE 'UTC')")} AS week_start, coalesce(s.score, 0) + coalesce(s.num_comments, 0) AS engagement,
  s.sentiment_compound, s.sentiment_label, a.final_cluster_id AS cluster_id, a.assignment_confidence, a.assignment_status, a.cluster_usage_tier
  FROM sentiments s LEFT JOIN assignments a USING (mention_id)),
gate AS (SELECT * FROM base WHERE trim(cluster_id) <> '' AND cluster_usage_tier IN ('strong_match', 'usable_match', 'weak_match') AND assignment_confidence >= 0)"""
)
_MEASURES = """count(mention_id) AS mentions, count(DISTINCT mention_id) AS unique_posts, round(avg(sentiment_compound), 9) AS avg_sentiment,
  round(avg(CASE WHEN coalesce(sentiment_label, '') = 'positive' THEN 1.0 ELSE 0.0 END), 9) AS positive_share,
  round(avg(CASE WHEN coalesce(sentiment_label, '') = 'negative' THEN 1.0 ELSE 0.0 END), 9) AS negative_share"""
_ENGAGED = """, count(DISTINCT subreddit) AS unique_subreddits, round(sum(engagement), 4) AS engagement_sum, round(avg(engagement), 9) AS engagement_avg"""


def _grown(source: str, keys: str, growth: str, ties: str, extra: str = "") -> str:
    return f""", m AS (SELECT week_start, {keys}, {_MEASURES}{extra} FROM {source} GROUP BY ALL),
    g AS (SELECT *, lag(mentions) OVER (PARTITION BY {growth} ORDER BY week_start NULLS FIRST{ties}) AS p FROM m)
    SELECT * EXCLUDE (p), round(coalesce((mentions - p)::DOUBLE / nullif(p, 0), 0), 9) AS wow_growth FROM g"""


_EVIDENCE = """,
allowed AS (SELECT * REPLACE (coalesce(nullif(brand_norm, ''), entity_norm) AS brand_norm, coalesce(nullif(brand_display, ''), entity_text) AS brand_display)
  FROM entity_mentions WHERE entity_type = 'brand' OR (review_status = 'candidate' AND entity_type IN ('unknown_candidate', 'product_line'))),
one AS (SELECT * FROM allowed QUALIFY row_number() OVER (PARTITION BY brand_norm, mention_id ORDER BY confidence DESC NULLS LAST, entity_text NULLS FIRST,
  brand_display NULLS FIRST, source NULLS FIRST, start_char NULLS FIRST, context_window NULLS FIRST, matched_cluster_id NULLS FIRST) = 1),
idx AS (SELECT mention_id, brand_norm, brand_display, in_platform_brand, base.* EXCLUDE (mention_id) FROM one LEFT JOIN base USING (mention_id))"""


def _trend(base: str) -> str:
    rank = lambda c: f"(rank() OVER (PARTITION BY week ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY week, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY week)"
    bucket = lambda c: f"CASE WHEN {c} >= 0.8 THEN 5 WHEN {c} >= 0.6 THEN 4 WHEN {c} >= 0.4 THEN 3 WHEN {c} >= 0.2 THEN 2 ELSE 1 END"
    r2 = lambda c, n=100: f"round_even(({c}) * {n}, 0) / {n}"
    return f"""{base},
    w AS (SELECT week, cluster_id, count(DISTINCT mention_id) AS current_week_posts, count(DISTINCT subreddit) AS unique_subreddits,
      round(avg(sentiment), 9) AS avg_sentiment, round(avg(ln(1 + greatest(engagement, 0))), 9) AS avg_log_engagement FROM src WHERE week IS NOT NULL GROUP BY ALL),
    p AS (SELECT w.*, coalesce(b.current_week_posts, 0) AS previous_week_posts FROM w LEFT JOIN w b ON b.week + 7 = w.week AND b.cluster_id = w.cluster_id),
    d AS (SELECT *, current_week_posts - previous_week_posts AS absolute_delta,
      (current_week_posts - previous_week_posts)::DOUBLE / greatest(previous_week_posts, 1) AS growth_rate FROM p),
    k AS (SELECT *, {rank("current_week_posts")} AS volume_percentile, {rank("growth_rate")} AS spike_percentile,
      {rank("unique_subreddits")} AS cross_community_percentile, {rank("avg_log_engagement")} AS engagement_percentile FROM d),
    b1 AS (SELECT *, {bucket("volume_percentile")} AS volume_bucket, {bucket("spike_percentile")} AS s0, {bucket("cross_community_percentile")} AS c0,
      {bucket("engagement_percentile")} AS e0 FROM k),
    b2 AS (SELECT * EXCLUDE (s0, c0, e0), least(s0, CASE WHEN current_week_posts < 3 THEN 2 ELSE 5 END, CASE WHEN previous_week_posts = 0 AND current_week_posts < 5 THEN 3 ELSE 5 END) AS spike_bucket,
      least(c0, CASE WHEN current_week_posts < 3 THEN 2 ELSE 5 END, CASE WHEN unique_subreddits = 1 THEN 2 WHEN unique_subreddits = 2 THEN 3 ELSE 5 END) AS cross_community_score,
      least(e0, CASE WHEN current_week_posts < 3 THEN 2 ELSE 5 END) AS engagement_score,
      CASE WHEN avg_sentiment IS NULL THEN 3.0 WHEN avg_sentiment >= 0 THEN {r2("3.0::DOUBLE + 2.0 * (least(avg_sentiment, 0.70::DOUBLE) / 0.70::DOUBLE)")}
        ELSE {r2("3.0::DOUBLE - 2.0 * (least(abs(avg_sentiment), 0.35::DOUBLE) / 0.35::DOUBLE)")} END AS sentiment_score FROM b1),
    b3 AS (SELECT *, {r2("0.60::DOUBLE * volume_bucket + 0.40::DOUBLE * spike_bucket")} AS momentum_score FROM b2),
    b4 AS (SELECT *, {r2("0.40::DOUBLE * momentum_score + 0.20::DOUBLE * sentiment_score + 0.20::DOUBLE * cross_community_score + 0.20::DOUBLE * engagement_score")} AS trend_score FROM b3)
    SELECT *, {r2("trend_score * 20", 10)} AS trend_score_100 FROM b4"""


_GATED = BASE_SQL + """, j AS (SELECT e.*, g.* EXCLUDE (mention_id) FROM (SELECT mention_id, entity_text, entity_norm, entity_type, brand_signal_type, brand_norm,
  brand_display, in_platform_brand, matched_cluster_id FROM entity_mentions) e JOIN gate g USING (mention_id))"""


def _listed(source: str, keys: list[str], modes: dict[str, str]) -> str:
    k = ", ".join(["week_start", *keys])
    same = " AND ".join(f"m.{c} IS NOT DISTINCT FROM {{0}}.{c}" for c in ["week_start", *keys])
    ctes, joins, columns = [], [], []
    for i, (out, column) in enumerate(modes.items()):
        ctes.append(
            f"""o{i} AS (SELECT {k}, {column} AS {out} FROM (SELECT {k}, {column}, count(*) AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY c DESC, {column}) = 1)"""
        )
        joins.append(f"LEFT JOIN o{i} ON {same.format(f'o{i}')}")
        columns.append(out)
    ctes.append(
        f"""ts AS (SELECT {k}, string_agg(subreddit || ':' || c, '|' ORDER BY r) AS top_subreddits FROM (SELECT {k}, subreddit, count(*) AS c,
        row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, subreddit) AS r FROM {source} WHERE trim(subreddit) <> '' GROUP BY {k}, subreddit) WHERE r <= 20 GROUP BY {k}),
        td AS (SELECT {k}, string_agg(t || ':' || c, '|' ORDER BY t || ':' || c) AS tiers FROM (SELECT {k}, cluster_usage_tier AS t, count(*) AS c FROM {source} GROUP BY ALL) GROUP BY {k}),
        sp AS (SELECT {k}, string_agg(mention_id, '|' ORDER BY mention_id) AS sample_post_ids FROM (SELECT * FROM {source}
          QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY mention_id) <= 10) GROUP BY {k})"""
    )
    joins += [f"LEFT JOIN {t} ON {same.format(t)}" for t in ("ts", "td", "sp")]
    return f", {', '.join(ctes)} SELECT m.*, {', '.join(columns)}, top_subreddits, tiers, sample_post_ids FROM m {' '.join(joins)}"


def _top_sql(source: str, value: str, where: str = "true", n: int = 10) -> str:
    return f"""(SELECT cluster_id, string_agg(v || ':' || c, '|' ORDER BY r) AS l FROM (SELECT cluster_id, {value} AS v, count(*) AS c,
      row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, {value}) AS r FROM {source} WHERE trim({value}) <> '' AND {where} GROUP BY 1, 2) WHERE r <= {n} GROUP BY 1)"""


def _spread_sql(value: str) -> str:
    return f"(SELECT cluster_id, string_agg(v || ':' || c, '|' ORDER BY v || ':' || c) AS l FROM (SELECT cluster_id, {value} AS v, count(*) AS c FROM gate GROUP BY 1, 2) GROUP BY 1)"


SQL = {
    "cluster_quality": BASE_SQL
    + f""", en AS (SELECT entity_norm, entity_type, brand_norm, cluster_id FROM entity_mentions JOIN gate USING (mention_id)),
    q AS (SELECT cluster_id, count(DISTINCT mention_id) AS posts, round(avg(assignment_confidence), 9) AS confidence FROM gate GROUP BY 1)
    SELECT q.*, a.l AS top_subreddits, b.l AS top_terms, c.l AS top_brands, d.l AS top_candidates, e.l AS tiers, f.l AS statuses, g.l AS sample_titles FROM q
    LEFT JOIN {_top_sql("gate", "subreddit")} a USING (cluster_id) LEFT JOIN {_top_sql("en", "entity_norm")} b USING (cluster_id)
    LEFT JOIN {_top_sql("en", "brand_norm", "entity_type = 'brand'")} c USING (cluster_id) LEFT JOIN {_top_sql("en", "entity_norm", "entity_type = 'unknown_candidate'")} d USING (cluster_id)
    LEFT JOIN {_spread_sql("cluster_usage_tier")} e USING (cluster_id) LEFT JOIN {_spread_sql("assignment_status")} f USING (cluster_id)
    LEFT JOIN (SELECT cluster_id, string_agg(title_clean, '|' ORDER BY mention_id) AS l FROM (SELECT * FROM gate WHERE trim(title_clean) <> ''
      QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY mention_id) <= 10) GROUP BY 1) g USING (cluster_id)""",
    "cluster_discussion_terms": _GATED
    + f", m AS (SELECT week_start, cluster_id, entity_type, entity_norm, {_MEASURES}, round(avg(assignment_confidence), 9) AS avg_assignment_confidence FROM j GROUP BY ALL)"
    + _listed("j", ["cluster_id", "entity_type", "entity_norm"], {"term": "entity_text", "entity_matched_cluster_id": "matched_cluster_id"}),
    "cluster_brand_mentions": _GATED
    + """, b AS (SELECT *, brand_signal_type IN ('confirmed_whitelist_brand', 'catalog_known_brand') AS known,
      CASE WHEN brand_signal_type IN ('confirmed_whitelist_brand', 'catalog_known_brand') THEN brand_norm ELSE entity_norm END AS identity_key
      FROM j WHERE entity_type IN ('brand', 'unknown_candidate') AND assignment_confidence >= CASE WHEN cluster_usage_tier = 'weak_match' THEN 0.25::DOUBLE ELSE 0.30::DOUBLE END),"""
    + f" m AS (SELECT week_start, cluster_id, brand_signal_type, identity_key, {_MEASURES}, bool_or(in_platform_brand) AS in_platform_brand FROM b GROUP BY ALL)"
    + _listed("b", ["cluster_id", "brand_signal_type", "identity_key"], {"bn": "brand_norm", "ct": "entity_text"})
    .replace("SELECT m.*, bn, ct,", """SELECT m.*, CASE WHEN brand_signal_type IN ('confirmed_whitelist_brand', 'catalog_known_brand') THEN bn ELSE '' END AS brand_norm,
      CASE WHEN brand_signal_type IN ('confirmed_whitelist_brand', 'catalog_known_brand') THEN '' ELSE ct END AS candidate_text,""").replace("o0.brand_signal_type IN", "brand_signal_type IN").replace("WHEN brand_signal_type", "WHEN m.brand_signal_type"),
    "weekly_brand_metrics": BASE_SQL + _EVIDENCE + _grown("idx", "brand_norm, brand_display, in_platform_brand", "brand_norm", ", brand_display NULLS FIRST, in_platform_brand NULLS FIRST", _ENGAGED),
    "weekly_cluster_metrics": BASE_SQL
    + ", cm AS (SELECT * FROM base WHERE trim(cluster_id) <> '' AND assignment_status <> 'unassigned')"
    + _grown("cm", "cluster_id", "cluster_id", "", _ENGAGED),
    "weekly_cluster_metrics_all": BASE_SQL
    + """, cm AS (SELECT * REPLACE (CASE WHEN trim(cluster_id) <> '' AND assignment_status <> 'unassigned' THEN cluster_id ELSE 'UNASSIGNED' END AS cluster_id) FROM base)"""
    + _grown("cm", "cluster_id", "cluster_id", "", _ENGAGED),
    "strict_discussion_terms": _GATED
    + f""", k AS (SELECT * FROM j WHERE cluster_usage_tier IN ('strong_match', 'usable_match')),
    m AS (SELECT week_start, cluster_id, entity_type, entity_norm, {_MEASURES}, round(avg(assignment_confidence), 9) AS avg_assignment_confidence FROM k GROUP BY ALL)"""
    + _listed("k", ["cluster_id", "entity_type", "entity_norm"], {"term": "entity_text", "entity_matched_cluster_id": "matched_cluster_id"}),
    "weekly_trend_terms": BASE_SQL
    + """, tt AS (SELECT e.mention_id, entity_text, entity_norm, entity_type, matched_cluster_id, week_start, sentiment_compound, sentiment_label
      FROM entity_mentions e LEFT JOIN base USING (mention_id))"""
    + _grown("tt", "entity_text, entity_norm, entity_type, matched_cluster_id", "entity_norm, entity_type", ", entity_text NULLS FIRST, matched_cluster_id NULLS FIRST"),
    "high_precision_posts": BASE_SQL + " SELECT mention_id, cluster_id, assignment_confidence, subreddit, url FROM base WHERE assignment_status = 'confident' AND trim(cluster_id) <> ''",
    "weekly_cluster_scores": _trend(BASE_SQL + ", src AS (SELECT week_start AS week, cluster_id, mention_id, subreddit, engagement, sentiment_compound AS sentiment FROM gate)"),
    "weekly_trend_score": _trend(
        f"WITH src AS (SELECT {_WEEK.format('ts')} AS week, event_type AS cluster_id, event_id AS mention_id, user_id AS subreddit, value AS engagement, round(value / 100, 6) - 0.5::DOUBLE AS sentiment FROM events)"
    ),
    "weekly_percentiles": f"""WITH w AS (SELECT {_WEEK.format("o_orderdate")} AS week, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL),
    p AS (SELECT w.*, coalesce(b.orders, 0) AS previous FROM w LEFT JOIN w b ON b.week + 7 = w.week AND b.o_orderpriority = w.o_orderpriority)
    SELECT *, (rank() OVER (PARTITION BY week ORDER BY orders) + (count(*) OVER (PARTITION BY week, orders) - 1) / 2.0::DOUBLE) / count(orders) OVER (PARTITION BY week) AS orders_rank,
      (rank() OVER (PARTITION BY week ORDER BY price) + (count(*) OVER (PARTITION BY week, price) - 1) / 2.0::DOUBLE) / count(price) OVER (PARTITION BY week) AS price_rank FROM p""",
}
