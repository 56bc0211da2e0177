"""The weekly document whole: cards, keywords, brands, signals, evidence, distribution, meta and weeks, each also as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.ids import search_url, site_guess
from tidewatch.functions.text import snippet
from tidewatch.operators import bundle as B
from tidewatch.plans import metric_queries as M
from tidewatch.plans.bundle_queries import _BRANDS, _TERMS, _brands, _terms
from tidewatch.storage import pinned, table

CARDS, CARD_TERMS, KEYWORDS, EVIDENCE, LEAST = 40, 8, 120, 120, 20


class _Sources:
    """The tables of one document, made once: scores of full weeks, brand rows, terms, and evidence of brands."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        scores = M.weekly_cluster_scores(spark, folder).withColumn("week_start", F.date_format("week", "yyyy-MM-dd")).drop("week")
        self.scores = pinned(B.in_full_weeks(scores, LEAST), "week-scores")
        self.weeks = B.full_weeks(self.scores, LEAST).select("week_start")

    def of_weeks(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.weeks), "week_start", "left_semi")

    def brands(self) -> DataFrame:
        return self.of_weeks(_brands(self.spark, self.folder))

    def terms(self) -> DataFrame:
        return self.of_weeks(_terms(self.spark, self.folder))

    def evidence(self) -> DataFrame:
        """Posts that show a brand, with the brand's loose form and the key of the post: its id, else its address."""
        rows = M._indexed(self.spark, self.folder).withColumns(
            {
                "week_start": F.date_format("week_start", "yyyy-MM-dd"), "norm": B.loose_brand_form(F.col("brand_norm")),
                "post_key": F.coalesce(F.when(F.trim("mention_id") != "", F.col("mention_id")), F.col("url")),
            }
        )
        return self.of_weeks(rows).where("norm <> '' and trim(post_key) <> ''")


def _position(rows: DataFrame, n: int | None, *order, by=("week_start",)) -> DataFrame:
    out = rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col("position") <= n) if n else out


def _cards(s: _Sources) -> DataFrame:
    momentum = F.round(0.60 * F.col("volume_percentile") + 0.40 * F.col("spike_percentile"), 9)
    top = _position(s.scores, CARDS, F.desc("trend_score"), F.desc("current_week_posts"), "cluster_id")
    return top.select(
        "week_start", "position", "cluster_id", "trend_score", "trend_score_100", "momentum_score", "sentiment_score", "cross_community_score", "engagement_score",
        momentum.alias("momentum_percentile"), "cross_community_percentile", "current_week_posts", "previous_week_posts", "growth_rate", "unique_subreddits",
        "avg_sentiment", "avg_log_engagement",
    )


def _card_terms(s: _Sources) -> DataFrame:
    rows = s.terms().join(_cards(s).select("week_start", "cluster_id"), ["week_start", "cluster_id"], "left_semi")
    order = (F.desc("mentions"), F.desc("unique_posts"), "term_norm", "entity_type", "term")
    top = _position(rows, CARD_TERMS, *order, by=("week_start", "cluster_id"))
    return top.select("week_start", "cluster_id", "position", "term", "entity_type", "mentions", F.round("avg_sentiment", 9).alias("sentiment"))


def _signals(s: _Sources, keys: list[str]) -> DataFrame:
    """Signals with the canonical name of the brand; posts are those that show it, else the most any row counted."""
    rows = s.brands().withColumn("cluster_id", F.coalesce("cluster_id", F.lit("")))
    meta = B.canonical(rows)
    shown = s.evidence().withColumn("cluster_id", F.coalesce("cluster_id", F.lit("")))
    shown = shown.groupBy("week_start", *keys).agg(F.countDistinct("post_key").alias("_shown"))
    out = B.signals(rows, keys).join(shown, ["week_start", *keys], "left").join(meta, ["week_start", "norm"])
    out = out.withColumn("unique_posts", F.coalesce("_shown", "unique_posts")).drop("_shown")
    extra = [] if "cluster_id" in keys else [search_url(F.col("display")).alias("google_search_url"), F.concat(F.lit("https://"), site_guess(F.col("display"))).alias("logo_url"), "clusters", "spellings"]
    ranked = _position(out, None, F.desc("unique_posts"), F.desc("mentions"), "norm", *keys[:-1])
    return ranked.select("week_start", "position", *keys, "display", "brand_signal_type", "unique_posts", "mentions", "avg_sentiment", "positive_share", *extra)


def _evidence_rows(s: _Sources) -> DataFrame:
    order = (F.desc_nulls_last("published_at"), "mention_id", "norm", "brand_display")
    top = _position(s.evidence(), EVIDENCE, *order)
    return top.select(
        "week_start", "position", "norm", "brand_display", "cluster_id", F.col("title_clean").alias("title"), "subreddit", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        "url", "sentiment_label", F.round("sentiment_compound", 6).alias("sentiment_compound"), snippet(F.col("title_clean"), 80).alias("snippet"),
    )


def _distribution(s: _Sources) -> DataFrame:
    """Clusters per week and band of the trend score; empty bands are kept."""
    over = F.size(F.filter(F.array(*[F.lit(float(e)) for e in B.EDGES]), lambda e: F.col("trend_score") > e))
    band = F.greatest(over, F.lit(1)).alias("position")
    counts = s.scores.groupBy("week_start", band).agg(F.count(F.lit(1)).alias("c"))
    every = s.spark.createDataFrame([(i, b) for i, b in enumerate(B.LABELS, 1)], "position int, band string")
    # weeks are few and bands seven
    grid = s.weeks.select("week_start", F.explode(F.array(*[F.lit(i) for i in range(1, len(B.LABELS) + 1)])).alias("position")).join(F.broadcast(every), "position")
    return grid.join(counts, ["week_start", "position"], "left").select("week_start", "position", "band", F.coalesce("c", F.lit(0)).alias("count"))


def _mean_of_hundredths(c: str):
    """Mean to two digits of values that have two; sums of whole numbers, so that no order of adding tips a tie."""
    return F.floor(F.sum(F.round(F.col(c) * 100).cast("long")) / F.count(c) + 0.5) / 100


def _meta(s: _Sources) -> DataFrame:
    clusters = s.scores.groupBy("week_start").agg(
        F.countDistinct("cluster_id").alias("cluster_count"), _mean_of_hundredths("trend_score").alias("avg_trend_score"), F.round(F.max("trend_score"), 2).alias("max_trend_score")
    )
    posts = M.posts(s.spark, s.folder).withColumn("week_start", F.date_format(M.week_start(F.col("published_at")), "yyyy-MM-dd"))
    key = F.coalesce(F.when(F.trim("mention_id") != "", F.col("mention_id")), F.when(F.trim("url") != "", F.col("url")))
    posts = posts.groupBy("week_start").agg(F.countDistinct(key).alias("weekly_post_count"))
    rows = s.brands().withColumn("cluster_id", F.coalesce("cluster_id", F.lit("")))
    brands = rows.groupBy("week_start").agg(F.countDistinct("cluster_id", "norm").alias("weekly_brand_signal_count"), F.countDistinct("norm").alias("weekly_unique_brand_count"))
    names = ("verified_brand_count", "known_brand_count", "candidate_brand_count")
    kinds = B.canonical(rows).groupBy("week_start").agg(*[F.count_if(F.col("brand_signal_type") == k).alias(n) for n, k in zip(names, B.PRIORITY, strict=True)])
    terms = s.terms().groupBy("week_start").agg(F.count(F.lit(1)).alias("term_signal_count"))
    out = clusters
    for part in (posts, brands, kinds, terms):
        out = out.join(part, "week_start", "left")
    counts = [c for c in out.columns if c.endswith("_count")]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def _keywords(s: _Sources) -> DataFrame:
    order = (F.desc("mentions"), F.desc("unique_posts"), "term_norm", "entity_type", "cluster_id", "term")
    return _position(s.terms(), KEYWORDS, *order).select("week_start", "position", "term", "term_norm", "entity_type", "cluster_id", "mentions", F.round("avg_sentiment", 9).alias("sentiment"))


def _query(part):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return part(_Sources(spark, folder))

    query.__doc__ = part.__doc__
    return query


def _brand_signals(s: _Sources) -> DataFrame:
    return _signals(s, ["norm"])


def _cluster_signals(s: _Sources) -> DataFrame:
    return _signals(s, ["cluster_id", "norm"])


def dashboard_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON document of every full week, with all eight sections."""
    s = _Sources(spark, folder)
    signals = pinned(_cluster_signals(s), "cluster-signals")
    terms = B.listed(_card_terms(s), ["week_start", "cluster_id"], "terms")
    brands = B.listed(signals, ["week_start", "cluster_id"], "brands")
    cards = _cards(s).join(terms, ["week_start", "cluster_id"], "left").join(brands, ["week_start", "cluster_id"], "left")
    parts = {"clusters": cards, "keywords": _keywords(s), "brands": _brand_signals(s), "cluster_brand_signals": signals, "posts": _evidence_rows(s), "trend_distribution": _distribution(s)}
    weeks = s.weeks.agg(F.sort_array(F.collect_list("week_start"), asc=False).alias("weeks"))
    return B.documents(s.weeks.join(F.broadcast(weeks)), parts, _meta(s))


QUERIES = {
    "week_cards": _query(_cards), "week_card_terms": _query(_card_terms), "week_brand_signals": _query(_brand_signals), "week_cluster_signals": _query(_cluster_signals),
    "week_evidence": _query(_evidence_rows), "week_distribution": _query(_distribution), "week_summary": _query(_meta), "week_keywords": _query(_keywords),
    "dashboard_documents": dashboard_documents,
}

_SC = f"""WITH sc0 AS ({M.SQL["weekly_cluster_scores"]}),
sc AS (SELECT strftime(week, '%Y-%m-%d') AS week_start, * EXCLUDE (week) FROM sc0),
wk AS (SELECT week_start FROM sc GROUP BY 1 HAVING count(DISTINCT cluster_id) >= {LEAST}),
fs AS (SELECT * FROM sc WHERE week_start IN (FROM wk))"""
_T = f"tm AS (SELECT * FROM ({_TERMS} SELECT * FROM t) WHERE week_start IN (FROM wk))"
_B = ", ".join(
    (
        f"bm AS (SELECT * REPLACE (coalesce(cluster_id, '') AS cluster_id) FROM ({_BRANDS} SELECT * FROM br) WHERE week_start IN (FROM wk))",
        f"""cn AS (SELECT week_start, norm, coalesce(nullif(trim(regexp_replace(display, '[^\\p{{L}}\\p{{N}}\\p{{M}}_)&+''®™]+$', '')), ''), display) AS display, brand_signal_type FROM bm
        QUALIFY row_number() OVER (PARTITION BY week_start, norm ORDER BY priority, unique_posts DESC NULLS LAST, mentions DESC NULLS LAST, display, brand_signal_type) = 1)""",
    )
)
_E = f"""ei AS ({M.BASE_SQL}{M._EVIDENCE} SELECT * FROM idx),
ev AS (SELECT * REPLACE (strftime(week_start, '%Y-%m-%d') AS week_start), trim(regexp_replace(regexp_replace(lower(coalesce(brand_norm, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s-]+', ' ', 'g'),
  '[\\s_-]+', ' ', 'g')) AS norm, coalesce(nullif(trim(mention_id), ''), url) AS post_key FROM ei),
es AS (SELECT * FROM ev WHERE week_start IN (FROM wk) AND norm <> '' AND trim(post_key) <> '')"""
_CARD = f"""cd AS (SELECT week_start, row_number() OVER (PARTITION BY week_start ORDER BY trend_score DESC, current_week_posts DESC, cluster_id) AS position, cluster_id, trend_score, trend_score_100,
  momentum_score, sentiment_score, cross_community_score, engagement_score, round(0.60::DOUBLE * volume_percentile + 0.40::DOUBLE * spike_percentile, 9) AS momentum_percentile,
  cross_community_percentile, current_week_posts, previous_week_posts, growth_rate, unique_subreddits, avg_sentiment, avg_log_engagement FROM fs QUALIFY position <= {CARDS})"""


def _signal_sql(keys: str, extra: str, ties: str) -> str:
    join = " AND ".join(f"g.{k.strip()} = h.{k.strip()}" for k in ["week_start", *keys.split(",")])
    return f"""{_SC}, {_B}, {_E},
    g AS (SELECT week_start, {keys}, CAST(sum(mentions) AS BIGINT) AS mentions, max(unique_posts) AS most, count(DISTINCT cluster_id) AS clusters,
      round(sum(avg_sentiment * greatest(mentions, 1)) / sum(greatest(mentions, 1)), 9) AS avg_sentiment,
      round(sum(positive_share * greatest(mentions, 1)) / sum(greatest(mentions, 1)), 9) AS positive_share,
      coalesce(array_to_string(list_sort(list(DISTINCT trim(display)) FILTER (WHERE trim(display) <> '')), '|'), '') AS spellings FROM bm GROUP BY ALL),
    h AS (SELECT week_start, {keys.replace("cluster_id", "coalesce(cluster_id, '') AS cluster_id")}, count(DISTINCT post_key) AS shown FROM es GROUP BY ALL),
    s AS (SELECT g.*, coalesce(h.shown, g.most) AS unique_posts FROM g LEFT JOIN h ON {join}),
    n AS (SELECT s.*, cn.display, cn.brand_signal_type FROM s JOIN cn USING (week_start, norm))
    SELECT week_start, row_number() OVER (PARTITION BY week_start ORDER BY unique_posts DESC NULLS LAST, mentions DESC NULLS LAST, norm{ties}) AS position, {keys}, display, brand_signal_type,
      unique_posts, mentions, avg_sentiment, positive_share{extra} FROM n"""


_SITE = """CASE WHEN lower(trim(display)) = 'saint laurent' THEN 'ysl.com' WHEN regexp_replace(lower(trim(display)), '[^a-z0-9]', '', 'g') = '' THEN ''
  ELSE regexp_replace(lower(trim(display)), '[^a-z0-9]', '', 'g') || '.com' END"""

SQL = {
    "week_cards": f"{_SC}, {_CARD} SELECT * FROM cd",
    "week_card_terms": f"""{_SC}, {_T}, {_CARD} SELECT week_start, cluster_id, row_number() OVER (PARTITION BY week_start, cluster_id ORDER BY mentions DESC, unique_posts DESC NULLS LAST,
      term_norm NULLS FIRST, entity_type NULLS FIRST, term NULLS FIRST) AS position, term, entity_type, mentions, round(avg_sentiment, 9) AS sentiment
      FROM tm SEMI JOIN cd USING (week_start, cluster_id) QUALIFY position <= {CARD_TERMS}""",
    "week_brand_signals": _signal_sql(
        "norm", f", 'https://www.google.com/search?q=' || replace(replace(url_encode(display || ' brand'), '%20', '+'), '%2A', '*') AS google_search_url, 'https://' || {_SITE} AS logo_url, clusters, spellings", ""
    ),
    "week_cluster_signals": _signal_sql("cluster_id, norm", "", ", cluster_id"),
    "week_evidence": f"""{_SC}, {_E} SELECT week_start, row_number() OVER (PARTITION BY week_start ORDER BY published_at DESC NULLS LAST, mention_id, norm, brand_display NULLS FIRST) AS position,
      norm, brand_display, cluster_id, title_clean AS title, subreddit, strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS published_at, url, sentiment_label,
      round(sentiment_compound, 6) AS sentiment_compound, CASE WHEN length(trim(regexp_replace(coalesce(title_clean, ''), '\\s+', ' ', 'g'))) > 80
        THEN rtrim(substr(trim(regexp_replace(title_clean, '\\s+', ' ', 'g')), 1, 77)) || '...' ELSE trim(regexp_replace(coalesce(title_clean, ''), '\\s+', ' ', 'g')) END AS snippet
      FROM es QUALIFY position <= {EVIDENCE}""",
    "week_distribution": f"""{_SC}, v AS (SELECT * FROM (VALUES (1, '1-2', -0.1, 2.0), (2, '2-2.5', 2.0, 2.5), (3, '2.5-3', 2.5, 3.0), (4, '3-3.5', 3.0, 3.5), (5, '3.5-4', 3.5, 4.0),
      (6, '4-4.5', 4.0, 4.5), (7, '4.5-5', 4.5, 5.01)) x(position, band, lo, hi))
    SELECT w.week_start, position, band, count(fs.trend_score) AS count FROM wk w CROSS JOIN v LEFT JOIN fs ON fs.week_start = w.week_start AND trend_score > lo AND trend_score <= hi GROUP BY ALL""",
    "week_summary": f"""{_SC}, {_T}, {_B},
    c AS (SELECT week_start, count(DISTINCT cluster_id) AS cluster_count, floor(CAST(sum(CAST(round(trend_score * 100) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 100 AS avg_trend_score, round(max(trend_score), 2) AS max_trend_score FROM fs GROUP BY 1),
    p AS (SELECT strftime((published_at AT TIME ZONE 'UTC')::DATE - CAST((isodow(published_at AT TIME ZONE 'UTC') + 5) % 7 AS INTEGER), '%Y-%m-%d') AS week_start,
      count(DISTINCT coalesce(nullif(trim(mention_id), ''), nullif(trim(url), ''))) AS weekly_post_count FROM clean_reddit_posts GROUP BY 1),
    b AS (SELECT week_start, count(DISTINCT (cluster_id, norm)) AS weekly_brand_signal_count, count(DISTINCT norm) AS weekly_unique_brand_count FROM bm GROUP BY 1),
    k AS (SELECT week_start, count(*) FILTER (WHERE brand_signal_type = 'confirmed_whitelist_brand') AS verified_brand_count, count(*) FILTER (WHERE brand_signal_type = 'catalog_known_brand')
      AS known_brand_count, count(*) FILTER (WHERE brand_signal_type = 'candidate_non_whitelist_brand') AS candidate_brand_count FROM cn GROUP BY 1),
    t AS (SELECT week_start, count(*) AS term_signal_count FROM tm GROUP BY 1)
    SELECT c.*, coalesce(weekly_post_count, 0) AS weekly_post_count, coalesce(weekly_brand_signal_count, 0) AS weekly_brand_signal_count, coalesce(weekly_unique_brand_count, 0)
      AS weekly_unique_brand_count, coalesce(verified_brand_count, 0) AS verified_brand_count, coalesce(known_brand_count, 0) AS known_brand_count,
      coalesce(candidate_brand_count, 0) AS candidate_brand_count, coalesce(term_signal_count, 0) AS term_signal_count
    FROM c LEFT JOIN p USING (week_start) LEFT JOIN b USING (week_start) LEFT JOIN k USING (week_start) LEFT JOIN t USING (week_start)""",
    "week_keywords": f"""{_SC}, {_T} SELECT week_start, row_number() OVER (PARTITION BY week_start ORDER BY mentions DESC, unique_posts DESC NULLS LAST, term_norm NULLS FIRST,
      entity_type NULLS FIRST, cluster_id NULLS FIRST, term NULLS FIRST) AS position, term, term_norm, entity_type, cluster_id, mentions, round(avg_sentiment, 9) AS sentiment
      FROM tm QUALIFY position <= {KEYWORDS}""",
}
