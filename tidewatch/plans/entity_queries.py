"""Queries over entities of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import catalog as C
from tidewatch.operators import entities as E
from tidewatch.operators.rows import keep_one
from tidewatch.plans.catalog_queries import products
from tidewatch.plans.text_queries import POSTS_SQL, combined, posts
from tidewatch.storage import table


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    form = F.trim(F.regexp_replace(F.lower(combined()), "[^a-z0-9]+", " "))
    return posts(spark, folder).select("mention_id", combined().alias("body"), form.alias("form"))


def alias_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases and names of the registry found in posts."""
    rows = table(spark, folder, "brand_registry")
    names = rows.select("brand_norm", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("brand_norm"))).alias("alias"))
    form = F.trim(F.regexp_replace(F.lower("alias"), "[^a-z0-9]+", " "))
    names = names.select(form.alias("alias_norm"), "brand_norm").where("alias_norm <> ''").distinct()
    return E.alias_hits(_forms(spark, folder), names).drop("start", "end")


def catalog_hits(spark: SparkSession, folder: str) -> DataFrame:
    return E.greedy_hits(_forms(spark, folder), table(spark, folder, "brand_registry")).drop("start", "end")


def rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = posts(spark, folder).select("mention_id", F.lower(combined()).alias("low"))
    return E.rule_hits(rows, F.col("low"))


def phrase_usefulness(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entity_mentions").select("entity_norm").where("trim(entity_norm) <> ''").distinct()
    return rows.select("entity_norm", E.useful_phrase(F.col("entity_norm")).alias("useful"))


def name_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return E.candidates(_forms(spark, folder), table(spark, folder, "brand_registry"))


def extracted_entities(spark: SparkSession, folder: str) -> DataFrame:
    """All entities of all posts by every rule, with their 19 columns."""
    registry = table(spark, folder, "brand_registry")
    terms = E.cluster_terms(C.cluster_profiles(products(spark, folder)))
    return E.extracted(_forms(spark, folder), registry, C.alias_lookup(registry), terms)


def distinct_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One mention per post, norm, type and source, the most confident."""
    order = [F.desc("confidence"), F.asc("start_char"), F.asc("entity_text"), F.asc("context_window")]
    rows = keep_one(table(spark, folder, "entity_mentions"), ["mention_id", "entity_norm", "entity_type", "source"], order)
    return rows.select("mention_id", "entity_norm", "entity_type", "source", "confidence", "start_char")


def _post_side(spark: SparkSession, folder: str) -> DataFrame:
    return posts(spark, folder).select("mention_id", F.col("title_clean").alias("title"), combined().alias("body"), "subreddit", "published_at", "url", "score", "num_comments")


def brand_post_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.evidence(table(spark, folder, "entity_mentions"), _post_side(spark, folder))
    return rows.select("brand_norm", "mention_id", "brand_display", "entity_type", "confidence", "title", "text_snippet", "subreddit", "engagement_score")


def orphan_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions per type whose post is accepted, and whose isn't, by semi- and anti-join."""
    mentions, known = table(spark, folder, "entity_mentions"), posts(spark, folder).select("mention_id")
    has = mentions.join(known, "mention_id", "left_semi").groupBy("entity_type").agg(F.count(F.lit(1)).alias("with_post"))
    lost = mentions.join(known, "mention_id", "left_anti").groupBy("entity_type").agg(F.count(F.lit(1)).alias("without_post"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("with_post", "without_post")]
    return has.join(lost, "entity_type", "full").select("entity_type", *zero)


QUERIES = {
    f.__name__: f
    for f in (alias_hits, catalog_hits, rule_hits, phrase_usefulness, name_candidates, extracted_entities, distinct_entities, brand_post_index, orphan_mentions)
}


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_RULES = " UNION ALL ".join(
    f"SELECT mention_id, '{p}' AS entity_text, '{kind}' AS entity_type, CAST({conf} AS DOUBLE) AS confidence, '{source}' AS source FROM l"
    f" WHERE regexp_matches(low, '(^|[^a-z0-9]){p}([^a-z0-9]|$)')"
    for kind, conf, source, phrases in E.RULES
    for p in phrases
)
_BARE = f"trim(regexp_replace(n, '{E.POSSESSIVE}', ''))"
EVIDENCE_SQL = f"""{POSTS_SQL},
allowed AS (SELECT * REPLACE (coalesce(nullif(brand_norm, ''), entity_norm) AS brand_norm, coalesce(nullif(brand_display, ''), entity_text) AS brand_display)
  FROM entity_mentions WHERE entity_type = 'brand' OR (review_status = 'candidate' AND entity_type IN ('unknown_candidate', 'product_line'))),
one AS (SELECT * FROM allowed QUALIFY row_number() OVER (PARTITION BY brand_norm, mention_id ORDER BY confidence DESC NULLS LAST, entity_text NULLS FIRST,
  brand_display NULLS FIRST, source NULLS FIRST, start_char NULLS FIRST, context_window NULLS FIRST, matched_cluster_id NULLS FIRST) = 1),
evidence AS (SELECT one.*, t.title_clean AS title, t.subreddit, t.published_at, t.url, t.body, trim(regexp_replace(coalesce(t.body, ''), '\\s+', ' ', 'g')) AS q,
  coalesce(t.score, 0) + coalesce(t.num_comments, 0) AS engagement_score FROM one LEFT JOIN texts t USING (mention_id))"""

SQL = {
    "alias_hits": f"""WITH {POSTS_SQL}, w AS (SELECT mention_id, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM texts),
    r AS (SELECT mention_id, i AS place, array_to_string(t[i:i+k-1], ' ') AS run FROM w, range(1, 4) n(k), unnest(range(1, greatest(len(t) - k + 1, 0) + 1)) u(i)),
    a AS (SELECT DISTINCT trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS alias_norm, brand_norm
      FROM (SELECT brand_norm, unnest(list_append(coalesce(aliases, []), brand_norm)) AS alias FROM brand_registry)),
    u AS (SELECT * FROM a WHERE alias_norm <> '' AND (length(replace(alias_norm, ' ', '')) >= 3 OR alias_norm IN ({_quoted(E.SHORT_ALIASES)})))
    SELECT mention_id, alias_norm, brand_norm, min(place) AS place FROM r JOIN u ON run = alias_norm GROUP BY ALL""",
    "rule_hits": f"WITH {POSTS_SQL}, l AS (SELECT mention_id, lower(body) AS low FROM texts) {_RULES}",
    "phrase_usefulness": f"""WITH d AS (SELECT DISTINCT entity_norm AS n FROM entity_mentions WHERE trim(entity_norm) <> ''),
    p AS (SELECT n, regexp_split_to_array(n, ' +') AS parts FROM d)
    SELECT n AS entity_norm, length(n) >= 4 AND regexp_matches(n, '[a-z]') AND len(list_filter(parts, lambda p: p NOT IN ({_quoted(E.GENERIC)}))) > 0
      AND n NOT IN ({_quoted(E.PRONOUNS)}) AND len(list_filter(parts, lambda p: p NOT IN ({_quoted(E.PRONOUNS)}))) > 0
      AND n NOT IN ({_quoted(E.SENTIMENT_ONLY)}) AND {_BARE} NOT IN ({_quoted(E.VAGUE_NOUNS)}) AS useful FROM p""",
    "distinct_entities": """SELECT mention_id, entity_norm, entity_type, source, confidence, start_char FROM entity_mentions
    QUALIFY row_number() OVER (PARTITION BY mention_id, entity_norm, entity_type, source
      ORDER BY confidence DESC NULLS LAST, start_char NULLS FIRST, entity_text NULLS FIRST, context_window NULLS FIRST) = 1""",
    "brand_post_index": f"""WITH {EVIDENCE_SQL} SELECT brand_norm, mention_id, brand_display, entity_type, confidence, title,
    CASE WHEN length(q) > 320 THEN rtrim(substr(q, 1, 317)) || '...' ELSE q END AS text_snippet, subreddit, engagement_score FROM evidence""",
    "orphan_mentions": """SELECT entity_type, count(*) FILTER (WHERE mention_id IN (SELECT mention_id FROM clean_reddit_posts)) AS with_post,
    count(*) FILTER (WHERE mention_id IS NULL OR mention_id NOT IN (SELECT mention_id FROM clean_reddit_posts)) AS without_post
    FROM entity_mentions GROUP BY entity_type""",
}
