"""Queries over words, phrases and sentiment of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import ids, text
from tidewatch.operators import language as L
from tidewatch.storage import table


def combined() -> Column:
    return F.concat(F.coalesce("title_clean", F.lit("")), F.lit(". "), F.coalesce("text_clean", F.lit("")))


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of the accepted history, repeated rows once."""
    return table(spark, folder, "clean_reddit_posts").dropDuplicates(["mention_id"])


def post_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.token_lists(posts(spark, folder), F.lower(combined()))
    joined = {c: F.array_join(c, " ") for c in ("tokens", "tokens_no_stopwords")}
    grams = {c: F.array_join(c, "|") for c in ("noun_phrases", "bigrams", "trigrams")}
    return rows.select("mention_id", *[v.alias(k) for k, v in (joined | grams).items()])


def post_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.sentiment(posts(spark, folder), combined())
    numbers = [c for c in rows.columns if c.endswith("_count") or c.startswith("sentiment_")]
    return rows.select("mention_id", *numbers, F.array_join("matched_sentiment_phrases", "|").alias("matched"))


def sentiment_by_subreddit(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.sentiment(posts(spark, folder), combined())
    return rows.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("posts"),
        F.round(F.avg("sentiment_compound"), 6).alias("avg_sentiment"),
        F.round(F.avg((F.col("sentiment_label") == "positive").cast("double")), 6).alias("positive_share"),
        F.round(F.avg((F.col("sentiment_label") == "negative").cast("double")), 6).alias("negative_share"),
    )


def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Posts and occurrences of every word that isn't a stop word."""
    rows = L.token_lists(posts(spark, folder), F.lower(combined()))
    words = rows.select("mention_id", F.explode("tokens_no_stopwords").alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("mention_id").alias("posts"))


def language_shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), text.language(F.col("text")).alias("detected"))
    return rows.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("documents"))


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The surroundings of located entity mentions in their posts, and a snippet of each post."""
    found = table(spark, folder, "entity_mentions").where("start_char >= 0").select("mention_id", "start_char", "end_char").distinct()
    rows = found.join(posts(spark, folder).select("mention_id", "text_clean"), "mention_id")
    return rows.select(
        "mention_id",
        "start_char",
        "end_char",
        text.context(F.col("text_clean"), F.col("start_char"), F.col("end_char"), 80).alias("context"),
        text.snippet(F.col("text_clean"), 320).alias("snippet"),
    )


def alias_words(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases of every brand, cut at separators, with the address of a search for the brand."""
    rows = table(spark, folder, "brand_registry").select(
        "brand_norm",
        F.explode_outer("aliases").alias("alias"),
        ids.search_url(F.col("brand_norm")).alias("search_url"),
        ids.site_guess(F.col("brand_norm")).alias("site"),
    )
    return rows.select("brand_norm", "search_url", "site", F.array_join(text.split_aliases(F.col("alias")), "|").alias("parts"))


def brand_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form and display form of registry names."""
    return table(spark, folder, "brand_registry").select(
        "brand_norm", text.brand_form(F.col("brand_display")).alias("form"), text.brand_display(F.col("brand_display")).alias("display")
    )


def part_keywords(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", F.array_join(text.keywords(F.concat("p_name", F.lit(" and "), "p_type")), "|").alias("keywords"))
    return rows


def readable_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw titles and texts without markup."""
    rows = table(spark, folder, "clean_reddit_posts")
    return rows.select("mention_id", text.readable(F.col("title_raw")).alias("title"), text.readable(F.col("text_raw")).alias("text")).distinct()


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The content hash of every post, made from its texts' token forms."""
    rows = table(spark, folder, "clean_reddit_posts")
    return rows.select("mention_id", text.content_hash(F.col("title_clean"), F.col("text_clean")).alias("content_hash")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        post_tokens, post_sentiment, sentiment_by_subreddit, term_frequencies, language_shares, contexts, alias_words, brand_forms,
        part_keywords, readable_texts, content_hashes,
    )
}


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


POSTS_SQL = """posts AS (SELECT * FROM clean_reddit_posts QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY content_hash) = 1),
texts AS (SELECT *, coalesce(title_clean, '') || '. ' || coalesce(text_clean, '') AS body FROM posts)"""


def _grams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({tokens}) - {n - 1}, 0) + 1), lambda i: array_to_string({tokens}[i:i+{n - 1}], ' '))"


TOKENS_SQL = f"""{POSTS_SQL},
tokenized AS (SELECT *, regexp_extract_all(lower(body), '[A-Za-z][A-Za-z0-9''&+-]*') AS tokens FROM texts),
kept AS (SELECT *, list_filter(tokens, lambda t: NOT list_contains({_list(L.STOPWORDS)}, t) OR list_contains({_list(L.PROTECTED)}, t)) AS ns
         FROM tokenized)"""


def _hits(name: str) -> str:
    return f"list_filter({_list(L.PHRASES[name])}, lambda p: contains(low, p))"


SENTIMENT_SQL = f"""{POSTS_SQL},
lowered AS (SELECT *, lower(body) AS low FROM texts),
hits AS (SELECT *, {", ".join(f"{_hits(k)} AS h_{k}" for k in L.PHRASES)} FROM lowered),
scored AS (SELECT *, len(h_positive)::DOUBLE AS pos, len(h_negative)::DOUBLE AS neg,
  (len(h_positive) - len(h_negative))::DOUBLE / greatest(len(h_positive) + len(h_negative), 1) AS sentiment_compound FROM hits),
sentiments AS (SELECT *, CASE WHEN sentiment_compound >= 0.05 THEN 'positive' WHEN sentiment_compound <= -0.05 THEN 'negative'
  ELSE 'neutral' END AS sentiment_label FROM scored)"""

SQL = {
    # the tables hold what the reference's own cleaning gives
    "readable_texts": "SELECT DISTINCT mention_id, title_clean AS title, text_clean AS text FROM clean_reddit_posts",
    "content_hashes": "SELECT DISTINCT mention_id, content_hash FROM clean_reddit_posts",
    "post_tokens": f"""WITH {TOKENS_SQL} SELECT mention_id, array_to_string(tokens, ' ') AS tokens, array_to_string(ns, ' ') AS tokens_no_stopwords,
    array_to_string(list_filter({_grams("tokens", 2)}, lambda g: length(g) > 3)[1:40], '|') AS noun_phrases,
    array_to_string(({_grams("ns", 2)})[1:120], '|') AS bigrams, array_to_string(({_grams("ns", 3)})[1:120], '|') AS trigrams FROM kept""",
    "post_sentiment": f"""WITH {SENTIMENT_SQL} SELECT mention_id, sentiment_compound, pos AS sentiment_pos, neg AS sentiment_neg,
    CAST(pos = 0 AND neg = 0 AS INTEGER)::DOUBLE AS sentiment_neu, sentiment_label, len(h_positive) AS positive_word_count,
    len(h_negative) AS negative_word_count, len(h_purchase_intent) AS purchase_intent_count, len(h_complaint) AS complaint_count,
    len(h_comparison) AS comparison_count, len(h_viral) AS viral_signal_count,
    array_to_string(list_sort(list_distinct(list_concat(h_positive, h_negative, h_purchase_intent, h_complaint, h_comparison, h_viral))), '|') AS matched
    FROM sentiments""",
    "sentiment_by_subreddit": f"""WITH {SENTIMENT_SQL} SELECT subreddit, count(*) AS posts, round(avg(sentiment_compound), 6) AS avg_sentiment,
    round(avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END), 6) AS positive_share,
    round(avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END), 6) AS negative_share FROM sentiments GROUP BY subreddit""",
    "term_frequencies": f"""WITH {TOKENS_SQL}, words AS (SELECT mention_id, unnest(ns) AS word FROM kept)
    SELECT word, count(*) AS occurrences, count(DISTINCT mention_id) AS posts FROM words GROUP BY word""",
    "language_shares": """WITH s AS (SELECT coalesce(lang, '') AS lang, substr(coalesce(text, ''), 1, 1200) AS t FROM documents)
    SELECT lang, CASE WHEN trim(t) <> '' AND (len(regexp_extract_all(t, '[A-Za-z]'))::DOUBLE
      / greatest(len(regexp_extract_all(t, '[\\p{L}\\p{N}\\p{M}_]')), 1) > 0.55
      OR len(regexp_extract_all(lower(t), '\\b(the|and|is|it|this|that|for|with|not|you|my|i|to|of|in)\\b')) >= 2) THEN 'en' ELSE 'unknown' END AS detected,
      count(*) AS documents FROM s GROUP BY 1, 2""",
    "contexts": f"""WITH {POSTS_SQL}, f AS (SELECT DISTINCT mention_id, start_char, end_char FROM entity_mentions WHERE start_char >= 0),
    j AS (SELECT f.*, text_clean, trim(regexp_replace(text_clean, '\\s+', ' ', 'g')) AS q FROM f JOIN posts USING (mention_id))
    SELECT mention_id, start_char, end_char, trim(substr(text_clean, greatest(start_char - 80, 0) + 1,
      least(end_char + 80, length(text_clean)) - greatest(start_char - 80, 0))) AS context,
      CASE WHEN length(q) > 320 THEN rtrim(substr(q, 1, 317)) || '...' ELSE q END AS snippet FROM j""",
    "alias_words": """WITH r AS (SELECT brand_norm, unnest(CASE WHEN aliases IS NULL OR len(aliases) = 0 THEN [NULL] ELSE aliases END) AS alias FROM brand_registry)
    SELECT brand_norm, 'https://www.google.com/search?q=' || replace(url_encode(brand_norm || ' brand'), '%20', '+') AS search_url,
    CASE WHEN regexp_replace(lower(brand_norm), '[^a-z0-9]', '', 'g') <> '' THEN regexp_replace(lower(brand_norm), '[^a-z0-9]', '', 'g') || '.com' ELSE '' END AS site,
    array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(alias, ''), '[,;|]'), lambda p: trim(p)), lambda p: p <> ''), '|') AS parts FROM r""",
    "brand_forms": """WITH f AS (SELECT brand_norm, brand_display AS d, strip_accents(brand_display) AS s FROM brand_registry),
    g AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(s), '\\([^)]*\\)', ' ', 'g'),
      '(?i)\\b(inc|llc|ltd|limited|corp|corporation|co|company|official store|store)\\b\\.?', ' ', 'g'),
      '[^A-Za-z0-9&''+\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS form FROM f)
    SELECT brand_norm, form, CASE WHEN form = '' THEN '' ELSE trim(regexp_replace(d, '\\s+', ' ', 'g')) END AS display FROM g""",
    "part_keywords": """WITH t AS (SELECT p_partkey, list_transform(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(p_name || ' and ' || p_type),
      '[^a-z0-9\\s''&+-]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s*(?:,|\\||/|;|&|\\band\\b)\\s*'), lambda p: trim(p)) AS parts FROM part)
    SELECT p_partkey, array_to_string(list_filter(parts, lambda p, i: length(p) >= 3 AND NOT regexp_matches(p, '^[0-9]+$')
      AND NOT list_contains(['product','products','item','items','new','hot','best','other','general','misc','miscellaneous','sale','seller','shipping','free','quality'], p)
      AND list_position(parts, p) = i), '|') AS keywords FROM t""",
}
