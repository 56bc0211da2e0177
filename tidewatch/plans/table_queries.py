"""Queries over table-level operators: JSON lists, numbering, windows, records, audits, logos, writers and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import ids, text, times
from tidewatch.functions.lists import json_list, json_only, json_rows, parsed_list
from tidewatch.operators import posts as P
from tidewatch.operators.rows import first_filled_value, head, keep_one, numbered, versioned
from tidewatch.sources import sinks, tables
from tidewatch.storage import scratch, table
from tidewatch.streaming import incremental as I

AS_OF = "2026-05-20 00:00:00+00:00"


def json_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases of every brand as a JSON list, whole and cut to one."""
    rows = table(spark, folder, "brand_registry")
    return rows.select("brand_norm", json_list(F.col("aliases")).alias("aliases"), json_list(F.col("related_cluster_ids"), 1).alias("first_cluster"))


def parsed_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Values of JSON lists, of lists in older forms, and of JSON lists only."""
    rows = table(spark, folder, "weekly_cluster_discussion_terms").select("sample_post_ids", "term", "entity_type").distinct()
    older = F.concat_ws("; ", F.col("term"), F.lit(" "), F.col("entity_type"))
    return rows.select(
        "term", "sample_post_ids", "entity_type",
        F.array_join(parsed_list(F.col("sample_post_ids")), "+").alias("ids"), F.array_join(parsed_list(older), "+").alias("parts"),
        F.size(json_only(F.col("sample_post_ids"))).alias("n"), F.size(json_only(older)).alias("none"),
    )


def numbered_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Products with running numbers in order of brand, name and key, their cleaned title, and the version of the table."""
    rows = table(spark, folder, "part").select("p_partkey", "p_brand", F.concat(F.lit("Hot SALE "), "p_name", F.lit(" <b>wholesale</b>  2026 New")).alias("title"))
    out = versioned(numbered(rows, ["p_brand", "title", "p_partkey"]), "v1")
    return out.select("row_id", "p_partkey", text.product_name(F.col("title")).alias("product_name"), "version", F.col("created_at").isNotNull().alias("stamped"))


def first_posts(spark: SparkSession, folder: str, n: int = 200) -> DataFrame:
    """The sample of a stage: its first rows in order of time and id."""
    rows = table(spark, folder, "clean_reddit_posts").dropDuplicates(["mention_id"])
    return head(rows, n, F.col("published_at"), F.col("mention_id")).select("mention_id", "subreddit", times.utc_text(F.col("published_at")).alias("published"))


def run_windows(spark: SparkSession, folder: str) -> DataFrame:
    """For every order date the window of a live run of two days and of the week before, and that week found by its label."""
    day = F.to_date("o_orderdate")
    start, end = times.live_window(day, 2)
    monday, sunday, label = times.previous_week(day)
    rows = table(spark, folder, "orders").select(day.alias("day"), start.alias("live_start"), end.alias("live_end"), monday.alias("week_first"), sunday.alias("week_last"), label.alias("week"))
    first, last = times.iso_week(F.col("week"))
    return rows.distinct().select("*", first.alias("label_first"), last.alias("label_last"))


def first_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Per id the first community and title that aren't blank, by time of collection."""
    rows = table(spark, folder, "raw_reddit_posts").where("trim(mention_id) <> ''")
    order = F.struct(F.coalesce(F.col("collected_at"), F.lit("")), F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("community"), F.lit("")))
    return rows.groupBy("mention_id").agg(first_filled_value("community", order).alias("community"), first_filled_value("title", order).alias("title"))


def brands_with_logos(spark: SparkSession, folder: str) -> DataFrame:
    """Brand mentions with the logo of their brand, one per brand in the lookup; candidates and brands without one stay."""
    logos = table(spark, folder, "brand_registry").where("is_whitelist_brand")
    logos = keep_one(logos.select("brand_norm", F.concat(F.lit("https://"), ids.site_guess(F.col("brand_display")), F.lit("/logo")).alias("logo_url")), ["brand_norm"], [F.col("logo_url")])
    rows = table(spark, folder, "entity_mentions").where("entity_type in ('brand', 'unknown_candidate')").select("mention_id", "entity_text", "brand_norm").distinct()
    return rows.join(logos, "brand_norm", "left").withColumn("logo_url", F.coalesce("logo_url", F.lit("")))


def built_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the raw contract made from what a source answers."""
    raw = table(spark, folder, "raw_reddit_posts")
    answers = raw.select(
        F.col("source_record_id").alias("reddit_id"), "title", "text", "author", "community", "published_at", "url", F.col("engagement_score").alias("engagement"), "collected_at",
        F.struct(F.get_json_object("metrics_json", "$.score").cast("double").alias("score")).alias("metrics"),
    )
    rows = P.record("reddit_json", "reddit", "run_1", answers)
    return rows.select("mention_id", "source_record_id", "canonical_url", "sub_source", "title", "text", "full_text", "event_date", "ingestion_date", "engagement_score", "metrics_json").distinct()


def _runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows of the last collections, and of those before."""
    raw = table(spark, folder, "raw_reddit_posts").where("trim(mention_id) <> '' and lower(trim(mention_id)) <> 'nan'")
    cut = F.col("ingestion_run_id") >= "run_20260501"
    return raw.where(cut), raw.where(~cut)


def new_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of the last collections that earlier ones don't have, each once, official answers before feeds and archives."""
    batch, known = _runs(spark, folder)
    rank = F.when(F.col("source") == "reddit_json", 0).when(F.col("source") == "reddit_rss", 1).otherwise(2)
    order = [rank, F.col("collected_at").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("text").asc_nulls_last(), F.col("url").asc_nulls_last()]
    return P.new_records(batch, known, order).select("mention_id", "source", "title")


def collection_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the last collections per run and community."""
    batch, known = _runs(spark, folder)
    return P.audit(batch, known, ["ingestion_run_id", "sub_source"])


def stream_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the raw batches as a stream, over all its micro-batches; ids are distinct within each."""
    stream = I.file_stream(spark, f"{folder}/raw_reddit_posts.parquet").withColumn("t", times.instant(F.col("published_at")))
    rows = I.batch_counters(stream, "mention_id", "t")
    return rows.agg(F.sum("records_seen").alias("records_seen"), F.sum("without_id").alias("without_id"), F.sum("unreadable").alias("unreadable"))


def stream_rescan(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of the last 21 days before a day, each once, however often they were collected in it."""
    stream = I.file_stream(spark, f"{folder}/raw_reddit_posts.parquet").withColumn("t", times.instant(F.col("published_at"))).where("trim(mention_id) <> ''")
    rows = I.rescanned(stream.select("mention_id", "t"), "mention_id", "t", F.to_timestamp(F.lit(AS_OF)), 21)
    return I.drained(rows, "append").select("mention_id")


def written_and_read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows through the writers and readers: two partitioned appends of a contract, read back with the source file's mode
    and window; a table written in order; a text form."""
    raw = table(spark, folder, "raw_reddit_posts").where("trim(mention_id) <> ''")
    contract = T.StructType([T.StructField(n, T.StringType()) for n in ("mention_id", "title", "community", "collected_at", "absent")])
    order = [F.desc_nulls_last("collected_at"), F.desc_nulls_last("title"), F.desc_nulls_last("community")]
    home = scratch(spark, "round-trip")
    for mode, part in (("daily", raw.where("source = 'reddit_json'")), ("backfill", raw.where("source <> 'reddit_json'"))):
        sinks.append_batch(part, f"{home}/raw", mode, "w1", contract, order)
    back = spark.read.parquet(f"{home}/raw")
    sinks.sorted_table(back.select("mention_id", "title", "community", "mode", "absent"), f"{home}/sorted", F.col("mode"), F.col("mention_id"))
    sinks.csv_view(spark.read.parquet(f"{home}/sorted").groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("mention_id").alias("ids"), F.count("absent").alias("absent"), F.max("title").alias("title")), f"{home}/table.csv")
    found = tables.any_table(spark, f"{home}/table.csv")
    return found.select("mode", F.col("rows").cast("long"), F.col("ids").cast("long"), F.col("absent").cast("long"), "title")


def term_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Per week and cluster the ten most mentioned terms as a JSON list of objects."""
    rows = table(spark, folder, "weekly_cluster_discussion_terms").where("mentions is not null and trim(cluster_id) <> ''")
    terms = rows.groupBy("week_start", "cluster_id", "term_norm").agg(F.max("mentions").alias("mentions")).where("term_norm is not null")
    listed = terms.groupBy("week_start", "cluster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("m"), "term_norm", "mentions"))).alias("t"))
    objects = F.transform(F.slice("t", 1, 10), lambda x: F.struct(x["term_norm"].alias("value"), x["mentions"].alias("count")))
    return listed.select("week_start", "cluster_id", json_rows(objects).alias("terms"))


def registry_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Brands of the registry: rows, distinct names, those in both sources and in one, missing and repeated display names."""
    rows = table(spark, folder, "brand_registry")
    shown = F.lower(F.trim("brand_display"))
    repeated = rows.where(shown != "").groupBy(shown.alias("d")).count().where(F.col("count") > 1)
    repeated = repeated.agg(F.count(F.lit(1)).alias("repeated_displays"), F.coalesce(F.max("count"), F.lit(0)).alias("most_repeated"))
    both = F.col("is_whitelist_brand") & F.col("is_catalog_brand")
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("brand_norm").alias("names"), F.count_if(both).alias("in_both"),
        F.count_if(F.col("is_whitelist_brand") & ~F.col("is_catalog_brand")).alias("whitelist_only"), F.count_if(F.col("is_catalog_brand") & ~F.col("is_whitelist_brand")).alias("catalog_only"),
        F.count_if(F.trim(F.coalesce("brand_display", F.lit(""))) == "").alias("without_display"),
    )
    return counts.join(F.broadcast(repeated))


def merged_communities(spark: SparkSession, folder: str, n: int = 10) -> DataFrame:
    """The communities with most merged posts, for the report of a merge."""
    rows = P.merged(table(spark, folder, "raw_reddit_posts"), F.to_timestamp(F.lit(AS_OF))).where("trim(community) <> ''")
    counts = rows.groupBy("community").agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("author").alias("authors"))
    return counts.orderBy(F.desc("posts"), "community").limit(n)


QUERIES = {
    f.__name__: f
    for f in (
        registry_counts, merged_communities, json_lists, parsed_lists, numbered_parts, first_posts, run_windows, first_communities, brands_with_logos, built_records, new_arrivals, collection_audit,
        stream_audit, stream_rescan, written_and_read, term_lists,
    )
}

_TS = """CASE WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN try_cast(CASE WHEN regexp_matches(trim({0}),
  '(?i)(z|[+-]\\d{{2}}:?\\d{{2}})$') THEN trim({0}) ELSE trim({0}) || 'Z' END AS timestamptz)
  WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(trim({0}) || 'T00:00:00Z' AS timestamptz) END"""
_JSON = "'[' || array_to_string(list_transform(list_filter(coalesce({0}, []), lambda v: v IS NOT NULL AND trim(v) <> ''){1}, lambda v: CAST(to_json(v) AS VARCHAR)), ', ') || ']'"
_NO_URL = "trim(coalesce(source_record_id, '')) = '' AND NOT regexp_matches(coalesce(url, ''), '(?i)/r/[^/]+/comments/[a-z0-9]+')"
_RUNS = """WITH raw AS (SELECT * FROM raw_reddit_posts WHERE trim(mention_id) <> '' AND lower(trim(mention_id)) <> 'nan'),
b AS (SELECT * FROM raw WHERE ingestion_run_id >= 'run_20260501'), k AS (SELECT DISTINCT mention_id FROM raw WHERE NOT ingestion_run_id >= 'run_20260501')"""
_DAY = "coalesce(strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%d'), '')"

SQL = {
    "registry_counts": """WITH r AS (SELECT count(*) AS n FROM brand_registry WHERE trim(brand_display) <> '' GROUP BY lower(trim(brand_display)) HAVING count(*) > 1)
    SELECT count(*) AS rows, count(DISTINCT brand_norm) AS names, count(*) FILTER (WHERE is_whitelist_brand AND is_catalog_brand) AS in_both,
      count(*) FILTER (WHERE is_whitelist_brand AND NOT is_catalog_brand) AS whitelist_only, count(*) FILTER (WHERE is_catalog_brand AND NOT is_whitelist_brand) AS catalog_only,
      count(*) FILTER (WHERE trim(coalesce(brand_display, '')) = '') AS without_display, (SELECT count(*) FROM r) AS repeated_displays,
      (SELECT coalesce(max(n), 0) FROM r) AS most_repeated FROM brand_registry""",
    "merged_communities": f"""WITH r AS (SELECT *, {_TS.format("published_at")} AS e, {_TS.format("collected_at")} AS a FROM raw_reddit_posts),
    k AS (SELECT *, CASE WHEN mention_id IS NULL OR trim(mention_id) IN ('', 'nan', 'None') THEN 'hash_' || concat_ws('||', lower(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))),
      lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), lower(trim(coalesce(community, ''))), lower(trim(coalesce(published_at, '')))) ELSE trim(mention_id) END AS key
      FROM r WHERE e >= TIMESTAMPTZ '2026-05-20 00:00:00+00' - INTERVAL 42 DAY),
    m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY a DESC NULLS LAST, title DESC NULLS LAST, text DESC NULLS LAST, published_at DESC NULLS LAST) = 1)
    SELECT community, count(*) AS posts, count(DISTINCT author) AS authors FROM m WHERE trim(community) <> '' GROUP BY 1 ORDER BY posts DESC, community LIMIT 10""",
    "json_lists": f"SELECT brand_norm, {_JSON.format('aliases', '')} AS aliases, {_JSON.format('related_cluster_ids', '[1:1]')} AS first_cluster FROM brand_registry",
    "parsed_lists": """WITH d AS (SELECT DISTINCT sample_post_ids, term, entity_type FROM weekly_cluster_discussion_terms)
    SELECT term, sample_post_ids, entity_type, array_to_string(coalesce(json_extract_string(sample_post_ids, '$[*]'), []), '+') AS ids,
      array_to_string(list_filter(list_transform(regexp_split_to_array(concat_ws('; ', term, ' ', entity_type), '[,|;]'), lambda v: trim(v)), lambda v: v <> ''), '+') AS parts,
      coalesce(len(json_extract_string(sample_post_ids, '$[*]')), 0) AS n, 0 AS none FROM d""",
    "numbered_parts": """SELECT row_number() OVER (ORDER BY p_brand, p_name, p_partkey) AS row_id, p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS product_name,
      'v1' AS version, true AS stamped FROM part""",
    "first_posts": """SELECT DISTINCT mention_id, subreddit, strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS published FROM clean_reddit_posts
      ORDER BY published, mention_id LIMIT 200""",
    "run_windows": """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), w AS (SELECT *, (date_trunc('week', day) - INTERVAL 7 DAY)::DATE AS week_first FROM d)
    SELECT day, day - 2 AS live_start, day AS live_end, week_first, week_first + 6 AS week_last, strftime(week_first, '%G-W%V') AS week,
      week_first AS label_first, week_first + 6 AS label_last FROM w""",
    "first_communities": """WITH r AS (SELECT * FROM raw_reddit_posts WHERE trim(mention_id) <> '')
    SELECT mention_id, coalesce(first(community ORDER BY coalesce(collected_at, ''), coalesce(title, ''), coalesce(community, '')) FILTER (WHERE trim(community) <> ''), '') AS community,
      coalesce(first(title ORDER BY coalesce(collected_at, ''), coalesce(title, ''), coalesce(community, '')) FILTER (WHERE trim(title) <> ''), '') AS title FROM r GROUP BY 1""",
    "brands_with_logos": """WITH l AS (SELECT brand_norm, min('https://' || CASE WHEN lower(trim(brand_display)) = 'saint laurent' THEN 'ysl.com'
      WHEN regexp_replace(lower(trim(brand_display)), '[^a-z0-9]', '', 'g') = '' THEN '' ELSE regexp_replace(lower(trim(brand_display)), '[^a-z0-9]', '', 'g') || '.com' END || '/logo') AS logo_url
      FROM brand_registry WHERE is_whitelist_brand GROUP BY 1),
    e AS (SELECT DISTINCT mention_id, entity_text, brand_norm FROM entity_mentions WHERE entity_type IN ('brand', 'unknown_candidate'))
    SELECT e.*, coalesce(logo_url, '') AS logo_url FROM e LEFT JOIN l USING (brand_norm)""",
    "built_records": f"""WITH a AS (SELECT *, CASE WHEN trim(coalesce(source_record_id, '')) <> '' THEN trim(source_record_id)
        ELSE regexp_extract(coalesce(url, ''), '(?i)/r/[^/]+/comments/([a-z0-9]+)', 1) END AS post,
      coalesce(nullif(regexp_replace(trim(coalesce(community, '')), '^r/', ''), ''), 'unknown') AS name, trim(coalesce(url, '')) AS address,
      CASE WHEN text IN ('[deleted]', '[removed]') THEN '' ELSE coalesce(text, '') END AS body, {_TS.format("published_at")} AS e, {_TS.format("collected_at")} AS c,
      coalesce(try_cast(json_extract_string(metrics_json, '$.score') AS DOUBLE), NULL) AS score FROM raw_reddit_posts),
    u AS (SELECT *, CASE WHEN post <> '' THEN 'https://www.reddit.com/r/' || name || '/comments/' || post || '/' WHEN address <> '' THEN
      'https://www.reddit.com' || regexp_replace(regexp_replace(regexp_replace(address, '(?i)^https?://[^/?#]*', ''), '[?#].*$', ''), '/+$', '/') ELSE '' END AS canonical_url FROM a)
    SELECT DISTINCT CASE WHEN post <> '' THEN 'reddit_submission_' || post WHEN canonical_url <> '' THEN 'url_' || substr(sha256(canonical_url), 1, 24)
        ELSE 'hash_' || substr(sha256('reddit_json||' || coalesce(title, '') || '||' || lower(trim(regexp_replace(body, '\\s+', ' ', 'g')))), 1, 24) END AS mention_id,
      CASE WHEN post <> '' THEN post ELSE canonical_url END AS source_record_id, canonical_url, 'r/' || community AS sub_source, coalesce(title, '') AS title, body AS text,
      trim(coalesce(title, '') || ' ' || body) AS full_text, {_DAY.format("e")} AS event_date, {_DAY.format("c")} AS ingestion_date, coalesce(engagement_score, 0) AS engagement_score,
      CASE WHEN score IS NULL THEN '{{}}' ELSE '{{"score":' || CAST(score AS VARCHAR) || '}}' END AS metrics_json FROM u""",
    "new_arrivals": _RUNS
    + """ SELECT mention_id, source, title FROM b WHERE mention_id NOT IN (SELECT mention_id FROM k) QUALIFY row_number() OVER (PARTITION BY mention_id
      ORDER BY CASE source WHEN 'reddit_json' THEN 0 WHEN 'reddit_rss' THEN 1 ELSE 2 END, collected_at NULLS LAST, title NULLS LAST, text NULLS LAST, url NULLS LAST) = 1""",
    "collection_audit": _RUNS
    + f""", s AS (SELECT ingestion_run_id, sub_source, count(*) AS records_seen, count(DISTINCT b.mention_id) FILTER (WHERE k.mention_id IS NULL) AS records_new,
      count(*) FILTER (WHERE ({_TS.format("published_at")}) IS NULL) AS unreadable, min(collected_at) AS started_at, max(collected_at) AS finished_at
      FROM b LEFT JOIN k USING (mention_id) GROUP BY ALL)
    SELECT *, records_seen - records_new AS records_duplicate, CASE WHEN unreadable = 0 THEN 'success' ELSE 'partial' END AS status FROM s""",
    "stream_audit": f"""SELECT count(*) AS records_seen, count(*) FILTER (WHERE mention_id IS NULL) AS without_id,
      count(*) FILTER (WHERE ({_TS.format("published_at")}) IS NULL) AS unreadable FROM raw_reddit_posts""",
    "stream_rescan": f"""WITH r AS (SELECT mention_id, {_TS.format("published_at")} AS t FROM raw_reddit_posts WHERE trim(mention_id) <> '')
    SELECT DISTINCT mention_id FROM r WHERE t >= TIMESTAMPTZ '2026-05-20 00:00:00+00' - INTERVAL 21 DAY AND t <= TIMESTAMPTZ '2026-05-20 00:00:00+00'""",
    "written_and_read": """WITH r AS (SELECT *, CASE WHEN source = 'reddit_json' THEN 'daily' ELSE 'backfill' END AS mode FROM raw_reddit_posts WHERE trim(mention_id) <> ''),
    o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY mode, mention_id ORDER BY collected_at DESC NULLS LAST, title DESC NULLS LAST, community DESC NULLS LAST) = 1)
    SELECT mode, count(*) AS rows, count(DISTINCT mention_id) AS ids, 0 AS absent, max(title) AS title FROM o GROUP BY 1""",
    "term_lists": """WITH t AS (SELECT week_start, cluster_id, term_norm, max(mentions) AS mentions FROM weekly_cluster_discussion_terms
      WHERE mentions IS NOT NULL AND trim(cluster_id) <> '' AND term_norm IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY week_start, cluster_id ORDER BY mentions DESC, term_norm) AS n FROM t QUALIFY n <= 10)
    SELECT week_start, cluster_id, '[' || string_agg('{"value":' || CAST(to_json(term_norm) AS VARCHAR) || ',"count":' || mentions || '}', ',' ORDER BY n) || ']' AS terms
    FROM r GROUP BY ALL""",
}
