"""Queries over products (part), brands and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import catalog as C
from tidewatch.operators.rows import missing
from tidewatch.storage import table


def products(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return table(spark, folder, "part").select(
        c("p_partkey").alias("row_id"), c("p_type").alias("cluster_id"), c("p_type").alias("cluster_name"), c("p_brand").alias("brand_display"),
        F.lower("p_brand").alias("brand_norm"), c("p_name").alias("product_name"),
    )


def brand_prior(spark: SparkSession, folder: str) -> DataFrame:
    prior = C.brand_cluster_prior(products(spark, folder))
    return prior.withColumn("cluster_share", F.round("cluster_share", 9))


def cluster_profiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.cluster_profiles(products(spark, folder))
    arrays = ["top_brands", "sample_product_titles", "top_product_terms", "top_product_phrases"]
    return rows.withColumns({a: F.array_join(a, "|") for a in arrays})


def products_per_cluster(spark: SparkSession, folder: str) -> DataFrame:
    counts = products(spark, folder).groupBy("cluster_id", "brand_norm").agg(F.count(F.lit(1)).alias("n"))
    return C.described(counts, "n")


def product_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of missing names and clusters, and registry rows without an id."""
    rows = table(spark, folder, "brand_registry")
    rate = lambda c: F.round(F.avg(missing(F.col(c)).cast("double")), 9)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), rate("brand_id").alias("no_id"), rate("primary_cluster_id").alias("no_cluster"),
        rate("brand_display").alias("no_display"),
    )


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "brand_registry")
    return rows.where("is_whitelist_brand"), rows.where("is_catalog_brand")


def registry_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Brands in both sources, in the whitelist only, in the catalog only, by set operations."""
    white, cat = (s.select("brand_norm") for s in _sides(spark, folder))
    parts = {"both": white.intersect(cat), "whitelist_only": white.subtract(cat), "catalog_only": cat.subtract(white)}
    out = None
    for name, df in parts.items():
        one = df.withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def registry_built(spark: SparkSession, folder: str) -> DataFrame:
    """The registry put together again from its sources, denied and common-word brands left out, clusters filled."""
    keep = ["brand_norm", "brand_display", "primary_cluster_id"]
    white, cat = (s.select(*keep) for s in _sides(spark, folder))
    denied = table(spark, folder, "weekly_cluster_brand_mentions").where("mentions >= 12").select("brand_norm")
    usable = lambda df: C.without_denied(C.usable_brands(df, ["home", "goods", "works"]), denied)
    registry = C.combined_registry(usable(white), usable(cat))
    links = table(spark, folder, "entity_mentions").where("is_brand and trim(matched_cluster_id) <> ''")
    prior = C.brand_cluster_prior(links.select("brand_norm", F.col("matched_cluster_id").alias("cluster_id")))
    out = C.filled_clusters(registry, prior)
    return out.withColumn("prior_cluster_ids", F.array_join("prior_cluster_ids", "|"))


def alias_table(spark: SparkSession, folder: str) -> DataFrame:
    return C.alias_lookup(table(spark, folder, "brand_registry")).select("alias_norm", "alias_text", "brand_norm", "source")


def related_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Brands per cluster, as primary and as related one."""
    rows = table(spark, folder, "brand_registry")
    related = rows.select("brand_norm", F.explode("related_cluster_ids").alias("cluster_id"), F.lit(0).alias("primary"))
    primary = rows.where(~missing(F.col("primary_cluster_id"))).select("brand_norm", F.col("primary_cluster_id").alias("cluster_id"), F.lit(1).alias("primary"))
    both = primary.unionByName(related)
    return both.groupBy("cluster_id").agg(
        F.countDistinct("brand_norm").alias("brands"), F.sum("primary").alias("primary_of"), F.array_join(F.slice(F.array_sort(F.collect_set("brand_norm")), 1, 5), "|").alias("first_brands")
    )


QUERIES = {
    f.__name__: f
    for f in (brand_prior, cluster_profiles, products_per_cluster, product_quality, registry_sets, registry_built, alias_table, related_clusters)
}

_PRIOR = """counts AS (SELECT brand_norm, cluster_id, count(*) AS product_count FROM src WHERE trim(brand_norm) <> '' AND trim(cluster_id) <> '' GROUP BY ALL),
ranked AS (SELECT *, product_count::DOUBLE / sum(product_count) OVER (PARTITION BY brand_norm) AS cluster_share,
  row_number() OVER (PARTITION BY brand_norm ORDER BY product_count DESC, cluster_id) AS rank FROM counts),
prior AS (SELECT *, rank = 1 AS is_primary_cluster FROM ranked WHERE rank <= 5)"""
_MISSING = "({0} IS NULL OR lower(trim({0})) IN ('', 'nan', 'none', 'null'))"


def _top(source: str, value: str, n: int, out: str) -> str:
    return f"""(SELECT cluster_id, string_agg({value}, '|' ORDER BY r) AS {out}, list({value} ORDER BY r) AS l_{out} FROM (
      SELECT cluster_id, {value}, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, {value}) AS r
      FROM {source} GROUP BY cluster_id, {value}) WHERE r <= {n} GROUP BY cluster_id)"""


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


SQL = {
    "brand_prior": f"""WITH src AS (SELECT lower(p_brand) AS brand_norm, p_type AS cluster_id FROM part), {_PRIOR}
    SELECT brand_norm, cluster_id, product_count, round(cluster_share, 9) AS cluster_share, rank, is_primary_cluster FROM prior""",
    "cluster_profiles": f"""WITH p AS (SELECT p_partkey AS row_id, p_type AS cluster_id, p_brand AS brand_display, p_name AS product_name FROM part),
    t AS (SELECT cluster_id, product_name, min(row_id) AS row_id FROM p GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) AS n FROM t QUALIFY n <= 12),
    w AS (SELECT cluster_id, unnest(regexp_extract_all(lower(product_name), '[a-z][a-z0-9''&+-]*')) AS term FROM f),
    w2 AS (SELECT * FROM w WHERE length(term) > 2 AND term NOT IN ({_quoted(C.PROFILE_STOP)})),
    k AS (SELECT cluster_id, list_filter(regexp_extract_all(lower(product_name), '[a-z][a-z0-9''&+-]*'),
      lambda x: length(x) > 1 AND x NOT IN ({_quoted(C.PHRASE_STOP)})) AS ts FROM p),
    g AS (SELECT cluster_id, unnest(list_concat(list_transform(range(1, greatest(len(ts) - 1, 0) + 1), lambda i: array_to_string(ts[i:i+1], ' ')),
      list_transform(range(1, greatest(len(ts) - 2, 0) + 1), lambda i: array_to_string(ts[i:i+2], ' ')))) AS phrase FROM k),
    g2 AS (SELECT * FROM g WHERE phrase NOT IN ({_quoted(C.PHRASE_NOISE)})),
    s AS (SELECT cluster_id, string_agg(product_name, '|' ORDER BY n) AS sample_product_titles, list(product_name ORDER BY n) AS l_s FROM f GROUP BY 1),
    c AS (SELECT cluster_id, cluster_id AS cluster_name, count(*) AS product_count FROM p GROUP BY ALL)
    SELECT cluster_id, cluster_name, product_count, top_brands, sample_product_titles, top_product_terms, top_product_phrases,
      'Cluster: ' || cluster_name || '.' || chr(10) || 'Representative brands: ' || array_to_string(l_top_brands[1:15], ', ') || '.' || chr(10)
      || 'Representative products: ' || array_to_string(l_s[1:8], ', ') || '.' || chr(10)
      || 'Common product terms: ' || array_to_string(l_top_product_terms[1:20], ', ') || '.' || chr(10)
      || 'Common product phrases: ' || array_to_string(l_top_product_phrases[1:20], ', ') || '.' AS cluster_profile_text,
      product_count < 30 AS low_sample_cluster
    FROM c LEFT JOIN {_top("p", "brand_display", 20, "top_brands")} USING (cluster_id) LEFT JOIN s USING (cluster_id)
    LEFT JOIN {_top("w2", "term", 30, "top_product_terms")} USING (cluster_id) LEFT JOIN {_top("g2", "phrase", 40, "top_product_phrases")} USING (cluster_id)""",
    "products_per_cluster": """WITH c AS (SELECT p_type, lower(p_brand) AS b, count(*) AS n FROM part GROUP BY ALL)
    SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS q25,
      quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max FROM c""",
    "product_quality": "SELECT count(*) AS rows, "
    + ", ".join(
        f"round(avg(CASE WHEN {_MISSING.format(c)} THEN 1.0 ELSE 0.0 END), 9) AS {n}"
        for c, n in (("brand_id", "no_id"), ("primary_cluster_id", "no_cluster"), ("brand_display", "no_display"))
    )
    + " FROM brand_registry",
    "registry_sets": """SELECT brand_norm, CASE WHEN is_whitelist_brand AND is_catalog_brand THEN 'both' WHEN is_whitelist_brand THEN 'whitelist_only'
      ELSE 'catalog_only' END AS part FROM brand_registry WHERE is_whitelist_brand OR is_catalog_brand""",
    "registry_built": f"""WITH src AS (SELECT brand_norm, matched_cluster_id AS cluster_id FROM entity_mentions WHERE is_brand AND trim(matched_cluster_id) <> ''),
    {_PRIOR}, b AS (SELECT * FROM brand_registry WHERE (is_whitelist_brand OR is_catalog_brand)
      AND len(list_filter(string_split(trim(brand_norm), ' '), lambda w: w NOT IN ('home', 'goods', 'works'))) > 0
      AND brand_norm NOT IN (SELECT brand_norm FROM weekly_cluster_brand_mentions WHERE mentions >= 12 AND brand_norm IS NOT NULL)),
    rel AS (SELECT brand_norm, string_agg(cluster_id, '|' ORDER BY rank) AS ids FROM prior GROUP BY 1)
    SELECT b.brand_norm, b.brand_display, CASE WHEN {_MISSING.format("b.primary_cluster_id")} THEN prior.cluster_id ELSE b.primary_cluster_id END AS primary_cluster_id,
      b.is_whitelist_brand, b.is_catalog_brand,
      CASE WHEN b.is_whitelist_brand AND b.is_catalog_brand THEN 'whitelist_and_catalog' WHEN b.is_whitelist_brand THEN 'whitelist_only' ELSE 'catalog_only' END AS brand_source,
      CASE WHEN b.is_whitelist_brand THEN 'approved' ELSE 'catalog_observed' END AS review_status, true AS in_platform_brand, coalesce(ids, '') AS prior_cluster_ids
    FROM b LEFT JOIN prior ON prior.brand_norm = b.brand_norm AND prior.is_primary_cluster LEFT JOIN rel ON rel.brand_norm = b.brand_norm""",
    "alias_table": """WITH r AS (SELECT brand_norm, is_whitelist_brand, unnest(list_distinct(list_append(coalesce(aliases, []), brand_display))) AS alias_text FROM brand_registry),
    n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(strip_accents(alias_text)), '\\([^)]*\\)', ' ', 'g'),
      '(?i)\\b(inc|llc|ltd|limited|corp|corporation|co|company|official store|store)\\b\\.?', ' ', 'g'),
      '[^A-Za-z0-9&''+\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS alias_norm FROM r)
    SELECT alias_norm, min(alias_text) AS alias_text, brand_norm, CASE WHEN any_value(is_whitelist_brand) THEN 'whitelist' ELSE 'catalog' END AS source
    FROM n WHERE alias_norm NOT IN ('', 'no brand', 'nobrand', 'generic', 'unbranded', 'unknown', 'none', 'n/a', 'na', 'null', 'nan') GROUP BY alias_norm, brand_norm""",
    "related_clusters": f"""WITH b AS (SELECT brand_norm, primary_cluster_id AS cluster_id, 1 AS p FROM brand_registry WHERE NOT {_MISSING.format("primary_cluster_id")}
      UNION ALL SELECT brand_norm, unnest(related_cluster_ids), 0 FROM brand_registry)
    SELECT cluster_id, count(DISTINCT brand_norm) AS brands, CAST(sum(p) AS BIGINT) AS primary_of,
      array_to_string((list_sort(list(DISTINCT brand_norm)))[1:5], '|') AS first_brands FROM b GROUP BY cluster_id""",
}
