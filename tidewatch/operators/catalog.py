"""Reference side: products per cluster, brand priors, cluster profiles, the brand registry and its aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text
from tidewatch.operators.rows import keep_one, missing

# Words and phrases no profile lists.
PROFILE_STOP = ["the", "and", "for", "with", "from", "that", "this", "your", "you", "are", "product"]
PHRASE_STOP = [*PROFILE_STOP, "item", "new", "hot", "best", "sale", "free", "shipping"]
PHRASE_NOISE = ["high quality", "best seller", "free shipping", "hot sale"]


def brand_cluster_prior(products: DataFrame, top: int = 5) -> DataFrame:
    """Per brand its ``top`` clusters by number of products, with share of all its products and the primary one; ties go
    by cluster. Rows without brand or cluster are left out."""
    valid = products.where((F.trim("brand_norm") != "") & (F.trim("cluster_id") != ""))
    counts = valid.groupBy("brand_norm", "cluster_id").agg(F.count(F.lit(1)).alias("product_count"))
    brand = Window.partitionBy("brand_norm")
    ranked = counts.withColumns(
        {
            "cluster_share": F.col("product_count") / F.sum("product_count").over(brand),
            "rank": F.row_number().over(brand.orderBy(F.desc("product_count"), "cluster_id")),
        }
    )
    return ranked.where(F.col("rank") <= top).withColumn("is_primary_cluster", F.col("rank") == 1)


def _ranked_list(rows: DataFrame, keys: Sequence[str], value: str, weight: Column, n: int, out: str, ordinal: Column | None = None) -> DataFrame:
    """Per key the ``n`` values with the largest sum of weight, as an array; ties by first ordinal, then by value."""
    counts = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), (F.min(ordinal) if ordinal is not None else F.lit(0)).alias("_o"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_w"), "_o", value)
    top = counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))).alias(out))
    return listed.withColumn(out, F.transform(out, lambda x: x["v"]))


def cluster_profiles(products: DataFrame, samples: int = 12) -> DataFrame:
    """Per cluster: products, top brands, first distinct titles, top words of those titles, top phrases of all titles, the
    profile text and whether it rests on few products. ``products``: row_id, cluster_id, cluster_name, brand_display,
    product_name."""
    keys = ["cluster_id"]
    size = products.groupBy(*keys).agg(F.min("cluster_name").alias("cluster_name"), F.count(F.lit(1)).alias("product_count"))
    brands = _ranked_list(products.where(F.trim("brand_display") != ""), keys, "brand_display", F.lit(1), 20, "top_brands")
    titles = products.where(F.col("product_name").isNotNull()).groupBy(*keys, "product_name").agg(F.min("row_id").alias("row_id"))
    first = titles.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))).where(F.col("_n") <= samples)
    sampled = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "product_name"))).alias("s"))
    sampled = sampled.select(*keys, F.transform("s", lambda x: x["product_name"]).alias("sample_product_titles"))
    words = first.select(*keys, F.explode(text.words(F.col("product_name"))).alias("term"))
    words = words.where((F.length("term") > 2) & ~F.col("term").isin(PROFILE_STOP))
    terms = _ranked_list(words, keys, "term", F.lit(1), 30, "top_product_terms")
    kept = F.filter(text.words(F.col("product_name")), lambda t: (F.length(t) > 1) & ~t.isin(PHRASE_STOP))
    phrases = products.select(*keys, kept.alias("t")).select(
        *keys, F.explode(F.concat(text.grams(F.col("t"), 2), text.grams(F.col("t"), 3))).alias("phrase")
    )
    phrases = _ranked_list(phrases.where(~F.col("phrase").isin(PHRASE_NOISE)), keys, "phrase", F.lit(1), 40, "top_product_phrases")
    out = size
    for part in (brands, sampled, terms, phrases):
        out = out.join(part, keys, "left")
    profile = F.concat_ws(
        "\n",
        F.concat(F.lit("Cluster: "), "cluster_name", F.lit(".")),
        *[
            F.concat(F.lit(f"{label}: "), F.array_join(F.slice(c, 1, n), ", "), F.lit("."))
            for label, c, n in (
                ("Representative brands", "top_brands", 15),
                ("Representative products", "sample_product_titles", 8),
                ("Common product terms", "top_product_terms", 20),
                ("Common product phrases", "top_product_phrases", 20),
            )
        ],
    )
    return out.withColumns({"cluster_profile_text": profile, "low_sample_cluster": F.col("product_count") < 30})


def described(counts: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation and exact quartiles (interpolated) of a column."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return counts.agg(
        F.count(value).alias("count"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"),
        F.min(value).alias("min"), quartiles.alias("q"), F.max(value).alias("max"),
    ).select("count", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"), "max")


def usable_brands(brands: DataFrame, common_words: list[str]) -> DataFrame:
    """Brands whose name isn't empty and has a word that isn't common English."""
    kept = F.filter(F.split(F.trim("brand_norm"), " "), lambda w: ~w.isin(common_words))
    return brands.where((F.trim("brand_norm") != "") & (F.size(kept) > 0))


def without_denied(brands: DataFrame, denied: DataFrame) -> DataFrame:
    return brands.join(denied.select("brand_norm").distinct(), "brand_norm", "left_anti")


def combined_registry(whitelist: DataFrame, catalog: DataFrame) -> DataFrame:
    """Both sources by brand_norm: whitelist rows first, then what only the catalog has; with source and status."""
    known = catalog.select("brand_norm").distinct().withColumn("_c", F.lit(True))
    first = whitelist.join(known, "brand_norm", "left").withColumns(
        {"is_whitelist_brand": F.lit(True), "is_catalog_brand": F.coalesce("_c", F.lit(False))}
    ).drop("_c")
    rest = catalog.join(whitelist.select("brand_norm").distinct(), "brand_norm", "left_anti").withColumns(
        {"is_whitelist_brand": F.lit(False), "is_catalog_brand": F.lit(True)}
    )
    source = F.when(F.col("is_whitelist_brand") & F.col("is_catalog_brand"), "whitelist_and_catalog").when(
        F.col("is_whitelist_brand"), "whitelist_only"
    ).otherwise("catalog_only")
    return first.unionByName(rest, allowMissingColumns=True).withColumns(
        {
            "brand_source": source,
            "review_status": F.when(F.col("is_whitelist_brand"), "approved").otherwise("catalog_observed"),
            "in_platform_brand": F.col("is_whitelist_brand") | F.col("is_catalog_brand"),
        }
    )


def filled_clusters(registry: DataFrame, prior: DataFrame) -> DataFrame:
    """Missing primary clusters filled from the prior; all clusters of the prior as related ones, most products first."""
    primary = prior.where("is_primary_cluster").select("brand_norm", F.col("cluster_id").alias("_id"))
    related = prior.groupBy("brand_norm").agg(F.array_sort(F.collect_list(F.struct("rank", "cluster_id"))).alias("r"))
    related = related.select("brand_norm", F.transform("r", lambda x: x["cluster_id"]).alias("prior_cluster_ids"))
    out = registry.join(primary, "brand_norm", "left").join(related, "brand_norm", "left")
    filled = F.when(missing(F.col("primary_cluster_id")), F.col("_id")).otherwise(F.col("primary_cluster_id"))
    empty = F.array().cast("array<string>")
    return out.withColumns({"primary_cluster_id": filled, "prior_cluster_ids": F.coalesce("prior_cluster_ids", empty)}).drop("_id")


def alias_lookup(registry: DataFrame) -> DataFrame:
    """Each normal form of an alias or display name with its brand, once per brand; the smallest spelling is kept."""
    spellings = F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("brand_display")))
    rows = registry.select(
        "brand_norm", "brand_display", F.when(F.col("is_whitelist_brand"), "whitelist").otherwise("catalog").alias("source"),
        F.explode(spellings).alias("alias_text"),
    )
    rows = rows.withColumn("alias_norm", text.brand_form(F.col("alias_text"))).where("alias_norm <> ''")
    return keep_one(rows, ["alias_norm", "brand_norm"], [F.col("alias_text")])
