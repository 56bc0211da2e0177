"""The weekly document of the dashboard: canonical brands, signals, keywords, evidence, distribution, meta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.rows import bands, keep_one, weighted_mean

# Trust in a brand by kind of signal, and the bands of the score histogram.
PRIORITY = {"confirmed_whitelist_brand": 0, "catalog_known_brand": 1, "candidate_non_whitelist_brand": 2}
EDGES = [0, 2, 2.5, 3, 3.5, 4, 4.5, 5.01]
LABELS = ["1-2", "2-2.5", "2.5-3", "3-3.5", "3.5-4", "4-4.5", "4.5-5"]


def loose_brand_form(c: Column) -> Column:
    """Lower case, marks to spaces, underscores and dashes to one space."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s-]+", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)[\s_-]+", " "))


def trimmed_display(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    cut = F.trim(F.regexp_replace(text, r"(?U)[^\w)&+'®™]+$", ""))
    return F.when(cut == "", text).otherwise(cut)


def prepared(brands: DataFrame) -> DataFrame:
    """Brand rows with a normal form, a display name and the priority of their kind; rows without a form go."""
    filled = lambda *cs: F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in cs], F.lit(""))
    priority = F.lit(3)
    for kind, p in PRIORITY.items():
        priority = F.when(F.col("brand_signal_type") == kind, F.lit(p)).otherwise(priority)
    rows = brands.withColumn("norm", loose_brand_form(filled("brand_norm", "brand_display", "candidate_text")))
    display = F.trim(filled("brand_display", "candidate_text", "norm"))
    return rows.withColumns({"display": display, "priority": priority}).where("norm <> ''")


def canonical(rows: DataFrame) -> DataFrame:
    """Per week and brand the row of the most trusted kind, of those the most discussed; ties by display name."""
    order = [F.col("priority"), F.desc_nulls_last("unique_posts"), F.desc_nulls_last("mentions"), F.col("display"), F.col("brand_signal_type")]
    one = keep_one(rows, ["week_start", "norm"], order)
    return one.select("week_start", "norm", trimmed_display(F.col("display")).alias("display"), "brand_signal_type")


def signals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per week and keys: mentions, means weighted by them, posts, all spellings."""
    m = F.col("mentions")
    return rows.groupBy("week_start", *keys).agg(
        F.sum("mentions").alias("mentions"),
        F.max("unique_posts").alias("unique_posts"),
        F.countDistinct("cluster_id").alias("clusters"),
        F.round(weighted_mean("avg_sentiment", m), 9).alias("avg_sentiment"),
        F.round(weighted_mean("positive_share", m), 9).alias("positive_share"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.trim("display") != "", F.trim("display")))), "|").alias("spellings"),
    )


def full_weeks(rows: DataFrame, least: int = 20) -> DataFrame:
    """Weeks with at least ``least`` clusters, and how many."""
    weeks = rows.groupBy("week_start").agg(F.countDistinct("cluster_id").alias("clusters"))
    return weeks.where(F.col("clusters") >= least)


def in_full_weeks(rows: DataFrame, least: int = 20) -> DataFrame:
    """The rows of full weeks; weeks are few, so they are broadcast."""
    return rows.join(F.broadcast(full_weeks(rows, least).select("week_start")), "week_start", "left_semi")


def histogram(scores: DataFrame, value: str) -> DataFrame:
    return bands(scores, value, EDGES, LABELS)


def listed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key the other columns of its rows as an array of structs in order of ``position``."""
    fields = [c for c in rows.columns if c not in (*keys, "position")]
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("v")))).alias(name))
    return out.withColumn(name, F.transform(name, lambda x: x["v"]))


def documents(weeks: DataFrame, parts: dict[str, DataFrame], meta: DataFrame) -> DataFrame:
    """One JSON document per week: ``meta`` as an object, each part's rows of the week as a list of objects in order of
    their position (empty where there are none), and what else ``weeks`` has. A part has a bounded number of rows a week."""
    facts = meta.select("week_start", F.struct(F.col("week_start").alias("latest_week"), *[c for c in meta.columns if c != "week_start"]).alias("meta"))
    out = weeks.join(facts, "week_start", "left")
    for name, df in parts.items():
        made = listed(df, ["week_start"], name)
        out = out.join(made, "week_start", "left").withColumn(name, F.coalesce(name, F.array().cast(made.schema[name].dataType)))
    rest = [c for c in weeks.columns if c != "week_start"]
    return out.select("week_start", F.to_json(F.struct("meta", *parts, *rest)).alias("document"))
