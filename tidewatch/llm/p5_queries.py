"""Top terms of every week and cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.top_items import top_items
from tidewatch.storage import table


def p5_top_terms(spark: SparkSession, folder: str, n: int = 8) -> DataFrame:
    return top_items(
        table(spark, folder, "weekly_cluster_discussion_terms"),
        group=["week_start", "cluster_id"],
        item=["entity_type", "term_norm"],
        scores=["mentions", "unique_posts"],
        ties=["term_norm", "entity_type"],
        n=n,
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_top_terms(spark, folder).select("week_start", "cluster_id", "entity_type", "term_norm")


QUERIES = {"p5_found": p5_found, "p5_top_terms": p5_top_terms}

_RANKED = """WITH items AS (
  SELECT week_start, cluster_id, entity_type, term_norm, mentions, unique_posts FROM weekly_cluster_discussion_terms
  WHERE mentions IS NOT NULL AND trim(week_start) <> '' AND trim(cluster_id) <> ''
  QUALIFY row_number() OVER (PARTITION BY week_start, cluster_id, entity_type, term_norm
                             ORDER BY mentions DESC, unique_posts DESC NULLS LAST) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY week_start, cluster_id
    ORDER BY mentions DESC, unique_posts DESC NULLS LAST, term_norm NULLS LAST, entity_type NULLS LAST) AS rank FROM items)
"""
SQL = {
    "p5_found": _RANKED + "SELECT week_start, cluster_id, entity_type, term_norm FROM ranked WHERE rank <= 8",
    "p5_top_terms": _RANKED + "SELECT * FROM ranked WHERE rank <= 8",
}
