"""The N best items of every group under one tie rule.

``row_number`` over (group ordered by the rule) with a filter on the rank: Catalyst turns the pair into a group limit
that keeps at most N rows per group and task before the shuffle and again after it, so a group of millions of items
ships N rows per task.

Defined results: rows whose group column or score is null, or whose group column is blank, are left out; several
rows of one item count as its best row; ties go by the rule down to the item's own columns, so the result is unique;
groups with fewer than N items give all of them; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_items(df: DataFrame, group: list[str], item: list[str], scores: list[str], ties: list[str], n: int) -> DataFrame:
    """``scores`` descending (nulls last), then ``ties`` ascending by code point. Columns: group, item, scores, rank."""
    rows = df.where(F.col(scores[0]).isNotNull())
    for g in group:
        rows = rows.where(F.col(g).isNotNull() & (F.trim(F.col(g).cast("string")) != ""))
    # copies and earlier runs of an item meet in a map-side combine before anything is ranked
    best = rows.groupBy(*group, *item).agg(F.max(F.struct(*scores)).alias("best"))
    flat = best.select(*group, *item, *[F.col(f"best.{s}").alias(s) for s in scores])
    rule = [F.col(s).desc_nulls_last() for s in scores] + [F.col(t).asc_nulls_last() for t in ties]
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*rule)))
    return ranked.where(F.col("rank") <= n)
