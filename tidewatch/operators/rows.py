"""Row-level building blocks: choosing rows per key, ranks, growth, weighted means, nested summaries.

Each takes and gives DataFrames and stays in generated code. Nulls: group keys keep null groups, ranks leave null
values out, means and sums skip nulls, as said at each function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.storage import pinned


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def resolve(df: DataFrame, *names: str, default: object = "") -> Column:
    """The first column found under any of ``names``, whatever its case, else the default."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        if n.lower() in by_lower:
            return F.col(f"`{by_lower[n.lower()]}`")
    return F.lit(default)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null, blank nor a written-out nothing."""
    return F.coalesce(*[F.when(~missing(c), c) for c in columns])


def first_filled_value(value: str, ordinal: Column) -> Column:
    """Aggregate: the first value in order of ``ordinal`` that is neither null nor blank, else empty."""
    return F.coalesce(F.min_by(F.col(value), F.when(~_blank(F.col(value)), ordinal)), F.lit(""))


def numbered(df: DataFrame, order: Sequence[str], out: str = "row_id") -> DataFrame:
    """Rows numbered 1, 2, ... in a total order, without bringing them into one task: partitions are ranges of the order,
    and each starts where the ones before it end; one number per partition comes to the driver."""
    rows = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("p")).count().orderBy("p").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["p"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbers = rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return numbers.withColumn(out, F.col("_start") + inside + 1).drop("_p", "_at", "_start")


def head(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a total order: a sample that is the same every time."""
    return df.orderBy(*order).limit(n)


def versioned(df: DataFrame, version: str) -> DataFrame:
    """Adds the version of a computation and when it ran, the same instant in all rows."""
    return df.withColumns({"version": F.lit(version), "created_at": F.current_timestamp()})


def missing(c: Column) -> Column:
    """Null, blank, or the words nan, none, null."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("", "nan", "none", "null")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``. ``order`` should be total; null keys form one group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_first_by_either(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows that come first under each of ``keys`` taken alone; every row counts, also those left out by another key.
    ``order`` are values that ascend, nulls first. Rows equal in ``order`` are copies of one another, of which one stays.
    The first of each key is an aggregate, combined before the shuffle, and rows meet it by key and order at once, so a key
    that holds a third of the rows (a blank text's hash) is no single task's."""
    at = [f"_o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(at, order, strict=True)))
    out = rows
    for k in keys:
        least = rows.groupBy(F.col(k).alias("_k")).agg(F.min(F.struct(*at)).alias("_f")).select("_k", *[F.col(f"_f.{c}").alias(f"_f{c}") for c in at])
        same = F.col(k).eqNullSafe(F.col("_k"))
        for c in at:
            same = same & F.col(c).eqNullSafe(F.col(f"_f{c}"))
        out = out.join(least, same, "left_semi")
    return out.drop(*at).dropDuplicates(list(keys))


def share_of_total(value: str, keys: Sequence[str]) -> Column:
    return F.col(value) / F.sum(value).over(Window.partitionBy(*keys))


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Average rank of ties divided by the number of values; null for null, which doesn't count."""
    group = Window.partitionBy(*keys)
    rank = F.rank().over(group.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2) / F.count(value).over(group))


def growth_on_previous_row(df: DataFrame, keys: Sequence[str], time: str, value: str, ties: Sequence[str]) -> DataFrame:
    """``wow_growth`` on the previous row of the keys in order of time; 0 without one or where it is 0. ``ties`` order
    several rows of one time."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(time, *ties))
    change = (F.col(value) - previous) / F.nullif(previous, F.lit(0))
    return df.withColumn("wow_growth", F.coalesce(change, F.lit(0.0)))


def with_previous_week(df: DataFrame, week: str, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The value of the same keys exactly seven days earlier, 0 without one."""
    before = df.select(F.date_add(week, 7).alias(week), *keys, F.col(value).alias(out))
    return df.join(before, [week, *keys], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def weighted_mean(value: str, weight: Column) -> Column:
    """Mean weighted by ``weight`` raised to 1 at least; rows without a value add nothing above but count below."""
    w = F.greatest(weight, F.lit(1))
    return F.sum(F.col(value) * w) / F.sum(w)


def top_counts(df: DataFrame, keys: Sequence[str], value: str, n: int, out: str, ordinal: Column | None = None) -> DataFrame:
    """Per key the ``n`` most frequent non-blank values as an array of (value, count); ties by first place in
    ``ordinal`` order, else by value."""
    rows = df.where(~_blank(F.col(value)))
    first = F.min(ordinal) if ordinal is not None else F.min(value)
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), first.alias("_o"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_c"), "_o", value)
    ranked = counts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    entry = F.struct(F.col("_n"), F.col(value).cast("string").alias("value"), F.col("_c").alias("count"))
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(out))
    return listed.withColumn(out, F.transform(out, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))))


def distribution(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Per key a map from non-blank value to its count."""
    counts = df.where(~_blank(F.col(value))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_c")))).alias(out))


def first_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], n: int, out: str) -> DataFrame:
    """Per key the first ``n`` non-blank values in order, repeats kept. Only ``n`` rows per key and task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.where(~_blank(F.col(value))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))).alias(out))
    return listed.withColumn(out, F.transform(out, lambda x: x["v"]))


def most_common(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Per key the most frequent value, the smallest of several."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return keep_one(counts, keys, [F.desc("_c"), F.col(value)]).select(*keys, F.col(value).alias(out))


def bands(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Counts of right-closed bands; the first includes its lower edge; empty bands are kept, values outside aren't."""
    v = F.col(value)
    # the value stands once in the expression, so a long one isn't copied for every edge
    over = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: v > e))
    rows = df.select(F.when(v == edges[0], F.lit(1)).otherwise(over).alias("_b"))
    counts = rows.groupBy((F.col("_b") - 1).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    every = df.sparkSession.createDataFrame(list(enumerate(labels)), "_b int, band string")
    return every.join(F.broadcast(counts), "_b", "left").select("band", F.coalesce("_c", F.lit(0)).alias("count"))


def exact_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows, the same for the same seed: those with the smallest hash of their key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), *keys).limit(n)


def union_all(*frames: DataFrame) -> DataFrame:
    """By name, columns that one lacks filled with null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
