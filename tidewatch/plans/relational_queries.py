"""Queries for joins, set operations, arrays, JSON and defaults over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.times import feed_instant
from tidewatch.operators import rows as R
from tidewatch.storage import align, table, try_table


def semi_and_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Customers per segment with and without orders."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    has = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").withColumn("has", F.lit(True))
    lacks = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").withColumn("has", F.lit(False))
    return has.unionByName(lacks).groupBy("c_mktsegment", "has").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def joined_with_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Nations with their region and their suppliers' number and balance, 0 where there is none."""
    n, r, s = (table(spark, folder, t) for t in ("nation", "region", "supplier"))
    sums = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    out = n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(sums, "n_nationkey", "left")
    return out.select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("balance", F.lit(0.0)).alias("balance"))


def union_of_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Two shapes of rows united by name; what one lacks is null and counts as missing."""
    a = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return R.union_all(a, b).groupBy("nation").agg(F.count(F.lit(1)).alias("rows"), F.count("segment").alias("segments"), F.count("balance").alias("balances"))


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, folder, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    both, only = c.intersect(s).withColumn("part", F.lit("both")), c.subtract(s).withColumn("part", F.lit("customers"))
    return both.unionByName(only)


def top_counts_per_nation(spark: SparkSession, folder: str) -> DataFrame:
    """The two most frequent segments of each nation, its most frequent one, its first five customers."""
    c = table(spark, folder, "customer")
    keys = ["c_nationkey"]
    top = R.top_counts(c, keys, "c_mktsegment", 2, "top")
    first = R.first_values(c, keys, "c_name", [F.col("c_custkey")], 5, "first")
    out = top.join(R.most_common(c, keys, "c_mktsegment", "mode"), keys).join(first, keys).join(R.distribution(c, keys, "c_mktsegment", "d"), keys)
    text = lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string"))
    return out.select(*keys, F.array_join(F.transform("top", text), "|").alias("top"), "mode", F.array_join("first", "|").alias("first"), F.size("d").alias("segments"))


def growth_by_month(spark: SparkSession, folder: str) -> DataFrame:
    months = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    out = R.growth_on_previous_row(months, ["o_orderpriority"], "month", "orders", [])
    return out.withColumns({"wow_growth": F.round("wow_growth", 9), "share": F.round(R.share_of_total("orders", ["month"]), 9)})


def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON of events decoded and encoded again, and what was in it."""
    rows = table(spark, folder, "events").select("event_type", F.from_json("props", "map<string, int>").alias("m"))
    return rows.groupBy("event_type").agg(
        F.sum(F.size("m")).alias("keys"), F.sum(F.element_at("m", "k")).alias("total"), F.max(F.to_json("m")).alias("last"), F.countDistinct(F.to_json("m")).alias("kinds")
    )


def array_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters shared by brands with the same primary cluster and their own related ones."""
    b = table(spark, folder, "brand_registry").where("primary_cluster_id is not null")
    every = b.groupBy("primary_cluster_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("related_cluster_ids")))).alias("pool"))
    rows = b.join(every, "primary_cluster_id").select(
        "brand_norm", F.size(F.array_intersect("related_cluster_ids", "pool")).alias("shared"), F.size(F.array_union("related_cluster_ids", "pool")).alias("united"),
        F.forall("related_cluster_ids", lambda x: F.array_contains("pool", x)).alias("subset"), F.array_join(F.slice("pool", 1, 3), "|").alias("first"),
    )
    return rows


def aligned_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in the shape of a contract: a missing column null, an unknown one gone, a missing table empty."""
    contract = T.StructType().add("p_partkey", "string").add("p_name", "string").add("logo_url", "string")
    have = align(table(spark, folder, "part"), contract)
    return have.unionByName(try_table(spark, f"{folder}/no_such_table.parquet", contract))


def feed_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written as feed dates and read back; the hours that come out different."""
    rows = table(spark, folder, "orders").select(F.col("o_orderdate").alias("t"), F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200")).alias("s"))
    back = rows.select(((F.unix_timestamp(F.col("t").cast("timestamp")) - F.unix_timestamp(feed_instant(F.col("s")))) / 3600).alias("hours"))
    return back.groupBy("hours").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {
    f.__name__: f
    for f in (
        semi_and_anti, joined_with_defaults, union_of_batches, set_operations, top_counts_per_nation, growth_by_month, event_properties, array_operations,
        aligned_contract, feed_dates,
    )
}
SQL = {
    "semi_and_anti": """SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS has, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1, 2""",
    "joined_with_defaults": """SELECT n_name, r_name, count(s_suppkey) AS suppliers, round(coalesce(sum(s_acctbal), 0), 2) AS balance
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "union_of_batches": """SELECT nation, count(*) AS rows, count(segment) AS segments, count(balance) AS balances FROM (SELECT c_nationkey AS nation, c_mktsegment AS segment, NULL AS balance
    FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier) GROUP BY 1""",
    "set_operations": """(SELECT c_nationkey AS k, 'both' AS part FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier WHERE s_acctbal > 5000)
    UNION ALL (SELECT c_nationkey, 'customers' FROM customer EXCEPT SELECT s_nationkey, 'customers' FROM supplier WHERE s_acctbal > 5000)""",
    "top_counts_per_nation": """WITH c AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s) AS r FROM c),
    f AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
    SELECT c_nationkey, string_agg(s || ':' || n, '|' ORDER BY r) FILTER (WHERE r <= 2) AS top, min(s) FILTER (WHERE r = 1) AS mode,
      (SELECT string_agg(c_name, '|' ORDER BY k) FROM f WHERE f.c_nationkey = r.c_nationkey AND k <= 5) AS first, count(*) AS segments FROM r GROUP BY c_nationkey""",
    "growth_by_month": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS orders FROM orders GROUP BY 1, 2),
    g AS (SELECT *, lag(orders) OVER (PARTITION BY o_orderpriority ORDER BY month) AS p FROM m)
    SELECT month, o_orderpriority, orders, round(coalesce((orders - p)::DOUBLE / nullif(p, 0), 0), 9) AS wow_growth,
      round(orders::DOUBLE / sum(orders) OVER (PARTITION BY month), 9) AS share FROM g""",
    "event_properties": """SELECT event_type, CAST(sum(len(json_keys(props))) AS BIGINT) AS keys, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
    max(replace(props, ' ', '')) AS last, count(DISTINCT replace(props, ' ', '')) AS kinds FROM events GROUP BY 1""",
    "array_operations": """WITH b AS (SELECT * FROM brand_registry WHERE primary_cluster_id IS NOT NULL), u AS (SELECT primary_cluster_id, unnest(related_cluster_ids) AS x FROM b),
    e AS (SELECT primary_cluster_id, list_sort(list(DISTINCT x)) AS pool FROM u GROUP BY 1)
    SELECT brand_norm, len(list_intersect(related_cluster_ids, coalesce(pool, []))) AS shared, len(list_distinct(list_concat(related_cluster_ids, coalesce(pool, [])))) AS united,
      len(list_filter(related_cluster_ids, lambda x: NOT list_contains(coalesce(pool, []), x))) = 0 AS subset, coalesce(array_to_string(pool[1:3], '|'), '') AS first FROM b LEFT JOIN e USING (primary_cluster_id)""",
    "aligned_contract": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(NULL AS VARCHAR) AS logo_url FROM part",
    "feed_dates": "SELECT 2.0::DOUBLE AS hours, count(*) AS rows FROM orders",
}
