"""Queries of the reranker over products (part): type for cluster, half the type's name for its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text
from tidewatch.operators import catalog as C
from tidewatch.operators import clusters as K
from tidewatch.operators import reranker as R
from tidewatch.operators.rows import exact_sample
from tidewatch.plans.catalog_queries import products
from tidewatch.storage import pinned, table


def _inputs(spark: SparkSession, folder: str):
    p = products(spark, folder)
    parent = F.substring("cluster_id", 1, 1)
    queries = p.select(F.col("row_id").alias("query_id"), F.col("cluster_id").alias("true_cluster_id"), parent.alias("parent"), "brand_norm", text.words(F.lower("product_name")).alias("terms"))
    profiles = p.groupBy("cluster_id").agg(F.array_distinct(F.flatten(F.collect_set(text.words(F.lower("product_name"))))).alias("terms"), F.count(F.lit(1)).alias("cluster_products"))
    clusters = pinned(profiles.withColumn("parent", parent), "reranker-clusters")
    pairs = K.cosine(K.count_vectors(queries, "query_id", "terms"), "query_id", K.count_vectors(clusters, "cluster_id", "terms"), "cluster_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "cluster_id")
    similarity = pairs.withColumn("semantic", F.round("semantic", 9)).withColumn("candidate_rank", F.row_number().over(w))
    return queries, clusters, pinned(similarity, "reranker-similarity"), C.brand_cluster_prior(p)


def reranker_pairs(spark: SparkSession, folder: str) -> DataFrame:
    queries, clusters, similarity, prior = _inputs(spark, folder)
    made = R.pairs(queries, clusters, similarity)
    longer = lambda df, key: df.select(key, F.explode("terms").alias("term")).where(F.length("term") > 2)
    leaves = clusters.select("cluster_id", text.words(F.lower("cluster_id")).alias("terms"))
    asked, overlap = longer(queries.withColumnRenamed("query_id", "mention_id"), "mention_id"), None
    for name, terms in (("overlap", longer(clusters, "cluster_id").unionByName(longer(leaves, "cluster_id"))), ("leaf_overlap", longer(leaves, "cluster_id")), ("phrase_overlap", longer(clusters, "cluster_id"))):
        part = K.overlaps(asked, terms).withColumnRenamed("overlap", name)
        overlap = part if overlap is None else overlap.join(part, ["mention_id", "cluster_id"], "left")
    overlap = overlap.withColumnRenamed("mention_id", "query_id")
    return R.features(made, queries, clusters, similarity, overlap, prior)


def reranker_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reranker_pairs(spark, folder).groupBy("negative_type").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("query_id").alias("queries"))


def reranker_model(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking metrics on held-out queries of the similarity alone and of the trained model."""
    data = pinned(R.split(reranker_pairs(spark, folder)), "reranker-pairs")
    model = R.trained(data.where("is_train"))
    held = data.where("not is_train")
    a = R.ranking_metrics(held, "semantic").withColumn("by", F.lit("similarity"))
    return a.unionByName(R.ranking_metrics(R.scored(model, held), "score").withColumn("by", F.lit("model")))


def similarity_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking metrics of part types by the share of their brand's products, as a query per part."""
    p = products(spark, folder)
    prior = p.groupBy("brand_norm", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    rows = p.select(F.col("row_id").alias("query_id"), "brand_norm", F.col("cluster_id").alias("t")).join(prior, "brand_norm")
    rows = rows.withColumn("label", (F.col("t") == F.col("cluster_id")).cast("int"))
    return R.ranking_metrics(rows, "n")


def sampled_parts(spark: SparkSession, folder: str) -> DataFrame:
    """An exact sample of 100 parts, the same for the same seed."""
    return exact_sample(table(spark, folder, "part"), 100, 42, "p_partkey").select("p_partkey", "p_name")


QUERIES = {f.__name__: f for f in (reranker_pairs, reranker_pair_counts, reranker_model, similarity_ranking, sampled_parts)}
_WORDS = "regexp_extract_all(lower({0}), '[a-z][a-z0-9''&+-]*')"
_PAIRS = f"""WITH q AS (SELECT p_partkey AS query_id, p_type AS t, substr(p_type, 1, 1) AS parent, lower(p_brand) AS b, {_WORDS.format("p_name")} AS terms FROM part),
c AS (SELECT t AS cluster_id, substr(t, 1, 1) AS parent, list_distinct(flatten(list(terms))) AS terms, count(*) AS cluster_products FROM q GROUP BY t),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS w FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY ALL), ct AS (SELECT cluster_id, unnest(terms) AS term FROM c),
qu AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS u FROM qt), cu AS (SELECT *, 1 / sqrt(count(*) OVER (PARTITION BY cluster_id)) AS v FROM ct),
s0 AS (SELECT query_id, cluster_id, round(sum(u * v), 9) AS semantic FROM qu JOIN cu USING (term) GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, cluster_id) AS candidate_rank FROM s0),
w AS (SELECT s.*, q.parent AS qp, c.parent AS cp FROM s JOIN q USING (query_id) JOIN c USING (cluster_id) WHERE cluster_id <> t),
h AS (SELECT query_id, cluster_id FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, cluster_id) <= 5),
m AS (SELECT query_id, cluster_id FROM w WHERE qp = cp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY md5('42|' || query_id || '|' || cluster_id)) <= 3),
r AS (SELECT query_id, cluster_id FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY md5('43|' || query_id || '|' || cluster_id)) <= 2),
e AS (SELECT query_id, t AS cluster_id, 'positive' AS k, 0 AS o FROM q UNION ALL SELECT *, 'semantic_hard_negative', 1 FROM h UNION ALL SELECT *, 'same_parent_negative', 2 FROM m
  UNION ALL SELECT *, 'random_negative', 3 FROM r),
f AS (SELECT query_id, cluster_id, arg_min(k, o) AS negative_type FROM e GROUP BY ALL),
ql AS (SELECT DISTINCT query_id, term FROM qt WHERE length(term) > 2), lt AS (SELECT DISTINCT cluster_id, unnest({_WORDS.format("cluster_id")}) AS term FROM c),
al AS (SELECT cluster_id, term FROM ct WHERE length(term) > 2 UNION SELECT cluster_id, term FROM lt WHERE length(term) > 2),
o1 AS (SELECT query_id, cluster_id, count(*) AS a FROM ql JOIN al USING (term) GROUP BY ALL),
o2 AS (SELECT query_id, cluster_id, count(*) AS l FROM ql JOIN (SELECT * FROM lt WHERE length(term) > 2) USING (term) GROUP BY ALL),
o3 AS (SELECT query_id, cluster_id, count(*) AS p FROM ql JOIN (SELECT * FROM ct WHERE length(term) > 2) USING (term) GROUP BY ALL),
pc AS (SELECT b, t AS cluster_id, row_number() OVER (PARTITION BY b ORDER BY count(*) DESC, t) AS rank FROM q GROUP BY b, t QUALIFY rank <= 5),
z AS (SELECT f.*, q.b, q.parent AS qp, c.parent AS cp, c.cluster_products, coalesce(s.semantic, 0) AS semantic, coalesce(s.candidate_rank, (SELECT count(*) FROM c)) AS candidate_rank,
  coalesce(a, 0) AS a, coalesce(l, 0) AS leaf_overlap, coalesce(o3.p, 0) AS phrase_overlap, CASE WHEN pc.rank = 1 THEN 0.2::DOUBLE WHEN pc.rank IS NOT NULL THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS brand_prior
  FROM f JOIN q USING (query_id) JOIN c USING (cluster_id) LEFT JOIN s USING (query_id, cluster_id) LEFT JOIN o1 USING (query_id, cluster_id) LEFT JOIN o2 USING (query_id, cluster_id)
  LEFT JOIN o3 USING (query_id, cluster_id) LEFT JOIN pc ON pc.b = q.b AND pc.cluster_id = f.cluster_id),
pairs AS (SELECT query_id, cluster_id, CAST(negative_type = 'positive' AS INTEGER) AS label, negative_type, semantic, least(a / 8.0::DOUBLE, 1.0::DOUBLE) AS keyword, brand_prior,
  CAST(qp = cp AS INTEGER) AS same_parent, candidate_rank, 1.0::DOUBLE / greatest(candidate_rank, 1) AS inverse_rank, cluster_products, leaf_overlap, phrase_overlap,
  CAST(brand_prior >= 0.2 AS INTEGER) AS primary_match, CAST(brand_prior > 0 AND brand_prior < 0.2 AS INTEGER) AS related_match FROM z)"""

SQL = {
    "reranker_pairs": f"{_PAIRS} SELECT * FROM pairs",
    "reranker_pair_counts": f"{_PAIRS} SELECT negative_type, count(*) AS pairs, count(DISTINCT query_id) AS queries FROM pairs GROUP BY 1",
    "sampled_parts": "SELECT p_partkey, p_name FROM part ORDER BY md5('42|' || p_partkey), p_partkey LIMIT 100",
    "similarity_ranking": """WITH p AS (SELECT p_partkey AS query_id, lower(p_brand) AS b, p_type AS t FROM part), c AS (SELECT b, t AS cluster_id, count(*) AS n FROM p GROUP BY ALL),
    r AS (SELECT query_id, t = cluster_id AS hit, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, cluster_id) AS r FROM p JOIN c USING (b)),
    f AS (SELECT query_id, min(r) AS r FROM r WHERE hit GROUP BY 1)
    SELECT count(*) AS queries, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 9) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 9) AS top3,
      round(avg(1.0::DOUBLE / r), 9) AS reciprocal, round(avg(r), 9) AS mean_rank FROM f""",
}
