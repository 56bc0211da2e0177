"""Queries that compare texts and vectors with clusters and assign posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import clusters as K
from tidewatch.operators.rows import missing
from tidewatch.plans.text_queries import POSTS_SQL, combined, posts
from tidewatch.storage import table


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the registry with a profile: the name and the names of its brands."""
    rows = table(spark, folder, "brand_registry").where(~missing(F.col("primary_cluster_id")))
    return rows.groupBy(F.col("primary_cluster_id").alias("cluster_id")).agg(
        F.min("primary_cluster_name").alias("cluster_name"),
        F.concat_ws(" ", F.min("primary_cluster_name"), F.array_join(F.array_sort(F.collect_set("brand_norm")), " ")).alias("profile"),
    )


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p = posts(spark, folder).select("mention_id", text.words(F.lower(combined())).alias("terms"))
    return p, _clusters(spark, folder).select("cluster_id", "cluster_name", text.words(F.lower("profile")).alias("terms"))


def _bow(p: DataFrame, c: DataFrame) -> DataFrame:
    pairs = K.cosine(K.count_vectors(p, "mention_id", "terms"), "mention_id", K.count_vectors(c, "cluster_id", "terms"), "cluster_id")
    return pairs.withColumn("semantic", F.round("semantic", 9))


def bow_similarity(spark: SparkSession, folder: str, k: int = 3) -> DataFrame:
    """The three clusters closest to each post by word counts."""
    return K.top_scores(_bow(*_sides(spark, folder)), "mention_id", "cluster_id", "semantic", k)


def tfidf_similarity(spark: SparkSession, folder: str, k: int = 3) -> DataFrame:
    """The three subject descriptions closest to each document by weighted words and word pairs."""
    with_pairs = lambda c: F.concat(text.words(F.lower(c)), text.grams(text.words(F.lower(c)), 2))
    d = table(spark, folder, "documents").where("trim(text) <> ''").select("doc_id", with_pairs(F.col("text")).alias("terms"))
    s = table(spark, folder, "subject_areas").select("subject", with_pairs(F.col("description")).alias("terms"))
    a, b = K.tfidf_vectors([(d, "doc_id"), (s, "subject")], "terms")
    pairs = K.cosine(a, "doc_id", b, "subject").withColumn("semantic", F.round("semantic", 9))
    return K.top_scores(pairs, "doc_id", "subject", "semantic", k)


def embedding_topk(spark: SparkSession, folder: str, k: int = 3) -> DataFrame:
    """The three label centroids closest to each vector, and the gap between the first two."""
    rows = table(spark, folder, "embeddings")
    top = K.nearest(rows, "vec_id", "embedding", K.centroids(rows, "label", "embedding"), k)
    return top.groupBy("vec_id").agg(
        F.max(F.when(F.col("candidate_rank") == 1, F.col("centroid"))).alias("first"),
        F.max(F.when(F.col("candidate_rank") == 2, F.col("centroid"))).alias("second"),
        F.round(F.max(F.when(F.col("candidate_rank") == 1, F.col("score"))) - F.max(F.when(F.col("candidate_rank") == 2, F.col("score"))), 5).alias("gap"),
    )


def _assignment_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, overlaps and priors of all posts."""
    p, c = _sides(spark, folder)
    candidates = K.top_scores(_bow(p, c), "mention_id", "cluster_id", "semantic", 10).select("mention_id", "cluster_id", "semantic")
    candidates = K.filled_candidates(candidates, p, c, 10)
    longer = lambda df, key: df.select(key, F.explode("terms").alias("term")).where(F.length("term") > 2)
    names = _clusters(spark, folder).select("cluster_id", text.words(F.lower("cluster_name")).alias("terms"))
    overlap = K.overlaps(longer(p, "mention_id"), longer(names, "cluster_id"))
    brands = table(spark, folder, "entity_mentions").where("entity_type = 'brand'").select("mention_id", "brand_norm", "matched_cluster_id")
    primary = brands.where("trim(matched_cluster_id) <> ''").select("mention_id", F.col("matched_cluster_id").alias("cluster_id"), F.lit(0.2).alias("p"))
    related = brands.join(table(spark, folder, "brand_registry").select("brand_norm", "related_cluster_ids"), "brand_norm")
    related = related.select("mention_id", F.explode("related_cluster_ids").alias("cluster_id"), F.lit(0.1).alias("p"))
    prior = primary.unionByName(related).groupBy("mention_id", "cluster_id").agg(F.max("p").alias("brand_prior"))
    return candidates, overlap, prior


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    return K.assigned(*_assignment_parts(spark, folder))


def assignment_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Per post the number of candidates, the best one's name, and all of them as JSON."""
    ranked = K.weighed(*_assignment_parts(spark, folder))
    return K.candidates_json(ranked, _clusters(spark, folder).select("cluster_id", "cluster_name"))


def similarity_report(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity each of the three preferences ends in where there is no sentence model."""
    rows = [(p, *K.similarity_by(p, {"embedding": False})) for p in ("embedding", "tfidf", "bow")]
    return spark.createDataFrame(rows, "preferred string, similarity_method string, fallback_reason string")


def assignment_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = assignments(spark, folder)
    return rows.groupBy("assignment_status", "cluster_usage_tier").agg(
        F.count(F.lit(1)).alias("posts"), F.countDistinct("final_cluster_id").alias("clusters"), F.round(F.avg("assignment_confidence"), 6).alias("confidence")
    )


QUERIES = {f.__name__: f for f in (bow_similarity, tfidf_similarity, embedding_topk, assignments, assignment_summary, assignment_candidates, similarity_report)}

_WORDS = "regexp_extract_all(lower({0}), '[a-z][a-z0-9''&+-]*')"
_CLUSTERS = """cl AS (SELECT primary_cluster_id AS cluster_id, min(primary_cluster_name) AS cluster_name,
  min(primary_cluster_name) || ' ' || array_to_string(list_sort(list(DISTINCT brand_norm)), ' ') AS profile FROM brand_registry
  WHERE primary_cluster_id IS NOT NULL AND lower(trim(primary_cluster_id)) NOT IN ('', 'nan', 'none', 'null') GROUP BY 1)"""
_BOW = f"""{POSTS_SQL}, {_CLUSTERS},
pt AS (SELECT mention_id, unnest({_WORDS.format("body")}) AS term FROM texts), ct AS (SELECT cluster_id, unnest({_WORDS.format("profile")}) AS term FROM cl),
pc AS (SELECT mention_id, term, count(*)::DOUBLE AS w FROM pt GROUP BY ALL), cc AS (SELECT cluster_id, term, count(*)::DOUBLE AS w FROM ct GROUP BY ALL),
pu AS (SELECT mention_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY mention_id)) AS u FROM pc),
cu AS (SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)) AS v FROM cc),
bow AS (SELECT mention_id, cluster_id, round(sum(u * v), 9) AS semantic FROM pu JOIN cu USING (term) GROUP BY ALL)"""
_ASSIGN = f"""WITH {_BOW},
near AS (SELECT * FROM bow QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY semantic DESC, cluster_id) <= 10),
cl20 AS (SELECT cluster_id FROM cl ORDER BY cluster_id LIMIT 20),
cand AS (SELECT * FROM (SELECT * FROM near UNION ALL (SELECT mention_id, cluster_id, 0.0::DOUBLE FROM (SELECT mention_id, cluster_id FROM texts CROSS JOIN cl20) ANTI JOIN near USING (mention_id, cluster_id)))
  QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY semantic DESC, cluster_id) <= 10),
nt AS (SELECT cluster_id, unnest({_WORDS.format("cluster_name")}) AS term FROM cl),
ov AS (SELECT mention_id, cluster_id, count(*) AS overlap FROM (SELECT DISTINCT * FROM pt WHERE length(term) > 2)
  JOIN (SELECT DISTINCT * FROM nt WHERE length(term) > 2) USING (term) GROUP BY ALL),
br AS (SELECT mention_id, brand_norm, matched_cluster_id FROM entity_mentions WHERE entity_type = 'brand'),
pr AS (SELECT mention_id, cluster_id, max(p) AS brand_prior FROM (
  SELECT mention_id, matched_cluster_id AS cluster_id, 0.2::DOUBLE AS p FROM br WHERE trim(matched_cluster_id) <> ''
  UNION ALL SELECT mention_id, unnest(related_cluster_ids), 0.1::DOUBLE FROM br JOIN brand_registry USING (brand_norm)) GROUP BY ALL),
sc AS (SELECT mention_id, cluster_id, semantic, least(coalesce(overlap, 0) / 8.0::DOUBLE, 0.2::DOUBLE) AS keyword, coalesce(brand_prior, 0) AS brand_prior
  FROM cand LEFT JOIN ov USING (mention_id, cluster_id) LEFT JOIN pr USING (mention_id, cluster_id)),
cf AS (SELECT *, round(least(greatest(semantic, 0) * 0.78::DOUBLE + keyword + brand_prior, 1.0::DOUBLE), 9) AS confidence FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY confidence DESC, cluster_id) AS r FROM cf),
tw AS (SELECT a.mention_id, a.cluster_id, a.confidence AS assignment_confidence, a.semantic AS semantic_score, a.keyword AS keyword_overlap_score,
  a.brand_prior AS brand_prior_score, coalesce(b.cluster_id, '') AS top2_cluster_id, coalesce(b.confidence, 0) AS top2_score,
  round(a.confidence - coalesce(b.confidence, 0), 9) AS score_gap
  FROM (SELECT * FROM rk WHERE r = 1) a LEFT JOIN (SELECT * FROM rk WHERE r = 2) b USING (mention_id)),
asg AS (SELECT *, CASE WHEN assignment_confidence >= 0.55 AND score_gap >= 0.05 THEN 'confident' WHEN assignment_confidence >= 0.30 THEN 'uncertain'
    ELSE 'unassigned' END AS assignment_status,
  CASE WHEN assignment_confidence >= 0.55 AND score_gap >= 0.05 THEN 'strong_match' WHEN assignment_confidence >= 0.35 THEN 'usable_match'
    WHEN assignment_confidence >= 0.25 THEN 'weak_match' ELSE 'unassigned' END AS cluster_usage_tier FROM tw),
assignments AS (SELECT * EXCLUDE (cluster_id), CASE WHEN cluster_usage_tier <> 'unassigned' THEN cluster_id ELSE '' END AS final_cluster_id,
  format('semantic={{:.3f}}; keyword={{:.3f}}; brand_prior={{:.3f}}', semantic_score, keyword_overlap_score, brand_prior_score) AS assignment_reason FROM asg)"""
ASSIGN_SQL = _ASSIGN

SQL = {
    "bow_similarity": f"""WITH {_BOW} SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY semantic DESC, cluster_id) AS candidate_rank
    FROM bow QUALIFY candidate_rank <= 3""",
    "tfidf_similarity": f"""WITH dw AS (SELECT doc_id, {_WORDS.format("text")} AS t FROM documents WHERE trim(text) <> ''),
    sw AS (SELECT subject, {_WORDS.format("description")} AS t FROM subject_areas),
    dt AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, greatest(len(t) - 1, 0) + 1), lambda i: array_to_string(t[i:i+1], ' ')))) AS term FROM dw),
    st AS (SELECT subject, unnest(list_concat(t, list_transform(range(1, greatest(len(t) - 1, 0) + 1), lambda i: array_to_string(t[i:i+1], ' ')))) AS term FROM sw),
    dc AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), sc AS (SELECT subject, term, count(*) AS tf FROM st GROUP BY ALL),
    n AS (SELECT (SELECT count(*) FROM dw) + (SELECT count(*) FROM sw) AS n),
    f AS (SELECT term, sum(df) AS df FROM (SELECT term, count(*) AS df FROM dc GROUP BY 1 UNION ALL SELECT term, count(*) FROM sc GROUP BY 1) GROUP BY 1),
    i AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM f, n),
    du AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS u FROM dc JOIN i USING (term)),
    su AS (SELECT subject, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY subject)) AS v FROM sc JOIN i USING (term)),
    s AS (SELECT doc_id, subject, round(sum(u * v), 9) AS semantic FROM du JOIN su USING (term) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY semantic DESC, subject) AS candidate_rank FROM s QUALIFY candidate_rank <= 3""",
    "embedding_topk": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), s AS (SELECT vec_id, m.label AS centroid, round(sum(x * m), 5) AS score FROM e JOIN m USING (i) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, centroid) AS k FROM s)
    SELECT vec_id, max(centroid) FILTER (WHERE k = 1) AS first, max(centroid) FILTER (WHERE k = 2) AS second,
      round(max(score) FILTER (WHERE k = 1) - max(score) FILTER (WHERE k = 2), 5) AS gap FROM r GROUP BY vec_id""",
    "assignments": f"{_ASSIGN} SELECT * FROM assignments",
    "assignment_candidates": f"""{_ASSIGN}, e AS (SELECT mention_id, r, cluster_name, '{{"cluster_id":"' || cluster_id || '","cluster_name":' || to_json(cluster_name) || ',"semantic_score":' || semantic
      || ',"keyword_overlap_score":' || keyword || ',"brand_prior_score":' || brand_prior || ',"confidence":' || confidence || '}}' AS v FROM rk JOIN cl USING (cluster_id))
    SELECT mention_id, '[' || string_agg(v, ',' ORDER BY r) || ']' AS top_candidates_json, count(*) AS candidates, max(cluster_name) FILTER (WHERE r = 1) AS best_name FROM e GROUP BY 1""",
    "similarity_report": """SELECT * FROM (VALUES ('embedding', 'tfidf', 'embedding unavailable'), ('tfidf', 'tfidf', ''), ('bow', 'bow', '')) v(preferred, similarity_method, fallback_reason)""",
    "assignment_summary": f"""{_ASSIGN} SELECT assignment_status, cluster_usage_tier, count(*) AS posts, count(DISTINCT final_cluster_id) AS clusters,
    round(avg(assignment_confidence), 6) AS confidence FROM assignments GROUP BY 1, 2""",
}
