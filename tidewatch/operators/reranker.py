"""Training pairs, features, split, model and ranking metrics of the cluster reranker.

Randomness is by hash of seed and ids: the same rows come out on any cluster and in any order of tasks.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = [
    "semantic", "keyword", "brand_prior", "same_parent", "candidate_rank", "inverse_rank", "cluster_products", "leaf_overlap", "phrase_overlap", "primary_match",
    "related_match",
]


def drawn(seed: int, *keys: str) -> Column:
    """A number as good as random, the same for the same seed and keys in any engine that knows MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def pairs(queries: DataFrame, clusters: DataFrame, similarity: DataFrame, hard: int = 5, parents: int = 3, others: int = 2, seed: int = 42) -> DataFrame:
    """The true cluster of each query and negatives: the closest, some of the same parent, some at random; one that comes
    up twice keeps its first kind. ``queries``: query_id, true_cluster_id, parent; ``clusters``: cluster_id, parent;
    ``similarity``: query_id, cluster_id, semantic, candidate_rank over all clusters."""
    wrong = similarity.join(queries.select("query_id", "true_cluster_id"), "query_id").where("cluster_id <> true_cluster_id")
    nth = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    draw = drawn(seed, "query_id", "cluster_id")
    positive = queries.select("query_id", F.col("true_cluster_id").alias("cluster_id"), F.lit("positive").alias("kind"), F.lit(0).alias("turn"))
    closest = wrong.withColumn("n", nth(F.desc("semantic"), F.col("cluster_id"))).where(F.col("n") <= hard)
    closest = closest.select("query_id", "cluster_id", F.lit("semantic_hard_negative").alias("kind"), F.lit(1).alias("turn"))
    family = wrong.join(queries.select("query_id", "parent"), "query_id").join(F.broadcast(clusters.select("cluster_id", "parent")) if clusters.count() <= 100_000 else clusters.select("cluster_id", "parent"), ["cluster_id", "parent"])
    family = family.withColumn("n", nth(draw)).where(F.col("n") <= parents)
    family = family.select("query_id", "cluster_id", F.lit("same_parent_negative").alias("kind"), F.lit(2).alias("turn"))
    chance = wrong.withColumn("n", nth(drawn(seed + 1, "query_id", "cluster_id"))).where(F.col("n") <= others)
    chance = chance.select("query_id", "cluster_id", F.lit("random_negative").alias("kind"), F.lit(3).alias("turn"))
    every = positive.unionByName(closest).unionByName(family).unionByName(chance)
    first = every.groupBy("query_id", "cluster_id").agg(F.min_by("kind", "turn").alias("negative_type"))
    return first.withColumn("label", (F.col("negative_type") == "positive").cast("int"))


def features(pairs: DataFrame, queries: DataFrame, clusters: DataFrame, similarity: DataFrame, overlap: DataFrame, prior: DataFrame) -> DataFrame:
    """The eleven features of pairs. ``queries``: also brand_norm; ``clusters``: also cluster_products; ``overlap``: query_id,
    cluster_id, overlap, leaf_overlap, phrase_overlap (terms shared with all terms of the cluster, its leaf keywords, its
    phrases); ``prior``: brand_norm, cluster_id, is_primary_cluster."""
    out = pairs.join(queries.select("query_id", "brand_norm", F.col("parent").alias("qp")), "query_id")
    out = out.join(clusters.select("cluster_id", F.col("parent").alias("cp"), "cluster_products"), "cluster_id")
    out = out.join(similarity.select("query_id", "cluster_id", "semantic", "candidate_rank"), ["query_id", "cluster_id"], "left")
    out = out.join(overlap, ["query_id", "cluster_id"], "left").join(prior.select("brand_norm", "cluster_id", "is_primary_cluster"), ["brand_norm", "cluster_id"], "left")
    p = F.when(F.col("is_primary_cluster"), 0.2).when(F.col("is_primary_cluster").isNotNull(), 0.1).otherwise(0.0)
    rank = F.coalesce("candidate_rank", F.lit(clusters.count()))
    made = {
        "semantic": F.coalesce("semantic", F.lit(0.0)),
        "keyword": F.least(F.coalesce("overlap", F.lit(0)) / 8.0, F.lit(1.0)),
        "brand_prior": p,
        "same_parent": ((F.trim("qp") != "") & (F.lower(F.trim("qp")) == F.lower(F.trim("cp")))).cast("int"),
        "candidate_rank": rank,
        "inverse_rank": 1.0 / F.greatest(rank, F.lit(1)),
        "leaf_overlap": F.coalesce("leaf_overlap", F.lit(0)),
        "phrase_overlap": F.coalesce("phrase_overlap", F.lit(0)),
        "primary_match": (p >= 0.2).cast("int"),
        "related_match": ((p > 0) & (p < 0.2)).cast("int"),
    }
    return out.withColumns(made).select("query_id", "cluster_id", "label", "negative_type", *FEATURES)


def split(df: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``is_train`` by query: every query is on one side, each side has one at least where there are two queries."""
    hashed = F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(1_000_000)) / 1_000_000
    ends = df.agg(F.min(hashed), F.max(hashed)).first()
    if ends[0] is None:
        return df.withColumn("is_train", F.lit(True))
    cut = min(max(share, ends[0] + 1e-7), ends[1] if ends[1] > ends[0] else 1.0)
    return df.withColumn("is_train", hashed < F.lit(cut))


def ranking_metrics(df: DataFrame, score: str) -> DataFrame:
    """Top-1 and top-3 accuracy, mean reciprocal and mean rank of the first positive; queries without one don't count."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "cluster_id")
    ranked = df.withColumn("r", F.row_number().over(w)).where("label = 1")
    first = ranked.groupBy("query_id").agg(F.min("r").alias("r"))
    return first.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.coalesce(F.avg((F.col("r") == 1).cast("double")), F.lit(0.0)), 9).alias("top1"),
        F.round(F.coalesce(F.avg((F.col("r") <= 3).cast("double")), F.lit(0.0)), 9).alias("top3"),
        F.round(F.coalesce(F.avg(1 / F.col("r")), F.lit(0.0)), 9).alias("reciprocal"),
        F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 9).alias("mean_rank"),
    )


def trained(train: DataFrame, trees: int = 300, seed: int = 42) -> GBTClassificationModel:
    """The reference's size of model. Its columns are drawn per tree; here each node draws from 0.8 of them."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
    return GBTClassifier(labelCol="label", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed).fit(data)


def scored(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    out = model.transform(data).withColumn("score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def importance(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """feature and importance, which add up to 1."""
    found = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(x)) for f, x in zip(FEATURES, found, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")
