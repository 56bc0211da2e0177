"""Assigning posts to clusters: similarity of texts, keyword overlap, brand prior, confidence ladders.

Similarities are rows (post, cluster, score) from an equi-join on terms: a post meets only clusters it shares a term
with, no matrix is built, and the cluster side, a few hundred short profiles, is broadcast after its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Terms of cluster profiles that may be broadcast.
BROADCAST_TERMS = 500_000


def small(df: DataFrame, bound: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def term_counts(df: DataFrame, key: str, terms: str) -> DataFrame:
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _unit(weights: DataFrame, key: str) -> DataFrame:
    """Weights divided by their key's length; without weights there is no row."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weights.withColumn("u", F.col("w") / norm).select(key, "term", "u")


def count_vectors(df: DataFrame, key: str, terms: str) -> DataFrame:
    return _unit(term_counts(df, key, terms).withColumn("w", F.col("tf").cast("double")), key)


def tfidf_vectors(frames: list[tuple[DataFrame, str]], terms: str) -> list[DataFrame]:
    """Unit vectors of several frames weighted by one smoothed idf, fitted on all of them together."""
    counts = [term_counts(df, key, terms) for df, key in frames]
    sizes = sum(df.count() for df, _ in frames)
    seen = None
    for c in counts:
        one = c.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        seen = one if seen is None else seen.unionByName(one)
    idf = seen.groupBy("term").agg((F.log((1 + F.lit(sizes)) / (1 + F.sum("df"))) + 1).alias("idf"))
    return [_unit(c.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf")), key) for c, (_, key) in zip(counts, frames, strict=True)]


def cosine(posts: DataFrame, post_key: str, clusters: DataFrame, cluster_key: str) -> DataFrame:
    """Scores of pairs that share a term."""
    met = posts.join(small(clusters.withColumnRenamed("u", "v")), "term")
    return met.groupBy(post_key, cluster_key).agg(F.sum(F.col("u") * F.col("v")).alias("semantic"))


#: Centroids that are compared at once.
CENTROIDS = 10_000


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label and mean vector."""
    cells = rows.select(label, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    return listed.select(label, F.transform("c", lambda x: x["m"]).alias("c"))


def nearest(rows: DataFrame, key: str, vector: str, centers: DataFrame, k: int, digits: int = 5) -> DataFrame:
    """The ``k`` centroids of largest product with each vector: key, centroid, score, candidate_rank; ties by centroid. The
    centroids are a stated set, compared in blocks of ``CENTROIDS``; null vectors and those of another length come out
    with no centroid."""
    label = centers.columns[0]
    found = sorted(centers.collect(), key=lambda r: r[label])
    kinds = dict(rows.dtypes)[key], dict(centers.dtypes)[label]
    shared = rows.sparkSession.sparkContext.broadcast(([r[label] for r in found], np.array([r["c"] for r in found], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix = shared.value
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            here = [i for i, v in enumerate(vectors) if v is not None and len(labels) and len(v) == matrix.shape[1] and None not in v]
            if not here:
                continue
            own = np.array([vectors[i] for i in here], float)
            best = np.zeros((len(here), 0))
            at = np.zeros((len(here), 0), np.int64)
            for block in range(0, len(labels), CENTROIDS):
                scores = np.round(own @ matrix[block : block + CENTROIDS].T, digits)
                best = np.hstack([best, scores])
                at = np.hstack([at, np.broadcast_to(np.arange(block, block + scores.shape[1]), scores.shape)])
                order = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, at = np.take_along_axis(best, order, 1), np.take_along_axis(at, order, 1)
            n = best.shape[1]
            out = [batch.column(0).take(pa.array(np.repeat(here, n))), pa.array([labels[i] for i in at.ravel()]), pa.array(best.ravel()), pa.array(np.tile(np.arange(1, n + 1), len(here)), pa.int32())]
            yield pa.RecordBatch.from_arrays([out[0], out[1].cast(kinds_arrow), *out[2:]], [key, "centroid", "score", "candidate_rank"])

    kinds_arrow = {"int": pa.int32(), "bigint": pa.int64()}.get(kinds[1], pa.string())
    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kinds[0]}, centroid {kinds[1]}, score double, candidate_rank int")


def top_scores(pairs: DataFrame, key: str, cluster: str, score: str, k: int) -> DataFrame:
    """The ``k`` best clusters of every key with their rank; ties by cluster."""
    w = Window.partitionBy(key).orderBy(F.desc(score), cluster)
    return pairs.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= k)


def filled_candidates(candidates: DataFrame, posts: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """``candidates`` (mention_id, cluster_id, semantic: the k best) with clusters of similarity 0, smallest id first, for
    every post of ``posts`` that has fewer than k. Of clusters the first 2k are enough, so the list is bounded."""
    first = [r[0] for r in clusters.select("cluster_id").orderBy("cluster_id").limit(2 * k).collect()]
    have = candidates.groupBy("mention_id").agg(F.collect_list(F.struct("cluster_id", "semantic")).alias("c"))
    rows = posts.select("mention_id").join(have, "mention_id", "left")
    none = F.array().cast("array<struct<cluster_id:string,semantic:double>>")
    own = F.coalesce("c", none)
    names = F.transform(own, lambda x: x["cluster_id"])
    free = F.slice(F.array_except(F.array(*[F.lit(x) for x in first]) if first else F.array().cast("array<string>"), names), 1, F.greatest(F.lit(k) - F.size(names), F.lit(0)))
    zero = F.transform(free, lambda x: F.struct(x.alias("cluster_id"), F.lit(0.0).alias("semantic")))
    return rows.select("mention_id", F.explode(F.concat(own, zero)).alias("e")).select("mention_id", "e.*")


def overlaps(post_terms: DataFrame, cluster_terms: DataFrame) -> DataFrame:
    """Distinct terms a post shares with a cluster's term set. (mention_id, term), (cluster_id, term)."""
    met = post_terms.distinct().join(small(cluster_terms.distinct()), "term")
    return met.groupBy("mention_id", "cluster_id").agg(F.count(F.lit(1)).alias("overlap"))


def status(confidence: Column, gap: Column) -> Column:
    return F.when((confidence >= 0.55) & (gap >= 0.05), "confident").when(confidence >= 0.30, "uncertain").otherwise("unassigned")


def tier(confidence: Column, gap: Column) -> Column:
    return (
        F.when((confidence >= 0.55) & (gap >= 0.05), "strong_match")
        .when(confidence >= 0.35, "usable_match")
        .when(confidence >= 0.25, "weak_match")
        .otherwise("unassigned")
    )


def weighed(candidates: DataFrame, overlap: DataFrame, prior: DataFrame, digits: int = 9) -> DataFrame:
    """Candidates with keyword overlap, brand prior, confidence and their rank ``r``. Scores are rounded to ``digits``, so that
    the order in which sums were made decides no tie."""
    keys = ["mention_id", "cluster_id"]
    rows = candidates.join(overlap, keys, "left").join(prior, keys, "left")
    rows = rows.withColumns(
        {
            "keyword": F.least(F.coalesce("overlap", F.lit(0)) / 8.0, F.lit(0.2)),
            "brand_prior": F.coalesce("brand_prior", F.lit(0.0)),
        }
    )
    confidence = F.least(F.greatest("semantic", F.lit(0.0)) * 0.78 + F.col("keyword") + F.col("brand_prior"), F.lit(1.0))
    rows = rows.withColumn("confidence", F.round(confidence, digits))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("confidence"), "cluster_id")))


def candidates_json(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """Per post its candidates as a JSON list, best first. ``names``: cluster_id, cluster_name."""
    rows = ranked.join(small(names), "cluster_id", "left")
    entry = F.struct("cluster_id", "cluster_name", F.col("semantic").alias("semantic_score"), F.col("keyword").alias("keyword_overlap_score"), F.col("brand_prior").alias("brand_prior_score"), "confidence")
    listed = rows.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("r", entry.alias("v")))).alias("c"))
    return listed.select("mention_id", F.to_json(F.transform("c", lambda x: x["v"])).alias("top_candidates_json"), F.size("c").alias("candidates"), F.get("c", F.lit(0))["v"]["cluster_name"].alias("best_name"))


def similarity_by(preferred: str, able: dict[str, bool]) -> tuple[str, str]:
    """The similarity that is used, and why not the preferred one: embeddings, then weighted terms, then word counts."""
    chain = ("embedding", "tfidf", "bow")
    tried = chain[chain.index(preferred) :]
    used = next((m for m in tried if able.get(m, True)), "bow")
    return used, "; ".join(f"{m} unavailable" for m in tried[: tried.index(used)])


def assigned(candidates: DataFrame, overlap: DataFrame, prior: DataFrame, digits: int = 9) -> DataFrame:
    """One row per post with candidates: its cluster, confidence, status, tier, runner-up and gap. ``candidates``:
    mention_id, cluster_id, semantic; ``prior``: mention_id, cluster_id, brand_prior."""
    ranked = weighed(candidates, overlap, prior, digits)
    first = F.max(F.when(F.col("r") == 1, F.struct("cluster_id", "confidence", "semantic", "keyword", "brand_prior")))
    second = F.max(F.when(F.col("r") == 2, F.struct("cluster_id", "confidence")))
    two = ranked.where("r <= 2").groupBy("mention_id").agg(first.alias("a"), second.alias("b"))
    gap = F.round(F.col("a.confidence") - F.coalesce("b.confidence", F.lit(0.0)), digits)
    top = two.select(
        "mention_id",
        F.col("a.cluster_id"),
        F.col("a.confidence").alias("assignment_confidence"),
        F.round("a.semantic", digits).alias("semantic_score"),
        F.col("a.keyword").alias("keyword_overlap_score"),
        F.col("a.brand_prior").alias("brand_prior_score"),
        F.coalesce("b.cluster_id", F.lit("")).alias("top2_cluster_id"),
        F.coalesce("b.confidence", F.lit(0.0)).alias("top2_score"),
        gap.alias("score_gap"),
    )
    c, g = F.col("assignment_confidence"), F.col("score_gap")
    out = top.withColumns({"assignment_status": status(c, g), "cluster_usage_tier": tier(c, g)})
    final = F.when(F.col("cluster_usage_tier") != "unassigned", F.col("cluster_id")).otherwise(F.lit(""))
    parts = (("semantic=", "semantic_score"), ("; keyword=", "keyword_overlap_score"), ("; brand_prior=", "brand_prior_score"))
    reason = F.concat(*[x for label, c in parts for x in (F.lit(label), F.format_number(c, 3))])
    return out.withColumns({"final_cluster_id": final, "assignment_reason": reason}).drop("cluster_id")
