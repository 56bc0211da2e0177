"""Subject areas of documents and of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.subjects import background_counts, fitted, labelled, subject_shares
from tidewatch.storage import table


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    areas = table(spark, folder, "subject_areas").select("subject").distinct()
    labels = table(spark, folder, "subject_labels").join(areas, "subject", "left_semi")
    texts, own = labelled(documents, labels)
    return subject_shares(documents, fitted(texts, own, background_counts(documents)))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_shares(spark, folder).select("doc_id", "subject").distinct()


def p10_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Per area the documents that have it and the words they give to it."""
    shares = p10_shares(spark, folder).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("words").alias("words"))
    areas = table(spark, folder, "subject_areas").select("subject").distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "words")]
    return areas.join(shares, "subject", "left").select("subject", *zero)


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_corpus": p10_corpus}
SQL: dict[str, str] = {}
