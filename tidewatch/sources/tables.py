"""Readers: batches of raw posts, tables of several formats, configuration, state and bundles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.storage import exists, read_text

# Names of sources as they may be given, and those no longer read.
SOURCE_NAMES = {"json": "reddit_json", "rss": "reddit_rss", "arctic": "arctic_shift_reddit"}
DROPPED_SOURCES = ("hn", "gnews")


def raw_batches(spark: SparkSession, *folders: str) -> DataFrame:
    """All parquet batches below the folders, united by name, unreadable files skipped, with the file of each row."""
    rows = (
        spark.read.option("recursiveFileLookup", True)
        .option("mergeSchema", True)
        .option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(*folders)
    )
    return rows.select("*", F.col("_metadata.file_path").alias("raw_source_file"))


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, csv (header, quoted line breaks), json, orc, or an Excel sheet where its reader is installed."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    reader = spark.read
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return {"parquet": reader.parquet, "json": reader.json, "orc": reader.orc}.get(kind, reader.parquet)(path)


def known_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids already collected; only their column is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "mention_id string")
    return spark.read.parquet(path).select("mention_id").where("mention_id is not null").distinct()


def communities(spark: SparkSession, path: str, first: tuple[str, ...] = ()) -> DataFrame:
    """(category, community, place) of a configuration {reddit: {subreddit_categories: {category: [names]}}}; communities
    of the categories named first come first, and each keeps its first place only."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "reddit struct<subreddit_categories: map<string, array<string>>>")
    rows = raw.select(F.posexplode(F.map_entries(parsed["reddit"]["subreddit_categories"])).alias("c", "e"))
    rows = rows.select("c", F.col("e.key").alias("category"), F.posexplode("e.value").alias("i", "community"))
    rank = F.array_position(F.array(*[F.lit(x) for x in first]) if first else F.array().cast("array<string>"), F.col("category"))
    turn = F.when(rank > 0, rank).otherwise(F.lit(1_000_000))
    best = rows.groupBy("community").agg(F.min(F.struct(turn, "c", "i", "category")).alias("p"))
    return best.select("p.category", "community", F.col("p").alias("place"))


def source_names(text: str) -> list[str]:
    """Canonical names of a comma-separated list, without those that are no longer read."""
    names = [s.strip().lower() for s in text.split(",") if s.strip()]
    return list(dict.fromkeys(SOURCE_NAMES.get(n, n) for n in names if n not in DROPPED_SOURCES))


def json_state(spark: SparkSession, path: str) -> dict:
    """A state document; a missing or broken one is empty."""
    if not exists(spark, path):
        return {}
    try:
        found = json.loads(read_text(spark, path))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def bundle_rows(spark: SparkSession, path: str, section: str, schema: T.StructType | str) -> DataFrame:
    """The rows of one section of a dashboard document."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    parsed = F.from_json("value", f"{section} array<struct<{kind}>>" if isinstance(schema, str) else f"{section} array<{kind}>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed[section]).alias("r")).select("r.*")


def retry_delays(status: int, attempts: int = 3) -> list[tuple[float, float]] | None:
    """For a failed fetch the shortest and longest wait before each further attempt; none where it is no use."""
    if status in (403, 404):
        return None
    if status == 429:
        return [(min(90, 2**n * 5), min(90, 2**n * 5 + 3)) for n in range(attempts)]
    return [(min(60, 2**n * 3), min(60, 2**n * 3 + 2)) for n in range(attempts)]
