"""Writers: raw batches, stage tables, audits, state, reports, review lists and weekly documents."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.rows import keep_one
from tidewatch.storage import _file, align, write_text


def append_batch(df: DataFrame, path: str, mode: str, window: str, contract: T.StructType, order: list[Column]) -> None:
    """Appends a batch under mode and window in the contract's shape, the last row of each id by ``order`` (descending
    columns first)."""
    rows = keep_one(align(df, contract), ["mention_id"], order)
    rows.withColumns({"mode": F.lit(mode), "window": F.lit(window)}).write.mode("append").partitionBy("mode", "window").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    """A true append: nothing written before is read."""
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, *views: str) -> None:
    """A stage's table, also under some view names."""
    df.write.mode("overwrite").parquet(path)
    for v in views:
        df.sparkSession.read.parquet(path).createOrReplaceTempView(v)


def csv_view(df: DataFrame, path: str) -> None:
    """Text form of a table, nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_report(row: DataFrame, path: str) -> None:
    """A report of one row as an indented document."""
    found = row.limit(1).toJSON().collect()
    write_text(row.sparkSession, path, json.dumps(json.loads(found[0]) if found else {}, indent=2, ensure_ascii=False) + "\n")


def review_queue(entities: DataFrame, path: str) -> None:
    """The distinct candidates that wait for a decision, as CSV."""
    columns = ["mention_id", "entity_text", "entity_norm", "source", "context_window", "review_status"]
    csv_view(entities.where("review_status = 'candidate'").select(*columns).distinct(), path)


@contextmanager
def exclusive(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds a lock file while its block runs; a second holder fails at once. The file system makes it atomically."""
    files, target = _file(spark, path)
    if not files.createNewFile(target):
        raise RuntimeError(f"{path} is held by another run")
    try:
        yield
    finally:
        files.delete(target, False)


def weekly_documents(documents: DataFrame, path: str) -> None:
    """One text file per week; the document is the only column of (week_start, document). ``latest`` names the last week."""
    documents.repartition("week_start").write.mode("overwrite").partitionBy("week_start").text(path)
    last = documents.agg(F.max("week_start")).first()[0]
    if last is not None:
        write_text(documents.sparkSession, f"{path}/_latest", str(last))


def sorted_table(df: DataFrame, path: str, *order: Column) -> None:
    """A stage's table in the order its readers expect, files in order of their names."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def saved_model(model: object, path: str) -> None:
    model.write().overwrite().save(path)
