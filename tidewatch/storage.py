"""Reading tables and cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session. Only where it is unset on a single machine
    (tests) a temporary folder is made and set; on a cluster that would be a folder of the driver's own, so it is an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed when the process ends."""
    path = f"{shared_root(spark)}/tidewatch/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _file(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path as it takes it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file(spark, path)
    return files.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is missing."""
    files, target = _file(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    files, target = _file(spark, path)
    files.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written through Spark's file system so that the path may be any it knows."""
    files, target = _file(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _file(spark, path)
    stream = files.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            pass


def pinned(df: DataFrame, label: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back: it survives lost executors, isn't computed
    twice, and what reads it starts from a short lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.option("compression", "zstd")
    if names := list(partition_by):
        writer = writer.partitionBy(*names)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions than there are (a small table, or files that can't be split),
    for work in Python that costs far more than moving the rows; unchanged where there are enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def try_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path`` aligned to ``schema``, or an empty one of that schema if it is missing. A table that is there
    but can't be read is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return align(spark.read.parquet(path), schema)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Contract alignment: missing columns become null, order and types follow the contract, extra columns go."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
