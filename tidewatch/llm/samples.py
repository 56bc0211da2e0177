"""Bounded samples of labelled or background rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_STEPS = 1 << 30


def bounded_sample(df: DataFrame, key: str, bound: int) -> list[Row]:
    """At most ``bound`` rows, those with the smallest hash of their key. Tasks keep about twice the bound of rows among
    all of them, so what reaches the driver doesn't grow with the number of tasks."""
    total = df.count()
    if not total:
        return []
    hashed = F.pmod(F.xxhash64(F.lit(17), key), F.lit(_STEPS))
    few = df.withColumn("_h", hashed).where(F.col("_h") <= int(min(1.0, 2.0 * bound / total + 1e-6) * _STEPS))
    rest = [F.col(f"`{c}`") for c in df.columns]
    return few.orderBy("_h", *rest).limit(bound).drop("_h").collect()
