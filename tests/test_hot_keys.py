from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.operators import hot_keys as H


def test_one_key_holds_most_rows(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("key"),
        (F.col("id") % 7).cast("double").alias("v"), F.lit(1).alias("block"), F.lit(2).alias("cell"),
    )
    expected = {r[0]: (r[1], r[2]) for r in rows.groupBy("key").agg(F.count("*"), F.sum("v")).collect()}
    found = {r[0]: (r[1], r[2]) for r in H.dense_totals(rows, F.col("key"), {"s": F.col("v")}).collect()}
    assert found == expected
    assert [r[0] for r in H.heavy_keys(rows, F.col("key")).collect()] == ["hot"]


def test_keys_numbered_by_each_split(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    rows = spark.range(20_000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 9000).cast("string"))).alias("key"),
        (F.col("id") % 7).cast("double").alias("v"), F.lit("clash").alias("block"), F.lit(2).alias("keys"),
    )
    expected = {r[0]: (r[1], r[2]) for r in rows.groupBy("key").agg(F.count("*"), F.sum("v")).collect()}
    found = H.dense_totals(rows, F.col("key"), {"s": F.col("v")})
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == expected
    assert found.count() == len(expected)
    # no exchange by key, only of blocks
    assert "hashpartitioning(key" not in found._jdf.queryExecution().toString()


def test_early_flush(spark, monkeypatch):
    monkeypatch.setattr(H, "SPLIT_BYTES", 0)
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), (None, 5.0), (" ", 1.0)], "key string, v double")
    for limit in (1 << 20, -1):
        monkeypatch.setattr(H, "BROADCAST_BYTES", limit)
        assert {tuple(r) for r in H.dense_totals(rows, F.col("key"), {"s": F.col("v")}).collect()} == {("a", 2, 1.0), ("b", 1, 2.0)}


def test_a_split_computed_again_gives_the_same_blocks(spark):
    """A lost map task is run again while others' output stays: its blocks must go to the same reducers."""
    rows = spark.range(30_000, numPartitions=7).select((F.col("id") % 5000).cast("string").alias("key"), F.col("id").cast("double").alias("m0"))
    keys, _ = H.dictionary(rows)
    shared = rows.join(F.broadcast(keys), "key").drop("key").mapInArrow(H._accumulate(["m0"]), "block int, salt int, sums array<double>")
    own = rows.withColumn("block", H.block_of(5000)).mapInArrow(H._accumulate_own(["m0"]), "block int, salt int, keys array<string>, sums array<double>")
    for parts in (shared, own):
        once, again = (sorted(map(tuple, parts.collect()), key=repr) for _ in range(2))
        assert once == again and len({r[1] for r in once}) == 7


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_empty_table(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_BYTES", limit)
    rows = spark.createDataFrame([], "key string, v double")
    assert H.dense_totals(rows, F.col("key"), {"s": F.col("v")}).count() == 0 and H.heavy_keys(rows, F.col("key")).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "", None, "é", "x" * 3000]), st.integers(-9, 9)), max_size=40))
def test_like_a_plain_sum(spark, data):
    plain = defaultdict(lambda: [0, 0.0])
    for k, v in data:
        if k and k.strip():
            plain[k][0] += 1
            plain[k][1] += v
    df = spark.createDataFrame(data, "key string, v int")
    found = {r[0]: [r[1], r[2]] for r in H.dense_totals(df, F.col("key"), {"s": F.col("v")}).collect()}
    assert found == dict(plain)
