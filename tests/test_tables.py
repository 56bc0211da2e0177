"""Numbering, first rows, records, lists, locks and written documents on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import lists, times
from tidewatch.operators import bundle, clusters, posts, rows
from tidewatch.sources import sinks
from tidewatch.storage import names, read_text, try_table


def test_numbers_run_through_many_partitions(spark):
    df = spark.range(5000, numPartitions=9).select((F.col("id") * 7919 % 5000).alias("v"), F.lit(None).cast("string").alias("row_id0"))
    found = rows.numbered(df, ["v"]).orderBy("row_id").collect()
    assert [(r["v"], r["row_id"]) for r in found] == [(i, i + 1) for i in range(5000)]
    assert rows.numbered(df.limit(0), ["v"]).count() == 0


def test_first_rows_where_a_third_has_one_hash(spark):
    data = [(f"i{k % 400}", "" if k % 3 == 0 else f"h{k % 150}", k * 37 % 1000) for k in range(900)] + [(None, None, 5), (None, "x", None)]
    df = spark.createDataFrame(data, "i string, h string, t int")
    order = lambda r: (r[2] is not None, r[2])  # noqa: E731 - nulls first
    expected = {r for r in data if r == min((s for s in data if s[0] == r[0]), key=order) and r == min((s for s in data if s[1] == r[1]), key=order)}
    out = rows.keep_first_by_either(df, ["i", "h"], [F.col("t")])
    assert {tuple(r) for r in out.collect()} == expected
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_first_filled_value(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, " "), (1, 3, "c"), (2, 1, None)], "g int, o int, v string")
    assert {r["g"]: r["v"] for r in df.groupBy("g").agg(rows.first_filled_value("v", F.col("o")).alias("v")).collect()} == {1: "b", 2: ""}


@pytest.mark.parametrize(
    "stored,values", [('["a", "b c"]', ["a", "b c"]), ("a, b;c | ", ["a", "b", "c"]), ("", []), (None, []), ("[1, 2]", ["1", "2"]), ("[broken", ["[broken"]), ('{"a": 1}', ['{"a": 1}'])]
)
def test_parsed_lists(spark, stored, values):
    df = spark.createDataFrame([(stored,)], "c string")
    assert df.select(lists.parsed_list(F.col("c"))).first()[0] == values
    strict = values if (stored or "").startswith("[") and "broken" not in stored else []
    assert df.select(lists.json_only(F.col("c"))).first()[0] == strict


def test_json_list_is_json(spark):
    values = ["plain", 'with "quotes"', "back\\slash", "é ü", " ", None, "last"]
    df = spark.createDataFrame([(values,), (None,)], "v array<string>")
    whole, none = (r[0] for r in df.select(lists.json_list(F.col("v"))).collect())
    assert whole == json.dumps([v for v in values if v and v.strip()], ensure_ascii=False) and none == "[]"
    assert df.select(lists.json_list(F.col("v"), 2)).first()[0] == json.dumps(values[:2], ensure_ascii=False)


def test_week_of_a_label(spark):
    df = spark.createDataFrame([("2026-W01",), ("2026-W53",), ("2027-W01",)], "w string")
    first, last = times.iso_week(F.col("w"))
    assert [(str(r[0]), str(r[1])) for r in df.select(first, last).collect()] == [("2025-12-29", "2026-01-04"), ("2026-12-28", "2027-01-03"), ("2027-01-04", "2027-01-10")]


def test_new_records_and_audit(spark):
    schema = "mention_id string, published_at string, collected_at string, title string, run string"
    batch = spark.createDataFrame([("a", "2026-01-01T00:00:00Z", "2", "x", "r"), ("a", "2026-01-01T00:00:00Z", "1", "y", "r"), ("k", "bad", "3", "z", "r"), (None, None, "4", "n", "r")], schema)
    known = spark.createDataFrame([("k",), ("k",), (None,)], "mention_id string")
    assert [tuple(r) for r in posts.new_records(batch, known, [F.col("collected_at")]).select("mention_id", "title").collect()] == [("a", "y")]
    r = posts.audit(batch, known, ["run"]).first()
    assert (r["records_seen"], r["records_new"], r["records_duplicate"], r["unreadable"], r["status"]) == (4, 1, 3, 2, "partial")
    assert posts.audit(batch.limit(0), known, ["run"]).count() == 0


def test_lock_review_queue_and_latest(spark, tmp_path):
    with sinks.exclusive(spark, f"{tmp_path}/lock"):
        with pytest.raises(RuntimeError):
            with sinks.exclusive(spark, f"{tmp_path}/lock"):
                pass
    with sinks.exclusive(spark, f"{tmp_path}/lock"):
        pass
    rows_ = [("1", "X", "x", "regex_allcaps", "c", "candidate")] * 2 + [("2", "Y", "y", "whitelist", "c", "approved")]
    df = spark.createDataFrame(rows_, "mention_id string, entity_text string, entity_norm string, source string, context_window string, review_status string")
    sinks.review_queue(df, f"{tmp_path}/queue")
    assert spark.read.option("header", True).csv(f"{tmp_path}/queue").count() == 1
    weeks = spark.createDataFrame([("2026-03-03", "{}"), ("2026-03-10", "{}")], "week_start string, document string")
    sinks.weekly_documents(weeks, f"{tmp_path}/weeks")
    assert read_text(spark, f"{tmp_path}/weeks/_latest") == "2026-03-10" and "week_start=2026-03-03" in names(spark, f"{tmp_path}/weeks")


def test_a_broken_table_is_an_error(spark, tmp_path):
    (tmp_path / "t.parquet").write_text("no parquet")
    schema = spark.createDataFrame([], "a string").schema
    assert try_table(spark, f"{tmp_path}/none", schema).count() == 0
    with pytest.raises(Exception):
        try_table(spark, f"{tmp_path}/t.parquet", schema).count()


def test_posts_without_words_have_candidates(spark):
    found = spark.createDataFrame([("a", "c2", 0.5)], "mention_id string, cluster_id string, semantic double")
    everyone = spark.createDataFrame([("a",), ("b",)], "mention_id string")
    names_ = spark.createDataFrame([(f"c{i}",) for i in range(5)], "cluster_id string")
    out = {(r["mention_id"], r["cluster_id"]): r["semantic"] for r in clusters.filled_candidates(found, everyone, names_, 3).collect()}
    assert out == {("a", "c2"): 0.5, ("a", "c0"): 0.0, ("a", "c1"): 0.0, ("b", "c0"): 0.0, ("b", "c1"): 0.0, ("b", "c2"): 0.0}
    assert clusters.similarity_by("embedding", {"embedding": False, "tfidf": False}) == ("bow", "embedding unavailable; tfidf unavailable")


def test_nearest_in_blocks(spark, monkeypatch):
    data = [(i, [float(i % 3), float(i % 5), 1.0], i % 7) for i in range(60)] + [(100, None, 0), (101, [1.0], 0)]
    df = spark.createDataFrame(data, "k long, v array<double>, label int")
    centers = clusters.centroids(df.where("k < 60"), "label", "v")
    one = [tuple(r) for r in clusters.nearest(df, "k", "v", centers, 3).orderBy("k", "candidate_rank").collect()]
    monkeypatch.setattr(clusters, "CENTROIDS", 2)
    assert [tuple(r) for r in clusters.nearest(df, "k", "v", centers, 3).orderBy("k", "candidate_rank").collect()] == one and len(one) == 180
    assert clusters.nearest(df, "k", "v", centers.limit(0), 3).count() == 0


def test_document_has_all_sections(spark):
    weeks = spark.createDataFrame([("w1", ["w1"]), ("w0", ["w1"])], "week_start string, weeks array<string>")
    meta = spark.createDataFrame([("w1", 3)], "week_start string, cluster_count int")
    part = spark.createDataFrame([("w1", 2, "b"), ("w1", 1, "a")], "week_start string, position int, term string")
    found = {r["week_start"]: json.loads(r["document"]) for r in bundle.documents(weeks, {"keywords": part}, meta).collect()}
    assert found["w1"] == {"meta": {"latest_week": "w1", "cluster_count": 3}, "keywords": [{"term": "a"}, {"term": "b"}], "weeks": ["w1"]}
    assert found["w0"]["keywords"] == []
