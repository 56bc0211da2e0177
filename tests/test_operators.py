"""Small cases with known results of the engine's own operators."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import ids, text
from tidewatch.functions.times import feed_instant, instant, iso_week_label, week_start
from tidewatch.operators import bundle, clusters, entities, posts, reranker, rows, scores
from tidewatch.sources import captured, sinks, tables


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], kinds).select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("a &amp; b", "a & b"), ("see [this](http://x.y) now", "see this now"), ("> quoted\nkept", "kept"), ("<b>bold</b> text", "bold text"),
        ("go https://a.b/c?d now", "go now"), ("thanks u/some_one !!!!", "thanks !"), ("from r/Tea", "from Tea"), ("ﬁne day 😀 ok", "fine day ok"),
        (None, ""), ("", ""), ("it’s — ok", "it's - ok"), ("a `code` b", "a 'code' b"), ("a &#96;code&#96; b", "a code b"),
    ],
)
def test_readable(spark, raw, clean):
    assert one(spark, text.readable(F.col("c")), c=raw) == clean


def test_forms_and_hash(spark):
    assert one(spark, text.token_form(F.col("c")), c="Crème Brûlée & Co. 5+5") == "creme brulee & co 5+5"
    assert one(spark, text.match_form(F.col("c")), c="Crème-Brûlée!") == "creme brulee"
    assert one(spark, text.brand_form(F.col("c")), c="Acme (US) Inc.") == "acme" and one(spark, text.brand_form(F.col("c")), c="No Brand") == ""
    assert one(spark, text.brand_form(F.col("c")), c="Nike™") == "niketm"
    expected = hashlib.sha256(b"a title some text").hexdigest()[:24]
    assert one(spark, text.content_hash(F.col("a"), F.col("b")), a="A title", b="Some text") == expected
    assert one(spark, text.snippet(F.col("c"), 10), c="abcdefghijklmn") == "abcdefg..."


@pytest.mark.parametrize("n,expected", [(1, ["a", "b", "c"]), (2, ["a b", "b c"]), (3, ["a b c"]), (4, [])])
def test_grams(spark, n, expected):
    assert one(spark, text.grams(F.split("c", " "), n), c="a b c") == expected


def test_times(spark):
    assert str(one(spark, week_start(instant(F.col("c"))), c="2026-07-06T12:00:00Z")) == "2026-06-30"
    assert str(one(spark, week_start(instant(F.col("c"))), c="2026-07-07T00:30:00+01:00")) == "2026-06-30"
    assert str(one(spark, week_start(instant(F.col("c")), "mon"), c="2026-07-07")) == "2026-07-06"
    assert one(spark, iso_week_label(instant(F.col("c"))), c="2027-01-01") == "2026-W53"
    assert one(spark, F.unix_timestamp(feed_instant(F.col("c"))), c="Tue, 03 Mar 2026 10:00:00 +0200") == 1772524800
    for bad in (None, "", "just now", "2026", "12:30"):
        assert one(spark, instant(F.col("c")), c=bad) is None


def test_ids(spark):
    url = F.col("u")
    post = ids.post_id(url, F.lit(None).cast("string"))
    address = ids.canonical_url(url, F.col("s"), post)
    made = ids.mention_id(F.lit("src"), post, address, F.lit("T"), F.lit(" A  b "))
    assert one(spark, address, u="https://old.reddit.com/r/Tea/comments/ab12/x?y=1", s="r/redditrunner") == "https://www.reddit.com/r/redditrunner/comments/ab12/"
    assert one(spark, made, u="https://x/r/Tea/comments/AB12/", s="") == "reddit_submission_AB12"
    assert one(spark, address, u="https://a.b/c//?q#f", s="") == "https://www.reddit.com/c/"
    assert one(spark, made, u=None, s="") == "hash_" + hashlib.sha256(b"src||T||a b").hexdigest()[:24]


def test_percentile_and_growth(spark):
    df = spark.createDataFrame([("w", v) for v in (5, 3, 3, 9, 1, 3, None)], "w string, v int").withColumn("p", rows.average_rank("v", ["w"]))
    found = sorted({(r["v"], round(r["p"], 6)) for r in df.where("v is not null").collect()})
    assert found == [(1, round(1 / 6, 6)), (3, 0.5), (5, round(5 / 6, 6)), (9, 1.0)]
    assert df.where("v is null").first()["p"] is None
    g = rows.growth_on_previous_row(spark.createDataFrame([("a", 1, 0), ("a", 3, 4), ("a", 9, 6)], "k string, t int, m int"), ["k"], "t", "m", [])
    assert [r["wow_growth"] for r in g.orderBy("t").collect()] == [0.0, 0.0, 0.5]


@pytest.mark.parametrize("value,score", [(None, 3.0), (0.7, 5.0), (0.9, 5.0), (-0.35, 1.0), (-1.0, 1.0), (0.35, 4.0), (0.0, 3.0)])
def test_sentiment_score(spark, value, score):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(scores.sentiment_score(F.col("v"))).first()[0] == score


@pytest.mark.parametrize(
    "confidence,gap,status,tier",
    [(0.55, 0.05, "confident", "strong_match"), (0.55, 0.04, "uncertain", "usable_match"), (0.32, 0.0, "uncertain", "weak_match"), (0.27, 0.0, "unassigned", "weak_match"), (0.24, 0.0, "unassigned", "unassigned")],
)
def test_ladders(spark, confidence, gap, status, tier):
    df = spark.createDataFrame([(confidence, gap)], "c double, g double")
    assert tuple(df.select(clusters.status(F.col("c"), F.col("g")), clusters.tier(F.col("c"), F.col("g"))).first()) == (status, tier)


def test_score_caps(spark):
    base = [("a", 2, 1), ("b", 4, 2), ("c", 9, 9), ("d", 1, 1), ("e", 1, 1)]
    df = spark.createDataFrame([(c, n, s, 0.1, 1.0) for c, n, s in base], "cluster_id string, current_week_posts long, unique_subreddits long, avg_sentiment double, avg_log_engagement double")
    out = {r["cluster_id"]: r for r in scores.trend_scores(df.withColumn("week", F.to_date(F.lit("2026-03-03")))).collect()}
    assert out["a"]["spike_bucket"] <= 2 and out["a"]["cross_community_score"] <= 2 and out["b"]["spike_bucket"] <= 3 and out["b"]["cross_community_score"] <= 3
    assert all(1 <= r["trend_score"] <= 5 for r in out.values())


def test_whole_words_and_greedy_names(spark):
    df = spark.createDataFrame([("1", "related to led and called off"), ("2", "ledger")], "mention_id string, c string")
    assert [(r[0], r[1]) for r in entities.rule_hits(df, F.col("c")).collect()] == [("1", "led")]
    texts = spark.createDataFrame([("1", "louis vuitton keepall and vuitton"), ("2", "a b"), ("3", "")], "mention_id string, form string")
    names = spark.createDataFrame([("louis vuitton",), ("louis",), ("vuitton",), ("vuitton keepall",), ("a b",)], "brand_norm string")
    found = {(r["mention_id"], r["brand_norm"], r["place"]) for r in entities.greedy_hits(texts, names).collect()}
    assert found == {("1", "louis vuitton", 1), ("1", "vuitton", 5), ("2", "a b", 1)}


def greedy(words, names, longest=3):
    taken, out = set(), set()
    for n in range(longest, 0, -1):
        for i in range(len(words) - n + 1):
            run = " ".join(words[i : i + n])
            if run in names and len(run) >= 3 and not taken & set(range(i, i + n)):
                taken |= set(range(i, i + n))
                out.add((run, i + 1))
    return out


def test_greedy_names_like_a_loop(spark):
    import random

    rng = random.Random(4)
    names = {" ".join(rng.choices(["aaa", "bbb", "ccc", "dd"], k=rng.randint(1, 3))) for _ in range(14)}
    posts_ = [(str(i), " ".join(rng.choices(["aaa", "bbb", "ccc", "dd", "eee"], k=rng.randint(0, 14)))) for i in range(60)]
    found = entities.greedy_hits(spark.createDataFrame(posts_, "mention_id string, form string"), spark.createDataFrame([(n,) for n in names], "brand_norm string"))
    got = {i: set() for i, _ in posts_}
    for r in found.collect():
        got[r["mention_id"]].add((r["brand_norm"], r["place"]))
    assert got == {i: greedy(t.split(), names) for i, t in posts_}


def test_candidates_need_a_purchase_word(spark):
    df = spark.createDataFrame([("1", "I bought a KitchenPro and ACME from Big Shop"), ("2", "KitchenPro is here"), ("3", None)], "mention_id string, body string")
    known = spark.createDataFrame([("acme",)], "brand_norm string")
    assert {r["entity_text"] for r in entities.candidates(df, known).collect()} == {"KitchenPro", "Big Shop"}


def test_right_closed_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 2.0, 2.5, 2.51, 5.0, 6.0)], "v double")
    assert {r["band"]: r["count"] for r in bundle.histogram(df, "v").collect()} == {"1-2": 2, "2-2.5": 1, "2.5-3": 1, "3-3.5": 0, "3.5-4": 0, "4-4.5": 0, "4.5-5": 1}


def test_first_by_either_key_counts_invalid_copies(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "z"), (4, "c", "z")], "t int, i string, h string")
    assert [(r["t"], r["i"]) for r in rows.keep_first_by_either(df, ["i", "h"], [F.col("t")]).orderBy("t").collect()] == [(1, "a"), (4, "c")]


def test_cleaning_stage(spark):
    names = "mention_id string, title string, text string, author string, community string, published_at string, collected_at string, url string, metrics_json string"
    data = [
        ("a", "The title", "I think that this is a good text for you", "me", "Tea", "2026-03-03T00:00:00Z", "2026-03-04T00:00:00Z", "u", '{"score": 3, "num_comments": 2}'),
        ("b", "The title", "I think that this is a good text for you", "me", "Tea", "2026-03-03T00:00:00Z", "2026-03-05T00:00:00Z", "u", None),
        ("c", "Gone", "[removed]", "me", "Tea", "2026-03-03T00:00:00Z", "2026-03-05T00:00:00Z", "u", "no json"),
        ("d", "Daily thread", "it is what it is for you and me today", "helper_bot", None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
    ]
    raw = spark.createDataFrame(data, names)
    out = posts.clean_posts(raw, [F.col("collected_at"), F.col("mention_id")]).collect()
    assert [(r["mention_id"], r["score"], r["num_comments"]) for r in out] == [("a", 3.0, 2.0)]
    report = posts.quality_report(posts.flagged_posts(raw)).first()
    assert report["rows"] == 5 and report["bots"] == 1 and report["deleted"] == 1 and report["megathreads"] == 1
    assert posts.clean_posts(raw.limit(0), [F.col("collected_at")]).count() == 0


def test_ranking_metrics_and_split(spark):
    df = spark.createDataFrame([("q1", "a", 1, 0.9), ("q1", "b", 0, 0.5), ("q2", "a", 0, 0.9), ("q2", "b", 1, 0.5), ("q3", "a", 0, 1.0)], "query_id string, cluster_id string, label int, s double")
    r = reranker.ranking_metrics(df, "s").first()
    assert (r["queries"], r["top1"], r["top3"], r["reciprocal"], r["mean_rank"]) == (2, 0.5, 1.0, 0.75, 1.5)
    sides = reranker.split(df).groupBy("query_id").agg(F.countDistinct("is_train").alias("n"), F.max("is_train").alias("t")).collect()
    assert all(x["n"] == 1 for x in sides) and {x["t"] for x in sides} == {True, False}


def test_reranker_has_the_references_size(spark, monkeypatch):
    monkeypatch.setattr(reranker.GBTClassifier, "fit", lambda self, data: self)
    fitted = reranker.trained(spark.createDataFrame([(1, *[0.0] * len(reranker.FEATURES))], ["label", *reranker.FEATURES]))
    assert (fitted.getMaxIter(), fitted.getMaxDepth(), fitted.getFeatureSubsetStrategy()) == (300, 4, "0.8")


def test_aliases_of_any_length(spark):
    names = ["one", "a very long name of seven words"]
    texts = spark.createDataFrame([("1", "one is a very long name of seven words here")], "mention_id string, form string")
    known = spark.createDataFrame([(n, n) for n in names], "alias_norm string, brand_norm string")
    assert {(r["alias_norm"], r["place"]) for r in entities.alias_hits(texts, known).collect()} == {(names[0], 1), (names[1], 3)}
    assert entities.alias_hits(texts, known.limit(0)).count() == 0


def test_category_keywords_and_phrases_of_all_the_post(spark):
    words = " ".join(f"w{i // 2}x" for i in range(200)) + " quiet heating pad"
    posts_ = spark.createDataFrame([("1", words)], "mention_id string, body string")
    registry = spark.createDataFrame([], "brand_norm string, is_whitelist_brand boolean")
    aliases = spark.createDataFrame([], "alias_norm string, brand_norm string, source string")
    profiles = spark.createDataFrame([("7", "Pads", ["pad"], ["Heating Pad"]), ("6", "Heat", None, ["heating pad"]), (" ", "-", None, ["quiet heating"])], "cluster_id string, cluster_name string, top_product_terms array<string>, top_product_phrases array<string>")
    found = {r["entity_norm"]: r for r in entities.extracted(posts_, registry, aliases, entities.cluster_terms(profiles)).collect()}
    pad, quiet = found["heating pad"], found["quiet heating"]
    assert (pad["entity_type"], pad["confidence"], pad["matched_cluster_id"], pad["matched_cluster_name"]) == ("category_keyword", 0.65, "7", "Pads")
    assert (quiet["entity_type"], quiet["confidence"], quiet["matched_cluster_id"]) == ("product_phrase", 0.45, None)


def test_captured_sources(spark, tmp_path):
    (tmp_path / "listing").mkdir()
    page = {"data": {"after": "x", "children": [{"data": {"id": "1", "title": "T", "selftext": "[deleted]", "created_utc": 1772524800, "score": 2, "num_comments": 3, "permalink": "/r/a/comments/1/"}}]}}
    (tmp_path / "listing/a.json").write_text(json.dumps(page))
    (tmp_path / "listing/b.json").write_text("{broken")
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="u"/><author><name>n</name></author><updated>2026-03-03T08:00:00+00:00</updated></entry></feed>')
    spark.dataSource.register(captured.CapturedPosts)
    rows_ = spark.read.format("captured_posts").option("path", str(tmp_path / "listing")).option("kind", "listing").load().collect()
    assert [(r["native_id"], r["text"], r["engagement_score"], r["published"]) for r in rows_] == [("1", "", 11.0, "2026-03-03T08:00:00+00:00")]
    feed = spark.read.format("captured_posts").option("path", str(tmp_path / "feed")).option("kind", "feed").load().first()
    assert (feed["url"], feed["author"], feed["source"]) == ("u", "n", "reddit_rss")


def test_readers_and_writers(spark, tmp_path):
    a = spark.createDataFrame([("1", "x")], "mention_id string, t string")
    a.write.parquet(f"{tmp_path}/raw/daily/d1/a.parquet")
    spark.createDataFrame([("2", 5)], "mention_id string, n int").write.parquet(f"{tmp_path}/raw/backfill/w1/b.parquet")
    both = tables.raw_batches(spark, f"{tmp_path}/raw")
    assert both.count() == 2 and {"t", "n", "raw_source_file"} <= set(both.columns)
    assert tables.known_ids(spark, f"{tmp_path}/none.parquet").count() == 0
    config = {"reddit": {"subreddit_categories": {"late": ["b", "a"], "first": ["c", "a"]}}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    order = tables.communities(spark, str(tmp_path / "c.json"), ("first",)).orderBy("place").collect()
    assert [(r["category"], r["community"]) for r in order] == [("first", "c"), ("first", "a"), ("late", "b")]
    assert tables.source_names("arctic, rss,hn,rss") == ["arctic_shift_reddit", "reddit_rss"]
    assert tables.json_state(spark, str(tmp_path / "none.json")) == {} and tables.retry_delays(404) is None and tables.retry_delays(429)[1] == (10, 13)
    from pyspark.sql import types as T

    contract = T.StructType().add("mention_id", "string").add("t", "string").add("logo", "string")
    sinks.append_batch(a.unionByName(a), f"{tmp_path}/out", "daily", "2026-03-03", contract, [F.desc("t")])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    sinks.csv_view(a.withColumn("l", F.array("t")), f"{tmp_path}/view.csv")
    assert tables.any_table(spark, f"{tmp_path}/view.csv").first()["l"] == "[\"x\"]"
    sinks.json_report(a, f"{tmp_path}/r/report.json")
    assert json.loads((tmp_path / "r/report.json").read_text()) == {"mention_id": "1", "t": "x"}
    (tmp_path / "bundle.json").write_text(json.dumps({"brands": [{"brand_norm": "x", "mentions": 3}]}))
    assert tables.bundle_rows(spark, str(tmp_path / "bundle.json"), "brands", "brand_norm: string, mentions: bigint").first()["mentions"] == 3
