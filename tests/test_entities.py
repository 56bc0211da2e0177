"""Entities of posts against independent renderings in plain Python, on small cases and on the smallest data."""

import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import entities as E

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
REGISTRY = (
    "brand_norm string, brand_display string, aliases array<string>, is_whitelist_brand boolean, primary_cluster_id string, primary_cluster_name string,"
    " related_cluster_ids array<string>, extra string"
)
ALIASES = "alias_norm string, brand_norm string, source string"


def _bodies():
    rows = pq.read_table(f"{FOLDER}/clean_reddit_posts.parquet", columns=["mention_id", "title_clean", "text_clean"]).to_pylist()
    return {r["mention_id"]: f"{r['title_clean'] or ''}. {r['text_clean'] or ''}".strip() for r in rows}


def _names():
    return [n for n in pq.read_table(f"{FOLDER}/brand_registry.parquet", columns=["brand_norm"]).column(0).to_pylist()]


@needs_data
def test_catalog_hits_like_a_scan_of_every_post(spark):
    from tidewatch.plans.entity_queries import catalog_hits

    names = {n for n in _names() if n}
    expected = set()
    for post, body in _bodies().items():
        words = re.sub("[^a-z0-9]+", " ", body.lower()).split()
        claimed = [False] * len(words)
        for n in (3, 2, 1):
            for i in range(len(words) - n + 1):
                run = " ".join(words[i : i + n])
                if len(run) >= 3 and run in names and not any(claimed[i : i + n]):
                    expected.add((post, run, i + 1, n))
                    claimed[i : i + n] = [True] * n
    found = {(r["mention_id"], r["brand_norm"], r["place"], r["n"]) for r in catalog_hits(spark, FOLDER).collect()}
    assert found == expected and found


@needs_data
def test_name_candidates_like_a_scan_of_every_post(spark):
    from tidewatch.functions import text
    from tidewatch.plans.entity_queries import name_candidates

    known, bodies = {n for n in _names() if n}, _bodies()
    patterns = {
        "regex_allcaps": r"\b[A-Z][A-Z0-9&+-]{1,10}\b", "regex_camel": r"\b[A-Z][a-z]+[A-Z][A-Za-z0-9]+\b",
        "regex_title": r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,2}\b", "regex_quote": r"['\"][^'\"]{3,40}['\"]",
    }
    spans = set()
    for post, body in bodies.items():
        for source, pattern in patterns.items():
            for m in re.finditer(pattern, body):
                shown = m[0][1:-1] if source == "regex_quote" else m[0]
                if source in ("regex_title", "regex_quote") and " " not in shown.strip():
                    continue
                if re.search(E.PURCHASE, body[max(0, m.start() - 80) : m.end() + 80].strip()):
                    spans.add((post, shown, source, m.start()))
    forms = spark.createDataFrame([(s,) for s in {s[1] for s in spans}], "t string").select("t", text.brand_form(F.col("t")).alias("f"))
    form = {r["t"]: r["f"] for r in forms.collect()}
    expected = {s for s in spans if len(form[s[1]]) >= 3 and form[s[1]] not in E.CANDIDATE_NOISE and form[s[1]] not in known}
    found = {(r["mention_id"], r["entity_text"], r["source"], r["start_char"]) for r in name_candidates(spark, FOLDER).collect()}
    assert found == expected and found


def _extracted(spark, bodies):
    registry = spark.createDataFrame(
        [
            ("acme", "Acme", [], True, "c1", "Pans", ["c1", "c2"], "x"), ("nordvik", "Nordvik", None, False, "c9", "Tents", None, "x"),
            ("tall oak mill", "Tall Oak Mill", [], False, None, None, [], "x"), ("cookies", "cookies", [], False, "c3", "Food", [], "x"),
        ],
        REGISTRY,
    )
    aliases = spark.createDataFrame([("acme", "acme", "whitelist"), ("acme gear", "acme", "whitelist"), ("acme deluxe cast iron pans", "acme", "whitelist"), ("nordvik", "nordvik", "catalog")], ALIASES)
    terms = spark.createDataFrame([("cast iron", "c1", "Pans")], "term string, cluster_id string, cluster_name string")
    posts = spark.createDataFrame(bodies, "mention_id string, body string, brand_norm string")
    return E.extracted(posts, registry, aliases, terms)


def test_extracted_rows_have_places_links_and_status(spark):
    far = "word " * 40
    bodies = [
        ("1", "I bought an ACME-gear pan, cast iron and led. Nordvik is fine, really.", "clash"),
        ("2", f"Nordvik {far} bought elsewhere. Acme", None),
        ("3", "Tall Oak  Mill pans without context", None),
        ("4", None, None), ("5", "", None), ("6", "the Acme Deluxe Cast Iron Pans and cookies", None),
    ]
    out = _extracted(spark, bodies)
    assert len(out.columns) == 19 and {"context_window", "google_search_url", "related_cluster_ids"} <= set(out.columns)
    rows = out.collect()
    brands = {(r["mention_id"], r["entity_text"], r["source"]): r for r in rows if r["is_brand"]}
    # Nordvik stands near a purchase word in 1 only, cookies nowhere; names of several words count without one
    assert set(brands) == {
        ("1", "ACME", "whitelist"), ("1", "ACME-gear", "whitelist"), ("1", "Nordvik", "catalog"), ("2", "Acme", "whitelist"), ("3", "Tall Oak  Mill", "catalog"),
        ("6", "Acme", "whitelist"), ("6", "Acme Deluxe Cast Iron Pans", "whitelist"),
    }
    for r in rows:
        body = dict((b[0], b[1]) for b in bodies)[r["mention_id"]]
        if r["start_char"] >= 0:
            assert body[r["start_char"] : r["end_char"]].lower() == r["entity_text"].lower()
            assert r["context_window"] == body[max(0, r["start_char"] - 80) : r["end_char"] + 80].strip()
        assert bool(r["google_search_url"]) == r["is_brand"]
    one = brands["1", "ACME-gear", "whitelist"]
    assert (one["brand_norm"], one["matched_cluster_id"], one["related_cluster_ids"], one["confidence"], one["review_status"]) == ("acme", "c1", ["c1", "c2"], 1.0, "approved")
    other = brands["1", "Nordvik", "catalog"]
    assert (other["brand_signal_type"], other["review_status"], other["matched_cluster_name"]) == ("catalog_known_brand", "catalog_observed", "Tents")
    phrase = next(r for r in rows if r["mention_id"] == "1" and r["entity_norm"] == "cast iron")
    assert (phrase["entity_type"], phrase["confidence"], phrase["matched_cluster_id"]) == ("category_keyword", 0.65, "c1")
    assert {r["entity_text"] for r in rows if r["entity_type"] == "ingredient_material" and r["mention_id"] == "1"} == {"led"}
    assert not [r for r in rows if r["mention_id"] in "45"]
    assert _extracted(spark, bodies).limit(0).count() == 0


def test_entities_of_no_posts(spark):
    assert _extracted(spark, []).count() == 0
