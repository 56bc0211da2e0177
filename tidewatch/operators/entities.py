"""Entities of posts: known names, catalog names without overlap, phrases, rule vocabularies, and candidates.

Names are found by hashing: every run of words of a post is one row and meets the table of names in an equi-join, so
the cost follows the length of the texts, not the number of names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ids, text
from tidewatch.operators.rows import keep_one, resolve
from tidewatch.storage import pinned

# Rule vocabularies, short aliases that count, and words that show a purchase.
NEED_STATES = [
    "worth it", "dupe", "alternative", "under desk", "sensitive skin", "travel friendly", "budget option", "cheap", "expensive",
    "overrated", "underrated", "holy grail",
]
MATERIALS = [
    "silicone", "stainless steel", "ceramic", "spf", "retinol", "niacinamide", "castor oil", "cotton", "wool", "leather", "uv", "led",
]
RETAILERS = ["amazon", "target", "walmart", "costco", "sephora", "ulta", "temu", "aliexpress"]
SHORT_ALIASES = ["3m", "lg", "hp", "dy"]
PURCHASE = r"(?i)\b(bought|ordered|recommend|recommended|worth it|vs|dupe|alternative|broke|returned|review|from|brand)\b"
RULES = (
    ("need_state", 0.8, "need_state_rules", NEED_STATES),
    ("ingredient_material", 0.75, "material_rules", MATERIALS),
    ("retailer_channel", 0.85, "retailer_rules", RETAILERS),
)
# Words that alone make no phrase.
GENERIC = [
    "the", "and", "for", "with", "from", "this", "that", "product", "item", "new", "hot", "best", "sale", "free", "shipping",
    "quality", "good", "bad", "great",
]
SENTIMENT_ONLY = ["love", "hate", "bad", "good", "great", "terrible", "amazing", "disappointed"]
PRONOUNS = [
    "i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "you guys", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "who", "whom", "whose", "whoever", "whichever", "what", "whatever", "which", "this", "that", "these",
    "those", "anyone", "anybody", "anything", "someone", "somebody", "something", "everyone", "everybody", "everything",
    "no one", "nobody", "nothing", "some", "any", "all", "none", "both", "either", "neither", "other", "others",
]
VAGUE_NOUNS = [
    "skin", "face", "life", "head", "day", "days", "thing", "things", "stuff", "people", "advice", "help", "time", "way", "body",
    "home", "hair", "camera", "bag", "bags", "pain", "routine", "lot", "bit", "part", "kind", "money", "food", "water", "cat",
    "dog", "daughter", "son", "kid", "kids", "school", "video", "videos", "job", "work", "week", "month", "year", "years", "guy",
    "guys", "person", "friend", "family", "house", "phone", "computer", "car", "room", "world", "problem", "problems",
    "question", "questions", "post", "comment", "comments", "reddit", "sub", "recommendation", "recommendations", "thoughts",
    "opinion", "opinions",
]
CANDIDATE_NOISE = [
    "ram", "gpu", "cpu", "ssd", "usd", "usb", "usb-c", "dac", "psu", "diy", "wifi", "led", "tldr", "cad", "til", "ips", "sas",
    "pro", "ups", "iem", "vsf", "usa", "and", "not", "the", "from", "help", "save", "w2c", "ibr", "llm", "imo", "imho", "tbh",
    "fyi", "asap", "btw", "lol", "omg", "wtf", "ngl", "iirc", "afaik", "faq", "psa", "eli5", "aita",
]
POSSESSIVE = r"^(my|your|his|her|their|our|its|the|a|an|this|that|these|those)\s+"


_TOKEN = re.compile(r"[^\W_]+")


def located_words(posts: DataFrame) -> DataFrame:
    """``posts`` (mention_id, body) with ``words``: normal form, first and behind-the-last place of each word of the body.
    Only offsets need Python; a word without Latin letters or digits keeps its own form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("w", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            found = [
                [{"w": "".join(c for c in text.folded(m[0]).lower() if c.isalnum()) or m[0], "s": m.start(), "e": m.end()} for m in _TOKEN.finditer(body or "")]
                for body in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["mention_id", "body", "words"])

    return posts.select("mention_id", "body").mapInArrow(run, "mention_id string, body string, words array<struct<w:string,s:int,e:int>>")


def word_runs(posts: DataFrame, longest: int) -> DataFrame:
    """Every run of 1..longest words of posts (mention_id and form, or words with offsets): mention_id, its first word's
    place, its length, the run, and where it starts and ends in the text (-1 without offsets)."""
    located = "words" in posts.columns
    words = F.col("words") if located else F.filter(F.split(F.trim("form"), " +"), lambda t: t != "")
    tokens = posts.select("mention_id", words.alias("t"))

    def of_length(n: int) -> Column:
        def at(i: Column) -> Column:
            part = F.slice("t", i, n)
            run = F.array_join(F.transform(part, lambda x: x["w"]) if located else part, " ")
            start, end = (F.get("t", i - 1)["s"], F.get("t", i + (n - 2))["e"]) if located else (F.lit(-1), F.lit(-1))
            return F.struct(i.alias("place"), F.lit(n).alias("n"), run.alias("run"), start.alias("start"), end.alias("end"))

        none = F.array().cast("array<struct<place:int,n:int,run:string,start:int,end:int>>")
        return F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), at)).otherwise(none)

    runs = F.concat(*[of_length(n) for n in range(1, longest + 1)])
    return tokens.select("mention_id", F.explode(runs).alias("r")).select("mention_id", "r.*")


def alias_hits(posts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that stand in a post as whole words, each once, at its first place. ``posts``: mention_id and form, or words
    with offsets; ``aliases``: alias_norm, brand_norm. Aliases of fewer than three letters count only if on the short list;
    the longest runs have as many words as the longest alias."""
    usable = aliases.where((F.length(F.replace("alias_norm", F.lit(" "))) >= 3) | F.col("alias_norm").isin(SHORT_ALIASES))
    longest = usable.agg(F.max(F.size(F.split("alias_norm", " +")))).first()[0] or 1
    runs = word_runs(posts, longest)
    hits = runs.join(usable, runs["run"] == usable["alias_norm"])
    first = F.min(F.struct("place", "start", "end")).alias("f")
    return hits.groupBy("mention_id", "alias_norm", "brand_norm").agg(first).select("mention_id", "alias_norm", "brand_norm", "f.*")


def greedy_hits(posts: DataFrame, catalog: DataFrame, longest: int = 3) -> DataFrame:
    """Catalog names of a post, longest first and then from the left, none sharing a word with one taken before.
    ``posts``: mention_id and form, or words with offsets; ``catalog``: brand_norm. Names of fewer than three letters don't
    count."""
    runs = word_runs(posts, longest).where(F.length("run") >= 3)
    found = runs.join(catalog.select(F.col("brand_norm").alias("run")).distinct(), "run")
    hit = F.struct((-F.col("n")).alias("m"), "place", "run", "start", "end")
    ordered = found.groupBy("mention_id").agg(F.array_sort(F.collect_list(hit)).alias("c"))
    none = F.array().cast("array<struct<m:int,place:int,run:string,start:int,end:int>>")
    start = F.struct(F.array().cast("array<int>").alias("taken"), none.alias("kept"))

    def claim(acc: Column, x: Column) -> Column:
        own = F.sequence(x["place"], x["place"] - x["m"] - 1)
        free = F.struct(F.concat(acc["taken"], own).alias("taken"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when(F.arrays_overlap(acc["taken"], own), acc).otherwise(free)

    kept = ordered.select("mention_id", F.explode(F.aggregate("c", start, claim)["kept"]).alias("k"))
    return kept.select("mention_id", F.col("k.run").alias("brand_norm"), "k.place", (-F.col("k.m")).alias("n"), "k.start", "k.end")


def rule_hits(posts: DataFrame, form: Column) -> DataFrame:
    """One row per rule phrase that stands in the text as whole words."""
    made = [
        F.when(form.rlike(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])"), F.struct(F.lit(p).alias("entity_text"), F.lit(kind).alias("entity_type"), F.lit(conf).alias("confidence"), F.lit(source).alias("source")))
        for kind, conf, source, phrases in RULES
        for p in phrases
    ]
    return posts.select("mention_id", F.explode(F.array_compact(F.array(*made))).alias("e")).select("mention_id", "e.*")


def useful_phrase(norm: Column) -> Column:
    """Whether a phrase in token form says something: long enough, with a letter, not only general words or pronouns,
    no bare sentiment word, and no bare vague noun once a leading possessive is gone."""
    parts = F.split(norm, " +")
    bare = F.trim(F.regexp_replace(norm, POSSESSIVE, ""))
    return (
        (F.length(norm) >= 4)
        & norm.rlike("[a-z]")
        & ~F.forall(parts, lambda p: p.isin(GENERIC))
        & ~norm.isin(PRONOUNS)
        & ~F.forall(parts, lambda p: p.isin(PRONOUNS))
        & ~norm.isin(SENTIMENT_ONLY)
        & ~bare.isin(VAGUE_NOUNS)
    )


_PATTERNS = (
    (re.compile(r"\b[A-Z][A-Z0-9&+-]{1,10}\b"), "regex_allcaps", 0),
    (re.compile(r"\b[A-Z][a-z]+[A-Z][A-Za-z0-9]+\b"), "regex_camel", 0),
    (re.compile(r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,2}\b"), "regex_title", 0),
    (re.compile(r"['\"]([^'\"]{3,40})['\"]"), "regex_quote", 1),
)
_PURCHASE = re.compile(PURCHASE)


def candidate_spans(posts: DataFrame) -> DataFrame:
    """Spans that look like a name and stand near a purchase word: mention_id, entity_text, source, start_char, end_char,
    context_window. Titles and quotations need two words. ``posts``: mention_id, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for post, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pattern, source, group in _PATTERNS:
                    for m in pattern.finditer(body or ""):
                        raw = m[group]
                        if group or source == "regex_title":
                            if " " not in raw.strip():
                                continue
                        around = body[max(0, m.start() - 80) : m.end() + 80].strip()
                        if _PURCHASE.search(around):
                            out.append((post, raw, source, m.start(), m.end(), around))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            names = ["mention_id", "entity_text", "source", "start_char", "end_char", "context_window"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    schema = "mention_id string, entity_text string, source string, start_char int, end_char int, context_window string"
    return posts.select("mention_id", "body").mapInArrow(run, schema)


def candidates(posts: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate spans whose normal form is no known brand and no noise."""
    rows = candidate_spans(posts).withColumn("entity_norm", text.brand_form(F.col("entity_text")))
    rows = rows.where((F.length("entity_norm") >= 3) & ~F.col("entity_norm").isin(CANDIDATE_NOISE))
    return rows.join(known.select(F.col("brand_norm").alias("entity_norm")).distinct(), "entity_norm", "left_anti")


def cluster_terms(profiles: DataFrame) -> DataFrame:
    """term, cluster_id, cluster_name of cluster profiles; a term of several clusters belongs to the last id."""
    lists = [c for c in ("leaf_keywords_top", "top_product_terms", "top_product_phrases") if c in profiles.columns]
    terms = F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]))
    rows = profiles.where(F.trim("cluster_id") != "").select(terms.alias("t"), "cluster_id", "cluster_name").withColumn("term", text.token_form(F.col("t")))
    return rows.where("term <> ''").groupBy("term").agg(F.max("cluster_id").alias("cluster_id"), F.max_by("cluster_name", "cluster_id").alias("cluster_name"))


#: Columns of an entity row, in order, and what a row has that doesn't say otherwise.
ENTITY = {
    "entity_text": "string", "entity_norm": "string", "entity_type": "string", "is_brand": "boolean", "in_platform_brand": "boolean", "brand_signal_type": "string",
    "brand_display": "string", "brand_norm": "string", "confidence": "double", "source": "string", "matched_cluster_id": "string", "matched_cluster_name": "string",
    "related_cluster_ids": "array<string>", "start_char": "int", "end_char": "int", "review_status": "string",
}
_PLAIN = {"is_brand": False, "in_platform_brand": False, "brand_signal_type": "", "brand_display": "", "brand_norm": "", "matched_cluster_id": "", "matched_cluster_name": "", "start_char": -1, "end_char": -1, "review_status": "approved"}


def _emitted(rows: DataFrame, stage: int, **values: object) -> DataFrame:
    """Rows with the columns of ENTITY: from ``values``, else their own, else what is plain."""
    out = []
    for name, kind in ENTITY.items():
        given = values.get(name)
        if given is None:
            given = F.col(name) if name in rows.columns else F.array() if kind.startswith("array") else F.lit(_PLAIN.get(name, ""))
        elif not isinstance(given, Column):
            given = F.lit(given)
        out.append(given.cast(kind).alias(name))
    return rows.select("mention_id", F.lit(stage).alias("stage"), *out)


def extracted(posts: DataFrame, registry: DataFrame, aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """All entities of posts (mention_id, body), 19 columns, the first emitted of each (post, norm, type, source): whitelist
    names, catalog names (single words only with a purchase word within 80 characters), phrases, rule words, candidates.
    ``terms``: term, cluster_id, cluster_name; a phrase that is one is a category keyword with that cluster. All word
    pairs of a post are phrases, and those that are no term have a null cluster. Null bodies have no entities; offsets are -1
    where the text isn't found again. Of ``registry`` only brand_norm and is_whitelist_brand must be there."""
    # words and forms need Python and are read by several branches, so they are made once
    readable = pinned(located_words(posts).withColumn("token", text.token_form(F.col("body"))), "words")
    bodies = readable.select("mention_id", "body")
    empty = F.array().cast("array<string>")
    related = F.coalesce("related_cluster_ids", empty) if "related_cluster_ids" in registry.columns else empty
    known = registry.select(
        "brand_norm", F.coalesce(resolve(registry, "brand_display"), F.lit("")).alias("_display"),
        F.coalesce(resolve(registry, "primary_cluster_id"), F.lit("")).alias("matched_cluster_id"),
        F.coalesce(resolve(registry, "primary_cluster_name"), F.lit("")).alias("matched_cluster_name"), related.alias("related_cluster_ids"),
    ).dropDuplicates(["brand_norm"])

    def located(hits: DataFrame) -> DataFrame:
        rows = hits.join(bodies, "mention_id").join(known, "brand_norm", "left")
        shown = F.substring("body", F.col("start") + 1, F.col("end") - F.col("start"))
        return rows.withColumns({"entity_text": shown, "entity_norm": text.token_form(shown), "start_char": F.col("start"), "end_char": F.col("end")})

    white = located(alias_hits(readable, aliases.where("source = 'whitelist'").select("alias_norm", "brand_norm")))
    brand = {"entity_type": "brand", "is_brand": True, "in_platform_brand": True, "brand_display": F.col("_display")}
    white_rows = _emitted(white, 1, confidence=1.0, source="whitelist", brand_signal_type="confirmed_whitelist_brand", **brand)
    found = greedy_hits(readable, registry.where("not is_whitelist_brand").select("brand_norm"))
    found = located(found.join(white.select("mention_id", "brand_norm").distinct(), ["mention_id", "brand_norm"], "left_anti"))
    found = found.where((F.col("n") > 1) | text.context(F.col("body"), F.col("start"), F.col("end")).rlike(PURCHASE))
    found_rows = _emitted(found, 2, confidence=0.85, source="catalog", brand_signal_type="catalog_known_brand", review_status="catalog_observed", **brand)
    phrases = readable.select("mention_id", F.explode(F.array_distinct(text.grams(text.words(F.col("token")), 2))).alias("entity_norm")).where(useful_phrase(F.col("entity_norm")))
    named = white_rows.unionByName(found_rows)
    named = named.select("mention_id", "entity_norm").unionByName(named.select("mention_id", F.col("brand_norm").alias("entity_norm"))).distinct()
    phrases = phrases.join(named, ["mention_id", "entity_norm"], "left_anti").join(terms.withColumnRenamed("term", "entity_norm"), "entity_norm", "left")
    is_term = F.col("cluster_id").isNotNull()
    phrase_rows = _emitted(
        phrases, 4, entity_text=F.col("entity_norm"), entity_type=F.when(is_term, "category_keyword").otherwise("product_phrase"), confidence=F.when(is_term, 0.65).otherwise(0.45),
        source="tokens", matched_cluster_id=F.col("cluster_id"), matched_cluster_name=F.col("cluster_name"),
    )
    rules = rule_hits(readable, F.col("token"))
    rule_rows = _emitted(rules, 5, entity_norm=F.col("entity_text"))
    new = candidates(posts, registry)
    new_rows = _emitted(
        new, 6, entity_norm=text.token_form(F.col("entity_text")), entity_type="unknown_candidate", confidence=0.45, brand_signal_type="candidate_non_whitelist_brand",
        review_status="candidate", entity_text=F.trim("entity_text"),
    )
    every = white_rows.unionByName(found_rows).unionByName(phrase_rows).unionByName(rule_rows).unionByName(new_rows)
    order = [F.col("stage"), F.col("start_char"), F.col("brand_norm"), F.col("entity_text")]
    rows = keep_one(every, ["mention_id", "entity_norm", "entity_type", "source"], order).drop("stage").join(bodies, "mention_id")
    at = F.when(F.col("start_char") >= 0, F.col("start_char")).otherwise(F.expr("instr(lower(body), lower(entity_text)) - 1"))
    rows = rows.withColumn("start_char", at.cast("int"))
    end = F.when(F.col("end_char") >= 0, F.col("end_char")).when(F.col("start_char") >= 0, F.col("start_char") + F.length("entity_text")).otherwise(F.lit(-1))
    rows = rows.withColumn("end_char", end.cast("int"))
    around = F.when(F.col("start_char") >= 0, text.context(F.col("body"), F.col("start_char"), F.col("end_char"))).otherwise(F.left("body", F.lit(180)))
    address = F.when(F.col("is_brand"), ids.search_url(F.coalesce(F.when(F.col("brand_display") != "", F.col("brand_display")), F.col("entity_text")))).otherwise(F.lit(""))
    return rows.select("mention_id", *ENTITY, around.alias("context_window"), address.alias("google_search_url"))


def evidence(entities: DataFrame, posts: DataFrame) -> DataFrame:
    """Brand and candidate rows with their post: one per brand and post, the most confident. ``posts``: mention_id, title,
    body, subreddit, published_at, url, score, num_comments."""
    allowed = (F.col("entity_type") == "brand") | (
        (F.col("review_status") == "candidate") & F.col("entity_type").isin("unknown_candidate", "product_line")
    )
    filled = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.col(b))
    rows = entities.where(allowed).withColumns({"brand_norm": filled("brand_norm", "entity_norm"), "brand_display": filled("brand_display", "entity_text")})
    one = keep_one(rows, ["brand_norm", "mention_id"], [F.desc("confidence"), F.col("entity_text"), F.col("brand_display"), F.col("source"), F.col("start_char"), F.col("context_window"), F.col("matched_cluster_id")])
    joined = one.join(posts, "mention_id", "left")
    return joined.withColumns(
        {
            "text_snippet": text.snippet(F.col("body")),
            "engagement_score": F.coalesce("score", F.lit(0.0)) + F.coalesce("num_comments", F.lit(0.0)),
        }
    )
