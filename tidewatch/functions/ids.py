"""Identifiers and addresses of posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import content_hash, stable_hash

_POST = r"(?i)/r/[^/]+/comments/([a-z0-9]+)"
SITE = "https://www.reddit.com"


def post_id(url: Column, native: Column) -> Column:
    """The native id, else the id in the address, else empty."""
    own = F.trim(F.coalesce(native, F.lit("")))
    return F.when(own != "", own).otherwise(F.regexp_extract(F.coalesce(url, F.lit("")), _POST, 1))


def canonical_url(url: Column, community: Column, post: Column) -> Column:
    """One address per post: by community and id where the id is known, else the path without query and fragment."""
    name = F.regexp_replace(F.trim(F.coalesce(community, F.lit(""))), "^r/", "")
    name = F.when(name == "", F.lit("unknown")).otherwise(name)
    address = F.trim(F.coalesce(url, F.lit("")))
    path = F.regexp_replace(F.regexp_replace(address, r"(?i)^https?://[^/?#]*", ""), r"[?#].*$", "")
    path = F.regexp_replace(path, "/+$", "/")
    return (
        F.when(post != "", F.concat(F.lit(f"{SITE}/r/"), name, F.lit("/comments/"), post, F.lit("/")))
        .when(address != "", F.concat(F.lit(SITE), path))
        .otherwise(F.lit(""))
    )


def squeezed_lower(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def mention_id(source: Column, post: Column, address: Column, title: Column, text: Column) -> Column:
    """By post id, else by the canonical address, else by the content."""
    return (
        F.when(post != "", F.concat(F.lit("reddit_submission_"), post))
        .when(address != "", F.concat(F.lit("url_"), stable_hash(address)))
        .otherwise(F.concat(F.lit("hash_"), stable_hash(source, title, squeezed_lower(text))))
    )


def _no_id(mention: Column) -> Column:
    return mention.isNull() | F.trim(mention).isin("", "nan", "None")


def merge_key(mention: Column, title: Column, text: Column, community: Column, published: Column) -> Column:
    """The trimmed mention id, or for rows without one a hash of what they say, where and when."""
    made = stable_hash(*[squeezed_lower(c) for c in (title, text, community, published)])
    return F.when(_no_id(mention), F.concat(F.lit("hash_"), made)).otherwise(F.trim(mention))


def filled_mention_id(mention: Column, title: Column, text: Column, row: Column) -> Column:
    """Rows without an id get one from title, text and row number, each for itself."""
    return F.when(_no_id(mention), F.concat(F.lit("generated_"), content_hash(title, text, row.cast("string")))).otherwise(mention)


def search_url(display: Column) -> Column:
    """Address of a web search for a brand, encoded as form data."""
    return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(F.concat(display, F.lit(" brand"))))


# Brands whose site isn't their name.
SITES = {"saint laurent": "ysl.com"}


def site_guess(display: Column) -> Column:
    """The site a brand most likely has; empty where the name has no letter or digit."""
    name = F.lower(F.trim(display))
    bare = F.regexp_replace(name, "[^a-z0-9]", "")
    guess = F.when(bare != "", F.concat(bare, F.lit(".com"))).otherwise(F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in SITES.items() for x in pair])
    return F.coalesce(F.element_at(known, name), guess)
