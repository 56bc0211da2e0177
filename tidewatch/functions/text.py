"""Text forms as column expressions.

Only compatibility normalization, HTML unescaping and folding to ASCII need Python (Spark has no such function); they
run as Arrow UDFs that are handed nulls for rows already in plain ASCII, everything else stays in generated code.
Null text counts as empty unless said otherwise.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic marks and what they are read as.
MARKS = str.maketrans({"’": "'", "‘": "'", "`": "'", "–": "-", "—": "-", "−": "-"})
# What stands for a missing or deleted text, for no brand, and too general keywords.
DELETED = ["[deleted]", "[removed]", "deleted", "removed", "nan", "none", "null"]
NO_BRAND = [
    "", "no brand", "nobrand", "generic", "unbranded", "unknown", "none", "n/a", "na", "not applicable", "not appliable",
    "not sure", "no_brand", "null", "nan",
]
GENERAL = [
    "product", "products", "item", "items", "new", "hot", "best", "other", "general", "misc", "miscellaneous", "sale", "seller",
    "shipping", "free", "quality",
]


def plain_unicode(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(MARKS)


def folded(text: str) -> str:
    return unicodedata.normalize("NFKD", plain_unicode(text)).encode("ascii", "ignore").decode()


def _python_where(condition: Column, c: Column, f: Callable[[str], str]) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.coalesce(run(F.when(condition, c)), c, F.lit(""))


def unicode_form(c: Column) -> Column:
    """Compatibility form with straight quotes and plain dashes."""
    return _python_where(c.rlike(r"[^\x00-\x7F]|`"), c, plain_unicode)


def ascii_form(c: Column) -> Column:
    return _python_where(c.rlike(r"[^\x00-\x7F]|`"), c, folded)


def unescaped(c: Column) -> Column:
    """``unicode_form`` with HTML entities resolved, in one pass through Python."""
    return _python_where(c.rlike(r"[^\x00-\x7F]|`|&"), c, lambda x: html.unescape(plain_unicode(x)))


#: The fixed order of markup removal: code, quoted lines, links, inline code, tags, addresses, users, communities,
#: astral symbols, runs of marks, white space.
MARKUP = (
    (r"(?s)```.*?```", " "),
    (r"(?dmU)^\s*>.*$", " "),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"<[^>]+>", " "),
    (r"(?iU)https?://\S+|www\.\S+", " "),
    (r"(?U)\bu/[A-Za-z0-9_-]+\b", " "),
    (r"(?U)\br/([A-Za-z0-9_]+)\b", "$1"),
    (r"[\x{10000}-\x{10FFFF}]", " "),
    (r"([!?.,]){3,}", "$1"),
)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def readable(c: Column) -> Column:
    """Text without markup."""
    out = unescaped(c)
    for pattern, by in MARKUP:
        out = F.regexp_replace(out, pattern, by)
    return squeezed(out)


def token_form(readable_text: Column) -> Column:
    """Lower-case ASCII words of readable text, with the marks ' & + - kept."""
    return squeezed(F.regexp_replace(F.lower(ascii_form(readable_text)), r"[^a-z0-9\s'&+-]", " "))


def match_form(readable_text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(ascii_form(readable_text)), r"[^a-z0-9]+", " "))


def content_hash(*readable_texts: Column) -> Column:
    """24 digits of SHA-256 over the token forms; null parts are left out."""
    parts = [F.when(c.isNotNull(), token_form(c)) for c in readable_texts]
    return F.substring(F.sha2(F.concat_ws(" ", *parts), 256), 1, 24)


def stable_hash(*parts: Column) -> Column:
    """24 digits of SHA-256 over the parts joined by two bars; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def brand_form(c: Column) -> Column:
    """Normal form of a brand name: without marks in brackets, corporate endings and punctuation; empty for none."""
    out = F.regexp_replace(F.trim(ascii_form(c)), r"[®™©]", "")
    out = F.regexp_replace(out, r"\([^)]*\)", " ")
    out = F.regexp_replace(
        out, r"(?i)\b(inc|llc|ltd|limited|corp|corporation|co|company|official store|store)\b\.?", " "
    )
    out = F.lower(squeezed(F.regexp_replace(out, r"[^A-Za-z0-9&'+\-\s]", " ")))
    return F.when(out.isin(NO_BRAND), F.lit("")).otherwise(out)


def brand_display(c: Column) -> Column:
    shown = squeezed(F.regexp_replace(unicode_form(c), r"[®™©]", ""))
    return F.when(brand_form(shown) == "", F.lit("")).otherwise(shown)


def words(c: Column) -> Column:
    """Lower-case word tokens."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9'&+-]*"), F.lit(0))
    return F.transform(found, F.lower)


def grams(tokens: Column, n: int) -> Column:
    """n-grams of a token array, in order; none where it is shorter. Shifted copies are zipped, so that ``tokens`` is
    evaluated a few times, not once per n-gram."""
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, 1, size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, k, size), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def keywords(readable_text: Column) -> Column:
    """Distinct keywords of a list-like text; numbers, short and too general ones are left out."""
    parts = F.split(token_form(readable_text), r"\s*(?:,|\||/|;|&|\band\b)\s*")
    parts = F.transform(parts, squeezed)
    kept = F.filter(parts, lambda p: (F.length(p) >= 3) & ~p.isin(GENERAL) & ~p.rlike(r"^[0-9]+$"))
    return F.array_distinct(kept)


def split_aliases(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;|]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


# Phrases of product titles that advertise.
ADVERTS = ["2026 new", "hot sale", "best seller", "free shipping", "limited time", "high quality", "wholesale", "dropshipping"]


def product_name(c: Column) -> Column:
    """A product title as readable text without advertising phrases."""
    out = readable(c)
    for phrase in ADVERTS:
        out = F.regexp_replace(out, f"(?i){phrase}", " ")
    return squeezed(out)


def context(c: Column, start: Column, end: Column, width: int = 80) -> Column:
    """The text around the half-open span [start, end)."""
    first = F.greatest(start - width, F.lit(0))
    return F.trim(F.substring(c, first + 1, F.least(end + width, F.length(c)) - first))


def snippet(c: Column, n: int = 320) -> Column:
    text = squeezed(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(n - 3))), F.lit("..."))).otherwise(text)


def language(c: Column) -> Column:
    """``en`` or ``unknown``, from the share of ASCII letters and common English words of the first 1,200 characters."""
    sample = F.substring(F.coalesce(c, F.lit("")), 1, 1200)
    letters = F.regexp_count(sample, F.lit("[A-Za-z]"))
    word_chars = F.regexp_count(sample, F.lit(r"(?U)\w"))
    common = F.regexp_count(
        F.lower(sample), F.lit(r"(?U)\b(the|and|is|it|this|that|for|with|not|you|my|i|to|of|in)\b")
    )
    english = (letters / F.greatest(word_chars, F.lit(1)) > 0.55) | (common >= 2)
    return F.when((F.trim(sample) != "") & english, F.lit("en")).otherwise(F.lit("unknown"))
