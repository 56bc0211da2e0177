"""Lists kept as JSON text, and what stands for a list in older columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import unicode_form


def _empty() -> Column:
    return F.array().cast("array<string>")


def json_list(values: Column, limit: int | None = None) -> Column:
    """A string array as JSON text with ``", "`` between values; null and blank values are left out, then the first
    ``limit`` kept. Null counts as empty."""
    kept = F.filter(F.coalesce(values, _empty()), lambda v: v.isNotNull() & (F.trim(v) != ""))
    if limit:
        kept = F.slice(kept, 1, limit)
    quoted = F.transform(kept, lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def json_only(c: Column) -> Column:
    """The values of a JSON list as strings; anything else is empty."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), _empty())


def parsed_list(c: Column) -> Column:
    """The values of a JSON list, else the parts between commas, bars and semicolons; blank parts are left out."""
    text = F.trim(unicode_form(F.coalesce(c, F.lit(""))))
    parts = F.filter(F.transform(F.split(text, "[,|;]"), lambda v: F.trim(v)), lambda v: v != "")
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), parts)


def json_rows(rows: Column, limit: int | None = None) -> Column:
    """An array of structs as a JSON list of objects; null counts as empty."""
    return F.coalesce(F.to_json(F.slice(rows, 1, limit) if limit else rows), F.lit("[]"))
