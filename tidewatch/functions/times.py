"""Instants, weeks and date labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """ISO-8601 text as an instant whatever the session's zone: no offset means UTC. Null where the text is
    null, blank or no date with time (a bare date is its midnight)."""
    t = F.trim(text)
    t = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).otherwise(t)
    t = F.when(t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(t))


def feed_instant(text: Column) -> Column:
    """RFC-822 (feeds) or ISO text as an instant."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), instant(text))


def week_start(moment: Column, anchor: str = "tue") -> Column:
    """Date of the metric week's first day. ``tue`` is the reference's week (it ends on Monday); ``mon`` is ISO."""
    day = F.to_date(moment)
    first = {"sun": 1, "mon": 2, "tue": 3, "wed": 4, "thu": 5, "fri": 6, "sat": 7}[anchor]
    return F.date_sub(day, F.pmod(F.dayofweek(day) - F.lit(first), F.lit(7)))


def iso_week_label(moment: Column) -> Column:
    day = F.to_date(moment)
    return F.concat(
        F.date_part(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    )


def iso_date_text(text: Column) -> Column:
    return F.coalesce(F.date_format(instant(text), "yyyy-MM-dd"), F.lit(""))


def utc_text(moment: Column) -> Column:
    """ISO text of an instant in UTC, to the second, with Z."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def live_window(as_of: Column, days_back: int) -> tuple[Column, Column]:
    """First and last day of a live run, both included."""
    return F.date_sub(as_of, days_back), F.to_date(as_of)


def previous_week(as_of: Column) -> tuple[Column, Column, Column]:
    """Monday, Sunday and ISO label of the last whole ISO week before a day."""
    monday = F.date_sub(F.trunc(as_of, "week"), 7)
    return monday, F.date_add(monday, 6), iso_week_label(monday)


def iso_week(label: Column) -> tuple[Column, Column]:
    """Monday and Sunday of an ISO week such as ``2026-W14``. January 4th is always in the first week."""
    first = F.trunc(F.make_date(F.left(label, F.lit(4)).cast("int"), F.lit(1), F.lit(4)), "week")
    monday = F.date_add(first, 7 * (F.right(label, F.lit(2)).cast("int") - 1))
    return monday, F.date_add(monday, 6)
