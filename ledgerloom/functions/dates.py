"""Date arithmetic of schedules and aging, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.operators.instants import MONTHS


def tolerant_date(c: Column) -> Column:
    """Date of a text in one of five layouts (2025-03-01, 3/1/2025, 3/1/25, 1-Mar-2025, 2025/3/1); what follows a blank is ignored, else null."""
    s = F.split_part(F.trim(c), F.lit(" "), F.lit(1))
    iso, us, named = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$"
    g = F.regexp_extract
    year = F.when(F.length(g(s, us, 3)) == 2, F.concat(F.lit("20"), g(s, us, 3))).otherwise(g(s, us, 3))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(g(s, named, 2))).cast("string")
    text = F.when(s.rlike(iso), F.concat_ws("-", g(s, iso, 1), g(s, iso, 2), g(s, iso, 3))).when(s.rlike(us), F.concat_ws("-", year, g(s, us, 1), g(s, us, 2))).when(s.rlike(named), F.concat_ws("-", g(s, named, 3), month, g(s, named, 1)))
    return text.try_cast("date")


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def next_month_start(c: Column) -> Column:
    return F.add_months(F.trunc(c, "month"), 1)


def month_difference(a: Column, b: Column) -> Column:
    """Calendar months from ``a`` to ``b``, days ignored."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def months_elapsed(a: Column, b: Column) -> Column:
    """Whole months from ``a`` to ``b``: the last one counts once its day is reached."""
    return month_difference(a, b) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)


def overlap_days(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Days that [a, b] and [c, d] share, both ends included."""
    return F.greatest(F.lit(0), F.datediff(F.least(b, d), F.greatest(a, c)) + 1)


def week_index(c: Column, start: Column, weeks: int) -> Column:
    """1-based week of ``c`` from ``start``; what is overdue falls in week 1, what lies beyond the horizon is null."""
    w = F.floor(F.datediff(c, start) / 7) + 1
    return F.when(w < 1, 1).when(w <= weeks, w).cast("int")


def recurrences(first: Column, until: Column, every: str) -> Column:
    """Array of the dates of a weekly, biweekly or monthly event; monthly ones fall on day 28 at the latest."""
    if every == "monthly":
        anchor = F.date_add(F.trunc(first, "month"), F.least(F.dayofmonth(first), F.lit(28)) - 1)
        return F.when(anchor <= until, F.sequence(anchor, until, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    step = F.expr("interval 7 days" if every == "weekly" else "interval 14 days")
    return F.when(first <= until, F.sequence(first, until, step)).otherwise(F.array().cast("array<date>"))
