"""Calendar ranges and date texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def month_start(d: dt.date, months: int = 0) -> dt.date:
    n = d.year * 12 + d.month - 1 + months
    return dt.date(n // 12, n % 12 + 1, 1)


def quick_range(option: str, ref: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of a named range relative to ``ref``."""
    q = month_start(ref.replace(month=(ref.month - 1) // 3 * 3 + 1, day=1))
    day = dt.timedelta(days=1)
    out = {
        "last_quarter": (month_start(q, -3), q - day), "current_quarter": (q, month_start(q, 3) - day), "last_3_months": (month_start(ref, -3), month_start(ref) - day),
        "last_month": (month_start(ref, -1), month_start(ref) - day), "current_month": (month_start(ref), month_start(ref, 1) - day),
        "year_to_date": (dt.date(ref.year, 1, 1), ref), "last_year": (dt.date(ref.year - 1, 1, 1), dt.date(ref.year - 1, 12, 31))}
    if option not in out:
        raise ValueError(f"unknown range {option}")
    return out[option]


def quick_range_of(option: str, ref: Column) -> Column:
    """The same ranges for a column of dates, as ``first, last``."""
    ref = ref.cast("date")
    start = lambda unit, months=0: F.add_months(F.trunc(ref, unit), months)
    before = lambda c: F.date_sub(c, 1)
    out = {
        "last_quarter": (start("quarter", -3), before(start("quarter"))), "current_quarter": (start("quarter"), before(start("quarter", 3))), "last_3_months": (start("month", -3), before(start("month"))),
        "last_month": (start("month", -1), before(start("month"))), "current_month": (start("month"), before(start("month", 1))),
        "year_to_date": (start("year"), ref), "last_year": (start("year", -12), before(start("year")))}
    if option not in out:
        raise ValueError(f"unknown range {option}")
    return F.struct(out[option][0].alias("first"), out[option][1].alias("last"))


def quarter_range(year: int, quarter: int) -> tuple[dt.date, dt.date]:
    """First and last day of a quarter."""
    if quarter not in (1, 2, 3, 4):
        raise ValueError("a quarter is 1 to 4")
    first = dt.date(year, 3 * quarter - 2, 1)
    return first, month_start(first, 3) - dt.timedelta(days=1)


def formats(ts: Column) -> dict[str, Column]:
    """The texts of a date: month, German, ISO, and as mail servers search for it."""
    return {"month": F.date_format(ts, "yyyy-MM"), "german": F.date_format(ts, "dd.MM.yyyy"), "iso": F.date_format(ts, "yyyy-MM-dd"), "imap": F.date_format(ts, "dd-MMM-yyyy")}


def parsed_iso(text: Column) -> Column:
    """An ISO 8601 date or time, ``Z`` included; null for any other text."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(ok, F.try_to_timestamp(text))


def seconds_between(first: Column, last: Column) -> Column:
    """Whole and part seconds, null while the end is open."""
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(1e6)


def between_months(first: str, last: str) -> tuple[dt.date, dt.date]:
    a, b = (dt.datetime.strptime(x, "%Y-%m").date() for x in (first, last))
    if a > b:
        raise ValueError("the range ends before it begins")
    return a, month_start(b, 1) - dt.timedelta(days=1)


def within(ts: Column, first: dt.date, last: dt.date, strict_midnight: bool = False) -> Column:
    """From the first day to the end of the last one; with ``strict_midnight``, to its beginning, included."""
    if strict_midnight:
        return ts.between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))
    return (ts >= F.lit(first).cast("timestamp")) & (ts < F.lit(last + dt.timedelta(days=1)).cast("timestamp"))


def months(first: Column, last: Column) -> Column:
    return F.transform(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def date_in_name(name: Column) -> Column:
    """The first of five patterns whose first match has a month and a day in range; not every such date exists."""
    got = []
    # The patterns and the order of year, month and day in them.
    for pattern, order in ((r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)), (r"(\d{4})_(\d{2})_(\d{2})", (1, 2, 3)), (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)), (r"(\d{2})\.(\d{2})\.(\d{4})", (3, 2, 1)), (r"(\d{2})-(\d{2})-(\d{4})", (3, 2, 1))):
        y, m, d = (F.regexp_extract(name, pattern, k) for k in order)
        n = lambda x: x.try_cast("int")
        got.append(F.when(n(y).between(1900, 2100) & n(m).between(1, 12) & n(d).between(1, 31), F.concat_ws("-", y, m, d)))
    return F.coalesce(*got)
