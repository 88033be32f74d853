"""Casts, labels and roundings that the operators share.

Everything here is an expression over columns; nothing starts a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2}(:\d{1,2})?)?$"
#: Excel's day zero
SERIAL_ZERO = "1899-12-30"


def number(c: Column, default: float | None = 0.0) -> Column:
    """The string as a double; empty, missing or malformed gives ``default``."""
    parsed = F.trim(c).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def moment(c: Column) -> Column:
    """'YYYY-MM-DD', with ' HH:MM' or ' HH:MM:SS' if there is a time, as timestamp_ntz; else null."""
    s = F.trim(c)
    return F.when(s.rlike(MOMENT), s.try_cast("timestamp_ntz"))


def loose_date(c: Column) -> Column:
    """A date in one of the milestone sheet's forms; null where empty, an error where it has none of them."""
    s = F.trim(F.coalesce(c, F.lit("")))
    serial = F.expr(f"date'{SERIAL_ZERO}'") + F.regexp_extract(s, r"^(\d{5})(\.\d+)?$", 1).try_cast("int")

    def form(pattern: str, fmt: str, value: Column = s) -> Column:
        return F.when(value.rlike(pattern), F.try_to_timestamp(value, F.lit(fmt)).cast("date"))

    def short(pattern: str, fmt: str, value: Column = s) -> Column:
        """Two digits of a year stand for 1969 to 2068."""
        d = form(pattern, fmt, value)
        return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)

    named = F.initcap(s)
    known = F.coalesce(
        F.when(s.rlike(r"^\d{5}(\.\d+)?$"), serial),
        form(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        form(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"),
        form(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        short(r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
        short(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy", named),
        form(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy", named),
    )
    wrong = F.raise_error(F.concat(F.lit("unrecognised date "), s, F.lit(" (use YYYY-MM-DD or MM/DD/YYYY)"))).cast("date")
    return F.when(s == "", F.lit(None).cast("date")).when(known.isNotNull(), known).otherwise(wrong)


def tenths(x: Column) -> Column:
    """Rounded to one decimal as decimal rounding of the exact binary value does, exact ties to the even digit.

    The nearest decimal differs from x * 10 rounded where the product rounds over a midpoint. So x
    is compared with the double nearest the midpoint and, where they are equal, with the midpoint
    itself: 20 times that double is the exact sum of two doubles (16 and 4 times it).
    """
    a = F.abs(x)
    k = F.floor(a * 10).cast("double")
    odd = 2 * k + 1
    mid = odd / F.lit(20.0)
    big, small = mid * 16, mid * 4
    total = big + small
    back = total - big
    rest = (big - (total - back)) + (small - back)
    off = (total - odd) + rest
    even = F.pmod(k, F.lit(2.0)) == 0
    up = (a > mid) | ((a == mid) & ((off > 0) | ((off == 0) & ~even)))
    size = (k + F.when(up, 1.0).otherwise(0.0)) / F.lit(10.0)
    return F.when(a < 1e14, F.when(x < 0, -size).otherwise(size)).otherwise(x)


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; a code without one stays as it is."""
    out = c
    for code, label in reversed(list(labels.items())):
        out = F.when(c == code, F.lit(label)).otherwise(out)
    return out


def seconds_of_day(t: Column) -> Column:
    """Seconds since midnight of a timestamp_ntz, with fractions, as a double."""
    return F.hour(t) * 3600.0 + F.minute(t) * 60.0 + F.date_format(t, "s.SSSSSS").cast("double")


def at_second(day: Column, second: Column) -> Column:
    """The timestamp_ntz that many seconds into the day, to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(second * 1e6).cast("long"), day.cast("timestamp_ntz"))


def elapsed_days(a: Column, b: Column) -> Column:
    """Days from a to b as a double."""
    return F.timestamp_diff("SECOND", a, b) / F.lit(86400.0)


def instant(t) -> Column:
    """A datetime (or None) as a timestamp_ntz constant."""
    return F.lit(None if t is None else str(t)).cast("timestamp_ntz")
