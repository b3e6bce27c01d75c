"""Date expressions: tolerant parsing, calendar parts and holiday flags."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Orders of the date parts to try: ISO first, then day-first, then month-first for
# texts that only fit that reading. Parts are separated by "-" or "/".
DAY_FIRST = ("ymd", "dmy", "mdy")
MONTH_FIRST = ("ymd", "mdy", "dmy")

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def parse_date(col: Column, orders: Sequence[str] = DAY_FIRST) -> Column:
    """Try each order of year, month and day in turn; NULL when none fits.

    The text is split once and its parts are put back in ISO order for a cast,
    which gives NULL for an impossible date without raising an error per row and
    format. Binding the parts in a lambda keeps the expression small when the
    optimizer copies it into filters.
    """

    def choose(parts: Column) -> Column:
        tries = []
        for order in orders:
            year, month, day = (F.get(parts, F.lit(order.index(p))) for p in "ymd")
            shaped = (F.length(year) == 4) & F.length(month).between(1, 2) & F.length(day).between(1, 2)
            tries.append(F.when(shaped, F.concat_ws("-", year, month, day).try_cast("date")))
        return F.when(F.size(parts) == 3, F.coalesce(*tries))

    pieces = F.split(F.translate(F.trim(col), "/", "-"), "-")
    return F.get(F.transform(F.array(pieces), choose), F.lit(0))


def day_text(col: Column) -> Column:
    """``DD-MM-YYYY`` text, the form used in the cleaned CSV files."""
    return F.date_format(col, "dd-MM-yyyy")


def weekday_label(col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(col) + 1)


def week_of_month(col: Column) -> Column:
    """Blocks of seven days counted from the first of the month (1..5)."""
    return F.floor((F.dayofmonth(col) - 1) / 7).cast("int") + 1


def is_weekend(col: Column) -> Column:
    return F.weekday(col) >= 5


def is_payday(col: Column, days: Sequence[int] = (15, 30)) -> Column:
    return F.dayofmonth(col).isin(*days)


def cyclical(col: Column, period: float) -> tuple[Column, Column]:
    angle = col * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def month_start(col: Column) -> Column:
    return F.trunc(col, "month")


def _nth_weekday(col: Column, month: int, weekday: int, nth: int) -> Column:
    return (
        (F.month(col) == month)
        & (F.weekday(col) == weekday)
        & (F.floor((F.dayofmonth(col) - 1) / 7) == nth - 1)
    )


def _last_weekday(col: Column, month: int, weekday: int) -> Column:
    return (
        (F.month(col) == month)
        & (F.weekday(col) == weekday)
        & (F.month(F.date_add(col, 7)) != month)
    )


def _observed(col: Column, month: int, day: int) -> Column:
    """Fixed date moved to Friday from a Saturday and to Monday from a Sunday."""

    def falls_on(d: Column) -> Column:
        return (F.month(d) == month) & (F.dayofmonth(d) == day)

    own = falls_on(col) & (F.weekday(col) < 5)
    from_saturday = falls_on(F.date_add(col, 1)) & (F.weekday(col) == 4)
    from_sunday = falls_on(F.date_sub(col, 1)) & (F.weekday(col) == 0)
    return own | from_saturday | from_sunday


def is_us_federal_holiday(col: Column) -> Column:
    """US federal holidays as observed, computed per date without a lookup table."""
    return (
        _observed(col, 1, 1)
        | ((F.year(col) >= 1986) & _nth_weekday(col, 1, 0, 3))
        | _nth_weekday(col, 2, 0, 3)
        | _last_weekday(col, 5, 0)
        | ((F.year(col) >= 2021) & _observed(col, 6, 19))
        | _observed(col, 7, 4)
        | _nth_weekday(col, 9, 0, 1)
        | _nth_weekday(col, 10, 0, 2)
        | _observed(col, 11, 11)
        | _nth_weekday(col, 11, 3, 4)
        | _observed(col, 12, 25)
    )
