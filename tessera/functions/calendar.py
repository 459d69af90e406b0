"""Dates at day resolution and business-day arithmetic; a missing date is NULL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
WEEK = (True, True, True, True, True, False, False)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def parse_weekmask(mask: str) -> tuple[bool, ...]:
    """``1111100`` or day names such as ``Mon Tue``."""
    text = mask.replace(" ", "")
    if len(text) == 7 and set(text) <= {"0", "1"}:
        return tuple(c == "1" for c in text)
    names = [text[i : i + 3].capitalize() for i in range(0, len(text), 3)]
    if not names or any(n not in DAYS for n in names):
        raise ValueError(f"not a weekmask: {mask!r}")
    return tuple(d in names for d in DAYS)


def weekmask_to_string(mask: tuple[bool, ...]) -> str:
    return "".join("1" if m else "0" for m in mask)


def normalize_holidays(holidays: list[date], mask: tuple[bool, ...] = WEEK) -> list[date]:
    """Sorted, distinct, only those that fall on working days of the week."""
    return sorted({d for d in holidays if d is not None and mask[d.weekday()]})


class BusinessCalendar:
    """A week mask and holidays.  Holidays are literals of the plan: a list of
    dates of some years, whatever the size of the data."""

    def __init__(self, weekmask: str | tuple[bool, ...] = WEEK, holidays: list[date] = ()):
        self.mask = parse_weekmask(weekmask) if isinstance(weekmask, str) else tuple(weekmask)
        if not any(self.mask):
            raise ValueError("a week without working days")
        self.holidays = normalize_holidays(list(holidays), self.mask)
        self.per_week = sum(self.mask)

    def _holidays(self) -> Column:
        return F.array(*[F.lit(d) for d in self.holidays]).cast("array<date>")

    def _open(self, weekday: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.mask)), (weekday + 1).cast("int"))

    def is_busday(self, d) -> Column:
        """False for a missing date."""
        v = _c(d)
        open_ = self._open(F.weekday(v))
        if self.holidays:
            open_ = open_ & ~F.array_contains(self._holidays(), v)
        return F.coalesce(open_, F.lit(False))

    def _days_before(self, d: Column) -> Column:
        """Working days of the plain week from Monday 1969-12-29 up to d, without d."""
        n = F.datediff(d, F.lit(date(1969, 12, 29)))
        prefix = [sum(self.mask[:k]) for k in range(7)]
        weeks = F.floor(n / 7).cast("bigint")
        return weeks * self.per_week + F.element_at(F.array(*map(F.lit, prefix)), (n - weeks * 7 + 1).cast("int"))

    def busday_count(self, begin, end) -> Column:
        """Working days in [begin, end); minus those in [end, begin) if end is
        earlier; 0 if a date is missing."""
        b, e = _c(begin), _c(end)
        lo, hi = F.least(b, e), F.greatest(b, e)
        n = self._days_before(hi) - self._days_before(lo)
        if self.holidays:
            n = n - F.size(F.filter(self._holidays(), lambda h: (h >= lo) & (h < hi)))
        n = F.when(e < b, -n).otherwise(n)
        return F.when(b.isNull() | e.isNull(), F.lit(0)).otherwise(n).cast("bigint")

    def _roll(self, d: Column, forward: bool) -> Column:
        """The nearest working day at or after (before) d, within a fortnight of holidays in a row."""
        reach = 14 + 2 * min(len(self.holidays), 60)
        days = F.sequence(F.lit(0), F.lit(reach))
        move = lambda k: F.date_add(d, k if forward else -k)
        return F.get(F.filter(F.transform(days, move), self.is_busday), 0)

    def busday_offset(self, d, n, roll: str = "raise") -> Column:
        """d rolled to a working day, then moved by n working days."""
        v, k = _c(d), _c(n).cast("bigint")
        if roll in ("forward", "following"):
            at = self._roll(v, True)
        elif roll in ("backward", "preceding"):
            at = self._roll(v, False)
        elif roll in ("modifiedfollowing", "modifiedpreceding"):
            first, other = self._roll(v, roll == "modifiedfollowing"), self._roll(v, roll != "modifiedfollowing")
            at = F.when(F.trunc(first, "month") == F.trunc(v, "month"), first).otherwise(other)
        elif roll == "nat":
            at = F.when(self.is_busday(v), v)
        elif roll == "raise":
            at = F.when(v.isNull() | self.is_busday(v), v).otherwise(F.raise_error(F.lit("not a working day")).cast("date"))
        else:
            raise ValueError(f"unknown roll {roll!r}")
        # Whole weeks first, then the days of the rest, then the holidays that were passed.
        weeks = F.when(k >= 0, F.floor(k / self.per_week)).otherwise(-F.floor(-k / self.per_week)).cast("int")
        rest = (k - weeks * self.per_week).cast("int")
        jumped = F.date_add(at, weeks * 7)

        def plain(start: Column, count: Column) -> Column:
            """count plain working days on from start (itself one)."""
            sign = F.when(count < 0, -1).otherwise(1)
            near = F.filter(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.date_add(start, i * sign)), lambda x: self._open(F.weekday(x)))
            return F.when(count == 0, start).otherwise(F.get(near, F.abs(count) - 1))

        out = plain(jumped, rest)
        if not self.holidays:
            return out
        step = lambda s, h: F.when((k > 0) & (h > at) & (h <= s), plain(s, F.lit(1))).otherwise(s)
        back = lambda s, h: F.when((k < 0) & (h < at) & (h >= s), plain(s, F.lit(-1))).otherwise(s)
        return F.aggregate(F.reverse(self._holidays()), F.aggregate(self._holidays(), out, step), back)


_PLAIN = BusinessCalendar()
is_busday, busday_count, busday_offset = _PLAIN.is_busday, _PLAIN.busday_count, _PLAIN.busday_offset


def weekday(d) -> Column:
    """Monday is 0."""
    return F.weekday(_c(d))


def from_string(s) -> Column:
    """The date in the first ten characters; '', 'NaT' and 'nat' are missing."""
    v = _c(s)
    return F.when(v.isin("", "NaT", "nat"), F.lit(None).cast("date")).otherwise(F.to_date(F.substring(v, 1, 10)))


def as_string(d, unit: str = "D") -> Column:
    tail = {"h": "T00", "m": "T00:00", "s": "T00:00:00", "ms": "T00:00:00.000", "us": "T00:00:00.000000", "ns": "T00:00:00.000000000"}
    if unit in ("Y", "M", "D"):
        text = F.date_format(_c(d), {"Y": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd"}[unit])
    else:
        text = F.concat(F.date_format(_c(d), "yyyy-MM-dd"), F.lit(tail[unit]))
    return F.coalesce(text, F.lit("NaT"))


def add(d, days) -> Column:
    return F.date_add(_c(d), _c(days))


def subtract(a, b) -> Column:
    return F.datediff(_c(a), _c(b))


def arange(start: date, stop: date, step: int = 1) -> Column:
    """An array of dates from start up to stop, without stop."""
    return F.filter(F.sequence(F.lit(start), F.lit(stop), F.make_dt_interval(F.lit(step))), lambda d: (d < F.lit(stop)) if step > 0 else (d > F.lit(stop)))


def datetime_data() -> tuple[str, int]:
    return ("D", 1)
