"""Calendar offsets, look-back windows and whole-day differences."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The duration units of an offset string such as "-1y6mo".
_MONTHS = {"y": 12, "q": 3, "mo": 1}
_DAYS = {"w": 7, "d": 1}
_SECONDS = {"h": 3600, "m": 60, "s": 1}
_TERM = re.compile(r"(\d+)(mo|y|q|w|d|h|m|s)")


@dataclass(frozen=True)
class Offset:
    """A signed calendar duration; one sign holds for the whole of it."""

    months: int = 0
    days: int = 0
    seconds: int = 0

    def negated(self) -> "Offset":
        return Offset(-self.months, -self.days, -self.seconds)

    @property
    def is_backward(self) -> bool:
        return min(self.months, self.days, self.seconds) < 0

    @property
    def approx_days(self) -> int:
        """Length in days, rounded up; only for sizing time buckets."""
        seconds = abs(self.seconds)
        return abs(self.months) * 31 + abs(self.days) + -(-seconds // 86400)


def parse_offset(text: str) -> Offset:
    """T9: "-6mo", "1y6mo", "-90d" ... to an :class:`Offset`."""
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    terms = _TERM.findall(body)
    if not terms or "".join(n + u for n, u in terms) != body:
        raise ValueError(f"not a duration: {text!r}")
    months = sum(int(n) * _MONTHS.get(u, 0) for n, u in terms)
    days = sum(int(n) * _DAYS.get(u, 0) for n, u in terms)
    seconds = sum(int(n) * _SECONDS.get(u, 0) for n, u in terms)
    return Offset(sign * months, sign * days, sign * seconds)


def as_offset(value: str | Offset) -> Offset:
    return value if isinstance(value, Offset) else parse_offset(value)


def offset_by(ts: Column | str, offset: str | Offset) -> Column:
    """Timestamp moved by a calendar offset; month ends saturate (Aug 31 - 6mo = Feb 28/29)."""
    o = as_offset(offset)
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts + F.make_interval(
        months=F.lit(o.months), days=F.lit(o.days), secs=F.lit(o.seconds)
    )


def window_predicate(fact_ts: Column, ref_ts: Column, window: str | Offset) -> Column:
    """Half-open look-back window, ``ref + offset <= t < ref`` for a negative offset."""
    return (fact_ts < ref_ts) & (fact_ts >= offset_by(ref_ts, window))


def total_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods between two instants, truncated toward zero."""
    return F.timestamp_diff("DAY", earlier, later)


def day_bucket(ts: Column, width_days: int) -> Column:
    """Number of the ``width_days`` wide time slot an instant falls into."""
    return F.floor(F.unix_date(ts.cast("date")) / F.lit(width_days)).cast("long")
