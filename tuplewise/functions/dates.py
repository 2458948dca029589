"""Intervals as seconds, temporal algebra, and dates given as parameters."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuplewise.errors import QueryError

_DAY = 86_400
UNITS = (("year", 365 * _DAY), ("month", 30 * _DAY), ("week", 7 * _DAY), ("day", _DAY), ("hour", 3600), ("minute", 60), ("second", 1))
_SECONDS = {n + s: u for n, u in UNITS for s in ("", "s")}
_PAIR = r"(-?\d+(?:\.\d+)?)\s+([A-Za-z]+)"
_DATE = re.compile(r"\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d)?")

#: Kinds of sums and differences of temporal values; what is missing is undefined.
ALGEBRA = {
    ("datetime", "+", "interval"): "datetime",
    ("interval", "+", "datetime"): "datetime",
    ("datetime", "-", "interval"): "datetime",
    ("interval", "-", "datetime"): "datetime",
    ("datetime", "-", "datetime"): "interval",
    ("interval", "+", "interval"): "interval",
    ("interval", "-", "interval"): "interval",
}


def interval(text: str) -> int | None:
    """Seconds of "4 years 20 minutes"; None for "now" and blanks."""
    text = text.strip()
    if text.lower() in ("", "now"):
        return None
    if not re.fullmatch(rf"{_PAIR}( {_PAIR})*", text):
        raise QueryError("syntax_error", f"{text!r} is no interval")
    total = 0
    for amount, unit in re.findall(_PAIR, text):
        if unit.lower() not in _SECONDS:
            raise QueryError("syntax_error", f"there is no unit {unit}")
        exact = float(amount) * _SECONDS[unit.lower()]
        total += int(abs(exact) + 0.5) * (1 if exact >= 0 else -1)
    return total


def is_date(text: str) -> bool:
    return bool(_DATE.fullmatch(text.strip()))


def moment(value: object) -> dt.datetime:
    """A parameter that is compared with a date: a datetime, seconds since 1970, or a date in text."""
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, str) and is_date(value):
        try:
            return dt.datetime.fromisoformat(value.strip())
        except ValueError:
            pass
    number = value if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(value, str) and re.fullmatch(r"-?\d+(\.\d+)?", value):
        number = float(value)
    if number is None:
        raise QueryError("type_error", f"{value!r} can't be compared with a date")
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(number))


def seconds(c: Column) -> Column:
    return F.unix_timestamp(c)


def timestamp(secs: Column) -> Column:
    return F.timestamp_seconds(secs).cast("timestamp_ntz")


def interval_text(secs: Column) -> Column:
    """Seconds as "1 day 20 hours"; "0 seconds"; a minus before the whole."""
    left, parts = F.abs(secs), []
    for name, unit in UNITS:
        count = F.floor(left / unit)
        parts.append(F.when(count == 1, F.lit(f"1 {name}")).when(count > 1, F.concat(count.cast("string"), F.lit(f" {name}s"))))
        left = left % unit
    text = F.concat_ws(" ", *parts)
    return F.when(secs.isNull(), None).when(secs == 0, "0 seconds").when(secs < 0, F.concat(F.lit("-"), text)).otherwise(text)
