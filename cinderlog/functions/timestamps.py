"""Timestamp coercion of log values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import strip

# Calendar date (with or without dashes), optionally hour, minute, second, fraction and
# offset.
_ISO = (
    r"^\d{4}(?:-\d{2}-\d{2}|\d{4})"
    r"(?:.\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:[+-]\d{2}:?\d{2})?)?$"
)
# The rarer forms: calendar or week date, time with or without colons, offset with seconds.
_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
_CLOCK = r"(\d{2})(?::(\d{2})(?::(\d{2})(\.\d+)?)?|(\d{2})(?:(\d{2})(\.\d+)?)?)?"
_OFFSET = r"(?:([+-])(\d{2})(?::(\d{2})(?::(\d{2})(?:\.\d+)?)?|(\d{2})(?:(\d{2})(?:\.\d+)?)?)?)?"
_RARE = f"^{_DATE}(?:.{_CLOCK}{_OFFSET})?$"
_FIRST_SECOND = -62135596800  # 0001-01-01
_LAST_SECOND = 253402300800  # 10000-01-01
_MILLIS_ABOVE = 1e11


def from_text(value: Column) -> Column:
    """ISO text to a timestamp: comma or point before the fraction, ``Z`` or an offset,
    no offset means UTC; anything else is null."""
    text = F.regexp_replace(F.replace(strip(value), F.lit(","), F.lit(".")), "Z$", "+00:00")
    dashed = F.regexp_replace(text, r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2}))?", "$1-$2-$3T$4")
    timed = F.regexp_replace(dashed, r"T(\d{2})?(?=$|[+-])", "T0$1:00")
    real = ~F.startswith(text, F.lit("0000"))
    common = F.regexp_replace(timed, r"T0(?=\d\d)", "T").try_cast("timestamp")
    found = F.when(text.rlike(_ISO) & real, common)
    # a lambda keeps the long expression for rare forms out of the generated code
    rare = F.get(F.transform(F.array(text), _rare), F.lit(0))
    return F.when(found.isNotNull(), found).when(text.rlike(_RARE) & real, rare)


def _rare(text: Column) -> Column:
    """The time a text of a rarer form tells, from its parts; null where it can't be."""
    part = [F.regexp_extract(text, _RARE, i) for i in range(23)]

    def either(a: int, b: int, none: str) -> Column:
        found = F.concat(part[a], part[b])
        return F.when(found == "", none).otherwise(found)

    week, weekday = F.concat(part[6], part[8]), F.concat(part[7], part[9])
    monday = F.date_trunc("week", F.concat(part[1], F.lit("-01-04")).try_cast("timestamp")).cast("date")
    days = (week.try_cast("int") - 1) * 7 + F.when(weekday == "", 1).otherwise(weekday.try_cast("int")) - 1
    by_week = F.date_add(monday, days)
    good_week = (F.weekofyear(by_week) == week.try_cast("int")) & (weekday.isin("", *"1234567"))
    day = F.when(week == "", F.concat_ws("-", part[1], F.concat(part[2], part[4]), F.concat(part[3], part[5]))).when(
        good_week, F.date_format(by_week, "yyyy-MM-dd")
    )
    hour = F.when(part[10] == "", "00").otherwise(part[10])
    clock = F.concat_ws(":", hour, either(11, 14, "00"), F.concat(either(12, 15, "00"), part[13], part[16]))
    local = F.concat(day, F.lit("T"), clock, F.lit("Z")).try_cast("timestamp")
    ahead = F.when(part[18] == "", "0").otherwise(part[18]), either(19, 21, "0"), either(20, 22, "0")
    seconds = sum(a.try_cast("bigint") * b for a, b in zip(ahead, (3600, 60, 1)))
    sign = F.when(part[17] == "-", -1).otherwise(1)
    return F.when(
        seconds < 86_400, F.timestamp_micros(F.unix_micros(local) - sign * seconds * 1_000_000)
    )


def from_number(value: Column) -> Column:
    """Epoch number to a timestamp: above 1e11 it counts milliseconds, else seconds."""
    seconds = F.when(value > _MILLIS_ABOVE, value / 1000.0).otherwise(value)
    whole = F.floor(seconds)
    micros = whole * 1_000_000 + F.bround((seconds - whole) * 1e6).cast("bigint")
    return F.when(
        (seconds >= _FIRST_SECOND) & (seconds < _LAST_SECOND), F.timestamp_micros(micros)
    )


def leading(value: Column) -> Column:
    """Timestamp of a text line's prefix, whose shape the prefix pattern has checked."""
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("timestamp")
