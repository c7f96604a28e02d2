"""Date-times as fare interfaces write them: wall-clock texts whose offset is dropped.

A parsed date-time has `sec`, its wall-clock seconds since 1970, `aware`, whether it was marked Z,
and `day`, the days since 1970 of the text up to T. Aware and other date-times have no
difference but that of their days.

Expressions are kept short: the optimiser copies them into filters and projections, and a text
is parsed by one pattern and one cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternway.functions.values import present

DAY = 86_400
_DATE = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_CLOCK = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
_WHOLE, _AWARE, _DAY = rf"^{_DATE}(T{_CLOCK}Z?| {_CLOCK})?$", r"T[0-9:]+Z$", rf"^{_DATE}$"


def without_offset(text: Column) -> Column:
    """The text up to a plus sign, and up to a third minus sign."""
    return F.substring_index(F.substring_index(text, "+", 1), "-", 3)


def date_part(text: Column) -> Column:
    return F.substring_index(text, "T", 1)


def aware(text: Column) -> Column:
    """Whether a date-time ends in Z after a time with T."""
    clean = without_offset(text)
    return F.when(clean.endswith("Z"), clean.rlike(_AWARE)).otherwise(F.lit(False))


def seconds(text: Column) -> Column:
    """Wall-clock seconds since 1970 of a date, or of a date and a time with seconds, T or a blank between them; null if it is neither.

    The text is read as if it were UTC, whatever the session's zone.
    """
    clean = without_offset(text)
    bare = F.when(clean.endswith("Z"), F.left(clean, F.length(clean) - 1)).otherwise(clean)
    # a cast to timestamp_ntz looks up no zone, unlike one of a text with Z
    at = F.when(clean.rlike(_WHOLE), bare).try_cast("timestamp_ntz")
    return (at - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("long")


def parsed(text: Column) -> Column:
    """struct<sec, aware> of a date-time, sec null if it is none."""
    return F.struct(seconds(text).alias("sec"), aware(text).alias("aware"))


def day_number(text: Column) -> Column:
    """Days since 1970 of the text up to T, null if that is no date."""
    day = date_part(text)
    return F.unix_date(F.when(day.rlike(_DAY), day).try_cast("date")).cast("long")


def day_of(text: Column, sec: Column) -> Column:
    """`day_number` of a text whose `seconds` are known: their day, unless the text has a blank instead of T."""
    return F.when(sec.isNull(), day_number(text)).when(~F.contains(text, F.lit(" ")), F.floor(sec / DAY))


def _micros(minutes: Column) -> Column:
    return F.rint(minutes.cast("double") * 60_000_000.0).cast("long")


def arrival_seconds(departed: Column, minutes: Column) -> Column:
    """Seconds of a departure (seconds) plus minutes; null where that is no whole second, as its text does not parse then."""
    micros = _micros(minutes)
    return F.when(micros % 1_000_000 == 0, departed + F.floor(micros / 1_000_000))


def arrival_text(departure: Column, minutes: Column, departed: Column | None = None, marked: Column | None = None) -> Column:
    """Departure plus minutes on the wall clock, in ISO form; the departure's text where it can't be parsed.

    departed, marked: `seconds` and `aware` of the departure, if they are at hand.
    """
    at = seconds(departure) if departed is None else departed
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    text = F.replace(F.timestamp_add("MICROSECOND", at * 1_000_000 + _micros(minutes), zero).cast("string"), F.lit(" "), F.lit("T"))
    text = F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)  # fractions have six places
    return F.coalesce(F.concat(text, F.when(aware(departure) if marked is None else marked, "+00:00").otherwise("")), departure)


def stay_days(arrival: Column, departure: Column) -> Column:
    """Whole days from arrival to departure, rounded down; of dates where the times can't be compared; else 0."""
    exact, dates = stay_parts(*[f(x) for x in (arrival, departure) for f in (seconds, aware, day_number)])
    return F.coalesce(exact, dates, F.lit(0)).cast("long")


def stay_parts(sec1: Column, aware1: Column, day1: Column, sec2: Column, aware2: Column, day2: Column) -> tuple[Column, Column]:
    """Whole days from an arrival to a departure by their times, and by their dates; each null where that can't be told."""
    return F.when(aware1 == aware2, F.floor((sec2 - sec1) / DAY)), day2 - day1


def within(text: Column, first: str | None, last: str | None) -> Column | None:
    """Whether a departure's date, compared as text, is in a range; None without bounds."""
    if not first and not last:
        return None
    day = date_part(present(text))
    ok = day.isNotNull()
    if first:
        ok = ok & (day >= first)
    if last:
        ok = ok & (day <= last)
    return ok


def days(first: Column, last: Column) -> Column:
    """array<date> of all days of a range, empty if it is reversed."""
    return F.when(first <= last, F.sequence(F.least(first, last), last, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))
