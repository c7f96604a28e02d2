"""Values that count as absent: null, the empty text and the number zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(text: Column) -> Column:
    """A text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def nonzero(number: Column) -> Column:
    return F.nullif(number, F.lit(0).cast("double"))


def text_or(first: Column, other: Column) -> Column:
    """The first text unless it is absent, else the other as it is."""
    return F.coalesce(present(first), other)


def price_of(price: Column, value: Column) -> Column:
    """The price, the value where the price is absent or zero, and 0 without either."""
    return F.coalesce(nonzero(price.cast("double")), value.cast("double"), F.lit(0.0))


def thousands(number: Column) -> Column:
    """A number without decimals and with commas, as in 12,345."""
    return F.format_number(number, 0)


def two_places(number: Column) -> Column:
    return F.format_string("%.2f", number)


def cents(number: Column) -> Column:
    """A number rounded to two places, halves away from zero, by arithmetic on doubles; Spark's own rounding goes through decimals, which costs more than a pair of flights."""
    scaled = F.abs(number) * 100
    whole = F.floor(scaled).cast("double")
    near = F.signum(number) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / 100
    return F.when(scaled < 1e15, near).otherwise(F.round(number, 2))


def hours_minutes(minutes: Column) -> Column:
    """125 as `2ч 5м`; empty for an absent duration."""
    whole = minutes.cast("long")
    text = F.concat(F.floor(whole / 60).cast("string"), F.lit("ч "), (whole % 60).cast("string"), F.lit("м"))
    return F.when(F.coalesce(minutes, F.lit(0)) == 0, "").otherwise(text)


def labelled(code: Column, city: Column) -> Column:
    """`IATA (City)`, or the code alone where the city is absent."""
    return F.when(present(city).isNotNull(), F.concat(code, F.lit(" ("), city, F.lit(")"))).otherwise(code)
