"""Flights of both legs, made ready for the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternway.functions import times
from ternway.functions.values import nonzero, present, price_of, text_or

KEPT = ("origin", "destination", "departure_at", "arrival_at", "price", "airline", "flight_number", "link", "duration")


#: What legs know of the time at which they meet: seconds, whether it was marked Z, and the date's day.
TIME = ("sec", "aware", "day")


def _timed(rows: DataFrame) -> DataFrame:
    """The departure's seconds and mark, from which arrivals are computed."""
    return rows.withColumns({"_sec": times.seconds(F.col("departure_at")), "_aware": times.aware(F.col("departure_at"))})


def _known() -> tuple[Column, Column]:
    """Whether the arrival is given, and whether it can be computed: from a departure and a duration other than 0."""
    return present(F.col("arrival_at")).isNotNull(), present(F.col("departure_at")).isNotNull() & nonzero(F.col("duration").cast("double")).isNotNull()


def _leg(arrival: Column) -> Column:
    """The struct that results show."""
    return F.struct(
        text_or(F.col("origin"), F.col("search_origin")).alias("origin"),
        text_or(F.col("destination"), F.col("search_destination")).alias("destination"),
        F.col("departure_at"),
        arrival.alias("arrival_at"),
        price_of(F.col("price"), F.col("value")).alias("price"),
        F.col("airline"),
        F.col("flight_number"),
        F.col("link"),
        F.col("duration").cast("double").alias("duration"),
    )


def _computed() -> Column:
    return times.arrival_text(F.col("departure_at"), F.col("duration"), F.col("_sec"), F.col("_aware"))


def first_legs(flights: DataFrame, depart_from: str | None = None, depart_to: str | None = None, via: str | None = None) -> DataFrame:
    """(pos, city, leg, sec, aware, day) of first-leg flights whose arrival is known or can be computed, with that arrival's time.

    Bounds compare the text of the departure's date and, if there are any, drop flights without
    one. via keeps flights to one city; an airport near it is another city.
    """
    ok = times.within(F.col("departure_at"), depart_from, depart_to)
    given, computed = _known()
    city = text_or(F.col("destination"), F.col("search_destination"))
    rows = (flights if ok is None else flights.where(ok)).where(given | computed)
    rows = _timed(rows if not via else rows.where(city == via))
    at, minutes = F.col("arrival_at"), F.col("duration")
    # a computed arrival needs no parsing, unless it is the departure's text
    sec = F.when(given, times.seconds(at)).otherwise(times.arrival_seconds(F.col("_sec"), minutes))
    aware = F.when(given, times.aware(at)).when(F.col("_sec").isNull(), F.col("_aware")).otherwise(F.lit(False))
    whole = F.floor((F.col("_sec") + minutes.cast("double") * 60) / times.DAY)
    day = F.when(given, times.day_number(at)).when(F.col("_sec").isNull(), times.day_number(F.col("departure_at"))).otherwise(whole)
    return rows.select("pos", city.alias("city"), _leg(F.when(given, at).otherwise(_computed())).alias("leg"), sec.alias("sec"), aware.alias("aware"), day.alias("day"))


def second_legs(flights: DataFrame, depart_from: str | None = None, depart_to: str | None = None) -> DataFrame:
    """(pos, origin, leg, sec, aware, day) of second-leg flights with a departure, with its time; an unknown arrival is the departure."""
    ok = times.within(F.col("departure_at"), depart_from, depart_to)
    rows = _timed((flights if ok is None else flights.where(ok)).where(present(F.col("departure_at")).isNotNull()))
    given, computed = _known()
    leg = _leg(F.when(given, F.col("arrival_at")).when(computed, _computed()).otherwise(F.col("departure_at")))
    return rows.select("pos", text_or(F.col("origin"), F.col("search_origin")).alias("origin"), leg.alias("leg"), F.col("_sec").alias("sec"), F.col("_aware").alias("aware"), times.day_of(F.col("departure_at"), F.col("_sec")).alias("day"))
