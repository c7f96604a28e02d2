"""The search for journeys in collected flights."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

from ternway.operators import legs, prices
from ternway.operators.meeting import Meeting
from ternway.sources.files import Flights, Network

log = logging.getLogger(__name__)


@dataclass
class Options:
    """What is searched for. Dates are YYYY-MM-DD, empty or None for none.

    A leg's exact date wins over its range. depart_* are the older names for the first leg:
    depart_date counts like leg1_date, depart_from and depart_to where leg1_from and leg1_to are
    absent.
    """

    min_stay: int = 1
    max_stay: int = 30
    leg1_date: str | None = None
    leg1_from: str | None = None
    leg1_to: str | None = None
    leg2_date: str | None = None
    leg2_from: str | None = None
    leg2_to: str | None = None
    depart_date: str | None = None
    depart_from: str | None = None
    depart_to: str | None = None
    via: str | None = None
    transfers: bool = True
    same_country: bool = True
    max_km: float = 100.0
    top: int = 10
    unique_cities: bool = False

    def first_range(self) -> tuple[str | None, str | None]:
        exact = self.leg1_date or self.depart_date
        return (exact, exact) if exact else (self.leg1_from or self.depart_from, self.leg1_to or self.depart_to)

    def second_range(self) -> tuple[str | None, str | None]:
        return (self.leg2_date, self.leg2_date) if self.leg2_date else (self.leg2_from, self.leg2_to)


@dataclass
class Result:
    """The tables that a search gives. Only `journeys`, `unordered` and `listed` pair all flights."""

    meeting: Meeting
    options: Options

    @property
    def journeys(self) -> DataFrame:
        return self.meeting.journeys

    @cached_property
    def statistics(self) -> DataFrame:
        return self.meeting.statistics()

    @property
    def cities(self) -> DataFrame:
        return self.meeting.cities_ordered()

    @property
    def top(self) -> DataFrame:
        return self.meeting.cheapest(self.options.top, self.options.unique_cities)

    @property
    def unordered(self) -> DataFrame:
        """What the result file lists: all journeys, or the cheapest of each city."""
        return self.meeting.cheapest_per_city() if self.options.unique_cities else self.journeys

    @property
    def listed(self) -> DataFrame:
        """The same by price."""
        return self.unordered.orderBy(*prices.ORDER)

    def kept(self) -> Result:
        """The same with its legs and what first legs find written, for several tables."""
        return replace(self, meeting=self.meeting.kept())


def search(flights: Flights, network: Network | None = None, options: Options = Options()) -> Result:
    """Pair both legs of collected flights; a network counts only if transfers are on.

    A warning is logged if airports are asked for that are farther apart than the network tells of.
    """
    if options.transfers and network is not None and network.max_km is not None and options.max_km > network.max_km:
        log.warning("the network holds airports up to %g km from each other, not %g", network.max_km, options.max_km)
    first = legs.first_legs(flights.leg1, *options.first_range(), via=options.via)
    second = legs.second_legs(flights.leg2, *options.second_range())
    return Result(Meeting(first, second, network if options.transfers else None, options.min_stay, options.max_stay, options.max_km, options.same_country), options)
