"""Both legs and the rules under which they meet: all that is asked about their journeys."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternway.operators import journeys, medians, partners, prices
from ternway.operators.network import allowed_airports
from ternway.session import kept
from ternway.sources.files import Network


@dataclass
class Meeting:
    """Prepared legs (`operators.legs`), a network or none, and the stay. Only `journeys` pairs all flights."""

    first: DataFrame
    second: DataFrame
    network: Network | None = None
    min_stay: int = 1
    max_stay: int = 30
    max_km: float = 100.0
    same_country: bool = True
    known: DataFrame | None = None

    def _journeys(self, first: DataFrame) -> DataFrame:
        return journeys.journeys(first, self.second, self.network, self.min_stay, self.max_stay, self.max_km, self.same_country)

    @cached_property
    def journeys(self) -> DataFrame:
        return self._journeys(self.first)

    @cached_property
    def pieces(self) -> DataFrame:
        """What the first legs find (`operators.partners`)."""
        if self.known is not None:
            return self.known
        return partners.pieces(self.first, self.second, self._allowed(), self.min_stay, self.max_stay)

    def _allowed(self) -> DataFrame | None:
        return None if self.network is None else allowed_airports(self.first, self.network, self.max_km, self.same_country)

    def kept(self) -> Meeting:
        """The same with its legs and pieces written, for several questions."""
        own = replace(self, first=kept(self.first, "first-legs"), second=kept(self.second, "second-legs"))
        return replace(own, known=kept(own.pieces, "pieces"))

    def _figures(self, cities: bool) -> DataFrame:
        """Figures and medians of all journeys, and of each city's if asked for; no flights are paired (`operators.medians`)."""
        found = medians.blocks(self.first, self.second, self._allowed(), self.min_stay, self.max_stay)
        rows = [] if found is None else medians.summary(found, cities, True)
        return self.first.sparkSession.createDataFrame(rows, "intermediate_city string, total_combinations long, min_price double, max_price double, avg_price double, median_price double")

    def statistics(self) -> DataFrame:
        """One row of figures over all journeys, all 0 if there are none."""
        one = self.first.sparkSession.range(1).select(F.lit(0).alias("whole"))
        found = self._figures(False).drop("intermediate_city").withColumn("whole", F.lit(0))
        return one.join(found, "whole", "left").drop("whole").na.fill(0)

    def statistics_by_city_and_all(self) -> DataFrame:
        """Figures for all journeys (is_total 1, no city) and for each city."""
        return self._figures(True).withColumn("is_total", F.col("intermediate_city").isNull().cast("long"))

    def journeys_of_each(self) -> DataFrame:
        """How many journeys each first leg has, and how many of them by another airport; no flights are paired."""
        return partners.journeys_of_each(self.first, self.pieces)

    def cities(self) -> DataFrame:
        """Number, least and mean price for each stopover city."""
        return partners.figures(self.pieces, "city").select(F.col("city").alias("intermediate_city"), "count", "min_price", "avg_price")

    def cities_ordered(self) -> DataFrame:
        """City figures with their rank by least price, ties by the first journey's place."""
        rank = F.row_number().over(Window.orderBy("min_price", "first")).cast("long")
        return partners.figures(self.pieces, "city", first=True).select(F.col("city").alias("intermediate_city"), "count", "min_price", "avg_price", rank.alias("rank"))

    def _leaders(self, n: int | None) -> DataFrame:
        """First legs with a part in the n cheapest journeys, or with None in a city's cheapest one.

        Bounds by day leave few of them. A stay of exactly one length has no whole day inside, and
        with many equal prices many are left; then pieces tell them apart.
        """
        if n == 0:
            return self.first.withColumn("most", F.lit(0.0)).where(F.lit(False))
        if self.max_stay > self.min_stay:
            found = kept(partners.candidates(self.first, self.second, self._allowed(), self.min_stay, self.max_stay, n), "candidates")
            if found.count() <= partners.MANY + 10 * (n or 0):
                return found
        pieces = self.known if self.known is not None else kept(self.pieces, "pieces")
        return partners.leaders(self.first, pieces, n)

    def cheapest_per_city(self) -> DataFrame:
        """The first journey of each city by price, ties by the flights' places."""
        return prices.cheapest_per_city(self._journeys(self._leaders(None)))

    def cheapest(self, n: int, unique_cities: bool = False) -> DataFrame:
        """The n first journeys with their rank, one for each city if asked for; a negative n is an error."""
        if n < 0:
            raise ValueError("the number of journeys must not be negative")
        return prices.cheapest(self._journeys(self._leaders(None if unique_cities else n)), n, unique_cities)
