"""Places on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in km.
RADIUS_KM = 6371.0
KM_PER_DEGREE = RADIUS_KM * math.pi / 180
_NUMBER = r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|nan|inf|infinity)$"


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    up, along = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(up), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(along), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def coordinate(text: Column, index: int) -> Column:
    """The index-th number of `lat, lon`, null where that is none."""
    part = F.trim(F.get(F.split(text, ","), F.lit(index)))
    return F.when(part.rlike(_NUMBER), part.try_cast("double"))


def located(text: Column) -> Column:
    """struct<lat, lon> of `lat, lon`, both null unless both are numbers; what follows is ignored."""
    lat, lon = coordinate(text, 0), coordinate(text, 1)
    both = lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))
