"""Schemas of the files that are read and written."""

from __future__ import annotations

FLIGHT = (
    "origin string, destination string, departure_at string, arrival_at string, duration double, price double, value double, "
    "airline string, flight_number string, link string, leg string, search_origin string, search_destination string, search_date string"
)
RANGE = "struct<start: string, end: string>"
METADATA = f"origin string, destination string, intermediate_airports array<string>, leg1_date_range {RANGE}, currency string, collected_at string, total_flights bigint, leg2_date_range {RANGE}"
AIRPORT = "iata_code string, coordinates string, name string, municipality string, iso_country string"
#: Neighbours are read as text, as older files list bare codes.
NETWORK = "map<string, struct<name: string, municipality: string, country: string, coordinates: string, nearby_airports: array<string>>>"
