"""Operators on flights, airports and journeys."""
