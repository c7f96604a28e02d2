"""Whole tasks: searching, building a network, collecting flights."""
