"""Constrained similarity search between two point tables, on Spark."""

from climekin.api import availability, impact, index_stats, intensity, search, velocity
from climekin.plans.spec import SearchSpec

__all__ = ["SearchSpec", "availability", "impact", "index_stats", "intensity", "search", "velocity"]
