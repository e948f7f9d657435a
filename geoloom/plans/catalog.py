"""All registered queries over the driver's tables, with their oracle SQL."""

from __future__ import annotations

from geoloom.plans import carriageway_queries, classes, crop_queries, crossing_queries, fused, fusion_queries, jobs, level_queries, paths, places, polygon_queries, road_queries, service_queries, space, street_queries, structure_queries, transport_queries  # noqa: F401
from geoloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
