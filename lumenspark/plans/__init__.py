"""Registered queries over the driver's tables."""

from lumenspark.plans import frame_queries, geometry_queries, raster_queries, raycast_queries, scoring_queries, source_queries  # noqa: F401
from lumenspark.plans.registry import ORACLES, QUERIES  # noqa: F401
