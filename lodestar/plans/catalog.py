"""All registered queries and their SQL."""

from __future__ import annotations

from lodestar.plans import aggregates, filters, hexgrid, joins, rasters, scalars, spatial, starschema, storage, windows  # noqa: F401
from lodestar.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
