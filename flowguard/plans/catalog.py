"""Importing this module registers every named query."""

from flowguard.plans import (  # noqa: F401
    cells,
    dashboards,
    detection,
    models,
    profiles,
    readers,
    relational,
    stores,
    streams,
    traffic,
    training,
)
from flowguard.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
