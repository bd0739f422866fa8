"""Queries by name, with the same queries in SQL."""

from . import adapters, builds, comparisons, content, evaluation, events, experiments, exposures, leases, paging, platform, profiles, projections, quality, reconciliation, scoring, search, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "adapters", "builds", "comparisons", "content", "events", "experiments", "exposures", "leases", "paging", "platform", "profiles", "projections", "quality", "reconciliation", "scoring", "search", "streams"]
