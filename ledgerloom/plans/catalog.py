"""Importing this module registers every query."""

from ledgerloom.plans import celltables, changelog, checks, ingest, jobs, matching, patches, rowwise, scalars, streams, terms  # noqa: F401
from ledgerloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
