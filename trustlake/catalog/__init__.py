"""Queries over the given tables, each with its SQL counterpart where SQL can say it."""

from trustlake.catalog.base import ORACLES, QUERIES
from trustlake.catalog import assurance, data, evidence, ingest, models, shift, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
