"""All registered queries. Importing this package fills the registry."""

from hearsay.catalog import aggregates, analytics, filters, learning, scalars, series, sources, text  # noqa: F401
from hearsay.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
