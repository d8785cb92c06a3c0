"""Registered queries: the operators applied to the star-schema tables, with equivalent SQL."""

from barloom.catalog.base import REGISTRY, oracle_sql, queries  # noqa: F401
from barloom.catalog import (  # noqa: F401, E402
    downstream,
    features,
    ingest,
    quality,
    relational,
    reports,
    universe,
)
