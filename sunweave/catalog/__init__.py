"""Queries over the given tables, each with its SQL where SQL can say it."""

from sunweave.catalog import (  # noqa: F401
    cleaning,
    ingest,
    islands,
    jobs,
    learning,
    order,
    scaling,
    scoring,
    statistics,
    timing,
)
from sunweave.catalog.base import ORACLES, QUERIES  # noqa: F401
