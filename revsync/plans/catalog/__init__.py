"""The catalogue: every operator as a named query over the given tables."""

from revsync.plans.catalog import (  # noqa: F401  (each module registers its queries)
    health,
    ingest,
    loads,
    quality,
    revenue,
    scalars,
    streams,
    upserts,
    webhooks,
)
from revsync.plans.catalog.registry import CHECKS, QUERIES, check_sql


def queries():
    return dict(QUERIES)


def checks():
    return {name: check_sql(text) for name, text in CHECKS.items()}
