"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revsync.plans.inputs import NAME, PROJECTIONS, Inputs, names_in

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# Views used by several checks, on top of the projections.
CHECK_VIEWS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a function of Inputs under a name, with the SQL that must give the same rows."""

    def add(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return fn

    return add


def check_sql(text: str) -> str:
    """A check as one statement: what it refers to is put in front as WITH clauses."""
    ordered: dict[str, str] = {}

    def visit(sql: str) -> None:
        for name in names_in(sql):
            body = CHECK_VIEWS.get(name) or PROJECTIONS.get(name)
            if body is not None and name not in ordered:
                visit(body)
                ordered[name] = body

    visit(text)
    body = _plain(text)
    if not ordered:
        return body
    views = ",\n".join(f"{name} as ({_plain(sql)}\n)" for name, sql in ordered.items())
    return f"with {views}\n{body}"


def _plain(sql: str) -> str:
    return NAME.sub(r"\1", sql.strip())
