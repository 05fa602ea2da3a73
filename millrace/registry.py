"""Names of the registered queries, with their functions and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Queries over the reference operators, by name."""
    from millrace.plans import catalog, catalog_layouts, catalog_more  # noqa: F401  the others add to the first

    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those of queries() that SQL can express."""
    from millrace.plans import catalog, catalog_layouts, catalog_more  # noqa: F401

    return dict(catalog.ORACLES)
