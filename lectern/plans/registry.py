"""Every registered query of the transcript operators, with the SQL that it must agree with."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of views: its parameters' names are those of the views or tables it reads.

    sql reads the same views by the same names. None where SQL can not say it.
    """

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        reads = list(inspect.signature(fn).parameters)
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, r) for r in reads))
        if sql is not None:
            from .views import VIEWS

            ORACLE_SQL[name] = with_views(sql, *(r for r in reads if r in VIEWS))
        return fn

    return register


def load() -> None:
    from . import query_aggs, query_audits, query_correct, query_edits, query_filters, query_joins, query_sources, query_text, query_voices, query_windows  # noqa: F401
