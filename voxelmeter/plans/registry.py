"""Named queries with, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelmeter.functions import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir)``; doubles are rounded the same way on both sides."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf), digits)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def load() -> None:
    from voxelmeter.plans import (queries_boards, queries_ensembles, queries_integrity, queries_masks,  # noqa: F401
                                  queries_sampling, queries_sources, queries_stats, queries_streams,
                                  queries_sweeps, queries_text)
