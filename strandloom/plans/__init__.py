"""Named queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import annotate, coverage, loading, paths, sessions, stats, transcriptome

_MODULES = (loading, coverage, stats, annotate, paths, transcriptome, sessions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in _MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
