"""Every query of the engine's own operators, by name, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.queries import aligners, alignment, dispatch, guards, language, runs, streams

_GROUPS = (streams, alignment, language, dispatch, guards, runs, aligners)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for g in _GROUPS for k, v in g.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for g in _GROUPS for k, v in g.ORACLE_SQL.items()}
