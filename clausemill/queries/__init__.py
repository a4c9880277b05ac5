"""Registry of the engine's own queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausemill.queries import concepts, configs, documents, graphs, search, sections, webs

_PARTS = (documents, search, concepts, sections, graphs, configs, webs)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
