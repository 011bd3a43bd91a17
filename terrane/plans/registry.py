"""Queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.plans import queries as _queries
from terrane.plans.sql import ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in vars(_queries).items() if inspect.isfunction(f) and f.__module__ == _queries.__name__ and not name.startswith("_") and name != "r6"
}

__all__ = ["ORACLE_SQL", "QUERIES"]
