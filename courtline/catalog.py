"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import plans
from .plans.registry import QUERIES, SQL

for _m in pkgutil.iter_modules(plans.__path__):
    if _m.name.startswith("q_"):
        importlib.import_module(f"{plans.__name__}.{_m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
