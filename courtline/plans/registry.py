"""The register of queries: a name, a function of (spark, sf_dir), and its SQL twin if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import shared_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _steady(sql: str) -> str:
    """Turns round(x, 6) into round((x) + 1e-9, 6), as r6 does."""
    at = len(sql)
    while (at := sql.rfind("round(", 0, at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if sql[:end].endswith(", 6)"):
            sql = f"{sql[:at]}round(({sql[at + 6 : end - 4]}) + 1e-9, 6){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with shared_views():
                return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = _steady(sql)
        return f

    return add


def r6(c: Column | str) -> Column:
    """Doubles are rounded in both engines, as the order of addition differs.

    A billionth is added first: exact halves, which short binary fractions often are, then
    round alike whatever the last bit is; so does zero of either sign.
    """
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6)
