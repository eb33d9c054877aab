"""Catalogue of runnable queries: a name, a Spark plan, and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan; ``sql`` is the DuckDB statement with the same result."""
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals (with no negative zero) for comparison."""
    from pyspark.sql import functions as F

    return df.select(*[
        (F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n)
        for n, t in df.dtypes])
