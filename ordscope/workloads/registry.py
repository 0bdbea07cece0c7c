"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def register(func: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = sql
        return func

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round all doubles (the last digits depend on summation order); no negative zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def longs(df: DataFrame) -> DataFrame:
    """Integers as longs, so that both engines report one type."""
    return df.select(
        *[F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    return longs(rounded(df, digits))


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def _simpson(f: str, upper: str, n: int) -> str:
    """Composite Simpson rule in SQL over ``u`` from 0 to ``upper``; ``f`` is an expression in ``u``."""
    weight = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    value = f.replace("{u}", f"(({upper}) * i / {n}.0)")
    return f"(list_sum(list_transform(range(0, {n + 1}), lambda i: ({weight}) * ({value}))) * ({upper}) / {3 * n}.0)"


def normal_cdf_sql(z: str) -> str:
    """By quadrature of the density; beyond 12 the tail is zero in all digits compared."""
    area = _simpson("exp(-{u} * {u} / 2.0)", f"least(abs({z}), 12.0)", 600)
    return f"(0.5 + sign({z}) * {area} / sqrt(2.0 * pi()))"


def t_cdf_sql(t: str, df: str) -> str:
    """By quadrature over the angle atan(t / sqrt(df))."""
    area = _simpson(f"pow(cos({{u}}), {df} - 1)", f"atan(least(abs({t}), 40.0) / sqrt({df}))", 4000)
    return f"(0.5 + sign({t}) * {area} * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()))"


def f_sf_sql(f: str, d1: str, d2: str) -> str:
    """By quadrature over the angle asin(sqrt(x)) of the beta integral."""
    x = f"({d1} * {f} / ({d2} + {d1} * {f}))"
    area = _simpson(f"pow(sin({{u}}), {d1} - 1) * pow(cos({{u}}), {d2} - 1)", f"asin(sqrt({x}))", 4000)
    return f"(1.0 - 2.0 * {area} * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)))"


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return (
        F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86_400
        + F.hour(ts) * 3_600
        + F.minute(ts) * 60
        + F.second(ts)
    )
