"""Small literal tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope.functions.literals import sql_literal


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Inline VALUES table: the optimizer sees its exact size, no job builds it."""
    rows = list(rows)
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    names = [name.strip("`") for name, _ in fields]
    if not rows:
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f"`{n}`" for n in names)
    values = spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")
    return values.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, (_, t) in zip(names, fields)])
