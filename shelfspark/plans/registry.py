"""Queries and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task makes pages or images of.
PER_TASK = 2_500


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows of a compact file, much work each, dealt to as many tasks as they need. Counting reads the file's footer only."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PER_TASK)), key)


def values(rows: list[tuple], names: str) -> str:
    """Rows as SQL."""
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"
