"""Where queries and their SQL are put together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.sources.derived import Tables, with_bases
from paneltide.sources.shared import shared_path  # noqa: F401  (plans take it from here)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Decimals of doubles that are compared with another engine's.
DIGITS = 6


def query(name: str, sql: str | None = None, uses: Sequence[str] = ()):
    """Registers f(tables) under a name, with SQL over the derived tables that it uses."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_bases(sql, tuple(uses))
        return f

    return add


def shown(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """The columns (all if none are named), doubles rounded; a -0 becomes 0."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*(
        (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(f"`{c}`") for c in columns or df.columns
    ))


def shown_sql(inner: str, plain: Sequence[str] = (), doubles: Sequence[str] = (), digits: int = DIGITS) -> str:
    """The same around SQL text; a leading WITH of it stays in front."""
    columns = ", ".join([*(f'"{c}"' for c in plain), *(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles)])
    return f"SELECT {columns} FROM ({inner})"
