"""Registered queries: one Spark plan per operator key, each with its SQL twin.

A query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
input tables. Doubles are rounded to 6 places (``+ 0.0`` folds negative zero)
in both engines so results hash equal; integers are ``bigint``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, widen integers to bigint, turn booleans into bigint 0/1."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("bigint").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def r6(expr: str) -> str:
    """SQL side of ``tidy`` for one double expression."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def load_all() -> None:
    """Import every plan module so its queries register."""
    from nearhit.plans import q_vector, q_eval, q_data, q_text, q_store, q_replay, q_io  # noqa: F401
