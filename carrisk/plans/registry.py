"""Registry of named queries and their oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or
the master Spark derives from them).  ``finish`` normalises the output the
same way the oracle SQL does: doubles rounded to 6 places (``-0.0`` folded
to ``0.0``) and dates as ISO text, so an order-insensitive hash can compare
the two engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs[f.name] = F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            exprs[f.name] = F.col(f.name).cast("string")
    return df.withColumns(exprs) if exprs else df


def query(name: str, sql: str | None = None):
    """Register ``fn`` as query ``name`` with optional oracle ``sql``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: finish(_fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from carrisk.plans import queries_core  # noqa: F401
    from carrisk.plans import queries_eda  # noqa: F401
    from carrisk.plans import queries_model  # noqa: F401
    from carrisk.plans import queries_segment  # noqa: F401
