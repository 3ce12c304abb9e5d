"""Shared registry state and helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def comparable(df: DataFrame) -> DataFrame:
    """Cast decimals to double (last step, identical on the oracle side)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(c.cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else c)
    return df.select(*cols)


def nullable_counts_as_double(df: DataFrame, *cols: str) -> DataFrame:
    """Nullable integer outputs as DOUBLE (the oracle does the same), so both
    engines hand over the same type when a column holds NULLs."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


# As-of instants used by the time-dependent queries.
SALES_AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def with_ctes(sql_ctes: str, *fixtures_: str, body: str) -> str:
    """Oracle text: fixture CTEs, then extra CTEs, then the body."""
    return fx.with_fixtures("SELECT 1", *fixtures_).rsplit("\nSELECT 1", 1)[0] + ",\n" + sql_ctes + "\n" + body


def fresh_dir(spark: SparkSession, name: str) -> str:
    import uuid
    from ...session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
