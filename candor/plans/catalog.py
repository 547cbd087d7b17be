"""The query catalogue: name -> job, and name -> the same result as plain SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType)


def comparable(df: DataFrame) -> DataFrame:
    """Widen whole numbers to bigint and round doubles to 6 places (never to -0.0)."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _WHOLE):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") * 1e6) / 1e6 + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Add a job under `name`; `sql` is its oracle."""

    def wrap(job: Job) -> Job:
        assert name not in JOBS, name
        JOBS[name] = lambda spark, sf_dir: comparable(job(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return job

    return wrap


def r6(expr: str, name: str) -> str:
    """A double column of an oracle, rounded as `comparable` rounds it."""
    return f"round(({expr})::DOUBLE, 6) + 0.0 AS {name}"


def big(expr: str, name: str) -> str:
    return f"({expr})::BIGINT AS {name}"


def load() -> None:
    """Import every module that registers queries."""
    from candor.plans import (  # noqa: F401
        audit_queries,
        batch_queries,
        csv_queries,
        eda_queries,
        ingest_queries,
        score_queries,
        stream_queries,
    )
