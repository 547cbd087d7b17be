"""Writers: partitioned reviews, feature tables, samples and run manifests."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from candor.fixed_values import ANALYSIS_COLUMNS, ML_COLUMNS, SAMPLE_ROWS_PER_SOURCE
from candor.operators.dedup import dropped_counts, first_rows


def write_by_category(df: DataFrame, path: str) -> None:
    """One folder per category, so a lookup that knows the category reads only that folder."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy("category").parquet(path)


def write_table(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Replace a Parquet table. `sort_by` clusters a key so that min/max statistics skip row groups."""
    if sort_by:
        df = df.repartitionByRange(F.col(sort_by)).sortWithinPartitions(sort_by)
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def analysis_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(*ANALYSIS_COLUMNS)


def ml_rows(cleaned: DataFrame) -> DataFrame:
    """The model-ready projection: no metrics and no class columns, which would leak the label."""
    return cleaned.select(*ML_COLUMNS)


def write_csv_sample(
    df: DataFrame, path: str, group: list[str], order: list[str], limit: int = SAMPLE_ROWS_PER_SOURCE
) -> None:
    first_rows(df, group, order, limit).write.mode("overwrite").option("header", True).csv(path)


def run_manifest(cleaned: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows read, written, kept and dropped per source, with the text issues found."""
    counts = dropped_counts(cleaned, kept)
    issues = cleaned.groupBy(F.col("source_file").alias("_f")).agg(
        F.sum("text_missing").cast("bigint").alias("text_missing"),
        F.sum("text_very_short").cast("bigint").alias("text_very_short"),
    )
    return counts.join(issues, F.col("source_file").eqNullSafe(F.col("_f"))).select(
        "source_file", "rows_read", F.col("rows_read").alias("rows_written"), "rows_kept", "rows_dropped",
        "text_missing", "text_very_short",
    )


STEP_MANIFEST = "kind string, name string, type string, n bigint, seconds double"


def write_observed(df: DataFrame, path: str, issues: dict[str, Column]) -> DataFrame:
    """Replace a Parquet table and report the write: rows and seconds, type and NULLs of every column, rows per issue.

    The figures are taken while the rows are written, directly before the sink, so nothing is scanned or computed a
    second time and a stage that runs again before it is not counted twice. One row per figure, as `STEP_MANIFEST`.
    """
    nulls = {f"null_{i}": F.count_if(F.col(f"`{c}`").isNull()) for i, c in enumerate(df.columns)}
    found = {f"issue_{i}": F.count_if(held) for i, held in enumerate(issues.values())}
    seen = Observation()
    start = time.monotonic()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in {**nulls, **found}.items()]).write.mode(
        "overwrite").option("compression", "snappy").parquet(path)
    seconds, figures = time.monotonic() - start, seen.get
    return df.sparkSession.createDataFrame(
        [("rows", "written", None, figures["n"], seconds)]
        + [("column", c, t, figures[f"null_{i}"], None) for i, (c, t) in enumerate(df.dtypes)]
        + [("issue", name, None, figures[f"issue_{i}"], None) for i, name in enumerate(issues)],
        STEP_MANIFEST,
    )


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
