"""Checks on the feature tables: (table, check, hits) rows and the list of failed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.fixed_values import FINITE_CHECK_COLUMNS

TABLE_KEYS = {"review": "review_id", "reviewer": "reviewerID", "product": "asin"}
FAILURES = [
    "duplicate_keys", "null_key", "rating_oob", "neg_span", "null_std_n_gt1", "nonzero_hour", "inf_or_nan",
]


def _not_finite(c: Column) -> Column:
    return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)).cast("bigint")


def _oob(rating: str) -> Column:
    return F.count_if((F.col(rating) < 1) | (F.col(rating) > 5)).alias("rating_oob")


def _std_checks() -> list[Column]:
    missing = F.col("rating_std").isNull()
    return [
        F.count_if(F.col("review_span_days") < 0).alias("neg_span"),
        F.count_if(missing).alias("null_std"),
        F.count_if(missing & (F.col("review_count") == 1)).alias("null_std_n1"),
        F.count_if(missing & (F.col("review_count") > 1)).alias("null_std_n_gt1"),
        _oob("avg_rating"),
        F.min("review_count").alias("min_n"),
        F.max("review_count").alias("max_n"),
    ]


def table_checks(df: DataFrame, name: str) -> DataFrame:
    """All checks of one feature table in a single aggregation, as (table, check, hits)."""
    key = TABLE_KEYS[name]
    finite = sum((_not_finite(F.col(c)) for c in FINITE_CHECK_COLUMNS[name][1:]),
                 _not_finite(F.col(FINITE_CHECK_COLUMNS[name][0])))
    checks = [
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(key).alias("n_distinct_key"),
        F.count_if(F.col(key).isNull()).alias("null_key"),
        F.coalesce(F.sum(finite), F.lit(0)).alias("inf_or_nan"),
    ]
    if name == "review":
        checks += [
            F.min("rating").cast("bigint").alias("min_rating"),
            F.max("rating").cast("bigint").alias("max_rating"),
            _oob("rating"),
            F.count_if(F.col("review_length_chars") < 0).alias("neg_len"),
            F.count_if(F.col("exact_text_copy_count") < 1).alias("bad_dup_count"),
            F.count_if(F.col("review_hour") != 0).alias("nonzero_hour"),
        ]
    else:
        checks += _std_checks()
    wide = df.agg(*checks).withColumn("duplicate_keys", F.col("n") - F.col("n_distinct_key"))
    return wide.unpivot([], wide.columns, "check", "hits").select(F.lit(name).alias("table"), "check", "hits")


def failed_checks(checks: DataFrame) -> DataFrame:
    """The checks that must be zero and are not."""
    return checks.filter(F.col("check").isin(FAILURES) & (F.col("hits") > 0))


def reviewer_null_checks(reviewers: DataFrame) -> DataFrame:
    return reviewers.agg(
        F.count_if(F.col("reviewerID").isNull()).alias("null_reviewerID"),
        F.count_if(F.col("review_count").isNull() | (F.col("review_count") < 1)).alias("bad_review_count"),
        F.count_if(F.col("unique_products").isNull()).alias("null_unique_products"),
        F.count_if(F.col("avg_rating").isNull()).alias("null_avg_rating"),
        F.count_if(F.col("rating_std").isNull()).alias("null_rating_std"),
        F.count_if(F.col("review_span_days") < 0).alias("negative_span"),
    )


def schema_listing(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types, from the plan only."""
    return df.dtypes
