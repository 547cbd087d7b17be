"""Raw review strings to the typed review table. Rows are never dropped here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.fixed_values import (
    HELPFUL_PATTERN,
    LABEL_COLUMN,
    METRIC_COLUMN,
    METRIC_KEYS,
    METRIC_VALUE_PATTERN,
    OID_PATTERN,
    VERY_SHORT_BATCH,
)
from candor.functions.columns import extract, is_missing, strip, to_number

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("mongo_id", T.StringType()),
        T.StructField("reviewerID", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("reviewerName", T.StringType()),
        T.StructField("helpful_votes", T.DoubleType()),
        T.StructField("helpful_total", T.DoubleType()),
        T.StructField("helpful_ratio", T.DoubleType()),
        T.StructField("reviewText", T.StringType()),
        T.StructField("text_length", T.IntegerType()),
        T.StructField("text_missing", T.ByteType()),
        T.StructField("text_very_short", T.ByteType()),
        T.StructField("summary", T.StringType()),
        T.StructField("summary_missing", T.ByteType()),
        T.StructField("overall", T.DoubleType()),
        T.StructField("rating_polarity", T.DoubleType()),
        T.StructField("unixReviewTime", T.DoubleType()),
        T.StructField("review_datetime_utc", T.TimestampType()),
        T.StructField("category", T.StringType()),
        T.StructField("class_raw", T.DoubleType()),
        T.StructField("class_missing", T.ByteType()),
        T.StructField("row_key_hash", T.LongType()),
    ]
)


def _column(raw: DataFrame, name: str) -> Column:
    """The raw column, or NULL when this file family does not have it."""
    return F.col(name) if name in raw.columns else F.lit(None).cast("string")


def present(c: Column) -> Column:
    """The original text, or NULL when it counts as missing."""
    return F.when(~is_missing(c), c)


def object_id(c: Column) -> Column:
    """Hex id inside a serialized `$oid` document."""
    return extract(c, OID_PATTERN)


def helpful_pair(c: Column) -> tuple[Column, Column, Column]:
    """`[votes, total]` to votes, total and their ratio (NULL when total is not positive)."""
    text = strip(c)
    votes = to_number(extract(text, HELPFUL_PATTERN, 1))
    total = to_number(extract(text, HELPFUL_PATTERN, 2))
    return votes, total, F.when(total > 0, votes / total)


def metric_value(c: Column, key: str) -> Column:
    """One number of the serialized metric dict. The key must be quoted, so NR never matches MNR."""
    return extract(c, "['\"]" + key + "['\"]" + METRIC_VALUE_PATTERN).try_cast("double")


def metric_columns(c: Column) -> list[Column]:
    return [metric_value(c, k).alias(f"bfr_{k}") for k in METRIC_KEYS]


def rating_class(rating: Column) -> Column:
    """1 for four stars and more, 0 for other ratings, NULL without a rating."""
    return F.when(rating >= 4, 1.0).when(rating.isNotNull(), 0.0)


def to_utc(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def number_or_missing(c: Column) -> Column:
    """A label-like number: NULL when missing, never filled with 0."""
    return F.when(~is_missing(c), to_number(c))


def clean_reviews(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All-string review rows to the 22 typed columns, plus any raw columns named in `keep`."""
    text, summary = _column(raw, "reviewText"), _column(raw, "summary")
    votes, total, ratio = helpful_pair(_column(raw, "helpful"))
    rating = to_number(_column(raw, "overall"))
    seconds = to_number(_column(raw, "unixReviewTime"))
    text_missing = is_missing(text)
    columns = {
        "source_file": _column(raw, "source_file"),
        "mongo_id": object_id(_column(raw, "_id")),
        "reviewerID": F.col("reviewerID"),
        "asin": F.col("asin"),
        "reviewerName": present(_column(raw, "reviewerName")),
        "helpful_votes": votes,
        "helpful_total": total,
        "helpful_ratio": ratio,
        "reviewText": F.when(~text_missing, text),
        "text_length": F.when(text_missing, 0).otherwise(F.length(text)),
        "text_missing": flag(text_missing),
        "text_very_short": flag(~text_missing & (F.length(text) < VERY_SHORT_BATCH)),
        "summary": present(summary),
        "summary_missing": flag(is_missing(summary)),
        "overall": rating,
        "rating_polarity": rating_class(rating),
        "unixReviewTime": seconds,
        "review_datetime_utc": to_utc(seconds),
        "category": _column(raw, "category"),
        "class_raw": number_or_missing(_column(raw, "class")),
        "class_missing": flag(is_missing(_column(raw, "class"))),
        "row_key_hash": F.xxhash64("reviewerID", "asin", seconds.cast("bigint").cast("string")),
    }
    typed = [columns[f.name].cast(f.dataType).alias(f.name) for f in CLEAN_SCHEMA]
    return raw.select(*typed, *[F.col(k) for k in keep or []])


def clean_labelled(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The labelled file family: cleaned columns, the 13 metrics and the candidate label."""
    base = clean_reviews(raw, [METRIC_COLUMN, LABEL_COLUMN, *(keep or [])])
    return base.select(
        *CLEAN_SCHEMA.names,
        *metric_columns(F.col(METRIC_COLUMN)),
        number_or_missing(F.col(LABEL_COLUMN)).alias("candidate_label"),
        *[F.col(k) for k in keep or []],
    )


def enforce_schema(df: DataFrame, schema: T.StructType = CLEAN_SCHEMA) -> DataFrame:
    """Cast to the declared types; a value that cannot be cast fails the job instead of passing."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns])
