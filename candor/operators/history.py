"""Exact-id lookup in the historical tables, identity filters and the status of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions.columns import blank_to_null
from candor.operators.urls import looks_like_asin


def lookup_keys(requests: DataFrame) -> DataFrame:
    """Distinct ids that may be looked up: Amazon requests with a well-formed id."""
    wanted = (F.col("platform") == "amazon") & looks_like_asin(F.col("catalog_product_id"))
    return requests.filter(wanted).select(F.upper(F.trim("catalog_product_id")).alias("asin")).distinct()


def historical_products(requests: DataFrame, product_features: DataFrame) -> DataFrame:
    """Feature rows of the requested products."""
    return product_features.join(lookup_keys(requests), "asin", "left_semi").filter("review_count > 0")


def historical_review_stats(requests: DataFrame, review_features: DataFrame) -> DataFrame:
    rows = review_features.join(lookup_keys(requests), "asin", "left_semi")
    return rows.groupBy("asin").agg(
        F.count(F.lit(1)).alias("n"), F.median("rating").alias("median_rating"),
        F.avg("review_length_chars").alias("avg_review_length_chars"), F.avg("helpful_votes").alias("avg_helpful_votes"),
        F.avg(F.when(F.col("is_exact_duplicate_text"), 1.0).otherwise(0.0)).alias("exact_duplicate_share"),
        F.count_if("text_available").alias("n_with_text"),
    )


def to_canonical(reviews: DataFrame, platform: str = "amazon") -> DataFrame:
    """Historical rows as canonical reviews; blank texts become NULL, the date falls back to unix time."""
    return reviews.select(
        F.lit(platform).alias("platform"), F.col("asin").alias("product_id"), F.col("mongo_id").alias("review_id"),
        F.col("reviewerID").alias("reviewer_id"), F.col("reviewerName").alias("reviewer_name"), F.col("overall").alias("rating"),
        F.when(blank_to_null(F.col("summary")).isNotNull(), F.col("summary")).alias("title"),
        F.when(blank_to_null(F.col("reviewText")).isNotNull(), F.col("reviewText")).alias("text"),
        F.col("helpful_votes").cast("int").alias("helpful_votes"),
        F.coalesce("review_datetime_utc", F.timestamp_seconds("unixReviewTime")).alias("review_date"),
        F.lit(None).cast("boolean").alias("verified_purchase"),
    )


def historical_reviews(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """All reviews of the requested products."""
    rows = reviews.join(lookup_keys(requests), "asin", "left_semi")
    return to_canonical(rows)


def same_product(wanted: Column, found: Column) -> Column:
    """No id on the review, or the requested id in any case."""
    return wanted.isNull() | found.isNull() | (found == "") | (F.upper(wanted) == F.upper(found))


def matching_reviews(requests: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched reviews whose product id does not contradict the request (`request_id` links both)."""
    wanted = requests.select(F.col("request_id").alias("_request"), F.col("catalog_product_id").alias("_wanted"))
    return fetched.join(
        wanted, (fetched["request_id"] == F.col("_request")) & same_product(F.col("_wanted"), fetched["product_id"]), "left_semi"
    )


def resolve_status(requests: DataFrame) -> DataFrame:
    """Status of each request.

    Needs valid_url, platform, listing_page, n_live, n_historical, has_title and fetch_error.
    Historical and live results are labelled and never merged.
    """
    live, past = F.col("n_live") > 0, F.col("n_historical") > 0
    status = (
        F.when(~F.col("valid_url"), "INVALID_URL").when(F.col("platform") == "unsupported", "UNSUPPORTED_PLATFORM")
        .when(F.col("listing_page"), "INVALID_URL").when(live & past, "LIVE_AND_HISTORICAL").when(live, "LIVE")
        .when(past, "HISTORICAL").when(F.col("fetch_error") & ~F.col("has_title"), "DATA_ACCESS_UNAVAILABLE")
        .otherwise("CATALOG_ONLY")
    )
    return requests.withColumn("data_status", status)


def enrich(summary: DataFrame, source_kind: str, n_available: str | None = None) -> DataFrame:
    """Retrieval columns of a summary. Nothing is cut, so all that was retrieved was analysed."""
    n = F.col("n_reviews")
    out = summary.withColumns({
        "n_retrieved": n, "n_analyzed": n, "source_kind": F.lit(source_kind),
    })
    return out.withColumn("n_historical_available", F.col(n_available)) if n_available else out
