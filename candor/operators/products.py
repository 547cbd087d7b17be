"""Per-product signals of live reviews, for every product at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.fixed_values import (
    MIN_RATED_FOR_DEVIATION,
    PRODUCT_FIELDS,
    RATING_DEVIATION,
    REVIEW_FIELDS,
    SHORT_TEXT_CHARS,
    SKIPPED_FEATURES,
)
from candor.functions.columns import blank_to_null, compact, divide, entropy, text_key, word_count
from candor.functions.skew import attach_by_key
from candor.operators.dedup import first_rows

GROUP = ["platform", "product_id"]
STARS = (1, 2, 3, 4, 5)
SPREAD = ["review_id", "reviewer_id", "rating", "review_date"]


def prepare(reviews: DataFrame) -> DataFrame:
    """Canonical reviews with the stripped text and its digest. A missing text, title or reviewer stays NULL."""
    text = blank_to_null(F.col("text"))
    return reviews.select(
        *[c for c in reviews.columns if c not in ("text", "title", "reviewer_id", "review_date")],
        F.col("review_date").cast("timestamp").alias("review_date"),
        F.nullif(F.col("reviewer_id"), F.lit("")).alias("reviewer_id"),
        F.nullif(F.col("title"), F.lit("")).alias("title"),
        text.alias("text"),
        F.length(text).alias("chars"),
        word_count(text).alias("words"),
        text_key(F.lower(text)).alias("text_key"),
    )


def _days(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(86400.0 * 1e6)


def text_copies(rows: DataFrame) -> DataFrame:
    """Copies of each exact text within a product, only for texts that occur more than once.

    A text has a key; that it is said lets the optimizer add nothing to some uses only, so all share one shuffle.
    """
    return (
        rows.filter(F.col("text").isNotNull() & F.col("text_key").isNotNull()).groupBy(*GROUP, "text_key")
        .agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    )


def rating_and_votes(rows: DataFrame) -> DataFrame:
    """One row per product with the sums that the review checks need: the same columns as in `product_signals`."""
    votes = F.col("helpful_votes")
    return rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count("rating").alias("n_with_rating"), F.avg("rating").alias("avg_rating"),
        F.count(votes).alias("n_with_helpful_votes"), F.sum(votes).alias("helpful_sum"),
        F.sum(votes.cast("bigint") * votes).alias("helpful_squares"),
    )


def product_signals(rows: DataFrame) -> DataFrame:
    """One row per product from prepared reviews.

    Reviews fold to (product, reviewer) and (product, text) before any per-product step, so a product
    or a text with very many rows is combined in the map tasks. Needs no ordering and no collected
    lists. Near-duplicate counts are added by `candor.operators.near_copies`.
    """
    star = F.bround("rating", 0)
    n, rated = F.count(F.lit(1)), F.count("rating")
    dist = {s: F.count_if(star == s) for s in STARS}
    base = rows.groupBy(*GROUP).agg(
        n.alias("n_reviews"), rated.alias("n_with_rating"), F.count("text").alias("n_with_text"),
        F.count("helpful_votes").alias("n_with_helpful_votes"),
        F.count("verified_purchase").alias("n_with_verified_purchase"),
        F.count("review_date").alias("n_with_review_date"), F.count("reviewer_id").alias("n_with_reviewer_id"),
        F.count("title").alias("n_with_title"),
        F.avg("rating").alias("avg_rating"),
        F.when(rated >= 2, F.stddev_pop("rating")).alias("rating_std"),
        *[c.alias(f"stars_{s}") for s, c in dist.items()],
        F.avg("chars").alias("avg_review_length_chars"), F.avg("words").alias("avg_review_length_words"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY chars DESC)").cast("bigint").alias("upper_median_chars"),
        F.avg("helpful_votes").alias("avg_helpful_votes"), F.sum("helpful_votes").alias("helpful_sum"),
        F.sum(F.col("helpful_votes").cast("bigint") * F.col("helpful_votes")).alias("helpful_squares"),
        F.avg(F.col("verified_purchase").cast("double")).alias("verified_purchase_share"),
        F.min("review_date").alias("first_date"), F.max("review_date").alias("last_date"),
    )
    people = rows.filter(F.col("reviewer_id").isNotNull()).groupBy(*GROUP, "reviewer_id").agg(n.alias("k")).groupBy(
        *GROUP).agg(n.alias("unique_reviewers"), F.max("k").alias("max_reviews_one_reviewer"))
    copies = text_copies(rows).groupBy(*GROUP).agg(F.sum("copies").alias("exact_duplicate_review_count"))
    out = join_by_product(join_by_product(base, people), copies)
    nr, nd = F.col("n_with_rating"), F.col("n_with_review_date")
    shares = [divide(F.col(f"stars_{s}"), nr) for s in STARS]
    span = F.when(nd >= 2, _days(F.col("first_date"), F.col("last_date"))).when(nd == 1, 0.0)
    dup = F.coalesce(F.col("exact_duplicate_review_count"), F.lit(0))
    total = F.col("n_reviews")
    return out.select(
        *GROUP, "n_reviews", "n_with_rating", "n_with_text", "n_with_helpful_votes", "n_with_verified_purchase",
        "n_with_review_date", "n_with_reviewer_id", "n_with_title", "avg_rating", "rating_std",
        F.create_map(*[x for s in STARS for x in (F.lit(str(s)), F.col(f"stars_{s}"))]).alias("rating_distribution"),
        shares[4].alias("five_star_ratio"), shares[0].alias("one_star_ratio"),
        divide(F.col("stars_1") + F.col("stars_5"), nr).alias("extreme_rating_ratio"),
        entropy(shares).alias("rating_entropy"),
        "avg_review_length_chars", "avg_review_length_words", "upper_median_chars", "avg_helpful_votes", "helpful_sum",
        "helpful_squares",
        "verified_purchase_share",
        dup.alias("exact_duplicate_review_count"),
        divide(dup, F.col("n_with_text")).alias("duplicate_text_ratio"),
        "unique_reviewers", divide(F.col("unique_reviewers"), total).alias("reviewer_diversity"),
        divide(total, F.col("unique_reviewers")).alias("reviews_per_reviewer"), "max_reviews_one_reviewer",
        span.alias("review_span_days"),
        F.when(nd >= 1, divide(total, span + 1.0)).alias("reviews_per_active_day"),
    )


def join_by_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """LEFT JOIN two one-row-per-product tables; products without an id still match each other."""
    other = b.select(*[F.col(k).alias(f"_{k}") for k in GROUP], *[c for c in b.columns if c not in GROUP])
    on = [a[k].eqNullSafe(other[f"_{k}"]) for k in GROUP]
    return a.join(other, on, "left").drop(*[f"_{k}" for k in GROUP])


def with_product_stats(rows: DataFrame, signals: DataFrame, columns: list[str], **skew: int) -> DataFrame:
    """Add per-product columns to the reviews, hot products answered from a broadcast."""
    stats = signals.select(*GROUP, "n_reviews", *[c for c in columns if c != "n_reviews"])
    return attach_by_key(rows, stats, GROUP, "n_reviews", SPREAD, null_safe=GROUP, **skew)


def with_copies(rows: DataFrame, **skew: int) -> DataFrame:
    """Add `copies`: rows of the product with the same stripped lower-case text (1 when alone, NULL without text)."""
    out = attach_by_key(rows, text_copies(rows), [*GROUP, "text_key"], "copies", SPREAD, null_safe=GROUP, **skew)
    # By the key, which every text has: the texts themselves need not travel.
    copies = F.when(F.col("text_key").isNotNull(), F.coalesce(F.col("copies"), F.lit(1).cast("bigint")))
    return out.withColumn("copies", copies)


def rating_deviation(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Mean absolute distance of the ratings from the product mean."""
    near = with_product_stats(rows.select(*GROUP, *SPREAD), signals, ["avg_rating"])  # NULL ids are one product
    return near.groupBy(*GROUP).agg(F.avg(F.abs(F.col("rating") - F.col("avg_rating"))).alias("mean_abs_rating_deviation"))


def review_flags(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Basic flags per review and the band they give."""
    r = with_product_stats(with_copies(rows), signals, ["avg_rating", "n_with_rating"])
    far = (F.col("n_with_rating") >= MIN_RATED_FOR_DEVIATION) & (
        F.abs(F.col("rating") - F.col("avg_rating")) >= RATING_DEVIATION
    )
    flags = compact(
        [
            F.when(F.col("chars") < SHORT_TEXT_CHARS, "very_short_text"),
            F.when(F.col("copies") > 1, "exact_duplicate_text"),
            F.when(far, "large_rating_deviation"),
            F.when(~F.col("verified_purchase"), "unverified_purchase_when_field_present"),
        ]
    )
    k = F.size("flags")
    return r.select(*GROUP, "review_id", "rating", flags.alias("flags")).withColumn(
        "flag_band", F.when(k >= 3, "High").when(k >= 1, "Medium").otherwise("Low")
    )


def feature_lists(signals: DataFrame) -> DataFrame:
    """Which feature families could be used, and which were skipped and why."""
    has = {k: F.col(c) > 0 for k, c in {
        "rating": "n_with_rating", "text": "n_with_text", "reviewer": "n_with_reviewer_id",
        "helpful": "n_with_helpful_votes", "verified": "n_with_verified_purchase", "dates": "n_with_review_date",
    }.items()}
    two = F.col("n_with_rating") >= 2
    used = compact(
        [
            F.lit("n_reviews"), F.when(has["rating"], "avg_rating"), F.when(has["rating"], "rating_distribution"),
            F.when(two, "rating_std"), F.when(has["rating"], "five_star_ratio"), F.when(has["rating"], "rating_entropy"),
            F.when(has["text"], "avg_review_length_chars"), F.when(has["text"], "duplicate_text_ratio"),
            F.when(has["reviewer"], "reviewer_diversity"), F.when(has["helpful"], "avg_helpful_votes"),
            F.when(has["verified"], "verified_purchase_share"), F.when(has["dates"], "review_span_days"),
        ]
    )
    absent = {"rating": ~has["rating"], "rating_std": ~two, **{k: ~has[k] for k in
              ("text", "reviewer", "helpful", "verified", "dates")}}
    skipped = compact([F.when(c, SKIPPED_FEATURES[k]) for k, c in absent.items()])
    return signals.select(*GROUP, used.alias("features_used"), skipped.alias("features_skipped"))


def review_field_availability(reviews: DataFrame) -> DataFrame:
    """(product, field, present, total) for every canonical review field."""
    wide = reviews.groupBy(*[F.col(g).alias(f"_{g}") for g in GROUP]).agg(
        F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in REVIEW_FIELDS]
    )
    return _fields(wide, REVIEW_FIELDS, "review")


def product_field_availability(products: DataFrame) -> DataFrame:
    """The same for one-row-per-product records."""
    wide = products.groupBy(*[F.col(g).alias(f"_{g}") for g in GROUP]).agg(
        F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in PRODUCT_FIELDS]
    )
    return _fields(wide, PRODUCT_FIELDS, "product")


def _fields(wide: DataFrame, fields: list[str], kind: str) -> DataFrame:
    ids = [f"_{g}" for g in GROUP]
    long = wide.unpivot([*ids, "total"], fields, "field", "present")
    return long.select(
        *[F.col(f"_{g}").alias(g) for g in GROUP], F.concat(F.lit(f"{kind}."), "field").alias("field"), "present", "total",
        (F.col("present") > 0).alias("available"),
    )


def capped(reviews: DataFrame, limit: int) -> DataFrame:
    """The retrieval cap of the analysis: at most `limit` reviews per product, earliest first."""
    order = [F.col("review_date").asc_nulls_last(), F.col("review_id")]
    return first_rows(reviews, GROUP, order, limit)
