"""Reviewer, review and product feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.columns import divide, entropy, text_key
from candor.functions.skew import attach_by_key
from candor.session import stored

DAY = 86400.0
STARS = (1, 2, 3, 4, 5)


def _span(unix: Column) -> Column:
    return (F.max(unix) - F.min(unix)) / F.lit(DAY)


def _star_counts(rating: str) -> list[Column]:
    return [F.count_if(F.col(rating) == s).alias(f"n_rating_{s}") for s in STARS]


def _reviewer_columns() -> list[Column]:
    rating = F.col("overall")
    return [
        F.count(F.lit(1)).alias("review_count"),
        F.countDistinct("asin").alias("unique_products"),
        F.countDistinct("category").alias("unique_categories"),
        F.avg(rating).alias("avg_rating"),
        F.stddev_samp(rating).alias("rating_std"),
        F.min(rating).alias("rating_min"),
        F.max(rating).alias("rating_max"),
        (F.max(rating) - F.min(rating)).alias("rating_range"),
        F.count_if(F.col("text_missing") == 0).alias("review_text_count"),
        F.avg("text_length").alias("avg_review_length"),
        F.sum("helpful_votes").alias("helpful_votes_total"),
        F.min("unixReviewTime").alias("first_review_unix"),
        F.max("unixReviewTime").alias("last_review_unix"),
        F.min("review_datetime_utc").alias("first_review_time"),
        F.max("review_datetime_utc").alias("last_review_time"),
        _span(F.col("unixReviewTime")).alias("review_span_days"),
    ]


def _median_length(reviews: DataFrame) -> DataFrame:
    """Exact median text length per reviewer, from counts per distinct length."""
    hist = reviews.groupBy(F.col("reviewerID").alias("_id"), "text_length").agg(F.count(F.lit(1)).alias("k"))
    mine = Window.partitionBy("_id")
    upto = F.sum("k").over(mine.orderBy("text_length"))
    total = F.sum("k").over(mine)
    ranked = hist.filter(F.col("text_length").isNotNull()).select(
        "_id", "text_length", (upto - F.col("k")).alias("before"), upto.alias("upto"), total.alias("total")
    )
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda place: (place >= F.col("before")) & (place < F.col("upto"))
    return ranked.filter(holds(low) | holds(high)).groupBy("_id").agg(F.avg("text_length").alias("median_review_length"))


def _reviewer_table(reviews: DataFrame, extra: list[Column]) -> DataFrame:
    agg = reviews.groupBy("reviewerID").agg(*_reviewer_columns(), *extra)
    median = _median_length(reviews)
    return agg.join(median, agg["reviewerID"].eqNullSafe(median["_id"]), "left").drop("_id")


def reviewer_aggregate(reviews: DataFrame) -> DataFrame:
    """One row per reviewer, 18 columns. Partial aggregation runs before the shuffle."""
    out = _reviewer_table(reviews, [])
    at = out.columns.index("avg_review_length") + 1
    names = [c for c in out.columns if c != "median_review_length"]
    return out.select(*names[:at], "median_review_length", *names[at:])


def reviewer_features(reviews: DataFrame) -> DataFrame:
    """One row per reviewer, 32 columns. The star histogram rides on the same aggregation."""
    agg = _reviewer_table(reviews, _star_counts("overall"))
    n = F.col("review_count")
    shares = [divide(F.col(f"n_rating_{s}"), n) for s in STARS]
    return agg.select(
        "reviewerID", "review_count", "unique_products", "unique_categories", "avg_rating",
        "rating_std",
        (F.col("rating_std") * F.col("rating_std")).alias("rating_variance"),
        "rating_min", "rating_max", "rating_range", "review_text_count", "avg_review_length",
        "median_review_length", "helpful_votes_total",
        divide(F.col("helpful_votes_total"), n).alias("average_helpfulness_per_review"),
        "first_review_time", "last_review_time", "first_review_unix", "last_review_unix",
        "review_span_days",
        (F.col("review_span_days") + 1.0).alias("inclusive_active_days"),
        divide(n, F.col("review_span_days") + 1.0).alias("reviews_per_active_day"),
        divide(F.col("unique_products"), F.col("unique_categories")).alias("products_per_category"),
        *[f"n_rating_{s}" for s in STARS],
        shares[4].alias("five_star_ratio"),
        shares[0].alias("one_star_ratio"),
        divide(F.col("n_rating_1") + F.col("n_rating_5"), n).alias("extreme_rating_ratio"),
        entropy(shares).alias("rating_entropy"),
    )


def review_features(reviews: DataFrame, hot_rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row per review, 24 columns, or those named in `columns`. Means and copy counts come from pre-aggregated sides.

    Where means or copy counts are asked for, the other columns are written once with a number per row. Each of the three is
    then found for (number, key) alone and written, and only the numbers join them: the wide rows are shuffled once,
    and no shuffle outlives the step that made it.
    """
    skew = {} if hot_rows is None else {"hot_rows": hot_rows}
    has_text = (F.col("text_missing") == 0) & F.col("reviewText").isNotNull()
    has_summary = (F.col("summary_missing") == 0) & F.col("summary").isNotNull()
    base = reviews.select(
        F.col("mongo_id").alias("review_id"), "reviewerID", "asin", "category",
        F.col("overall").alias("rating"), "helpful_votes", "helpful_total", "helpful_ratio",
        F.col("text_length").alias("review_length_chars"),
        F.when(has_text, F.size(F.split(F.trim(F.col("reviewText")), "[\\t\\n\\f\\r ]+", -1)))
        .otherwise(0).alias("review_length_words"),
        F.when(has_summary, F.length("summary")).otherwise(0).alias("summary_length"),
        (F.col("text_missing") == 0).alias("text_available"),
        (F.col("summary_missing") == 0).alias("summary_available"),
        "text_very_short", "unixReviewTime", "review_datetime_utc",
        F.when(has_text, text_key(F.col("reviewText"))).alias("_text"),
    )
    keep = [c for c in base.columns if c != "_text"]
    keys = {"_pm": "asin", "_rm": "reviewerID", "_copies": "_text"}
    needs = {"_pm": ["product_rating_deviation"], "_rm": ["reviewer_rating_deviation"], "_copies": ["exact_text_copy_count", "is_exact_duplicate_text"]}
    parts = {"review_year": F.year, "review_month": F.month, "review_day_of_week": lambda c: F.dayofweek(c) - 1, "review_hour": F.hour}
    out = [*keep, *parts, *[c for cs in needs.values() for c in cs]]
    columns = out if columns is None else [c for c in out if c in columns]
    wanted = [name for name, cs in needs.items() if any(c in columns for c in cs)]
    if wanted:
        used = {c for c in keep if c in columns} | {keys[name] for name in wanted}
        used |= {"rating"} if {"_pm", "_rm"} & set(wanted) else set()
        used |= {"review_datetime_utc"} if any(c in columns for c in parts) else set()
        table = stored(base.select(*[c for c in base.columns if c in used], F.monotonically_increasing_id().alias("_row")), "review-features")
        found = {name: _per_row(table, keys[name], name, **skew) for name in wanted}
        base = table.drop("_text")
        for name, values in found.items():
            base = base.join(values.withColumnRenamed("_row", f"_row{name}"), F.col("_row") == F.col(f"_row{name}"), "left")
    count = F.coalesce(F.col("_copies"), F.lit(1).cast("bigint"))
    made = {
        **{name: part(F.col("review_datetime_utc")) for name, part in parts.items()},
        "product_rating_deviation": F.col("rating") - F.col("_pm"), "reviewer_rating_deviation": F.col("rating") - F.col("_rm"),
        "exact_text_copy_count": count, "is_exact_duplicate_text": count > 1,
    }
    return base.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


def _per_row(table: DataFrame, key: str, name: str, **skew: int) -> DataFrame:
    """(_row, value): the mean rating of the row's key, or the copies of its text; only rows that have one. Written."""
    if name == "_copies":
        stats = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)
        size = name
    else:
        stats, size = table.groupBy(key).agg(F.avg("rating").alias(name), F.count(F.lit(1)).alias("_n")), "_n"
    found = attach_by_key(table.select("_row", key), stats, [key], size, ["_row"], **skew)
    return stored(found.filter(F.col(name).isNotNull()).select("_row", name), f"review-features{name.replace('_', '-')}")


def leave_one_out_deviation(reviews: DataFrame) -> DataFrame:
    """Rating minus the mean of the product's *other* ratings; NULL when there is no other."""
    sums = reviews.groupBy("asin").agg(
        F.sum("overall").alias("_s"), F.count("overall").alias("_n"), F.count(F.lit(1)).alias("_size")
    )
    rows = reviews.select("mongo_id", "reviewerID", "asin", "overall")
    out = attach_by_key(rows, sums, ["asin"], "_size", ["mongo_id", "reviewerID"])
    others = F.when(F.col("_n") > 1, (F.col("_s") - F.col("overall")) / (F.col("_n") - 1))
    return out.select(
        F.col("mongo_id").alias("review_id"), "reviewerID", "asin",
        (F.col("overall") - others).alias("loo_rating_deviation"),
    )


def product_features(
    reviews: DataFrame, reviewers: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """One row per product, 25 columns.

    `reviewers` is the reviewer aggregate (recomputed when absent). Reviews are first folded to
    (product, reviewer), so the reviewer join and the distinct count work on the smaller table and a
    product with a huge number of reviews is combined before it is shuffled.
    """
    skew = {} if hot_rows is None else {"hot_rows": hot_rows}
    if reviewers is None:
        reviewers = reviews.groupBy("reviewerID").agg(
            F.count(F.lit(1)).alias("review_count"),
            F.countDistinct("asin").alias("unique_products"),
            F.stddev_samp("overall").alias("rating_std"),
        )
    rating = F.col("overall")
    folded = reviews.groupBy("asin", "reviewerID").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(rating).alias("n_rated"),
        F.sum(rating).alias("s1"),
        F.sum(rating * rating).alias("s2"),
        F.min(rating).alias("lo"),
        F.max(rating).alias("hi"),
        *_star_counts("overall"),
        F.sum("helpful_votes").alias("votes"),
        F.count("helpful_votes").alias("n_votes"),
        F.count_if(F.col("text_missing") == 0).alias("n_text"),
        F.min("unixReviewTime").alias("t0"),
        F.max("unixReviewTime").alias("t1"),
    )
    stats = reviewers.select(
        "reviewerID",
        F.col("review_count").alias("rv_count"),
        F.col("unique_products").alias("rv_products"),
        F.col("rating_std").alias("rv_std"),
    )
    joined = attach_by_key(folded, stats, ["reviewerID"], "rv_count", ["asin", "reviewerID"], **skew)
    n = F.sum("n")
    star = {s: divide(F.sum(f"n_rating_{s}"), n) for s in STARS}
    rated = F.sum("n_rated")
    variance = F.greatest(
        (F.sum("s2") - F.sum("s1") * F.sum("s1") / rated) / (rated - 1), F.lit(0.0)
    )
    weighted = F.col("rv_std") * F.col("n")
    span = (F.max("t1") - F.min("t0")) / F.lit(DAY)
    main = joined.groupBy("asin").agg(
        n.alias("review_count"),
        F.count("reviewerID").alias("unique_reviewers"),
        divide(F.sum("s1"), rated).alias("avg_rating"),
        F.when(rated > 1, F.sqrt(variance)).alias("rating_std"),
        F.min("lo").alias("rating_min"),
        F.max("hi").alias("rating_max"),
        (F.max("hi") - F.min("lo")).alias("rating_range"),
        star[5].alias("five_star_ratio"),
        star[4].alias("four_star_ratio"),
        star[3].alias("three_star_ratio"),
        star[2].alias("two_star_ratio"),
        star[1].alias("one_star_ratio"),
        entropy([star[s] for s in STARS]).alias("rating_entropy"),
        divide(F.sum("votes"), F.sum("n_votes")).alias("avg_helpful_votes"),
        divide(F.sum("n_text"), n).alias("review_text_coverage"),
        F.min("t0").alias("first_review_unix"),
        F.max("t1").alias("last_review_unix"),
        span.alias("review_span_days"),
        divide(n, span + 1.0).alias("review_velocity"),
        divide(F.sum(F.col("rv_count") * F.col("n")), F.sum(F.when(F.col("rv_count").isNotNull(), F.col("n"))))
        .alias("avg_reviewer_review_count"),
        divide(F.sum(F.col("rv_products") * F.col("n")), F.sum(F.when(F.col("rv_products").isNotNull(), F.col("n"))))
        .alias("avg_reviewer_product_diversity"),
        divide(F.sum(weighted), F.sum(F.when(F.col("rv_std").isNotNull(), F.col("n"))))
        .alias("avg_reviewer_rating_variability"),
    )
    categories = reviews.groupBy("asin").agg(
        F.countDistinct("category").alias("n_categories"), F.min("category").alias("category")
    )
    by_asin = categories.withColumnRenamed("asin", "_asin")
    joined_all = main.join(by_asin, main["asin"].eqNullSafe(by_asin["_asin"]), "inner")
    order = [
        "asin", "review_count", "unique_reviewers", "n_categories", "category", "avg_rating",
        "rating_std", "rating_min", "rating_max", "rating_range", "five_star_ratio",
        "four_star_ratio", "three_star_ratio", "two_star_ratio", "one_star_ratio",
        "rating_entropy", "avg_helpful_votes", "review_text_coverage", "first_review_unix",
        "last_review_unix", "review_span_days", "review_velocity", "avg_reviewer_review_count",
        "avg_reviewer_product_diversity", "avg_reviewer_rating_variability",
    ]
    return joined_all.select(*order)
