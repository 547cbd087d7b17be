"""Review risk, reviewer trust and the blended product trust score, for every product at once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.fixed_values import (
    COMPONENT_SENTENCES,
    COMPONENT_TITLES,
    COMPONENT_WEIGHTS,
    MIN_RATED_FOR_DEVIATION,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    RATING_DEVIATION,
    REVIEWER_MISSING,
    REVIEWER_REASONS,
    RISK_FEATURES,
    RISK_INTERPRETATIONS,
    RISK_POINTS,
    RISK_REASONS,
    SENTIMENT_HEADLINES,
    SHORT_TEXT_CHARS,
    SUMMARY_SENTENCES,
    SUMMARY_TITLES,
)
from candor.functions.columns import clamp, compact, divide, half_even, let, text_key
from candor.functions.skew import attach_by_key
from candor.operators.dedup import first_rows
from candor.operators.near_copies import is_near, near_bounds, near_texts, pair_counts
from candor.operators.products import (
    GROUP,
    SPREAD,
    join_by_product,
    product_signals,
    rating_and_votes,
)
from candor.session import stored

EXPLANATION = (
    "struct<feature:string,observed_value:double,interpretation:string,direction:string,"
    "contribution:double,component:string>"
)


def places(c: Column, digits: int) -> Column:
    """Round half up after dropping float noise far below the last kept digit."""
    scale = 10.0**digits
    return F.round(F.round(c * scale, 5)) / scale


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 67, "High").when(risk >= 34, "Medium").when(risk.isNotNull(), "Low")


def trust_level(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 45, "Moderate").when(score.isNotNull(), "Low")


def star_polarity(rating: Column) -> Column:
    return (
        F.when(rating >= 4, "positive").when(rating <= 2, "negative").when(rating.isNotNull(), "neutral")
    )


# ---- Sentiment ----------------------------------------------------------------------------------


def _hits(text: Column, words: list[str]) -> Column:
    """Occurrences of whole tokens, a token being a run of a-z and apostrophes."""
    pattern = "(?<![a-z'])(?:" + "|".join(words) + ")(?![a-z'])"
    return F.regexp_count(F.lower(text), F.lit(pattern))


def with_sentiment(rows: DataFrame) -> DataFrame:
    """Add hits, score and label of the word-list sentiment; all NULL without text."""
    text = F.col("text")
    p, n = F.col("positive_hits"), F.col("negative_hits")
    counted = rows.withColumns(
        {"positive_hits": _hits(text, POSITIVE_WORDS), "negative_hits": _hits(text, NEGATIVE_WORDS)}
    )
    raw = F.when(text.isNotNull(), F.coalesce(divide(p - n, p + n), F.lit(0.0)))
    label = (
        F.when(text.isNull(), F.lit(None)).when(p + n == 0, "neutral").when(raw > 0.2, "positive")
        .when(raw < -0.2, "negative").otherwise("mixed")
    )
    return counted.withColumns({"sentiment_label": label, "sentiment_score": places(raw, 4)})


# ---- Reviews ------------------------------------------------------------------------------------


def _explanation(feature, value, interpretation, direction, contribution=None, component=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(feature).alias("feature"), as_col(value).cast("double").alias("observed_value"),
        as_col(interpretation).alias("interpretation"), as_col(direction).alias("direction"),
        as_col(contribution).cast("double").alias("contribution"), as_col(component).cast("string").alias("component"),
    )


_PER_PRODUCT = ["avg_rating", "n_with_rating", "n_with_helpful_votes", "helpful_sum", "helpful_squares"]


def _per_text(rows: DataFrame, stats: DataFrame, matches: DataFrame, **skew: int) -> DataFrame:
    """(product, text_id), the reviews without text as one: their number `m`, the copies and near copies of the text, the product's sums."""
    key = [*GROUP, "text_id"]
    texts = rows.groupBy(*key, "text_key").agg(F.count(F.lit(1)).alias("m"))
    any_case = Window.partitionBy(*GROUP, "text_key")
    texts = texts.withColumn("copies", F.when(F.col("text_id").isNotNull(), F.sum("m").over(any_case))).drop("text_key")
    bounds = near_bounds(matches).select(*[F.col(k).alias(f"_{k}") for k in key], "before", "after")
    on = [texts[g].eqNullSafe(bounds[f"_{g}"]) for g in GROUP] + [texts["text_id"] == bounds["_text_id"]]
    texts = texts.join(bounds, on, "left").drop(*[f"_{k}" for k in key])
    return attach_by_key(texts, stats.select(*GROUP, "n_reviews", *_PER_PRODUCT), GROUP, "n_reviews", ["text_id"], null_safe=GROUP, **skew)


def review_risk(rows: DataFrame, signals: DataFrame | None = None, matches: DataFrame | None = None, **skew: int) -> DataFrame:
    """Risk, band, reasons and explanations per review. `matches` are the near-copy texts.

    All a review needs of its text and its product is joined per distinct text first, and written, so the reviews
    themselves, without their texts, are shuffled once, when the shuffles of the texts are gone.
    """
    if matches is None:
        matches = near_texts(rows, **skew)
    keyed = with_sentiment(rows).withColumn("text_id", F.when(F.col("text").isNotNull(), text_key(F.col("text"))))
    keyed = keyed.select(
        *GROUP, "text_id", "text_key", *SPREAD, F.col("text").isNotNull().alias("text_present"), "chars", "words", "helpful_votes",
        "sentiment_label", "sentiment_score", "positive_hits", "negative_hits")
    per_text = stored(_per_text(keyed, rating_and_votes(rows) if signals is None else signals, matches, **skew), "review-risk")
    key = [*GROUP, "text_id"]
    r = attach_by_key(keyed.drop("text_key"), per_text, key, "m", SPREAD, null_safe=key, **skew).withColumn("near", is_near())
    n, s1, s2 = (F.col(c).cast("double") for c in ("n_with_helpful_votes", "helpful_sum", "helpful_squares"))
    # votes > mean + 2 deviations, with both sides scaled by n and squared so that ties stay exact
    above = n * F.col("helpful_votes") - s1
    spread = n * s2 - s1 * s1
    deviation = F.col("rating") - F.col("avg_rating")
    signs = {
        "exact": F.col("copies") > 1,
        "near": F.col("near"),
        "short": F.col("chars") < SHORT_TEXT_CHARS,
        "rating": (F.col("n_with_rating") >= MIN_RATED_FOR_DEVIATION) & (F.abs(deviation) >= RATING_DEVIATION),
        "helpful": (n >= 5) & (spread > 0) & (above > 0) & (above * above > 4 * spread),
    }
    observed = {
        "exact": F.col("copies"), "near": F.lit(1), "short": F.col("chars"), "rating": places(deviation, 3),
        "helpful": F.col("helpful_votes"),
    }
    seen = F.struct(
        *[F.coalesce(c, F.lit(False)).alias(k) for k, c in signs.items()],
        *[v.cast("double").alias(f"{k}_value") for k, v in observed.items()],
    )

    def explain(s: Column) -> Column:
        return compact([
            F.when(s[k], _explanation(RISK_FEATURES[k], s[f"{k}_value"], RISK_INTERPRETATIONS[k], "negative", RISK_POINTS[k]))
            for k in signs
        ])

    s = F.col("_signs")
    points = [F.when(s[k], RISK_POINTS[k]).otherwise(0) for k in signs]
    out = r.withColumn("_signs", seen).withColumns(
        {
            "suspicion_risk": F.least(F.lit(100), reduce(lambda a, b: a + b, points)),
            "reasons": compact([F.when(s[k], RISK_REASONS[k]) for k in signs]),
            "explanations": let(s, explain),
        }
    )
    return out.select(
        *GROUP, "review_id", "reviewer_id", "review_date", "rating", star_polarity(F.col("rating")).alias("rating_polarity"),
        "text_present", F.col("chars").alias("review_length_chars"),
        F.col("words").alias("review_length_words"), "helpful_votes", "sentiment_label", "sentiment_score",
        "positive_hits", "negative_hits", "suspicion_risk", risk_band(F.col("suspicion_risk")).alias("risk_level"),
        "reasons", "explanations",
    )


# ---- Reviewers ----------------------------------------------------------------------------------


def reviewer_profiles(rows: DataFrame) -> DataFrame:
    """Each reviewer within one product's reviews: profile, trust, reasons and missing signals."""
    rating, n = F.col("rating"), F.col("review_count")
    base = rows.filter(F.col("reviewer_id").isNotNull()).groupBy(*GROUP, "reviewer_id").agg(
        F.count(F.lit(1)).alias("review_count"), F.count("rating").alias("rated"), F.count("review_date").alias("dated"),
        F.avg(rating).alias("avg_rating"), F.when(F.count(rating) >= 2, F.stddev_pop(rating)).alias("rating_std"),
        divide(F.count_if(rating == 5), F.count(rating)).alias("five_star_ratio"),
        F.min("review_date").alias("d0"), F.max("review_date").alias("d1"),
    )
    span = F.when(F.col("dated") >= 2, (F.unix_micros("d1") - F.unix_micros("d0")) / F.lit(86400.0 * 1e6)).when(
        F.col("dated") == 1, 0.0)
    p = base.withColumn("review_span_days", span)
    signs = {
        "five_star": (F.col("five_star_ratio") >= 0.9) & (F.col("rated") >= 3),
        "burst": (F.col("review_span_days") < 1) & (n >= 3),
        "volume": n >= 3,
    }
    points = {"five_star": 15, "burst": 20, "volume": 10}
    trust = F.greatest(F.lit(0), reduce(lambda a, b: a - b, [F.when(signs[k], v).otherwise(0) for k, v in points.items()], F.lit(70)))
    reasons = compact([F.when(c, REVIEWER_REASONS[k]) for k, c in signs.items()])
    no_id = F.col("product_id").isNull()
    missing = compact(
        [
            F.when(F.col("rated") == 0, REVIEWER_MISSING["rating"]), F.when(no_id, REVIEWER_MISSING["product"]),
            F.when(F.col("dated") < 2, REVIEWER_MISSING["span"]),
        ]
    )
    scored = p.withColumns({"reviewer_trust_score": trust, "reasons": reasons, "missing_signals": missing})
    level = F.when(F.size("reasons") == 0, "Low").otherwise(risk_band(100 - F.col("reviewer_trust_score")))
    return scored.select(
        *GROUP, "reviewer_id", "review_count", F.when(~no_id, F.lit(1)).alias("unique_products"), "avg_rating", "rating_std",
        "five_star_ratio", "review_span_days",
        F.when(F.col("dated") >= 1, divide(n, F.col("review_span_days") + 1.0)).alias("reviews_per_active_day"),
        "reviewer_trust_score", level.alias("risk_level"), "reasons", "missing_signals",
    )


def reviewer_summary(signals: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per product: whether reviewers are known, how many, and their mean trust."""
    per = profiles.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_reviewers"), F.avg("reviewer_trust_score").alias("_trust")
    )
    out = join_by_product(signals.select(*GROUP, "reviewer_diversity", "max_reviews_one_reviewer"), per)
    return out.select(
        *GROUP, F.col("n_reviewers").isNotNull().alias("available"), F.coalesce("n_reviewers", F.lit(0)).alias("n_reviewers"),
        half_even(F.col("_trust")).alias("mean_reviewer_trust_score"), "reviewer_diversity", "max_reviews_one_reviewer",
        F.col("_trust").alias("mean_trust"),
    )


# ---- Products -----------------------------------------------------------------------------------


def _by_label(risk: DataFrame) -> DataFrame:
    """Per product and sentiment label, what the product score and its explanations need from the reviews."""
    level = F.col("risk_level")
    return risk.groupBy(*GROUP, "sentiment_label").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct("review_date", "review_id")).alias("seen"), F.sum("suspicion_risk").alias("points"),
        F.count_if(level == "High").alias("n_high"), F.count_if(level == "Medium").alias("n_medium"),
        F.count_if(level == "Low").alias("n_low"),
        F.count_if(F.array_contains("reasons", RISK_REASONS["short"])).alias("n_short"),
        F.count_if(~F.col("text_present")).alias("n_unscored"),
    )


def _review_rollup(by_label: DataFrame) -> DataFrame:
    """One row per product from its labels."""
    label, k = F.col("sentiment_label"), F.col("k")
    of = lambda c: F.sum(F.when(c, k).otherwise(0))
    return by_label.groupBy(*GROUP).agg(
        (F.sum("points") / F.sum("k")).alias("mean_risk"), *[F.sum(c).alias(c) for c in ("n_high", "n_medium", "n_low", "n_short")],
        *[of(label.eqNullSafe(s)).alias(f"n_{s}") for s in ("positive", "negative", "neutral", "mixed")],
        of(label.isNotNull()).alias("n_scored"), F.sum("n_unscored").alias("n_unscored"),
    )


def _first_label(by_label: DataFrame) -> DataFrame:
    """The most frequent sentiment label, the one seen first when counts tie."""
    return by_label.filter(F.col("sentiment_label").isNotNull()).groupBy(*GROUP).agg(
        F.min_by("sentiment_label", F.struct(-F.col("k"), F.col("seen"))).alias("top_label"), F.max("k").alias("top_count")
    )


def components(signals: DataFrame, rollup: DataFrame, people: DataFrame) -> DataFrame:
    """The five component scores, NULL where their signal is missing."""
    s = join_by_product(join_by_product(signals, rollup), people.select(*GROUP, "mean_trust", "n_reviewers"))
    n, n_text, avg_len = F.col("n_reviews"), F.col("n_with_text"), F.col("avg_review_length_chars")
    quality = F.when(
        n_text > 0, 100.0 * (0.55 * divide(n_text, n) + 0.45 * F.least(F.lit(1.0), avg_len / 200.0))
    )
    mixed = F.least(F.lit(1.0), F.col("rating_entropy") / math.log(5) / 0.8)
    piled = clamp((F.col("five_star_ratio") - 0.5) / 0.5, 0.0, 1.0)
    consistency = F.when(F.col("n_with_rating") >= 2, 100.0 * (0.65 * mixed + 0.35 * (1.0 - piled)))
    reliability = F.coalesce(100.0 * F.col("reviewer_diversity"), F.col("mean_trust"))
    mean_risk = half_even(F.col("mean_risk"))
    sample = 100.0 * F.least(F.lit(1.0), F.log10((n + 1).cast("double")) / math.log10(51))
    burst = (n >= 8) & (F.col("review_span_days") < 2) & (F.col("reviews_per_active_day") >= 5)
    activity = F.when(burst, F.greatest(F.lit(0.0), sample - 25)).otherwise(sample)
    values = {
        "review_quality": quality, "rating_consistency": consistency, "reviewer_reliability": reliability,
        "suspicious_review_risk": 100.0 - mean_risk, "review_diversity_activity": activity,
    }
    return s.withColumn("suspicion_risk", mean_risk).withColumns({k: places(v, 4) for k, v in values.items()})


def blend(scored: DataFrame) -> DataFrame:
    """Weighted mean of the available components, weights renormalised; plus the applied weights."""
    total = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in COMPONENT_WEIGHTS.items()), F.lit(0.0))
    shares = {k: F.when(F.col(k).isNotNull(), divide(F.lit(w), F.col("_weight"))).otherwise(0.0)
              for k, w in COMPONENT_WEIGHTS.items()}
    score = sum((shares[k] * F.coalesce(F.col(k), F.lit(0.0)) for k in shares), F.lit(0.0))
    out = scored.withColumn("_weight", total)
    return out.withColumns(
        {
            "product_trust_score": half_even(F.when(F.col("_weight") > 0, clamp(score, 0, 100))),
            **{f"applied_{k}": places(v, 4) for k, v in shares.items()},
        }
    ).withColumn("trust_level", trust_level(F.col("product_trust_score"))).drop("_weight")


def _component_explanation(name: str, s: Column) -> Column:
    score, weight = s[name], s[f"applied_{name}"]
    high, low, between = COMPONENT_SENTENCES[name]
    item = _explanation(
        COMPONENT_TITLES[name], half_even(score), F.when(score >= 55, high).when(score < 45, low).otherwise(between),
        F.when(score >= 55, "positive").when(score < 45, "negative").otherwise("neutral"),
        places(weight * (score - 50), 2), name,
    )
    return F.when((weight > 0) & score.isNotNull(), item)


def explanations() -> Column:
    """The ordered explanation list of one product."""
    inputs = ["duplicate_text_ratio", "reviewer_diversity", "n_short", "n_high", "n_scored", "top_label", "top_count"]
    return let(F.struct(*inputs, *COMPONENT_WEIGHTS, *[f"applied_{k}" for k in COMPONENT_WEIGHTS]), _explain_product)


def _explain_product(s: Column) -> Column:
    say, title = SUMMARY_SENTENCES, SUMMARY_TITLES
    dup, div = s["duplicate_text_ratio"], s["reviewer_diversity"]
    risk, people = "suspicious_review_risk", "reviewer_reliability"
    repeated = F.when(
        dup.isNotNull(),
        _explanation(title["repeated"], places(dup, 4), F.when(dup > 0, say["repeated"]).otherwise(say["not_repeated"]),
                     F.when(dup > 0, "negative").otherwise("positive"), None, risk),
    )
    varied = div >= 0.7
    variety = F.when(
        div.isNotNull(),
        _explanation(title["variety"], places(div, 4), F.when(varied, say["varied"]).otherwise(say["not_varied"]),
                     F.when(varied, "positive").otherwise("negative"), None, people),
    ).otherwise(_explanation(title["no_reviewers"], None, say["no_reviewers"], "neutral", None, people))
    n_short, n_high, top, k = (s[c] for c in ("n_short", "n_high", "top_label", "top_count"))
    short = F.when(n_short > 0, _explanation(title["short"], n_short, say["short"], "negative", None, risk))
    high = _explanation(title["high"], n_high, F.when(n_high > 0, say["high"]).otherwise(say["not_high"]),
                        F.when(n_high > 0, "negative").otherwise("positive"), None, risk)
    half = divide(k, s["n_scored"]) >= 0.5
    mood = F.when(
        s["n_scored"] > 0,
        _explanation(
            title["sentiment"], k,
            F.when((top == "positive") & half, say["positive"]).when((top == "negative") & half, say["negative"])
            .otherwise(say["mixed"]), "neutral",
        ),
    )
    items = [*[_component_explanation(c, s) for c in COMPONENT_WEIGHTS], repeated, variety, short, high, mood]
    return compact([i.cast(EXPLANATION) for i in items])


def product_trust(signals: DataFrame, risk: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per product: components, applied weights, score, level, explanations."""
    people = reviewer_summary(signals, profiles)
    by_label = stored(_by_label(risk), "labels")
    scored = blend(components(signals, _review_rollup(by_label), people))
    labelled = join_by_product(scored, _first_label(by_label))
    out = labelled.withColumn("explanations", explanations())
    return out.select(
        *GROUP, "n_reviews", "product_trust_score", "trust_level", "suspicion_risk",
        risk_band(F.col("suspicion_risk")).alias("suspicion_level"), *COMPONENT_WEIGHTS,
        *[f"applied_{k}" for k in COMPONENT_WEIGHTS], "explanations",
    )


TABLES = ("signals", "reviews", "reviewers", "products")


def score_reviews(rows: DataFrame, matches: DataFrame | None = None, tables: tuple[str, ...] = TABLES, **skew: int) -> dict[str, DataFrame]:
    """The whole analysis of prepared reviews, as tables at their own grain: those named in `tables`.

    What has one row per product is written where the product score needs it, so that its shuffles end there.
    """
    if matches is None:
        matches = near_texts(rows, **skew)
    signals, profiles = stored(product_signals(rows), "signals"), reviewer_profiles(rows)
    out = {"signals": join_by_product(signals, pair_counts(rows, matches)).withColumn(
        "near_duplicate_pairs", F.coalesce("found", F.lit(0).cast("long"))).drop("found"), "reviewers": profiles}
    if {"reviews", "products"} & set(tables):
        out["reviews"] = review_risk(rows, matches=matches, **skew)
    if "products" in tables:
        out["products"] = product_trust(signals, out["reviews"], profiles)
    return {name: out[name] for name in tables}


# ---- Summaries ----------------------------------------------------------------------------------


def review_summary(signals: DataFrame) -> DataFrame:
    return signals.select(
        *GROUP, "n_reviews", "n_with_text", "n_with_rating", places(F.col("avg_rating"), 4).alias("avg_rating"),
        places(F.col("avg_review_length_chars"), 4).alias("avg_review_length_chars"), "rating_distribution",
        places(F.col("duplicate_text_ratio"), 4).alias("duplicate_text_ratio"),
    )


def sentiment_summary(rows: DataFrame) -> DataFrame:
    """Label counts per product, scored and unscored reviews."""
    label = F.col("sentiment_label")
    return with_sentiment(rows).groupBy(*GROUP).agg(
        *[F.count_if(label == s).alias(f"n_{s}") for s in ("positive", "negative", "neutral", "mixed")],
        F.count(label).alias("n_scored"), F.count_if(F.col("text").isNull()).alias("n_unscored"),
    )


def suspicion_summary(risk: DataFrame) -> DataFrame:
    r = _review_rollup(_by_label(risk))
    mean = half_even(F.col("mean_risk"))
    return r.select(*GROUP, mean.alias("mean_suspicion_risk"), risk_band(mean).alias("level"), "n_high", "n_medium", "n_low")


def dashboard(risk: DataFrame) -> DataFrame:
    """Flagged reviews, their whole percentage, and the sentiment headline of each product."""
    r = _review_rollup(_by_label(risk))
    n = F.col("n_high") + F.col("n_medium") + F.col("n_low")
    flagged = F.col("n_high") + F.col("n_medium")
    pos, neg, neu, mix = (F.col(f"n_{s}") for s in ("positive", "negative", "neutral", "mixed"))
    headline = (
        F.when(F.col("n_scored") == 0, "")
        .when((pos >= neu) & (pos >= neg) & (pos >= mix), SENTIMENT_HEADLINES["positive"])
        .when((neg >= pos) & (neg >= neu) & (neg >= mix), SENTIMENT_HEADLINES["negative"])
        .otherwise(SENTIMENT_HEADLINES["mixed"])
    )
    return r.select(
        *GROUP, flagged.alias("flagged"), F.floor(divide(flagged * 100, n) + 0.5).alias("flagged_pct"),
        headline.alias("headline"),
    )


def top_reasons(risk: DataFrame, limit: int = 6) -> DataFrame:
    """The most frequent risk reasons of each product; ties by the first review that shows them."""
    items = risk.select(*GROUP, "review_date", "review_id", F.posexplode("reasons").alias("place", "reason"))
    counts = items.groupBy(*GROUP, "reason").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("review_date", "review_id", "place")).alias("seen")
    )
    return first_rows(counts, GROUP, [F.desc("n"), F.col("seen")], limit).drop("seen")
