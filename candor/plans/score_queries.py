"""Queries of the per-product half: signals, risk, trust, summaries and near copies."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from candor.fixed_values import (
    COMPONENT_SENTENCES,
    COMPONENT_TITLES,
    COMPONENT_WEIGHTS,
    FACTOR_TEXTS,
    MAX_REVIEWS,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    REVIEW_FIELDS,
    REVIEWER_MISSING,
    REVIEWER_REASONS,
    RISK_FEATURES,
    RISK_INTERPRETATIONS,
    RISK_REASONS,
    SENTIMENT_HEADLINES,
    SKIPPED_FEATURES,
    SUMMARY_SENTENCES,
    SUMMARY_TITLES,
)
from candor.operators import additive, near_copies, products, scoring
from candor.plans.batch_queries import entropy_sql
from candor.plans.catalog import big, r6, register
from candor.plans.views import DOCUMENT_SQL, LIVE_SQL, document_reviews, live_reviews
from candor.session import stored

G = "platform, product_id"


def _q(text):
    return "'" + text.replace("'", "''") + "'"


# ---- SQL of the signals -------------------------------------------------------------------------

_ST = {s: f"count(*) FILTER (WHERE round_even(rating, 0) = {s})" for s in range(1, 6)}
_SH = [f"(stars_{s}::DOUBLE / nullif(n_with_rating, 0))" for s in range(1, 6)]
SIGNALS_SQL = f"""prep AS (SELECT * EXCLUDE (text), nullif(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') AS text
  FROM live),
rows AS (SELECT *, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words,
  CASE WHEN text IS NOT NULL THEN count(*) OVER (PARTITION BY {G}, lower(text)) END AS copies,
  text LIKE 'note on %' AND count(*) OVER (PARTITION BY {G}, text) < count(*) OVER (PARTITION BY {G}, text LIKE 'note on %') AS near
 FROM prep),
near AS (SELECT {G}, ((sum(n) ** 2 - sum(n ** 2)) / 2)::BIGINT AS near_duplicate_pairs  -- different texts of the planted notes
 FROM (SELECT {G}, text, count(*) FILTER (WHERE text LIKE 'note on %') AS n FROM rows GROUP BY ALL) GROUP BY ALL),
base AS (SELECT {G}, count(*) AS n_reviews, count(rating) AS n_with_rating, count(text) AS n_with_text,
  count(helpful_votes) AS n_with_helpful_votes, count(verified_purchase) AS n_with_verified_purchase,
  count(review_date) AS n_with_review_date, count(reviewer_id) AS n_with_reviewer_id, count(title) AS n_with_title,
  avg(rating) AS avg_rating, CASE WHEN count(rating) >= 2 THEN stddev_pop(rating) END AS rating_std,
  {", ".join(f"{v} AS stars_{s}" for s, v in _ST.items())},
  avg(chars) AS avg_review_length_chars, avg(words) AS avg_review_length_words,
  list_sort(list(chars) FILTER (WHERE chars IS NOT NULL))[(count(chars) // 2 + 1)::INT] AS upper_median_chars,
  avg(helpful_votes) AS avg_helpful_votes, sum(helpful_votes) AS hs, sum(helpful_votes * helpful_votes) AS hq,
  avg(CASE WHEN verified_purchase THEN 1.0::DOUBLE WHEN verified_purchase IS NOT NULL THEN 0 END) AS verified_purchase_share,
  count(*) FILTER (WHERE copies > 1) AS exact_duplicate_review_count,
  count(DISTINCT reviewer_id) AS ur, (epoch_us(max(review_date)) - epoch_us(min(review_date))) / 86400e6 AS days
 FROM rows GROUP BY {G}),
people AS (SELECT {G}, max(k) AS max_one FROM (SELECT {G}, reviewer_id, count(*) AS k FROM rows
  WHERE reviewer_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
signals AS (SELECT b.*, max_one AS max_reviews_one_reviewer, {_SH[4]} AS five_star_ratio, {_SH[0]} AS one_star_ratio,
  (stars_1 + stars_5)::DOUBLE / nullif(n_with_rating, 0) AS extreme_rating_ratio,
  CASE WHEN n_with_rating > 0 THEN {entropy_sql(_SH)} END AS rating_entropy,
  exact_duplicate_review_count::DOUBLE / nullif(n_with_text, 0) AS duplicate_text_ratio,
  nullif(ur, 0) AS unique_reviewers, nullif(ur, 0)::DOUBLE / n_reviews AS reviewer_diversity,
  n_reviews::DOUBLE / nullif(ur, 0) AS reviews_per_reviewer,
  CASE WHEN n_with_review_date >= 2 THEN days WHEN n_with_review_date = 1 THEN 0 END AS review_span_days,
  CASE WHEN n_with_review_date >= 1 THEN n_reviews / (days + 1) END AS reviews_per_active_day,
  near_duplicate_pairs
 FROM base b LEFT JOIN people USING ({G}) LEFT JOIN near USING ({G}))"""

_SIG_DOUBLE = [
    "avg_rating", "rating_std", "five_star_ratio", "one_star_ratio", "extreme_rating_ratio", "rating_entropy",
    "avg_review_length_chars", "avg_review_length_words", "avg_helpful_votes", "verified_purchase_share",
    "duplicate_text_ratio", "reviewer_diversity", "reviews_per_reviewer", "review_span_days", "reviews_per_active_day",
]
_SIG_BIG = [
    "n_reviews", "n_with_rating", "n_with_text", "n_with_helpful_votes", "n_with_verified_purchase", "n_with_review_date",
    "n_with_reviewer_id", "n_with_title", "upper_median_chars", "exact_duplicate_review_count", "unique_reviewers",
    "max_reviews_one_reviewer", *[f"stars_{s}" for s in range(1, 6)],
]
_SIG_SELECT = f"""SELECT {G}, {", ".join(big(c, c) for c in _SIG_BIG)}, {", ".join(r6(c, c) for c in _SIG_DOUBLE)} FROM signals"""


def _flat_signals(rows):
    s = products.product_signals(rows)
    stars = [F.col("rating_distribution")[str(i)].alias(f"stars_{i}") for i in range(1, 6)]
    return s.select("platform", "product_id", *[c for c in _SIG_BIG + _SIG_DOUBLE if not c.startswith("stars_")], *stars)


def _line(spark, d):
    return products.prepare(live_reviews(spark, d))


def _docs(spark, d):
    return products.prepare(document_reviews(spark, d))


@register("product_signals", f"WITH {LIVE_SQL}, {SIGNALS_SQL} {_SIG_SELECT}")
def _(spark, d):
    return _flat_signals(_line(spark, d))


@register("product_signals_documents", f"WITH {DOCUMENT_SQL}, {SIGNALS_SQL} {_SIG_SELECT}")
def _(spark, d):
    return _flat_signals(_docs(spark, d))


@register(
    "rating_deviation",
    f"""WITH {LIVE_SQL}, {SIGNALS_SQL} SELECT r.platform, r.product_id,
 {r6('avg(abs(rating - avg_rating))', 'mean_abs_rating_deviation')} FROM rows r JOIN signals USING ({G}) GROUP BY ALL""",
)
def _(spark, d):
    rows = _line(spark, d)
    return products.rating_deviation(rows, products.product_signals(rows))


def _joined(items):
    """SQL: the non-NULL items joined by '|'."""
    return "array_to_string([f for f in [" + ", ".join(items) + "] if f IS NOT NULL], '|')"


FLAGS_SQL = f"""flags AS (SELECT {G}, review_id, rating, [f for f in [
  CASE WHEN chars < 20 THEN 'very_short_text' END, CASE WHEN copies > 1 THEN 'exact_duplicate_text' END,
  CASE WHEN n_with_rating >= 5 AND abs(rating - avg_rating) >= 2.5 THEN 'large_rating_deviation' END,
  CASE WHEN verified_purchase = FALSE THEN 'unverified_purchase_when_field_present' END] if f IS NOT NULL] AS f
 FROM rows JOIN signals USING ({G})),
flagged AS (SELECT *, CASE WHEN len(f) >= 3 THEN 'High' WHEN len(f) >= 1 THEN 'Medium' ELSE 'Low' END AS flag_band FROM flags)"""


@register(
    "review_flags",
    f"""WITH {LIVE_SQL}, {SIGNALS_SQL}, {FLAGS_SQL} SELECT {G}, review_id, {r6('rating', 'rating')},
 array_to_string(f, '|') AS flags, flag_band FROM flagged""",
)
def _(spark, d):
    rows = _line(spark, d)
    flags = products.review_flags(rows, products.product_signals(rows))
    return flags.withColumn("flags", F.array_join("flags", "|"))


_HAS = {"rating": "n_with_rating", "text": "n_with_text", "reviewer": "n_with_reviewer_id", "helpful": "n_with_helpful_votes",
        "verified": "n_with_verified_purchase", "dates": "n_with_review_date"}
_USED = ["'n_reviews'"] + [
    f"CASE WHEN {c} THEN '{v}' END" for c, v in [
        ("n_with_rating > 0", "avg_rating"), ("n_with_rating > 0", "rating_distribution"), ("n_with_rating >= 2", "rating_std"),
        ("n_with_rating > 0", "five_star_ratio"), ("n_with_rating > 0", "rating_entropy"),
        ("n_with_text > 0", "avg_review_length_chars"), ("n_with_text > 0", "duplicate_text_ratio"),
        ("n_with_reviewer_id > 0", "reviewer_diversity"), ("n_with_helpful_votes > 0", "avg_helpful_votes"),
        ("n_with_verified_purchase > 0", "verified_purchase_share"), ("n_with_review_date > 0", "review_span_days")]
]
_SKIP = [f"CASE WHEN n_with_rating = 0 THEN {_q(SKIPPED_FEATURES['rating'])} END",
         f"CASE WHEN n_with_rating < 2 THEN {_q(SKIPPED_FEATURES['rating_std'])} END"] + [
    f"CASE WHEN {_HAS[k]} = 0 THEN {_q(SKIPPED_FEATURES[k])} END" for k in ("text", "reviewer", "helpful", "verified", "dates")]


@register(
    "feature_lists",
    f"WITH {LIVE_SQL}, {SIGNALS_SQL} SELECT {G}, {_joined(_USED)} AS features_used, {_joined(_SKIP)} AS features_skipped FROM signals",
)
def _(spark, d):
    lists = products.feature_lists(products.product_signals(_line(spark, d)))
    return lists.select("platform", "product_id", *[F.array_join(c, "|").alias(c) for c in ("features_used", "features_skipped")])


@register(
    "review_fields",
    f"WITH {LIVE_SQL} " + " UNION ALL ".join(
        f"""SELECT {G}, 'review.{f}' AS field, count({'NULL' if f == 'reviewer_name' else f})::BIGINT AS present,
 count(*)::BIGINT AS total, count({'NULL' if f == 'reviewer_name' else f}) > 0 AS available FROM live GROUP BY {G}"""
        for f in REVIEW_FIELDS),
)
def _(spark, d):
    return products.review_field_availability(live_reviews(spark, d))


@register(
    "reviews_capped",
    f"""WITH {LIVE_SQL} SELECT {G}, review_id FROM live QUALIFY row_number() OVER
 (PARTITION BY {G} ORDER BY review_date NULLS LAST, review_id) <= 20""",
)
def _(spark, d):
    return products.capped(live_reviews(spark, d), 20).select("platform", "product_id", "review_id")


# ---- Sentiment ----------------------------------------------------------------------------------


def _hits_sql(words):
    listed = ", ".join(_q(w) for w in words)
    return f"len([x for x in regexp_extract_all(lower(text), '[a-z'']+') if x IN ({listed})])"


SENTIMENT_SQL = f"""hits AS (SELECT *, {_hits_sql(POSITIVE_WORDS)} AS p, {_hits_sql(NEGATIVE_WORDS)} AS q FROM rows),
mood AS (SELECT *, CASE WHEN text IS NULL THEN NULL WHEN p + q = 0 THEN 0.0::DOUBLE ELSE (p - q)::DOUBLE / (p + q) END AS raw FROM hits),
sentiment AS (SELECT *, CASE WHEN text IS NULL THEN NULL WHEN p + q = 0 THEN 'neutral' WHEN raw > 0.2::DOUBLE THEN 'positive'
  WHEN raw < -0.2::DOUBLE THEN 'negative' ELSE 'mixed' END AS sentiment_label FROM mood)"""
_SENTIMENT_SELECT = f"""SELECT {G}, review_id, {big('p', 'positive_hits')}, {big('q', 'negative_hits')}, sentiment_label,
 {r6('round(raw, 4)', 'sentiment_score')},
 CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' WHEN rating IS NOT NULL THEN 'neutral' END AS rating_polarity
 FROM sentiment"""


def _sentiment(rows):
    s = scoring.with_sentiment(rows)
    return s.select("platform", "product_id", "review_id", "positive_hits", "negative_hits", "sentiment_label", "sentiment_score",
                    scoring.star_polarity(F.col("rating")).alias("rating_polarity"))


@register("sentiment", f"WITH {LIVE_SQL}, {SIGNALS_SQL}, {SENTIMENT_SQL} {_SENTIMENT_SELECT}")
def _(spark, d):
    return _sentiment(_line(spark, d))


@register("sentiment_documents", f"WITH {DOCUMENT_SQL}, {SIGNALS_SQL}, {SENTIMENT_SQL} {_SENTIMENT_SELECT}")
def _(spark, d):
    return _sentiment(_docs(spark, d))


# ---- Review risk --------------------------------------------------------------------------------

_SIGNS = {
    "exact": "copies > 1", "near": "coalesce(near, FALSE)", "short": "chars < 20",
    "rating": "n_with_rating >= 5 AND abs(rating - avg_rating) >= 2.5",
    "helpful": "n_with_helpful_votes >= 5 AND n_with_helpful_votes * hq > hs * hs AND n_with_helpful_votes * helpful_votes > hs"
               " AND (n_with_helpful_votes * helpful_votes - hs) * (n_with_helpful_votes * helpful_votes - hs)"
               " > 4 * (n_with_helpful_votes * hq - hs * hs)",
}
_POINTS = {"exact": 35, "near": 20, "short": 15, "rating": 15, "helpful": 10}
_REASONS_SQL = "[f for f in [" + ", ".join(
    f"CASE WHEN {_SIGNS[k]} THEN {_q(RISK_REASONS[k])} END" for k in _SIGNS) + "] if f IS NOT NULL]"
RISK_SQL = f"""scored AS (SELECT s.*, avg_rating, {" + ".join(f"CASE WHEN {_SIGNS[k]} THEN {v} ELSE 0 END" for k, v in _POINTS.items())} AS risk,
  {_REASONS_SQL} AS reasons FROM sentiment s JOIN signals USING ({G})),
risk AS (SELECT *, CASE WHEN risk >= 67 THEN 'High' WHEN risk >= 34 THEN 'Medium' ELSE 'Low' END AS risk_level FROM scored)"""
_ALL = f"{LIVE_SQL}, {SIGNALS_SQL}, {SENTIMENT_SQL}, {RISK_SQL}"


def _risk(rows):
    return scoring.review_risk(rows)


def _flat_risk(risk):
    return risk.select(
        "platform", "product_id", "review_id", "rating", "text_present", "review_length_chars", "review_length_words",
        "helpful_votes", "sentiment_label", "suspicion_risk", "risk_level", F.array_join("reasons", "|").alias("reasons"))


@register(
    "review_risk",
    f"""WITH {_ALL} SELECT {G}, review_id, {r6('rating', 'rating')}, text IS NOT NULL AS text_present,
 {big('chars', 'review_length_chars')}, {big('words', 'review_length_words')}, {big('helpful_votes', 'helpful_votes')},
 sentiment_label, {big('risk', 'suspicion_risk')}, risk_level, array_to_string(reasons, '|') AS reasons FROM risk""",
)
def _(spark, d):
    return _flat_risk(_risk(_line(spark, d)))


@register("review_risk_documents")
def _(spark, d):
    return _flat_risk(_risk(_docs(spark, d)))


_OBSERVED = {"exact": "copies", "near": "1", "short": "chars", "rating": "round(rating - avg_rating, 3)", "helpful": "helpful_votes"}


@register(
    "review_explanations",
    f"WITH {_ALL} SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {G}, review_id, '{RISK_FEATURES[k]}' AS feature, {r6(_OBSERVED[k], 'observed_value')},
 {_q(RISK_INTERPRETATIONS[k])} AS interpretation, 'negative' AS direction, {r6(str(_POINTS[k]), 'contribution')}
 FROM risk WHERE list_contains(reasons, {_q(RISK_REASONS[k])})""" for k in _SIGNS) + ")",
)
def _(spark, d):
    r = _risk(_line(spark, d))
    e = r.select("platform", "product_id", "review_id", F.inline("explanations"))
    return e.drop("component")


# ---- Reviewers ----------------------------------------------------------------------------------

PROFILES_SQL = f"""prof AS (SELECT {G}, reviewer_id, count(*) AS n, count(rating) AS rated, count(review_date) AS dated,
  avg(rating) AS avg_rating, CASE WHEN count(rating) >= 2 THEN stddev_pop(rating) END AS rating_std,
  count(*) FILTER (WHERE rating = 5)::DOUBLE / nullif(count(rating), 0) AS five,
  CASE WHEN count(review_date) >= 2 THEN (epoch_us(max(review_date)) - epoch_us(min(review_date))) / 86400e6
       WHEN count(review_date) = 1 THEN 0.0::DOUBLE END AS span
 FROM rows WHERE reviewer_id IS NOT NULL GROUP BY ALL),
prof2 AS (SELECT *, coalesce(five >= 0.9 AND rated >= 3, FALSE) AS a, coalesce(span < 1 AND n >= 3, FALSE) AS b, n >= 3 AS c FROM prof),
profiles AS (SELECT *, 70 - CASE WHEN a THEN 15 ELSE 0 END - CASE WHEN b THEN 20 ELSE 0 END - CASE WHEN c THEN 10 ELSE 0 END AS trust FROM prof2)"""


@register(
    "reviewer_profiles",
    f"""WITH {LIVE_SQL}, {SIGNALS_SQL}, {PROFILES_SQL} SELECT {G}, reviewer_id, {big('n', 'review_count')}, 1::BIGINT AS unique_products,
 {r6('avg_rating', 'avg_rating')}, {r6('rating_std', 'rating_std')}, {r6('five', 'five_star_ratio')}, {r6('span', 'review_span_days')},
 {r6('CASE WHEN dated >= 1 THEN n / (span + 1) END', 'reviews_per_active_day')}, {big('trust', 'reviewer_trust_score')},
 CASE WHEN NOT (a OR b OR c) THEN 'Low' WHEN 100 - trust >= 67 THEN 'High' WHEN 100 - trust >= 34 THEN 'Medium' ELSE 'Low' END AS risk_level,
 {_joined([f"CASE WHEN a THEN {_q(REVIEWER_REASONS['five_star'])} END", f"CASE WHEN b THEN {_q(REVIEWER_REASONS['burst'])} END",
           f"CASE WHEN c THEN {_q(REVIEWER_REASONS['volume'])} END"])} AS reasons,
 {_joined([f"CASE WHEN rated = 0 THEN {_q(REVIEWER_MISSING['rating'])} END", f"CASE WHEN dated < 2 THEN {_q(REVIEWER_MISSING['span'])} END"])}
  AS missing_signals FROM profiles""",
)
def _(spark, d):
    p = scoring.reviewer_profiles(_line(spark, d))
    return p.withColumns({c: F.array_join(c, "|") for c in ("reasons", "missing_signals")})


PEOPLE_SQL = f"""crew AS (SELECT {G}, count(*) AS n_reviewers, avg(trust) AS mean_trust FROM profiles GROUP BY {G})"""


@register(
    "reviewer_summary",
    f"""WITH {LIVE_SQL}, {SIGNALS_SQL}, {PROFILES_SQL}, {PEOPLE_SQL} SELECT s.platform, s.product_id, n_reviewers IS NOT NULL AS available,
 coalesce(n_reviewers, 0)::BIGINT AS n_reviewers, {big('round_even(mean_trust, 0)', 'mean_reviewer_trust_score')},
 {r6('reviewer_diversity', 'reviewer_diversity')}, {big('max_reviews_one_reviewer', 'max_reviews_one_reviewer')}
 FROM signals s LEFT JOIN crew c USING ({G})""",
)
def _(spark, d):
    rows = _line(spark, d)
    return scoring.reviewer_summary(products.product_signals(rows), scoring.reviewer_profiles(rows)).drop("mean_trust")


# ---- Product trust ------------------------------------------------------------------------------

_MOODS = ("positive", "negative", "neutral", "mixed")
ROLLUP_SQL = f"""rollup_ AS (SELECT {G}, round_even(avg(risk), 0) AS mean_risk, count(*) FILTER (WHERE risk_level = 'High') AS n_high,
  count(*) FILTER (WHERE risk_level = 'Medium') AS n_medium, count(*) FILTER (WHERE risk_level = 'Low') AS n_low,
  count(*) FILTER (WHERE chars < 20) AS n_short, count(sentiment_label) AS n_scored, count(*) FILTER (WHERE text IS NULL) AS n_unscored,
  {", ".join(f"count(*) FILTER (WHERE sentiment_label = '{m}') AS n_{m}" for m in _MOODS)} FROM risk GROUP BY {G}),
toplabel AS (SELECT {G}, sentiment_label AS top_label, k AS top_count FROM (SELECT {G}, sentiment_label, count(*) AS k,
   min(coalesce(strftime(review_date, '%Y%m%d%H%M%S'), '') || '|' || review_id) AS seen FROM risk WHERE sentiment_label IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY k DESC, seen) = 1)"""
_LN5, _L51 = repr(math.log(5)), repr(math.log10(51))
_COMPONENTS = {
    "review_quality": "CASE WHEN n_with_text > 0 THEN 100 * (0.55::DOUBLE * n_with_text / n_reviews + 0.45::DOUBLE * least(1, avg_review_length_chars / 200)) END",
    "rating_consistency": f"CASE WHEN n_with_rating >= 2 THEN 100 * (0.65::DOUBLE * least(1, rating_entropy / {_LN5}::DOUBLE / 0.8::DOUBLE)"
                          " + 0.35::DOUBLE * (1 - least(1, greatest(0, (five_star_ratio - 0.5::DOUBLE) / 0.5::DOUBLE)))) END",
    "reviewer_reliability": "coalesce(100 * reviewer_diversity, mean_trust)",
    "suspicious_review_risk": "100 - mean_risk",
    "review_diversity_activity": f"""greatest(0, 100 * least(1, log10((n_reviews + 1)::DOUBLE) / {_L51}::DOUBLE)
      - CASE WHEN n_reviews >= 8 AND review_span_days < 2 AND reviews_per_active_day >= 5 THEN 25 ELSE 0 END)""",
}
_W = COMPONENT_WEIGHTS
TRUST_SQL = f"""{PROFILES_SQL}, {PEOPLE_SQL}, {ROLLUP_SQL},
comp AS (SELECT * EXCLUDE (mean_risk), mean_risk, {", ".join(f"round(round(({v})::DOUBLE * 1e4, 5)) / 1e4 AS {k}" for k, v in _COMPONENTS.items())}
 FROM signals LEFT JOIN crew USING ({G}) LEFT JOIN rollup_ USING ({G}) LEFT JOIN toplabel USING ({G})),
weights AS (SELECT *, {" + ".join(f"CASE WHEN {k} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for k, w in _W.items())} AS wsum FROM comp),
applied AS (SELECT *, {", ".join(f"round(CASE WHEN {k} IS NOT NULL THEN {w}::DOUBLE / wsum ELSE 0 END, 4) AS applied_{k}" for k, w in _W.items())},
  round_even(least(100, greatest(0, {" + ".join(f"CASE WHEN {k} IS NOT NULL THEN {w}::DOUBLE / wsum * {k} ELSE 0 END" for k, w in _W.items())})), 0)
   AS score FROM weights)"""


def _trust(rows):
    return scoring.score_reviews(rows, tables=("products",))["products"]


@register(
    "product_trust",
    f"""WITH {_ALL}, {TRUST_SQL} SELECT {G}, {big('n_reviews', 'n_reviews')}, {big('score', 'product_trust_score')},
 CASE WHEN score >= 70 THEN 'High' WHEN score >= 45 THEN 'Moderate' ELSE 'Low' END AS trust_level,
 {big('mean_risk', 'suspicion_risk')},
 CASE WHEN mean_risk >= 67 THEN 'High' WHEN mean_risk >= 34 THEN 'Medium' ELSE 'Low' END AS suspicion_level,
 {", ".join(r6(k, k) for k in _W)}, {", ".join(r6(f'applied_{k}', f'applied_{k}') for k in _W)} FROM applied""",
)
def _(spark, d):
    return _trust(_line(spark, d)).drop("explanations")


@register("product_trust_documents")
def _(spark, d):
    return _trust(_docs(spark, d)).withColumn("explanations", F.size("explanations"))


def _component_row(k):
    hi, lo, mid = (_q(s) for s in COMPONENT_SENTENCES[k])
    return f"""SELECT {G}, '{COMPONENT_TITLES[k]}' AS feature, {r6(f'round_even({k}, 0)', 'observed_value')},
 CASE WHEN {k} >= 55 THEN {hi} WHEN {k} < 45 THEN {lo} ELSE {mid} END AS interpretation,
 CASE WHEN {k} >= 55 THEN 'positive' WHEN {k} < 45 THEN 'negative' ELSE 'neutral' END AS direction,
 {r6(f'round(round(applied_{k} * ({k} - 50) * 100, 5)) / 100', 'contribution')}, '{k}' AS component FROM applied WHERE {k} IS NOT NULL"""


def _row(title, value, text, direction, component, where):
    comp = f"'{component}'" if component else "NULL::VARCHAR"
    return f"""SELECT {G}, '{SUMMARY_TITLES[title]}', {r6(value, 'v')}, {text}, {direction}, NULL::DOUBLE, {comp} FROM applied WHERE {where}"""


_S = {k: _q(v) for k, v in SUMMARY_SENTENCES.items()}
_EXPLAINED = [_component_row(k) for k in _W] + [
    _row("repeated", "round(duplicate_text_ratio, 4)", f"CASE WHEN duplicate_text_ratio > 0 THEN {_S['repeated']} ELSE {_S['not_repeated']} END",
         "CASE WHEN duplicate_text_ratio > 0 THEN 'negative' ELSE 'positive' END", "suspicious_review_risk", "duplicate_text_ratio IS NOT NULL"),
    _row("variety", "round(reviewer_diversity, 4)", f"CASE WHEN reviewer_diversity >= 0.7 THEN {_S['varied']} ELSE {_S['not_varied']} END",
         "CASE WHEN reviewer_diversity >= 0.7 THEN 'positive' ELSE 'negative' END", "reviewer_reliability", "reviewer_diversity IS NOT NULL"),
    _row("no_reviewers", "NULL", _S["no_reviewers"], "'neutral'", "reviewer_reliability", "reviewer_diversity IS NULL"),
    _row("short", "n_short", _S["short"], "'negative'", "suspicious_review_risk", "n_short > 0"),
    _row("high", "n_high", f"CASE WHEN n_high > 0 THEN {_S['high']} ELSE {_S['not_high']} END",
         "CASE WHEN n_high > 0 THEN 'negative' ELSE 'positive' END", "suspicious_review_risk", "TRUE"),
    _row("sentiment", "top_count", f"""CASE WHEN top_label = 'positive' AND top_count::DOUBLE / n_scored >= 0.5 THEN {_S['positive']}
   WHEN top_label = 'negative' AND top_count::DOUBLE / n_scored >= 0.5 THEN {_S['negative']} ELSE {_S['mixed']} END""",
         "'neutral'", None, "n_scored > 0"),
]


@register("product_explanations", f"WITH {_ALL}, {TRUST_SQL} " + " UNION ALL ".join(_EXPLAINED))
def _(spark, d):
    return _trust(_line(spark, d)).select("platform", "product_id", F.inline("explanations"))


# ---- Summaries ----------------------------------------------------------------------------------


@register(
    "review_summary",
    f"""WITH {LIVE_SQL}, {SIGNALS_SQL} SELECT {G}, {big('n_reviews', 'n_reviews')}, {big('n_with_text', 'n_with_text')},
 {big('n_with_rating', 'n_with_rating')}, {r6('round(avg_rating, 4)', 'avg_rating')},
 {r6('round(avg_review_length_chars, 4)', 'avg_review_length_chars')}, {big('stars_5', 'five_stars')},
 {r6('round(duplicate_text_ratio, 4)', 'duplicate_text_ratio')} FROM signals""",
)
def _(spark, d):
    s = scoring.review_summary(products.product_signals(_line(spark, d)))
    return s.withColumn("five_stars", F.col("rating_distribution")["5"]).drop("rating_distribution")


_MOOD_COUNTS = ", ".join(big(f"count(*) FILTER (WHERE sentiment_label = '{m}')", f"n_{m}") for m in _MOODS)


@register(
    "sentiment_summary",
    f"""WITH {LIVE_SQL}, {SIGNALS_SQL}, {SENTIMENT_SQL} SELECT {G}, {_MOOD_COUNTS}, count(sentiment_label)::BIGINT AS n_scored,
 count(*) FILTER (WHERE text IS NULL)::BIGINT AS n_unscored FROM sentiment GROUP BY {G}""",
)
def _(spark, d):
    return scoring.sentiment_summary(_line(spark, d))


@register(
    "suspicion_summary",
    f"""WITH {_ALL}, {ROLLUP_SQL} SELECT {G}, {big('mean_risk', 'mean_suspicion_risk')},
 CASE WHEN mean_risk >= 67 THEN 'High' WHEN mean_risk >= 34 THEN 'Medium' ELSE 'Low' END AS level,
 {big('n_high', 'n_high')}, {big('n_medium', 'n_medium')}, {big('n_low', 'n_low')} FROM rollup_""",
)
def _(spark, d):
    return scoring.suspicion_summary(_risk(_line(spark, d)))


@register(
    "dashboard",
    f"""WITH {_ALL}, {ROLLUP_SQL} SELECT {G}, (n_high + n_medium)::BIGINT AS flagged,
 floor((n_high + n_medium) * 100::DOUBLE / (n_high + n_medium + n_low) + 0.5)::BIGINT AS flagged_pct,
 CASE WHEN n_scored = 0 THEN '' WHEN n_positive >= n_neutral AND n_positive >= n_negative AND n_positive >= n_mixed
   THEN {_q(SENTIMENT_HEADLINES['positive'])} WHEN n_negative >= n_neutral AND n_negative >= n_positive AND n_negative >= n_mixed
   THEN {_q(SENTIMENT_HEADLINES['negative'])} ELSE {_q(SENTIMENT_HEADLINES['mixed'])} END AS headline FROM rollup_""",
)
def _(spark, d):
    return scoring.dashboard(_risk(_line(spark, d)))


@register(
    "top_reasons",
    f"""WITH {_ALL}, e AS (SELECT {G}, review_date, review_id, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS place FROM risk),
 c AS (SELECT {G}, reason, count(*) AS n, min(coalesce(strftime(review_date, '%Y%m%d%H%M%S'), '') || '|' || review_id || '|' || place) AS seen
  FROM e GROUP BY ALL)
 SELECT {G}, reason, {big('n', 'n')} FROM c QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY c.n DESC, seen) <= 6""",
)
def _(spark, d):
    return scoring.top_reasons(_risk(_line(spark, d)))


# ---- Additive score -----------------------------------------------------------------------------

_TERMS = {
    "sample": ("TRUE", "least(15, 8 * log10((n_reviews + 1)::DOUBLE))"),
    "diversity": ("reviewer_diversity IS NOT NULL", "12 * (reviewer_diversity - 0.5::DOUBLE)"),
    "duplicates": ("duplicate_text_ratio IS NOT NULL", "-20 * duplicate_text_ratio"),
    "near": ("n_with_text > 0 AND near_duplicate_pairs > 0", "-least(10, 2 * near_duplicate_pairs)"),
    "five_star": ("n_with_rating >= 8 AND five_star_ratio >= 0.85::DOUBLE", "-12 * least(1, (five_star_ratio - 0.85::DOUBLE) / 0.15::DOUBLE)"),
    "entropy": (f"n_with_rating >= 8 AND rating_entropy / {_LN5}::DOUBLE < 0.35::DOUBLE", "-8"),
    "short": ("n_reviews >= 5 AND avg_review_length_chars < 25", "-6"),
    "long": ("n_reviews >= 5 AND avg_review_length_chars >= 80", "4"),
    "burst": ("n_reviews >= 8 AND review_span_days < 2 AND reviews_per_active_day >= 5", "-8"),
    "one_reviewer": ("n_reviews >= 5 AND max_reviews_one_reviewer::DOUBLE / n_reviews >= 0.4::DOUBLE", "-7"),
}
ADDITIVE_SQL = f"""bands AS (SELECT {G}, count(*) FILTER (WHERE flag_band = 'High')::DOUBLE / count(*) AS h,
  count(*) FILTER (WHERE flag_band <> 'Low')::DOUBLE / count(*) AS hm FROM flagged GROUP BY {G}),
added AS (SELECT *, round_even(least(100, greatest(0, 50 + {" + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in _TERMS.values())})), 0) AS score,
  CASE WHEN h >= 0.25 OR hm >= 0.5 THEN 'High' WHEN hm >= 0.2 THEN 'Medium' ELSE 'Low' END AS review_risk_band
 FROM signals JOIN bands USING ({G}))"""


_METRICS = (
    "avg_rating", "rating_std", "five_star_ratio", "duplicate_text_ratio", "reviewer_diversity", "avg_review_length_chars", "rating_entropy")


def _additive(rows):
    tables = scoring.score_reviews(rows, tables=("signals",))
    return additive.additive_score(tables["signals"], products.review_flags(rows, stored(products.product_signals(rows), "signals")))


@register(
    "additive_score",
    f"""WITH {LIVE_SQL}, {SIGNALS_SQL}, {FLAGS_SQL}, {ADDITIVE_SQL} SELECT {G}, {big('score', 'score_additive')}, review_risk_band,
 {big('n_reviews', 'metric_n_reviews')}, near_duplicate_pairs AS metric_near_duplicate_pairs,
 {", ".join(r6(f'round({c}, 4)', f'metric_{c}') for c in _METRICS)} FROM added""",
)
def _(spark, d):
    a = _additive(_line(spark, d))
    m = F.col("metrics")
    return a.select(
        "platform", "product_id", "score_additive", "review_risk_band",
        *[m.getField(c).alias(f"metric_{c}") for c in ("n_reviews", "near_duplicate_pairs", *_METRICS)])


_FACTORS = {
    "sample": ("n_reviews", "n_reviews", "'positive'", "TRUE"),
    "diversity": ("reviewer_diversity", "round(reviewer_diversity, 4)", "CASE WHEN reviewer_diversity >= 0.5 THEN 'positive' ELSE 'negative' END",
                  "reviewer_diversity IS NOT NULL"),
    "no_diversity": ("reviewer_diversity", "NULL", "'neutral'", "reviewer_diversity IS NULL"),
    "duplicates": ("duplicate_text_ratio", "round(duplicate_text_ratio, 4)", "CASE WHEN duplicate_text_ratio > 0 THEN 'negative' ELSE 'positive' END",
                   "duplicate_text_ratio IS NOT NULL"),
    "near": ("near_duplicate_pairs", "near_duplicate_pairs", "'negative'", _TERMS["near"][0]),
    "no_near": ("near_duplicate_pairs", "0", "'positive'", "n_with_text > 0 AND near_duplicate_pairs = 0"),
    "five_star": ("five_star_ratio", "round(five_star_ratio, 4)", "'negative'", "n_with_rating >= 8 AND five_star_ratio >= 0.85::DOUBLE"),
    "no_five_star": ("five_star_ratio", "round(five_star_ratio, 4)", "'positive'", "n_with_rating >= 8 AND five_star_ratio < 0.85::DOUBLE"),
    "entropy": ("rating_entropy", "round(rating_entropy, 4)", "'negative'", _TERMS["entropy"][0]),
    "no_entropy": ("rating_entropy", "round(rating_entropy, 4)", "'positive'",
                   f"n_with_rating >= 8 AND rating_entropy / {_LN5}::DOUBLE >= 0.35::DOUBLE"),
    "short": ("avg_review_length_chars", "round(avg_review_length_chars, 1)", "'negative'", _TERMS["short"][0]),
    "long": ("avg_review_length_chars", "round(avg_review_length_chars, 1)", "'positive'", _TERMS["long"][0]),
    "burst": ("reviews_per_active_day", "round(reviews_per_active_day, 3)", "'negative'", _TERMS["burst"][0]),
    "one_reviewer": ("max_reviews_one_reviewer", "max_reviews_one_reviewer", "'negative'", _TERMS["one_reviewer"][0]),
}


_two = lambda c: f"round_even({c}, 2)"
_ARGS = {
    "sample": ["n_reviews"], "diversity": [_two("reviewer_diversity")], "duplicates": [_two("duplicate_text_ratio")],
    "near": ["near_duplicate_pairs"], "five_star": ["round_even(five_star_ratio * 100, 0)"],
    "no_five_star": ["round_even(five_star_ratio * 100, 0)"],
    "entropy": [_two("rating_entropy"), _two(f"rating_entropy / {_LN5}::DOUBLE")],
    "no_entropy": [_two("rating_entropy"), _two(f"rating_entropy / {_LN5}::DOUBLE")],
    "short": ["round_even(avg_review_length_chars, 0)"], "long": ["round_even(avg_review_length_chars, 0)"],
    "burst": ["n_reviews", "round_even(review_span_days, 1)", "round_even(reviews_per_active_day, 1)"],
    "one_reviewer": ["max_reviews_one_reviewer", "n_reviews"],
}


def _detail(name):
    """The factor's sentence with its numbers, as SQL."""
    text = FACTOR_TEXTS[name][1]
    return f"printf({_q(text)}, {', '.join(_ARGS[name])})" if name in _ARGS else _q(text)


@register(
    "additive_factors",
    f"WITH {LIVE_SQL}, {SIGNALS_SQL}, {FLAGS_SQL}, {ADDITIVE_SQL} " + " UNION ALL ".join(
        f"SELECT {G}, {dr} AS direction, {_q(FACTOR_TEXTS[k][0])} AS label, {_detail(k)} AS detail, '{f}' AS feature, {r6(v, 'value')} FROM added WHERE {w}"
        for k, (f, v, dr, w) in _FACTORS.items()),
)
def _(spark, d):
    return _additive(_line(spark, d)).select("platform", "product_id", F.inline("factors"))


@register("additive_score_documents")
def _(spark, d):
    return _additive(_docs(spark, d)).select("platform", "product_id", "score_additive", "review_risk_band", F.size("factors").alias("n_factors"))


# ---- Near copies --------------------------------------------------------------------------------


_PLANTED = f"WITH {LIVE_SQL}, {SIGNALS_SQL}"


@register("near_duplicate_pairs_live", f"{_PLANTED} SELECT {G}, near_duplicate_pairs FROM signals")
def _(spark, d):
    rows = _line(spark, d)
    return near_copies.near_pairs(rows, near_copies.near_texts(rows))


@register("near_duplicate_reviews_live", f"{_PLANTED} SELECT {G}, review_id FROM rows WHERE near")
def _(spark, d):
    rows = _line(spark, d)
    return near_copies.with_near_flag(rows, near_copies.near_texts(rows)).filter("near").select("platform", "product_id", "review_id")


@register("near_duplicate_pairs")
def _(spark, d):
    rows = _docs(spark, d)
    return near_copies.near_pairs(rows, near_copies.near_texts(rows))


@register("near_duplicate_reviews")
def _(spark, d):
    rows = _docs(spark, d)
    return near_copies.with_near_flag(rows, near_copies.near_texts(rows)).filter("near").select("platform", "product_id", "review_id")
