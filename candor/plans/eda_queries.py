"""Queries that profile the feature tables."""

from __future__ import annotations

from candor.fixed_values import (
    PRODUCT_NUMERIC,
    PRODUCT_RANKED,
    REVIEW_NUMERIC,
    REVIEWER_NUMERIC,
    REVIEWER_RANKED,
)
from candor.operators import eda, features
from candor.plans.batch_queries import (
    PRODUCT_FEATURES_SQL,
    REVIEW_FEATURES_SQL,
    REVIEWER_AGG_SQL,
    REVIEWER_FEATURES_SQL,
)
from candor.plans.catalog import big, r6, register
from candor.plans.views import REVIEWS_SQL, reviews

_RF = f"{REVIEWS_SQL}, {REVIEW_FEATURES_SQL}"
_VF = f"{REVIEWS_SQL}, {REVIEWER_AGG_SQL}, {REVIEWER_FEATURES_SQL}"
_PF = f"{REVIEWS_SQL}, {PRODUCT_FEATURES_SQL}"
_QS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _rf(spark, d, columns):
    return features.review_features(reviews(spark, d), columns=columns)


def _vf(spark, d):
    return features.reviewer_features(reviews(spark, d))


def _pf(spark, d):
    return features.product_features(reviews(spark, d))


def _profile_sql(with_, tbl, columns):
    def one(c):
        v = f"{c}::DOUBLE"
        qs = ", ".join(r6(f"quantile_cont({v}, {q})", f"p{round(q * 100):02d}") for q in _QS)
        return f"""SELECT '{c}' AS "column", count({c})::BIGINT AS n_non_null, (count(*) - count({c}))::BIGINT AS n_null,
 {r6(f'avg({v})', 'mean')}, {r6(f'stddev_samp({v})', 'std')}, {r6(f'min({v})', '"min"')}, {r6(f'max({v})', '"max"')}, {qs}
 FROM {tbl}"""

    return f"WITH {with_} " + " UNION ALL ".join(one(c) for c in columns)


@register("profile_review_features", _profile_sql(_RF, "rf", REVIEW_NUMERIC))
def _(spark, d):
    return eda.column_profile(_rf(spark, d, REVIEW_NUMERIC), REVIEW_NUMERIC)


@register("profile_reviewer_features", _profile_sql(_VF, "vf", REVIEWER_NUMERIC))
def _(spark, d):
    return eda.column_profile(_vf(spark, d), REVIEWER_NUMERIC)


@register("profile_product_features", _profile_sql(_PF, "pf", PRODUCT_NUMERIC))
def _(spark, d):
    return eda.column_profile(_pf(spark, d), PRODUCT_NUMERIC)


@register("profile_review_features_approximate")
def _(spark, d):
    return eda.approximate_profile(_rf(spark, d, REVIEW_NUMERIC), REVIEW_NUMERIC)


@register(
    "rating_shares",
    f"""WITH {REVIEWS_SQL} SELECT {r6('overall', 'overall')}, count(*)::BIGINT AS n,
 {r6('count(*)::DOUBLE / (SELECT count(*) FROM reviews)', 'share')} FROM reviews GROUP BY overall""",
)
def _(spark, d):
    return eda.shares(reviews(spark, d), "overall")


@register(
    "features_by_rating",
    f"""WITH {_RF} SELECT {r6('rating', 'rating')}, count(*)::BIGINT AS n, {r6('avg(review_length_chars)', 'mean_len')},
 {r6('median(review_length_chars)', 'median_len')}, {r6('avg(helpful_votes)', 'mean_helpful')} FROM rf GROUP BY rating""",
)
def _(spark, d):
    return eda.by_rating(_rf(spark, d, ["rating", "review_length_chars", "helpful_votes"]))


@register(
    "features_by_category",
    f"""WITH {_RF} SELECT category, count(*)::BIGINT AS n, {r6('avg(rating)', 'mean_rating')},
 {r6('median(review_length_chars)', 'median_len')}, {r6('avg(helpful_votes)', 'mean_helpful')} FROM rf GROUP BY category""",
)
def _(spark, d):
    return eda.by_category(_rf(spark, d, ["category", "rating", "review_length_chars", "helpful_votes"]))


@register(
    "availability",
    f"""WITH {_RF} SELECT {r6('avg(CASE WHEN text_available THEN 1.0::DOUBLE ELSE 0 END)', 'text_share')},
 {r6('avg(CASE WHEN summary_available THEN 1.0::DOUBLE ELSE 0 END)', 'summary_share')},
 count(*) FILTER (WHERE is_exact_duplicate_text)::BIGINT AS n_dup, {big('min(review_year)', 'ymin')},
 {big('max(review_year)', 'ymax')} FROM rf""",
)
def _(spark, d):
    return eda.availability(_rf(spark, d, ["text_available", "summary_available", "is_exact_duplicate_text", "review_year"]))


@register(
    "reviewer_extras",
    f"""WITH {_VF} SELECT count(*) FILTER (WHERE review_count = 1)::BIGINT AS n_single,
 count(*) FILTER (WHERE rating_std IS NULL)::BIGINT AS null_std,
 count(*) FILTER (WHERE rating_std IS NULL AND review_count = 1)::BIGINT AS null_std_n1,
 count(*) FILTER (WHERE rating_std IS NULL AND review_count > 1)::BIGINT AS null_std_n_gt1 FROM vf""",
)
def _(spark, d):
    return eda.reviewer_extras(_vf(spark, d))


@register(
    "most_active_reviewers",
    f"""WITH {_VF} SELECT "reviewerID", {big('review_count', 'review_count')}, {big('unique_products', 'unique_products')},
 {r6('avg_rating', 'avg_rating')}, {r6('review_span_days', 'review_span_days')}, {r6('five_star_ratio', 'five_star_ratio')}
 FROM vf ORDER BY vf.review_count DESC, "reviewerID" LIMIT 10""",
)
def _(spark, d):
    return eda.most_active(_vf(spark, d))


@register(
    "product_extras",
    f"""WITH {_PF}, q AS (SELECT quantile_cont(review_count::DOUBLE, 0.99) AS p99 FROM pf)
 SELECT count(*) FILTER (WHERE review_count = 1)::BIGINT AS n_single,
 count(*) FILTER (WHERE review_count > p99)::BIGINT AS n_high,
 count(*) FILTER (WHERE review_count >= 10 AND five_star_ratio >= 0.95)::BIGINT AS n_conc FROM pf, q""",
)
def _(spark, d):
    return eda.product_extras(_pf(spark, d))


_OUTLIER_SQL = f"""vq AS (SELECT quantile_cont(review_count::DOUBLE, 0.25) AS a, quantile_cont(review_count::DOUBLE, 0.75) AS b,
  quantile_cont(review_count::DOUBLE, 0.95) AS p95, quantile_cont(review_count::DOUBLE, 0.99) AS p99 FROM vf),
 tags AS (SELECT "reviewerID", review_count > p95 AS high, review_count > p99 AS extreme,
  review_count >= 5 AND extreme_rating_ratio >= 0.95 AS pattern, review_count > b + 1.5 * (b - a) AS iqr FROM vf, vq)"""


@register("reviewer_outliers", f"WITH {_VF}, {_OUTLIER_SQL} SELECT * FROM tags")
def _(spark, d):
    return eda.reviewer_outliers(_vf(spark, d))


@register(
    "outlier_counts",
    f"""WITH {_VF}, {_OUTLIER_SQL}, {REVIEW_FEATURES_SQL}, {PRODUCT_FEATURES_SQL},
 lq AS (SELECT quantile_cont(review_length_chars::DOUBLE, 0.01) AS a, quantile_cont(review_length_chars::DOUBLE, 0.99) AS b FROM rf),
 pq AS (SELECT quantile_cont(review_count::DOUBLE, 0.99) AS b FROM pf)
 SELECT 'reviewer_high' AS tag, count(*) FILTER (WHERE high)::BIGINT AS hits FROM tags
 UNION ALL SELECT 'reviewer_extreme', count(*) FILTER (WHERE extreme)::BIGINT FROM tags
 UNION ALL SELECT 'reviewer_pattern', count(*) FILTER (WHERE pattern)::BIGINT FROM tags
 UNION ALL SELECT 'reviewer_iqr', count(*) FILTER (WHERE iqr)::BIGINT FROM tags
 UNION ALL SELECT 'review_length', count(*) FILTER (WHERE review_length_chars < a OR review_length_chars > b)::BIGINT FROM rf, lq
 UNION ALL SELECT 'product_high', count(*) FILTER (WHERE review_count > b)::BIGINT FROM pf, pq""",
)
def _(spark, d):
    r = reviews(spark, d)
    return eda.outlier_counts(features.review_features(r, columns=["review_length_chars"]), features.reviewer_features(r), features.product_features(r))


def _log_sql(with_, tbl, column, steps, plus):
    x = f"({column} + {1 if plus else 0})"
    return f"""WITH {with_} SELECT {r6(f'floor(ln(CASE WHEN {x} > 0 THEN {x}::DOUBLE END) * {steps}) / {steps}', 'bin')},
 count(*)::BIGINT AS n FROM {tbl} GROUP BY 1"""


for _name, _with, _tbl, _make, _col, _steps, _plus in [
    ("histogram_review_length", _RF, "rf", lambda s, d: _rf(s, d, ["review_length_chars"]), "review_length_chars", 4, True),
    ("histogram_helpful_votes", _RF, "rf", lambda s, d: _rf(s, d, ["helpful_votes"]), "helpful_votes", 4, True),
    ("histogram_reviewer_activity", _VF, "vf", _vf, "review_count", 5, False),
    ("histogram_reviewer_products", _VF, "vf", _vf, "unique_products", 5, False),
    ("histogram_product_activity", _PF, "pf", _pf, "review_count", 5, False),
    ("histogram_product_velocity", _PF, "pf", _pf, "review_velocity", 5, True),
]:
    register(_name, _log_sql(_with, _tbl, _col, _steps, _plus))(
        lambda spark, d, make=_make, col=_col, steps=_steps, plus=_plus: eda.log_histogram(make(spark, d), col, steps, plus)
    )

for _name, _with, _tbl, _make, _col, _digits in [
    ("histogram_reviewer_rating", _VF, "vf", _vf, "avg_rating", 1),
    ("histogram_product_rating", _PF, "pf", _pf, "avg_rating", 1),
    ("histogram_product_five_star", _PF, "pf", _pf, "five_star_ratio", 2),
]:
    register(
        _name,
        f"WITH {_with} SELECT {r6(f'round({_col}, {_digits})', 'bin')}, count(*)::BIGINT AS n FROM {_tbl} GROUP BY 1",
    )(lambda spark, d, make=_make, col=_col, digits=_digits: eda.rounded_histogram(make(spark, d), col, digits))


def _corr_sql(with_, tbl, columns, where=""):
    def one(a, b):
        r = f"corr({a}::DOUBLE, {b}::DOUBLE)"
        return f"""SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END)::BIGINT AS n,
 {r6(f'CASE WHEN isnan({r}) THEN NULL ELSE {r} END', 'r')} FROM {tbl}"""

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return f"WITH {with_} SELECT * FROM (" + " UNION ALL ".join(one(a, b) for a, b in pairs) + f") {where}"


_VCOLS = [c for c in REVIEWER_NUMERIC if c != "rating_variance"]


@register("pearson_review_features", _corr_sql(_RF, "rf", REVIEW_NUMERIC))
def _(spark, d):
    return eda.pearson(_rf(spark, d, REVIEW_NUMERIC), REVIEW_NUMERIC)


@register("pearson_reviewer_features", _corr_sql(_VF, "vf", _VCOLS))
def _(spark, d):
    return eda.pearson(_vf(spark, d), _VCOLS)


@register("pearson_product_features", _corr_sql(_PF, "pf", PRODUCT_NUMERIC))
def _(spark, d):
    return eda.pearson(_pf(spark, d), PRODUCT_NUMERIC)


@register("pearson_high_pairs", _corr_sql(_PF, "pf", PRODUCT_NUMERIC, "WHERE abs(r) >= 0.8"))
def _(spark, d):
    return eda.high_pairs(eda.pearson(_pf(spark, d), PRODUCT_NUMERIC))


def _spearman_sql(with_, tbl, columns, where=""):
    def one(a, b):
        return f"""SELECT '{a}' AS a, '{b}' AS b, count(*)::BIGINT AS n, corr(x, y) AS c FROM (SELECT
 rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS x,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS y
 FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    body = " UNION ALL ".join(one(a, b) for a, b in pairs)
    return f"""WITH {with_}, t AS MATERIALIZED (SELECT {", ".join(f"round({c}::DOUBLE, 9) AS {c}" for c in columns)} FROM {tbl})
 SELECT a, b, n, {r6('CASE WHEN isnan(c) THEN NULL ELSE c END', 'r')} FROM ({body}) {where}"""


@register("spearman_reviewer_features", _spearman_sql(_VF, "vf", REVIEWER_RANKED))
def _(spark, d):
    return eda.spearman(_vf(spark, d), REVIEWER_RANKED)


@register("spearman_product_features", _spearman_sql(_PF, "pf", PRODUCT_RANKED))
def _(spark, d):
    return eda.spearman(_pf(spark, d), PRODUCT_RANKED)


@register("spearman_high_pairs", _spearman_sql(_VF, "vf", REVIEWER_RANKED, "WHERE abs(c) >= 0.8"))
def _(spark, d):
    return eda.high_pairs(eda.spearman(_vf(spark, d), REVIEWER_RANKED))
