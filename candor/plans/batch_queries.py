"""Queries of the batch half: cleaning, de-duplication, feature tables, validation, labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candor.fixed_values import METRIC_KEYS
from candor.operators import features
from candor.operators.cleaning import clean_labelled, clean_reviews
from candor.plans.catalog import big, r6, register
from candor.plans.views import CLEANED_SQL, REVIEWS_SQL, raw_reviews, reviews
from candor.session import ensure_checkpoint_dir, stored

# ---- Cleaning -----------------------------------------------------------------------------------


@register(
    "clean_reviews",
    f"""WITH {CLEANED_SQL} SELECT source_file, mongo_id, "reviewerID", asin, "reviewerName",
 {r6('helpful_votes', 'helpful_votes')}, {r6('helpful_total', 'helpful_total')}, {r6('helpful_ratio', 'helpful_ratio')},
 "reviewText", {big('text_length', 'text_length')}, {big('text_missing', 'text_missing')},
 {big('text_very_short', 'text_very_short')}, summary, {big('summary_missing', 'summary_missing')},
 {r6('overall', 'overall')}, {r6('rating_polarity', 'rating_polarity')}, {r6('"unixReviewTime"', '"unixReviewTime"')},
 review_datetime_utc, category, {r6('class_raw', 'class_raw')}, {big('class_missing', 'class_missing')}
 FROM cleaned""",
)
def _(spark, d):
    return clean_reviews(raw_reviews(spark, d)).drop("row_key_hash")


@register(
    "clean_labelled",
    f"""WITH {CLEANED_SQL} SELECT source_file, "reviewerID", asin, row_pos, {r6('candidate_label', 'candidate_label')},
 {", ".join(r6(f'"bfr_{k}"', f'"bfr_{k}"') for k in METRIC_KEYS)} FROM cleaned""",
)
def _(spark, d):
    return clean_labelled(raw_reviews(spark, d), ["row_pos"]).select(
        "source_file", "reviewerID", "asin", "row_pos", "candidate_label", *[f"bfr_{k}" for k in METRIC_KEYS]
    )


@register(
    "row_key_collisions",
    f"""WITH {CLEANED_SQL}, keys AS (SELECT count(*) AS n FROM
 (SELECT DISTINCT "reviewerID", asin, "unixReviewTime" FROM cleaned))
 SELECT {big('n', 'distinct_keys')}, {big('n', 'distinct_hashes')} FROM keys""",
)
def _(spark, d):
    rows = clean_reviews(raw_reviews(spark, d))
    keys = rows.select("reviewerID", "asin", "unixReviewTime", "row_key_hash").distinct()
    return keys.agg(
        F.count(F.lit(1)).alias("distinct_keys"), F.countDistinct("row_key_hash").alias("distinct_hashes")
    )


# ---- Feature tables -----------------------------------------------------------------------------

_DAY = '(max("unixReviewTime") - min("unixReviewTime")) / 86400.0'
REVIEWER_AGG_SQL = f"""rv AS (SELECT "reviewerID", count(*) AS review_count, count(DISTINCT asin) AS unique_products,
  count(DISTINCT category) AS unique_categories, avg(overall) AS avg_rating, stddev_samp(overall) AS rating_std,
  min(overall) AS rating_min, max(overall) AS rating_max, max(overall) - min(overall) AS rating_range,
  sum(CASE WHEN text_missing = 0 THEN 1 ELSE 0 END) AS review_text_count, avg(text_length) AS avg_review_length,
  median(text_length) AS median_review_length, sum(helpful_votes) AS helpful_votes_total,
  min("unixReviewTime") AS first_review_unix, max("unixReviewTime") AS last_review_unix,
  min(review_datetime_utc) AS first_review_time, max(review_datetime_utc) AS last_review_time,
  {_DAY} AS review_span_days,
  {", ".join(f"sum(CASE WHEN overall = {s} THEN 1 ELSE 0 END) AS n_rating_{s}" for s in range(1, 6))}
 FROM reviews GROUP BY "reviewerID")"""

_REVIEWER_COLS = f""""reviewerID", {big('review_count', 'review_count')}, {big('unique_products', 'unique_products')},
 {big('unique_categories', 'unique_categories')}, {r6('avg_rating', 'avg_rating')}, {r6('rating_std', 'rating_std')},
 {r6('rating_min', 'rating_min')}, {r6('rating_max', 'rating_max')}, {r6('rating_range', 'rating_range')},
 {big('review_text_count', 'review_text_count')}, {r6('avg_review_length', 'avg_review_length')},
 {r6('median_review_length', 'median_review_length')}, {r6('helpful_votes_total', 'helpful_votes_total')},
 {r6('first_review_unix', 'first_review_unix')}, {r6('last_review_unix', 'last_review_unix')},
 first_review_time, last_review_time, {r6('review_span_days', 'review_span_days')}"""


def entropy_sql(shares: list[str]) -> str:
    terms = [f"CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END" for p in shares]
    return "0.0 - (" + " + ".join(terms) + ")"


_SHARES = [f"(n_rating_{s}::DOUBLE / review_count)" for s in range(1, 6)]
REVIEWER_FEATURES_SQL = f"""vf AS (SELECT *, rating_std * rating_std AS rating_variance,
  helpful_votes_total / review_count AS average_helpfulness_per_review,
  review_span_days + 1 AS inclusive_active_days, review_count / (review_span_days + 1) AS reviews_per_active_day,
  unique_products::DOUBLE / unique_categories AS products_per_category,
  n_rating_5::DOUBLE / review_count AS five_star_ratio, n_rating_1::DOUBLE / review_count AS one_star_ratio,
  (n_rating_1 + n_rating_5)::DOUBLE / review_count AS extreme_rating_ratio,
  {entropy_sql(_SHARES)} AS rating_entropy FROM rv)"""


@register("reviewer_aggregate", f"WITH {REVIEWS_SQL}, {REVIEWER_AGG_SQL} SELECT {_REVIEWER_COLS} FROM rv")
def _(spark, d):
    return features.reviewer_aggregate(reviews(spark, d))


@register(
    "reviewer_features",
    f"""WITH {REVIEWS_SQL}, {REVIEWER_AGG_SQL}, {REVIEWER_FEATURES_SQL} SELECT {_REVIEWER_COLS},
 {", ".join(big(f'n_rating_{s}', f'n_rating_{s}') for s in range(1, 6))},
 {", ".join(r6(c, c) for c in ['rating_variance', 'average_helpfulness_per_review', 'inclusive_active_days',
   'reviews_per_active_day', 'products_per_category', 'five_star_ratio', 'one_star_ratio', 'extreme_rating_ratio',
   'rating_entropy'])} FROM vf""",
)
def _(spark, d):
    return features.reviewer_features(reviews(spark, d))


REVIEW_FEATURES_SQL = """rf AS (SELECT mongo_id AS review_id, b."reviewerID", b.asin, category, overall AS rating,
  helpful_votes, helpful_total, helpful_ratio, text_length AS review_length_chars,
  CASE WHEN text_missing = 1 THEN 0 ELSE len(regexp_split_to_array(trim("reviewText"), '[\\t\\n\\f\\r ]+')) END
   AS review_length_words,
  CASE WHEN summary_missing = 1 THEN 0 ELSE length(summary) END AS summary_length,
  text_missing = 0 AS text_available, summary_missing = 0 AS summary_available, text_very_short, "unixReviewTime",
  review_datetime_utc, year(review_datetime_utc) AS review_year, month(review_datetime_utc) AS review_month,
  dayofweek(review_datetime_utc) AS review_day_of_week, hour(review_datetime_utc) AS review_hour,
  overall - pm AS product_rating_deviation, overall - rm AS reviewer_rating_deviation,
  coalesce(copies, 1) AS exact_text_copy_count, coalesce(copies, 1) > 1 AS is_exact_duplicate_text
 FROM reviews b
 LEFT JOIN (SELECT asin, avg(overall) AS pm FROM reviews GROUP BY asin) p ON b.asin = p.asin
 LEFT JOIN (SELECT "reviewerID", avg(overall) AS rm FROM reviews GROUP BY 1) r ON b."reviewerID" = r."reviewerID"
 LEFT JOIN (SELECT "reviewText" AS t, count(*) AS copies FROM reviews WHERE "reviewText" IS NOT NULL GROUP BY 1) c
   ON b."reviewText" = c.t)"""


@register(
    "review_features",
    f"""WITH {REVIEWS_SQL}, {REVIEW_FEATURES_SQL} SELECT review_id, "reviewerID", asin, category, {r6('rating', 'rating')},
 {r6('helpful_votes', 'helpful_votes')}, {r6('helpful_total', 'helpful_total')}, {r6('helpful_ratio', 'helpful_ratio')},
 {", ".join(big(c, c) for c in ['review_length_chars', 'review_length_words', 'summary_length', 'text_very_short',
   'review_year', 'review_month', 'review_day_of_week', 'review_hour', 'exact_text_copy_count'])},
 text_available, summary_available, {r6('"unixReviewTime"', '"unixReviewTime"')}, review_datetime_utc,
 {r6('product_rating_deviation', 'product_rating_deviation')},
 {r6('reviewer_rating_deviation', 'reviewer_rating_deviation')}, is_exact_duplicate_text FROM rf""",
)
def _(spark, d):
    return features.review_features(reviews(spark, d))


@register(
    "leave_one_out_deviation",
    f"""WITH {REVIEWS_SQL}, s AS (SELECT asin, sum(overall) AS t, count(overall) AS n FROM reviews GROUP BY asin)
 SELECT mongo_id AS review_id, "reviewerID", r.asin,
 {r6('overall - CASE WHEN n > 1 THEN (t - overall) / (n - 1) END', 'loo_rating_deviation')}
 FROM reviews r JOIN s ON r.asin = s.asin""",
)
def _(spark, d):
    return features.leave_one_out_deviation(reviews(spark, d))


_PSHARES = [f"(sum(CASE WHEN overall = {s} THEN 1 ELSE 0 END)::DOUBLE / count(*))" for s in range(1, 6)]
PRODUCT_FEATURES_SQL = f"""pf AS (SELECT asin, count(*) AS review_count, count(DISTINCT b."reviewerID") AS unique_reviewers,
  count(DISTINCT category) AS n_categories, min(category) AS category, avg(overall) AS avg_rating,
  stddev_samp(overall) AS rating_std, min(overall) AS rating_min, max(overall) AS rating_max,
  max(overall) - min(overall) AS rating_range, {_PSHARES[4]} AS five_star_ratio, {_PSHARES[3]} AS four_star_ratio,
  {_PSHARES[2]} AS three_star_ratio, {_PSHARES[1]} AS two_star_ratio, {_PSHARES[0]} AS one_star_ratio,
  {entropy_sql(_PSHARES)} AS rating_entropy, avg(helpful_votes) AS avg_helpful_votes,
  avg(CASE WHEN text_missing = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS review_text_coverage,
  min("unixReviewTime") AS first_review_unix, max("unixReviewTime") AS last_review_unix, {_DAY} AS review_span_days,
  count(*) / ({_DAY} + 1) AS review_velocity, avg(rc) AS avg_reviewer_review_count,
  avg(up) AS avg_reviewer_product_diversity, avg(rs) AS avg_reviewer_rating_variability
 FROM reviews b LEFT JOIN (SELECT "reviewerID", count(*) AS rc, count(DISTINCT asin) AS up,
   stddev_samp(overall) AS rs FROM reviews GROUP BY 1) v ON b."reviewerID" = v."reviewerID" GROUP BY asin)"""
_PRODUCT_DOUBLES = [
    "avg_rating", "rating_std", "rating_min", "rating_max", "rating_range", "five_star_ratio", "four_star_ratio",
    "three_star_ratio", "two_star_ratio", "one_star_ratio", "rating_entropy", "avg_helpful_votes",
    "review_text_coverage", "first_review_unix", "last_review_unix", "review_span_days", "review_velocity",
    "avg_reviewer_review_count", "avg_reviewer_product_diversity", "avg_reviewer_rating_variability",
]


@register(
    "product_features",
    f"""WITH {REVIEWS_SQL}, {PRODUCT_FEATURES_SQL} SELECT asin, category, {big('review_count', 'review_count')},
 {big('unique_reviewers', 'unique_reviewers')}, {big('n_categories', 'n_categories')},
 {", ".join(r6(c, c) for c in _PRODUCT_DOUBLES)} FROM pf""",
)
def _(spark, d):
    return features.product_features(reviews(spark, d))


# ---- De-duplication and set operations ----------------------------------------------------------

from candor.operators import dedup, labels, validation  # noqa: E402
from candor.plans.views import RAW_SQL  # noqa: E402

_KEY = '"reviewerID", asin, "unixReviewTime"'
KEPT_SQL = f"""kept AS (SELECT * FROM cleaned QUALIFY row_number() OVER
 (PARTITION BY {_KEY} ORDER BY source_rank, row_pos) = 1)"""


def _cleaned(spark, d):
    return clean_labelled(raw_reviews(spark, d), ["source_rank", "row_pos"])


def _kept(spark, d):
    return dedup.keep_first(_cleaned(spark, d), dedup.REVIEW_KEY, ["source_rank", "row_pos"])


@register(
    "keep_first_across_files",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL} SELECT source_file, row_pos, "reviewerID", asin,
 {r6('"unixReviewTime"', '"unixReviewTime"')} FROM kept""",
)
def _(spark, d):
    return _kept(spark, d).select("source_file", "row_pos", "reviewerID", "asin", "unixReviewTime")


@register(
    "keep_first_in_one_file",
    f"""WITH {CLEANED_SQL}, one AS (SELECT "reviewerID", category, row_pos FROM cleaned WHERE source_file = 'N.csv'
  QUALIFY row_number() OVER (PARTITION BY "reviewerID", category ORDER BY row_pos) = 1)
 SELECT * FROM one""",
)
def _(spark, d):
    one = _cleaned(spark, d).filter("source_file = 'N.csv'").select("reviewerID", "category", "row_pos")
    return dedup.keep_first(one, ["reviewerID", "category"], ["row_pos"])


@register(
    "keep_first_in_each_file",
    f"""WITH {CLEANED_SQL} SELECT source_file, "reviewerID", category, row_pos FROM cleaned
 QUALIFY row_number() OVER (PARTITION BY source_file, "reviewerID", category ORDER BY row_pos) = 1""",
)
def _(spark, d):
    rows = _cleaned(spark, d).select("source_file", "reviewerID", "category", "row_pos")
    return dedup.keep_first(rows, ["source_file", "reviewerID", "category"], ["row_pos"])


@register(
    "dropped_rows",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL} SELECT a.source_file, {big('a.n', 'rows_read')}, {big('b.n', 'rows_kept')},
 {big('a.n - b.n', 'rows_dropped')} FROM (SELECT source_file, count(*) AS n FROM cleaned GROUP BY 1) a
 JOIN (SELECT source_file, count(*) AS n FROM kept GROUP BY 1) b ON a.source_file = b.source_file""",
)
def _(spark, d):
    return dedup.dropped_counts(_cleaned(spark, d), _kept(spark, d))


@register(
    "sample_per_source",
    f"""WITH {CLEANED_SQL} SELECT source_file, row_pos, "reviewerID", asin FROM cleaned
 QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY row_pos) <= 1500""",
)
def _(spark, d):
    rows = _cleaned(spark, d).select("source_file", "row_pos", "reviewerID", "asin")
    return dedup.first_rows(rows, ["source_file"], ["row_pos"], 1500)


@register(
    "union_of_samples",
    f"""WITH {CLEANED_SQL}, s AS (SELECT source_file, row_pos, "reviewerID" FROM cleaned
  QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY row_pos) <= 800)
 SELECT * FROM s WHERE source_file <> 'N.csv' UNION ALL SELECT * FROM s WHERE source_file = 'N.csv'""",
)
def _(spark, d):
    rows = _cleaned(spark, d).select("source_file", "row_pos", "reviewerID")
    parts = [
        dedup.first_rows(rows.filter(F.col("source_file") == s), ["source_file"], ["row_pos"], 800)
        for s in ("A.csv", "N.csv", "R.csv")
    ]
    return dedup.union_all(parts)


@register(
    "common_keys",
    f"""WITH {CLEANED_SQL} SELECT "reviewerID", asin FROM cleaned WHERE source_file = 'A.csv'
 INTERSECT SELECT "reviewerID", asin FROM cleaned WHERE source_file = 'N.csv'""",
)
def _(spark, d):
    rows = _cleaned(spark, d)
    return dedup.common_keys(
        rows.filter("source_file = 'A.csv'"), rows.filter("source_file = 'N.csv'"), ["reviewerID", "asin"]
    )


@register(
    "uniform_sample_size",
    f"""WITH {REVIEWS_SQL} SELECT least(count(*), 5000)::BIGINT AS n, least(count(*), 5000)::BIGINT AS n_distinct
 FROM reviews""",
)
def _(spark, d):
    sample = dedup.uniform_sample(reviews(spark, d).select("mongo_id"), 5000, ["mongo_id"])
    return sample.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mongo_id").alias("n_distinct"))


@register("uniform_sample")
def _(spark, d):
    return dedup.uniform_sample(reviews(spark, d).select("mongo_id", "asin", "overall"), 5000, ["mongo_id"])


# ---- Sinks' column sets and manifests -----------------------------------------------------------


@register(
    "run_manifest",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL}, a AS (SELECT source_file, count(*) AS n, sum(text_missing) AS tm,
  sum(text_very_short) AS ts FROM cleaned GROUP BY 1), b AS (SELECT source_file, count(*) AS n FROM kept GROUP BY 1)
 SELECT a.source_file, {big('a.n', 'rows_read')}, {big('a.n', 'rows_written')}, {big('b.n', 'rows_kept')},
 {big('a.n - b.n', 'rows_dropped')}, {big('tm', 'text_missing')}, {big('ts', 'text_very_short')}
 FROM a JOIN b ON a.source_file = b.source_file""",
)
def _(spark, d):
    from candor.sources.sinks import run_manifest

    return run_manifest(_cleaned(spark, d), _kept(spark, d))


_WRITTEN = {
    "source_file": "string", "reviewerID": "string", "asin": "string", "overall": "double", "summary": "string",
    "unixReviewTime": "double", "category": "string", "text_missing": "tinyint", "text_very_short": "tinyint",
}


def _written_sql():
    rows = ["SELECT 'rows' AS kind, 'written' AS name, NULL::VARCHAR AS type, count(*)::BIGINT AS n, TRUE AS timed FROM cleaned"]
    rows += [f"""SELECT 'column', '{c}', '{t}', (count(*) - count("{c}"))::BIGINT, FALSE FROM cleaned""" for c, t in _WRITTEN.items()]
    rows += [f"SELECT 'issue', '{c}', NULL, (count(*) FILTER (WHERE {c} = 1))::BIGINT, FALSE FROM cleaned"
             for c in ("text_missing", "text_very_short")]
    return f"WITH {CLEANED_SQL} " + " UNION ALL ".join(rows)


@register("written_manifest", _written_sql())
def _(spark, d):
    from candor.sources import sinks

    base = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    issues = {c: F.col(c) == 1 for c in ("text_missing", "text_very_short")}
    figures = sinks.write_observed(_cleaned(spark, d).select(*_WRITTEN), f"{base}/rows", issues)
    sinks.write_manifest(figures, f"{base}/manifest")
    return spark.read.schema(sinks.STEP_MANIFEST).json(f"{base}/manifest").select(
        "kind", "name", "type", "n", (F.coalesce(F.col("seconds"), F.lit(0.0)) > 0).alias("timed"))


@register(
    "row_count_from_footer",
    "SELECT count(*)::BIGINT AS n FROM lineitem",
)
def _(spark, d):
    from candor.sources.tables import row_count

    return row_count(spark, f"{d}/lineitem.parquet")


@register(
    "analysis_rows",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL} SELECT source_file, "reviewerID", asin, {r6('helpful_ratio', 'helpful_ratio')},
 "reviewText", {big('text_length', 'text_length')}, {r6('overall', 'overall')}, {r6('class_raw', 'class_raw')},
 {r6('candidate_label', 'candidate_label')}, {r6('"bfr_CS"', '"bfr_CS"')}, {r6('"bfr_PC"', '"bfr_PC"')} FROM kept""",
)
def _(spark, d):
    from candor.sources.sinks import analysis_rows

    return analysis_rows(_kept(spark, d)).select(
        "source_file", "reviewerID", "asin", "helpful_ratio", "reviewText", "text_length", "overall", "class_raw",
        "candidate_label", "bfr_CS", "bfr_PC",
    )


@register(
    "ml_rows",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL} SELECT "reviewerID", asin, category, {r6('overall', 'overall')},
 {r6('helpful_votes', 'helpful_votes')}, {r6('helpful_total', 'helpful_total')}, {r6('helpful_ratio', 'helpful_ratio')},
 "reviewText", {big('text_length', 'text_length')}, {big('text_missing', 'text_missing')},
 {big('text_very_short', 'text_very_short')}, summary, {r6('"unixReviewTime"', '"unixReviewTime"')},
 review_datetime_utc, {r6('candidate_label', 'candidate_label')} FROM kept""",
)
def _(spark, d):
    from candor.sources.sinks import ml_rows

    return ml_rows(_kept(spark, d))


# ---- Label statistics ---------------------------------------------------------------------------

_ALL_METRICS = ["overall", *labels.METRICS]


@register(
    "label_counts",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL}, c AS (SELECT count(*) FILTER (WHERE candidate_label = 0) AS a,
  count(*) FILTER (WHERE candidate_label = 1) AS b, count(*) AS n FROM kept)
 SELECT {big('a', 'n_label0')}, {big('b', 'n_label1')}, {big('n - a - b', 'n_invalid')},
 {r6('b::DOUBLE / (a + b)', 'positive_rate')} FROM c""",
)
def _(spark, d):
    return labels.label_counts(_kept(spark, d))


@register(
    "class_by_label",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL} SELECT {r6('coalesce(class_raw, -1)', 'class_raw')},
 {r6('candidate_label', 'candidate_label')}, count(*)::BIGINT AS n FROM kept GROUP BY ALL""",
)
def _(spark, d):
    return labels.cross_tab(_kept(spark, d), "class_raw", missing=-1.0)


@register(
    "rating_by_label",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL} SELECT {r6('overall', 'overall')}, {r6('candidate_label', 'candidate_label')},
 count(*)::BIGINT AS n FROM kept GROUP BY ALL""",
)
def _(spark, d):
    return labels.cross_tab(_kept(spark, d), "overall")


def _long_sql(columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS metric, \"{c}\" AS v, candidate_label AS y FROM kept" for c in columns
    )


@register(
    "metric_means_by_label",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL}, l AS ({_long_sql(labels.METRICS)})
 SELECT metric, count(v) FILTER (WHERE y = 0)::BIGINT AS n_label0, count(v) FILTER (WHERE y = 1)::BIGINT AS n_label1,
 {r6('avg(v) FILTER (WHERE y = 0)', 'mean_label0')}, {r6('avg(v) FILTER (WHERE y = 1)', 'mean_label1')},
 {r6('avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0)', 'mean_diff')} FROM l GROUP BY metric""",
)
def _(spark, d):
    return labels.metric_means(_kept(spark, d), labels.METRICS)


@register(
    "label_auc",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL}, l AS ({_long_sql(_ALL_METRICS)}),
 r AS (SELECT metric, y, rank() OVER (PARTITION BY metric ORDER BY v)
   + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0::DOUBLE AS rk FROM l WHERE v IS NOT NULL AND y IN (0, 1)),
 s AS (SELECT metric, sum(rk) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS p,
   count(*) FILTER (WHERE y = 0) AS n FROM r GROUP BY metric)
 SELECT metric, {r6('(rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n)', 'auc')}, {big('p', 'n_pos')}, {big('n', 'n_neg')}
 FROM s""",
)
def _(spark, d):
    return labels.rank_auc(_kept(spark, d), _ALL_METRICS)


_MEANS = ["overall", "text_length", "helpful_votes", "bfr_CS", "bfr_MNR", "bfr_RB", "bfr_NR", "class_raw"]


@register(
    "means_by_label",
    f"""WITH {CLEANED_SQL}, {KEPT_SQL} SELECT {r6('candidate_label', 'candidate_label')}, count(*)::BIGINT AS n,
 {", ".join(r6(f'avg("{c}")', f'"avg_{c}"') for c in _MEANS)} FROM kept GROUP BY candidate_label""",
)
def _(spark, d):
    return labels.means_by_label(_kept(spark, d), _MEANS)


@register(
    "labelled_documents_auc",
    f"""WITH l AS (SELECT 'n_chars' AS metric, n_chars::DOUBLE AS v, quality AS y FROM documents JOIN labels USING (doc_id)
   UNION ALL SELECT 'toxic', toxic::DOUBLE, quality FROM labels JOIN documents USING (doc_id)),
 r AS (SELECT metric, y, rank() OVER (PARTITION BY metric ORDER BY v)
   + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0::DOUBLE AS rk FROM l),
 s AS (SELECT metric, sum(rk) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS p,
   count(*) FILTER (WHERE y = 0) AS n FROM r GROUP BY metric)
 SELECT metric, {r6('(rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n)', 'auc')}, {big('p', 'n_pos')}, {big('n', 'n_neg')}
 FROM s""",
)
def _(spark, d):
    from candor.plans.views import table

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return labels.rank_auc(rows.select("n_chars", "toxic", F.col("quality").cast("double").alias("y")), ["n_chars", "toxic"], "y")


# ---- Validation ---------------------------------------------------------------------------------


def _checks_sql(name, table_name, key, finite, extra):
    bad = " + ".join(f"sum(CASE WHEN isnan({c}::DOUBLE) OR isinf({c}::DOUBLE) THEN 1 ELSE 0 END)" for c in finite)
    checks = {
        "n": "count(*)", "n_distinct_key": f"count(DISTINCT {key})", "null_key": f"count(*) FILTER (WHERE {key} IS NULL)",
        "inf_or_nan": bad, "duplicate_keys": f"count(*) - count(DISTINCT {key})", **extra,
    }
    wide = ", ".join(f"({v})::BIGINT AS {k}" for k, v in checks.items())
    return f"(SELECT '{name}' AS \"table\", \"check\", hits FROM (UNPIVOT (SELECT {wide} FROM {table_name}) ON COLUMNS(*) INTO NAME \"check\" VALUE hits))"


_STD = {
    "neg_span": "count(*) FILTER (WHERE review_span_days < 0)",
    "null_std": "count(*) FILTER (WHERE rating_std IS NULL)",
    "null_std_n1": "count(*) FILTER (WHERE rating_std IS NULL AND review_count = 1)",
    "null_std_n_gt1": "count(*) FILTER (WHERE rating_std IS NULL AND review_count > 1)",
    "rating_oob": "count(*) FILTER (WHERE avg_rating < 1 OR avg_rating > 5)",
    "min_n": "min(review_count)", "max_n": "max(review_count)",
}
_REVIEW_CHECKS = _checks_sql(
    "review", "rf", "review_id", ["rating", "helpful_ratio", "product_rating_deviation", "reviewer_rating_deviation"],
    {
        "min_rating": "min(rating)", "max_rating": "max(rating)",
        "rating_oob": "count(*) FILTER (WHERE rating < 1 OR rating > 5)",
        "neg_len": "count(*) FILTER (WHERE review_length_chars < 0)",
        "bad_dup_count": "count(*) FILTER (WHERE exact_text_copy_count < 1)",
        "nonzero_hour": "count(*) FILTER (WHERE review_hour <> 0)",
    },
)
_REVIEWER_CHECKS = _checks_sql(
    "reviewer", "vf", '"reviewerID"', ["avg_rating", "rating_variance", "reviews_per_active_day", "rating_entropy"], _STD
)
_PRODUCT_CHECKS = _checks_sql(
    "product", "pf", "asin", ["avg_rating", "review_velocity", "rating_entropy", "avg_reviewer_rating_variability"], _STD
)
_ALL_TABLES = f"{REVIEWS_SQL}, {REVIEWER_AGG_SQL}, {REVIEWER_FEATURES_SQL}, {REVIEW_FEATURES_SQL}, {PRODUCT_FEATURES_SQL}"


def _all_checks(spark, d):
    r = reviews(spark, d)
    tables = {"review": features.review_features(r), "reviewer": features.reviewer_features(r), "product": features.product_features(r)}
    # One table's checks after the other's: the shuffles of one are gone when the next begins.
    return dedup.union_all([stored(validation.table_checks(t, name), f"checks-{name}") for name, t in tables.items()])


@register(
    "validate_review_features",
    f"WITH {REVIEWS_SQL}, {REVIEW_FEATURES_SQL} SELECT * FROM {_REVIEW_CHECKS}",
)
def _(spark, d):
    return validation.table_checks(features.review_features(reviews(spark, d)), "review")


@register(
    "validate_reviewer_features",
    f"WITH {REVIEWS_SQL}, {REVIEWER_AGG_SQL}, {REVIEWER_FEATURES_SQL} SELECT * FROM {_REVIEWER_CHECKS}",
)
def _(spark, d):
    return validation.table_checks(features.reviewer_features(reviews(spark, d)), "reviewer")


@register(
    "validate_product_features",
    f"WITH {REVIEWS_SQL}, {PRODUCT_FEATURES_SQL} SELECT * FROM {_PRODUCT_CHECKS}",
)
def _(spark, d):
    return validation.table_checks(features.product_features(reviews(spark, d)), "product")


@register(
    "failed_checks",
    f"""WITH {_ALL_TABLES}, c AS (SELECT * FROM {_REVIEW_CHECKS} UNION ALL SELECT * FROM {_REVIEWER_CHECKS}
  UNION ALL SELECT * FROM {_PRODUCT_CHECKS})
 SELECT * FROM c WHERE hits > 0 AND "check" IN ('duplicate_keys', 'null_key', 'rating_oob', 'neg_span',
  'null_std_n_gt1', 'nonzero_hour', 'inf_or_nan')""",
)
def _(spark, d):
    return validation.failed_checks(_all_checks(spark, d))


@register(
    "reviewer_null_checks",
    f"""WITH {REVIEWS_SQL}, {REVIEWER_AGG_SQL} SELECT
 count(*) FILTER (WHERE "reviewerID" IS NULL)::BIGINT AS "null_reviewerID",
 count(*) FILTER (WHERE review_count IS NULL OR review_count < 1)::BIGINT AS bad_review_count,
 count(*) FILTER (WHERE unique_products IS NULL)::BIGINT AS null_unique_products,
 count(*) FILTER (WHERE avg_rating IS NULL)::BIGINT AS null_avg_rating,
 count(*) FILTER (WHERE rating_std IS NULL)::BIGINT AS null_rating_std,
 count(*) FILTER (WHERE review_span_days < 0)::BIGINT AS negative_span FROM rv""",
)
def _(spark, d):
    return validation.reviewer_null_checks(features.reviewer_aggregate(reviews(spark, d)))
