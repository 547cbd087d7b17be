"""Queries of the data-quality audit, on the raw string rows."""

from __future__ import annotations

from candor.operators import audit
from candor.plans.catalog import big, r6, register
from candor.plans.views import RAW_SQL, raw_reviews

_CELLS = {
    "_id": "raw_id", "reviewerID": '"reviewerID"', "asin": "asin", "reviewerName": "raw_name", "helpful": "raw_helpful",
    "reviewText": "raw_text", "overall": "raw_overall", "summary": "raw_summary", "unixReviewTime": "raw_unix",
    "reviewTime": "raw_time", "category": "category", "class": "raw_class", "label": "raw_label",
}


def _trim(c):
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"


def _missing(c):
    return f"(coalesce(lower({_trim(c)}) IN ('', 'nan', 'none', 'null'), TRUE))"


def _num(c):
    t = _trim(c)
    return f"(CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({t} AS DOUBLE) END)"


def _union(columns, body):
    return " UNION ALL ".join(body(c) for c in columns)


@register(
    "audit_missing",
    f"WITH {RAW_SQL} " + _union(_CELLS, lambda c: f"""SELECT source_file, '{c}' AS "column", count(*)::BIGINT AS n_rows,
 sum(CASE WHEN {_missing(_CELLS[c])} THEN 1 ELSE 0 END)::BIGINT AS missing,
 {r6(f'100.0::DOUBLE * sum(CASE WHEN {_missing(_CELLS[c])} THEN 1 ELSE 0 END) / count(*)', 'pct')}
 FROM raw GROUP BY source_file"""),
)
def _(spark, d):
    return audit.missing_profile(raw_reviews(spark, d), list(_CELLS))


@register(
    "audit_empty_rows",
    f"""WITH {RAW_SQL} SELECT source_file, sum(CASE WHEN {" AND ".join(_missing(_CELLS[c]) for c in
 ('helpful', 'overall', 'class'))} THEN 1 ELSE 0 END)::BIGINT AS empty_rows FROM raw GROUP BY source_file""",
)
def _(spark, d):
    return audit.empty_rows(raw_reviews(spark, d), ["helpful", "overall", "class"])


_LOW = ["overall", "class", "label", "category"]


@register(
    "audit_value_counts",
    f"""WITH {RAW_SQL}, c AS ({_union(_LOW, lambda c: f'''SELECT source_file, '{c}' AS "column",
  coalesce({_trim(_CELLS[c])}, '') AS value FROM raw''')}), n AS (SELECT source_file, "column", value, count(*) AS n
  FROM c GROUP BY ALL) SELECT source_file, "column", value, {big('n', 'n')} FROM n""",
)
def _(spark, d):
    return audit.value_counts(raw_reviews(spark, d), _LOW)


_NUM = ["overall", "unixReviewTime", "class", "label"]


@register(
    "audit_numeric",
    f"""WITH {RAW_SQL}, c AS ({_union(_NUM, lambda c: f'''SELECT source_file, '{c}' AS "column", {_num(_CELLS[c])} AS v,
  {_missing(_CELLS[c])} AS miss FROM raw''')}) SELECT source_file, "column", {r6('min(v)', '"min"')},
 {r6('max(v)', '"max"')}, {r6('avg(v)', 'mean')}, {r6('stddev_pop(v)', 'std')}, count(v)::BIGINT AS n,
 count(*) FILTER (WHERE v IS NULL AND NOT miss)::BIGINT AS non_numeric FROM c GROUP BY ALL""",
)
def _(spark, d):
    return audit.numeric_profile(raw_reviews(spark, d), _NUM)


@register(
    "audit_rating_domain",
    f"""WITH {RAW_SQL} SELECT source_file, count(*) FILTER (WHERE overall < 1 OR overall > 5)::BIGINT AS not_1_to_5,
 count(*) FILTER (WHERE overall <> round(overall))::BIGINT AS non_integer FROM raw GROUP BY source_file""",
)
def _(spark, d):
    return audit.rating_domain(raw_reviews(spark, d))


@register(
    "audit_unix_time",
    f"""WITH {RAW_SQL}, v AS (SELECT source_file, "unixReviewTime" AS u, {_missing('raw_unix')} AS miss FROM raw)
 SELECT source_file, count(*) FILTER (WHERE u < 788918400 OR u > 1577836800 OR (u IS NULL AND NOT miss))::BIGINT
  AS implausible, strftime(make_timestamp((min(u) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S+00:00') AS min_iso,
 strftime(make_timestamp((max(u) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S+00:00') AS max_iso FROM v GROUP BY source_file""",
)
def _(spark, d):
    return audit.unix_plausibility(raw_reviews(spark, d))


@register(
    "audit_dates",
    f"""WITH {RAW_SQL}, v AS (SELECT source_file, try_strptime(raw_time, '%m %d, %Y') AS t, {_missing('raw_time')} AS miss,
  make_timestamp(("unixReviewTime" * 1000000)::BIGINT) AS u FROM raw)
 SELECT source_file, count(*) FILTER (WHERE t IS NULL AND NOT miss)::BIGINT AS unparseable,
 count(*) FILTER (WHERE t::DATE <> u::DATE)::BIGINT AS day_mismatch FROM v GROUP BY source_file""",
)
def _(spark, d):
    return audit.date_check(raw_reviews(spark, d))


@register(
    "audit_text",
    f"""WITH {RAW_SQL}, v AS (SELECT *, CASE WHEN NOT {_missing('raw_text')} THEN length(raw_text) END AS size,
  {_missing('raw_summary')} AS no_summary FROM raw)
 SELECT source_file, count(size)::BIGINT AS n, min(size)::BIGINT AS "min", max(size)::BIGINT AS "max",
 {r6('avg(size)', 'mean')}, count(*) FILTER (WHERE size IS NULL)::BIGINT AS empty,
 count(*) FILTER (WHERE size < 5)::BIGINT AS very_short, count(*) FILTER (WHERE size > 5000)::BIGINT AS very_long,
 0::BIGINT AS whitespace_only, count(*) FILTER (WHERE contains(raw_text, chr(65533)))::BIGINT AS replacement_char_rows,
 count(*) FILTER (WHERE no_summary)::BIGINT AS summary_missing,
 count(*) FILTER (WHERE NOT no_summary)::BIGINT AS summary_present FROM v GROUP BY source_file""",
)
def _(spark, d):
    return audit.text_profile(raw_reviews(spark, d))


@register(
    "audit_document_text",
    """SELECT source AS source_file, count(*) FILTER (WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')::BIGINT AS n,
 max(length(text))::BIGINT AS "max", count(*) FILTER (WHERE length(text) > 5000)::BIGINT AS very_long,
 count(*) FILTER (WHERE contains(text, chr(65533)))::BIGINT AS replacement_char_rows FROM documents GROUP BY source""",
)
def _(spark, d):
    from pyspark.sql import functions as F

    from candor.plans.views import table

    docs = table(spark, d, "documents").select(
        F.col("source").alias("source_file"), F.col("text").alias("reviewText"), F.col("lang").alias("summary")
    )
    return audit.text_profile(docs).select("source_file", "n", "max", "very_long", "replacement_char_rows")


@register(
    "audit_helpful",
    f"""WITH {RAW_SQL}, v AS (SELECT source_file, {_missing('raw_helpful')} AS miss, helpful_votes AS a,
  helpful_total AS b FROM raw) SELECT source_file, count(*) FILTER (WHERE miss)::BIGINT AS missing,
 count(a)::BIGINT AS ok, count(*) FILTER (WHERE NOT miss AND a IS NULL)::BIGINT AS unparseable,
 count(*) FILTER (WHERE a < 0 OR b < 0)::BIGINT AS negative, count(*) FILTER (WHERE a > b)::BIGINT AS votes_gt_total,
 count(*) FILTER (WHERE a % 1 <> 0 OR b % 1 <> 0)::BIGINT AS non_integer, {r6('avg(a)', 'mean_votes')},
 {r6('avg(b)', 'mean_total')} FROM v GROUP BY source_file""",
)
def _(spark, d):
    return audit.helpful_quality(raw_reviews(spark, d))


@register(
    "audit_metric_status",
    f"""WITH {RAW_SQL} SELECT source_file, CASE raw_metrics WHEN '' THEN 'missing' WHEN '[1, 2]' THEN 'wrong_type'
  WHEN 'oops' THEN 'unparseable' ELSE 'ok' END AS status, count(*)::BIGINT AS n FROM raw GROUP BY ALL""",
)
def _(spark, d):
    return audit.metric_status(raw_reviews(spark, d))


@register(
    "audit_metric_keys",
    f"WITH {RAW_SQL} " + _union(["CS", "MNR", "RB", "RC", "PR", "NR", "FR", "RSP", "AW", "RD", "RL", "ER", "PC"], lambda k: f"""
 SELECT source_file, '{k}' AS key, count("bfr_{k}")::BIGINT AS n_keys, count("bfr_{k}")::BIGINT AS n,
 {r6(f'min("bfr_{k}")', '"min"')}, {r6(f'max("bfr_{k}")', '"max"')}, {r6(f'avg("bfr_{k}")', 'mean')}
 FROM raw GROUP BY source_file"""),
)
def _(spark, d):
    return audit.metric_key_profile(raw_reviews(spark, d))


_PAIRS = [("overall", "class"), ("overall", "label"), ("class", "label")]


@register(
    "audit_cross_tabs",
    f"""WITH {RAW_SQL}, c AS ({_union(_PAIRS, lambda p: f'''SELECT source_file, '{p[0]} x {p[1]}' AS pair,
  {_trim(_CELLS[p[0]])} AS a, {_trim(_CELLS[p[1]])} AS b FROM raw''')}), n AS (SELECT source_file, pair, a, b,
  count(*) AS n FROM c GROUP BY ALL) SELECT source_file, pair, a, b, {big('n', 'n')} FROM n""",
)
def _(spark, d):
    return audit.cross_tabs(raw_reviews(spark, d), _PAIRS)


@register(
    "audit_id_format",
    f"""WITH {RAW_SQL} SELECT source_file, count(*) FILTER (WHERE raw_id LIKE 'oid:%')::BIGINT AS mongo_oid_like,
 count(*) FILTER (WHERE raw_id NOT LIKE 'oid:%')::BIGINT AS plain_or_other FROM raw GROUP BY source_file""",
)
def _(spark, d):
    return audit.id_format(raw_reviews(spark, d))


@register(
    "audit_distinct",
    f"""WITH {RAW_SQL} SELECT source_file, count(DISTINCT "reviewerID")::BIGINT AS "reviewerID",
 count(DISTINCT asin)::BIGINT AS asin, count(DISTINCT raw_id)::BIGINT AS "_id" FROM raw GROUP BY source_file""",
)
def _(spark, d):
    return audit.distinct_counts(raw_reviews(spark, d), ["reviewerID", "asin", "_id"])


@register("audit_distinct_approximate")
def _(spark, d):
    return audit.distinct_counts(raw_reviews(spark, d), ["reviewerID", "asin", "_id"], approximate=True)


@register(
    "audit_duplicates",
    f"""WITH {RAW_SQL} SELECT source_file, (count(*) - count(DISTINCT raw_id))::BIGINT AS duplicate_id,
 (count(*) - count(DISTINCT "reviewerID" || '|' || asin || '|' || raw_unix))::BIGINT AS duplicate_triple,
 (count(*) - count(DISTINCT "reviewerID" || '|' || asin || '|' || coalesce(raw_text, '')))::BIGINT AS duplicate_text_pair,
 (count(*) - count(DISTINCT "reviewerID" || '|' || asin || '|' || raw_unix || '|' || coalesce(raw_text, '') || '|' ||
   raw_overall))::BIGINT AS duplicate_row FROM raw GROUP BY source_file""",
)
def _(spark, d):
    return audit.duplicate_hits(raw_reviews(spark, d))


def _per_value(b):
    return f"""per AS (SELECT source_file, {_trim('raw_overall')} AS a,
  count(DISTINCT CASE WHEN NOT {_missing(b)} THEN {_trim(b)} END) AS k FROM raw GROUP BY ALL)"""


@register(
    "audit_class_dependency",
    f"""WITH {RAW_SQL}, {_per_value('raw_class')} SELECT source_file, max(k) <= 1 AS deterministic,
 max(k)::BIGINT AS max_values FROM per GROUP BY source_file""",
)
def _(spark, d):
    return audit.functional_dependency(raw_reviews(spark, d))


@register(
    "audit_label_independence",
    f"""WITH {RAW_SQL}, {_per_value('raw_label')} SELECT source_file, count(*) FILTER (WHERE k > 1)::BIGINT AS mixed_values,
 count(*) FILTER (WHERE k > 1) >= 3 AS independent FROM per GROUP BY source_file""",
)
def _(spark, d):
    return audit.label_independence(raw_reviews(spark, d))


@register(
    "audit_class_rules",
    f"""WITH {RAW_SQL}, n AS (SELECT source_file, raw_overall AS a, raw_class AS b, count(*) AS n FROM raw
  WHERE NOT {_missing('raw_class')} GROUP BY ALL), t AS (SELECT * FROM n
  QUALIFY row_number() OVER (PARTITION BY source_file, a ORDER BY n DESC, b) = 1)
 SELECT DISTINCT source_file, {r6(_num('a'), 'value')}, (CASE WHEN b IN ('1', '1.0') THEN 1 ELSE 0 END)::BIGINT
  AS majority_class FROM t WHERE {_num('a')} IS NOT NULL""",
)
def _(spark, d):
    return audit.class_rules(raw_reviews(spark, d))


@register(
    "audit_file_overlap",
    f"""WITH {RAW_SQL}, k AS (SELECT DISTINCT source_file AS f, "reviewerID" || '|' || asin || '|' || raw_unix AS k FROM raw),
 s AS (SELECT f, count(*) AS n FROM k GROUP BY f),
 i AS (SELECT a.f AS fa, b.f AS fb, count(*) AS n FROM k a JOIN k b ON a.k = b.k AND a.f < b.f GROUP BY ALL)
 SELECT x.f AS file_a, y.f AS file_b, coalesce(i.n, 0)::BIGINT AS intersection, {big('x.n', 'len_a')}, {big('y.n', 'len_b')},
 {r6('100.0::DOUBLE * coalesce(i.n, 0) / x.n', 'pct_of_a')}, {r6('100.0::DOUBLE * coalesce(i.n, 0) / y.n', 'pct_of_b')}
 FROM s x JOIN s y ON x.f < y.f LEFT JOIN i ON i.fa = x.f AND i.fb = y.f""",
)
def _(spark, d):
    return audit.key_overlap(raw_reviews(spark, d), ["reviewerID", "asin", "unixReviewTime"])


@register(
    "audit_head",
    f"""WITH {RAW_SQL} SELECT source_file, row_pos, "reviewerID", raw_helpful AS helpful FROM raw
 QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY row_pos) <= 2""",
)
def _(spark, d):
    return audit.head_sample(raw_reviews(spark, d), ["row_pos"]).select("source_file", "row_pos", "reviewerID", "helpful")
