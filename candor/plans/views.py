"""Review-shaped views over the driver's tables, so every job runs on whole tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.fixed_values import LABEL_COLUMN, METRIC_COLUMN, METRIC_KEYS
from candor.session import tune

SOURCES = ["A.csv", "N.csv", "R.csv"]
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", "o_custkey", "o_orderpriority",
    "p_name", "p_type"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, read as it is."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a hash of `key`: the tables come as one row group each, and the views compute much per row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the order's customer and the part's name and type: one row per review."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])


def _variant() -> Column:
    return (F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % 12


def _planted() -> dict[int, Column]:
    """Long texts per product: notes that differ in one character (or its case), remarks just too far apart."""
    name, k = F.col("p_name"), F.col("l_orderkey")
    note = F.concat(F.lit("note on "), name, F.lit(": came well packed, simple to set up, still running after a month of use, grade "))
    remark = F.concat(F.lit("remark on "), name, F.lit(" from a long time owner of several such things, "))
    tail = F.repeat(F.element_at(F.array(F.lit("q"), F.lit("z"), F.lit("x")), (k % 3 + 1).cast("int")), F.ceil(F.length(remark) / 11).cast("int"))
    grade = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("A"), F.lit("c")), (k % 4 + 1).cast("int"))
    return {2: F.concat(note, grade), 3: F.concat(remark, tail)}


def _text(long: bool) -> Column:
    """Review texts. `long=False` keeps to a few phrases per product; only planted notes are near copies."""
    name, prio, v = F.col("p_name"), F.col("o_orderpriority"), _variant()
    texts = {
        1: F.lit("ok"),
        4: F.lit("great quality, works perfect and fast delivery"),
        5: F.lit("bad item: arrived broken and late"),
        6: F.lit("good price but slow and cheap"),
        7: F.concat(name, F.lit(" is excellent, I love it "), prio),
        8: F.concat(name, F.lit(" was a waste, want a refund "), prio),
        9: F.concat(name, F.lit(" "), prio, F.lit(" average thing for everyday use")),
        10: F.concat(F.lit("item "), F.col("l_orderkey"), F.lit(" fits my "), name, F.lit(" with no trouble so far"))
        if long else F.lit("nothing to say about it"),
        11: F.concat(F.lit("Bought for my "), name, F.lit(".  Nice and easy to use "), F.col("l_suppkey"))
        if long else F.lit("Nice!"),
    }
    out = F.when(v == 0, F.lit(None).cast("string"))
    for k, t in (texts if long else texts | _planted()).items():
        out = out.when(v == k, t)
    return out


def _rating() -> Column:
    q = F.col("l_quantity")
    return (
        F.when(q > 49, F.lit(None).cast("double"))
        .when(q <= 30, 5.0).when(q <= 40, 4.0).when(q <= 44, 3.0).when(q <= 47, 2.0).otherwise(1.0)
    )


def _row_id() -> Column:
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    return F.concat(F.col("l_orderkey"), F.lit("a"), F.col("l_partkey"), F.lit("b"), day)


def _asin() -> Column:
    return F.concat(F.lit("B"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))


def _unix() -> Column:
    return F.when(
        (F.col("l_linenumber") == 7) & (F.col("l_quantity") < 3), F.lit(None).cast("double")
    ).otherwise(F.unix_timestamp("l_shipdate").cast("double"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, cleaned reviews (the 19-column combined table plus `source_rank`)."""
    j = _lines(spark, sf_dir)
    text, rating, unix = _text(True), _rating(), _unix()
    votes = F.when(F.col("l_suppkey") % 11 != 0, (F.col("l_linenumber") - 1).cast("double"))
    total = votes + (F.col("l_suppkey") % 3)
    has_summary = F.col("l_linenumber") != 7
    return j.select(
        F.concat("l_returnflag", F.lit(".csv")).alias("source_file"),
        _row_id().alias("mongo_id"),
        F.concat(F.lit("R"), "o_custkey").alias("reviewerID"),
        _asin().alias("asin"),
        F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("Customer "), "o_custkey")).alias("reviewerName"),
        votes.alias("helpful_votes"),
        total.alias("helpful_total"),
        F.when(total > 0, votes / total).alias("helpful_ratio"),
        text.alias("reviewText"),
        F.coalesce(F.length(text), F.lit(0)).alias("text_length"),
        F.when(text.isNull(), 1).otherwise(0).cast("byte").alias("text_missing"),
        F.when(F.length(text) < 5, 1).otherwise(0).cast("byte").alias("text_very_short"),
        F.when(has_summary, F.col("p_name")).alias("summary"),
        F.when(has_summary, 0).otherwise(1).cast("byte").alias("summary_missing"),
        rating.alias("overall"),
        F.when(rating >= 4, 1.0).when(rating.isNotNull(), 0.0).alias("rating_polarity"),
        unix.alias("unixReviewTime"),
        F.timestamp_seconds(unix).alias("review_datetime_utc"),
        F.col("p_type").alias("category"),
    )


def _cell(c: Column) -> Column:
    """A number as the whole-number text a CSV would hold ('' for NULL)."""
    return F.coalesce(c.cast("bigint").cast("string"), F.lit(""))


def _eighths(key: str) -> Column:
    i = METRIC_KEYS.index(key)
    return (F.col("l_partkey") * (i + 3) + F.col("l_suppkey") * (i + 1) + F.col("l_linenumber")) % (40 + i)


def metric(key: str) -> Column:
    """Test metric values: plain functions of the line item, all multiples of 1/8."""
    return _eighths(key) / 8.0


def _metric_text(key: str) -> Column:
    """`metric` as text. Its few values are looked up, as doubles are slow to print; any other is printed."""
    known = F.array(*[F.lit(str(n / 8.0)) for n in range(40 + METRIC_KEYS.index(key))])
    return F.coalesce(F.get(known, _eighths(key).cast("int")), metric(key).cast("string"))


def stored_lines(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The joined line items of the raw view, written once for queries that need them several times."""
    _lines(spark, sf_dir).select(*LINE_COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def raw_reviews(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """All-string raw rows with the messy cells the cleaner must handle, in three source files.

    Rows with `l_linenumber` 1 or 2 also appear in the next file, so files overlap. `lines` are `stored_lines`, if there are any.
    """
    j = lines or _lines(spark, sf_dir)
    ln, sk = F.col("l_linenumber"), F.col("l_suppkey")
    rating, unix, v = _rating(), _unix(), _variant()
    files = F.array(*[F.lit(s) for s in SOURCES])
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    ranks = F.when(ln <= 2, F.array(rank, (rank + 1) % 3)).otherwise(F.array(rank))
    metrics = F.concat(
        F.lit("{"),
        F.concat_ws(", ", *[F.concat(F.lit(f"'{k}': "), _metric_text(k)) for k in METRIC_KEYS]),
        F.lit("}"),
    )
    return j.withColumn("source_rank", F.explode(ranks)).select(
        F.col("source_rank"),
        F.element_at(files, F.col("source_rank") + 1).alias("source_file"),
        F.when(ln == 6, F.lit("plain-id")).otherwise(
            F.concat(F.lit("{'$oid': '"), _row_id(), F.lit("'}"))).alias("_id"),
        F.concat(F.lit("R"), "o_custkey").alias("reviewerID"),
        _asin().alias("asin"),
        F.when(F.col("o_custkey") % 10 == 0, F.lit(" None ")).otherwise(
            F.concat(F.lit("Customer "), "o_custkey")).alias("reviewerName"),
        F.when(sk % 11 == 0, F.lit("")).when(sk % 13 == 0, F.lit("[1]"))
        .when(sk % 17 == 0, F.concat(F.lit("[-1, "), ln, F.lit("]")))
        .otherwise(F.concat(F.lit(" ["), ln - 1, F.lit(", "), (ln - 1 + sk % 3), F.lit(".0]"))).alias("helpful"),
        F.when(v == 2, F.lit(" \t ")).when(v == 3, F.lit("NaN")).otherwise(_text(True)).alias("reviewText"),
        F.when(ln == 5, F.lit("x"))
        .when(ln == 4, F.coalesce(F.concat(rating.cast("bigint"), F.lit(".0")), F.lit("")))
        .when((ln == 3) & (F.col("l_quantity") > 48), F.lit("6")).otherwise(_cell(rating)).alias("overall"),
        F.when(ln == 7, F.lit("null")).otherwise(F.col("p_name")).alias("summary"),
        F.when(sk == 5, F.lit("soon")).when(sk == 6, F.lit("788918399")).otherwise(_cell(unix)).alias("unixReviewTime"),
        F.when(sk % 19 == 0, F.lit("someday")).when(sk % 7 == 0, F.lit("01 15, 1997"))
        .otherwise(F.date_format("l_shipdate", "MM dd, yyyy")).alias("reviewTime"),
        F.col("p_type").alias("category"),
        F.when(F.col("l_returnflag") == "R", F.lit("")).when(rating >= 4, F.lit("1"))
        .when(rating.isNotNull(), F.lit("0.0")).otherwise(F.lit("none")).alias("class"),
        F.when(sk % 23 == 0, F.lit("")).when(sk % 29 == 0, F.lit("[1, 2]")).when(sk % 31 == 0, F.lit("{'CS': oops"))
        .otherwise(metrics).alias(METRIC_COLUMN),
        F.when(sk % 41 == 0, F.lit("")).when((sk + ln) % 5 == 0, F.lit("1")).otherwise(F.lit("0")).alias(LABEL_COLUMN),
        _row_id().alias("row_pos"),
    )


def live_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical live reviews made from line items: few texts per product, near copies planted by construction."""
    j = _lines(spark, sf_dir)
    sk, pk = F.col("l_suppkey"), F.col("l_partkey")
    return j.select(
        F.lit("amazon").alias("platform"),
        _asin().alias("product_id"),
        _row_id().alias("review_id"),
        F.when(pk % 17 != 0, F.concat(F.lit("R"), F.col("o_custkey") % 40)).alias("reviewer_id"),
        F.lit(None).cast("string").alias("reviewer_name"),
        _rating().alias("rating"),
        F.when(F.col("l_linenumber") != 7, F.col("p_name")).alias("title"),
        _text(False).alias("text"),
        F.when(sk % 11 != 0, F.col("l_linenumber") * (sk % 9)).cast("int").alias("helpful_votes"),
        F.when(pk % 13 != 0, F.col("l_shipdate")).alias("review_date"),
        F.when(F.col("l_returnflag") != "R", F.col("l_linestatus") == "F").alias("verified_purchase"),
    )


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical live reviews made from documents: long texts with exact and near copies."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        F.lit("store").alias("platform"),
        F.col("source").alias("product_id"),
        F.col("doc_id").cast("string").alias("review_id"),
        F.concat(F.lit("u"), F.col("doc_id") % 37).alias("reviewer_id"),
        F.lit(None).cast("string").alias("reviewer_name"),
        (F.col("n_chars") % 5 + 1).cast("double").alias("rating"),
        F.col("lang").alias("title"),
        F.col("text"),
        (F.col("n_chars") % 9).cast("int").alias("helpful_votes"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 3600).alias("review_date"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 == 0).alias("verified_purchase"),
    )


# ---- The same views as DuckDB SQL, for the oracle ------------------------------------------------

_TEXT_SQL = """CASE (l_partkey + l_suppkey + l_linenumber) % 12
 WHEN 1 THEN 'ok'
 WHEN 4 THEN 'great quality, works perfect and fast delivery'
 WHEN 5 THEN 'bad item: arrived broken and late'
 WHEN 6 THEN 'good price but slow and cheap'
 WHEN 7 THEN p_name || ' is excellent, I love it ' || o_orderpriority
 WHEN 8 THEN p_name || ' was a waste, want a refund ' || o_orderpriority
 WHEN 9 THEN p_name || ' ' || o_orderpriority || ' average thing for everyday use'
 WHEN 10 THEN {ten}
 WHEN 11 THEN {eleven}{planted} END"""
_LONG_SQL = _TEXT_SQL.format(
    ten="'item ' || l_orderkey || ' fits my ' || p_name || ' with no trouble so far'",
    eleven="'Bought for my ' || p_name || '.  Nice and easy to use ' || l_suppkey", planted="",
)
_REMARK_SQL = "'remark on ' || p_name || ' from a long time owner of several such things, '"
_PLANTED_SQL = f"""
 WHEN 2 THEN 'note on ' || p_name || ': came well packed, simple to set up, still running after a month of use, grade '
   || ['a', 'b', 'A', 'c'][l_orderkey % 4 + 1]
 WHEN 3 THEN {_REMARK_SQL} || repeat(['q', 'z', 'x'][l_orderkey % 3 + 1], ceil(length({_REMARK_SQL}) / 11.0)::INT)"""
_SHORT_SQL = _TEXT_SQL.format(ten="'nothing to say about it'", eleven="'Nice!'", planted=_PLANTED_SQL)
_RATING_SQL = """CASE WHEN l_quantity > 49 THEN NULL WHEN l_quantity <= 30 THEN 5.0::DOUBLE
 WHEN l_quantity <= 40 THEN 4.0::DOUBLE WHEN l_quantity <= 44 THEN 3.0::DOUBLE
 WHEN l_quantity <= 47 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"""
_UNIX_SQL = "CASE WHEN l_linenumber = 7 AND l_quantity < 3 THEN NULL ELSE epoch(l_shipdate)::DOUBLE END"
_ID_SQL = "l_orderkey || 'a' || l_partkey || 'b' || floor(epoch(l_shipdate) / 86400)::BIGINT"
_ASIN_SQL = "'B' || lpad(l_partkey::VARCHAR, 9, '0')"

LINES_SQL = f"""lines AS (
 SELECT *, {_LONG_SQL} AS long_text, {_SHORT_SQL} AS short_text, {_RATING_SQL} AS rating_v,
        {_UNIX_SQL} AS unix_v, {_ID_SQL} AS row_id, {_ASIN_SQL} AS asin_v
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

REVIEWS_SQL = f"""{LINES_SQL}, votes AS (
 SELECT *, CASE WHEN l_suppkey % 11 <> 0 THEN (l_linenumber - 1)::DOUBLE END AS hv,
        CASE WHEN l_suppkey % 11 <> 0 THEN (l_linenumber - 1)::DOUBLE END + l_suppkey % 3 AS ht FROM lines),
reviews AS (
 SELECT l_returnflag || '.csv' AS source_file, row_id AS mongo_id, 'R' || o_custkey AS "reviewerID",
  asin_v AS asin, CASE WHEN o_custkey % 10 <> 0 THEN 'Customer ' || o_custkey END AS "reviewerName",
  hv AS helpful_votes, ht AS helpful_total, CASE WHEN ht > 0 THEN hv / ht END AS helpful_ratio,
  long_text AS "reviewText", coalesce(length(long_text), 0) AS text_length,
  CASE WHEN long_text IS NULL THEN 1 ELSE 0 END AS text_missing,
  CASE WHEN length(long_text) < 5 THEN 1 ELSE 0 END AS text_very_short,
  CASE WHEN l_linenumber <> 7 THEN p_name END AS summary,
  CASE WHEN l_linenumber <> 7 THEN 0 ELSE 1 END AS summary_missing,
  rating_v AS overall,
  CASE WHEN rating_v >= 4 THEN 1.0::DOUBLE WHEN rating_v IS NOT NULL THEN 0.0::DOUBLE END AS rating_polarity,
  unix_v AS "unixReviewTime", make_timestamp((unix_v * 1000000)::BIGINT) AS review_datetime_utc,
  p_type AS category
 FROM votes)"""

_METRIC_SQL = ",\n  ".join(
    f"((l_partkey * {i + 3} + l_suppkey * {i + 1} + l_linenumber) % {40 + i}) / 8.0::DOUBLE AS m_{k}"
    for i, k in enumerate(METRIC_KEYS)
)

# What the raw view means once cleaned, written without going through the raw strings.
CLEANED_SQL = f"""{LINES_SQL}, ranked AS (
 SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS own FROM lines),
tagged AS (
 SELECT *, own AS source_rank FROM ranked
 UNION ALL SELECT *, (own + 1) % 3 AS source_rank FROM ranked WHERE l_linenumber <= 2),
parsed AS (
 SELECT *,
  CASE WHEN l_suppkey % 11 = 0 OR l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 17 = 0 THEN -1.0::DOUBLE
       ELSE (l_linenumber - 1)::DOUBLE END AS hv,
  CASE WHEN l_suppkey % 11 = 0 OR l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 17 = 0 THEN l_linenumber::DOUBLE
       ELSE (l_linenumber - 1 + l_suppkey % 3)::DOUBLE END AS ht,
  CASE WHEN l_linenumber = 5 THEN NULL
       WHEN l_linenumber = 4 THEN rating_v
       WHEN l_linenumber = 3 AND l_quantity > 48 THEN 6.0::DOUBLE ELSE rating_v END AS stars,
  CASE WHEN l_suppkey = 5 THEN NULL WHEN l_suppkey = 6 THEN 788918399.0::DOUBLE ELSE unix_v END AS secs,
  l_suppkey % 23 <> 0 AND l_suppkey % 29 <> 0 AND l_suppkey % 31 <> 0 AS has_metrics,
  {_METRIC_SQL}
 FROM tagged),
cleaned AS (
 SELECT source_rank, CASE source_rank WHEN 0 THEN 'A.csv' WHEN 1 THEN 'N.csv' ELSE 'R.csv' END AS source_file,
  CASE WHEN l_linenumber <> 6 THEN row_id END AS mongo_id, 'R' || o_custkey AS "reviewerID", asin_v AS asin,
  CASE WHEN o_custkey % 10 <> 0 THEN 'Customer ' || o_custkey END AS "reviewerName",
  hv AS helpful_votes, ht AS helpful_total, CASE WHEN ht > 0 THEN hv / ht END AS helpful_ratio,
  long_text AS "reviewText", coalesce(length(long_text), 0) AS text_length,
  CASE WHEN long_text IS NULL THEN 1 ELSE 0 END AS text_missing,
  CASE WHEN length(long_text) < 5 THEN 1 ELSE 0 END AS text_very_short,
  CASE WHEN l_linenumber <> 7 THEN p_name END AS summary,
  CASE WHEN l_linenumber <> 7 THEN 0 ELSE 1 END AS summary_missing,
  stars AS overall,
  CASE WHEN stars >= 4 THEN 1.0::DOUBLE WHEN stars IS NOT NULL THEN 0.0::DOUBLE END AS rating_polarity,
  secs AS "unixReviewTime", make_timestamp((secs * 1000000)::BIGINT) AS review_datetime_utc, p_type AS category,
  CASE WHEN l_returnflag = 'R' THEN NULL WHEN rating_v >= 4 THEN 1.0::DOUBLE
       WHEN rating_v IS NOT NULL THEN 0.0::DOUBLE END AS class_raw,
  CASE WHEN l_returnflag = 'R' OR rating_v IS NULL THEN 1 ELSE 0 END AS class_missing,
  {", ".join(f"CASE WHEN has_metrics THEN m_{k} END AS bfr_{k}" for k in METRIC_KEYS)},
  CASE WHEN l_suppkey % 41 = 0 THEN NULL WHEN (l_suppkey + l_linenumber) % 5 = 0 THEN 1.0::DOUBLE
       ELSE 0.0::DOUBLE END AS candidate_label,
  row_id AS row_pos, l_suppkey, l_linenumber, l_quantity, l_shipdate, l_returnflag, rating_v, unix_v,
  o_custkey, p_name, (l_partkey + l_suppkey + l_linenumber) % 12 AS variant
 FROM parsed)"""

LIVE_SQL = f"""{LINES_SQL}, live AS (
 SELECT 'amazon' AS platform, asin_v AS product_id, row_id AS review_id,
  CASE WHEN l_partkey % 17 <> 0 THEN 'R' || (o_custkey % 40) END AS reviewer_id,
  rating_v AS rating, CASE WHEN l_linenumber <> 7 THEN p_name END AS title, short_text AS text,
  CASE WHEN l_suppkey % 11 <> 0 THEN l_linenumber * (l_suppkey % 9) END AS helpful_votes,
  CASE WHEN l_partkey % 13 <> 0 THEN l_shipdate END AS review_date,
  CASE WHEN l_returnflag <> 'R' THEN l_linestatus = 'F' END AS verified_purchase
 FROM lines)"""

DOCUMENT_SQL = """live AS (
 SELECT 'store' AS platform, source AS product_id, doc_id::VARCHAR AS review_id, 'u' || (doc_id % 37) AS reviewer_id,
  (n_chars % 5 + 1)::DOUBLE AS rating, lang AS title, text, n_chars % 9 AS helpful_votes,
  make_timestamp((1700000000 + doc_id * 3600) * 1000000) AS review_date,
  CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS verified_purchase
 FROM documents)"""

_METRIC_CELL_SQL = """CASE WHEN l_suppkey % 23 = 0 THEN '' WHEN l_suppkey % 29 = 0 THEN '[1, 2]'
  WHEN l_suppkey % 31 = 0 THEN 'oops' ELSE 'dict' END"""

# The raw strings themselves (the metric dict only by its kind).
RAW_SQL = f"""{CLEANED_SQL}, raw AS (
 SELECT *, CASE WHEN l_linenumber = 6 THEN 'plain-id' ELSE 'oid:' || row_pos END AS raw_id,
  CASE WHEN o_custkey % 10 = 0 THEN ' None ' ELSE 'Customer ' || o_custkey END AS raw_name,
  CASE WHEN l_suppkey % 11 = 0 THEN '' WHEN l_suppkey % 13 = 0 THEN '[1]'
       WHEN l_suppkey % 17 = 0 THEN '[-1, ' || l_linenumber || ']'
       ELSE ' [' || (l_linenumber - 1) || ', ' || (l_linenumber - 1 + l_suppkey % 3) || '.0]' END AS raw_helpful,
  CASE variant WHEN 2 THEN ' \t ' WHEN 3 THEN 'NaN' ELSE "reviewText" END AS raw_text,
  CASE WHEN l_linenumber = 5 THEN 'x' WHEN l_linenumber = 4 THEN coalesce(rating_v::BIGINT || '.0', '')
       WHEN l_linenumber = 3 AND l_quantity > 48 THEN '6' ELSE coalesce(rating_v::BIGINT::VARCHAR, '') END AS raw_overall,
  CASE WHEN l_linenumber = 7 THEN 'null' ELSE p_name END AS raw_summary,
  CASE WHEN l_suppkey = 5 THEN 'soon' WHEN l_suppkey = 6 THEN '788918399'
       ELSE coalesce(unix_v::BIGINT::VARCHAR, '') END AS raw_unix,
  CASE WHEN l_suppkey % 19 = 0 THEN 'someday' WHEN l_suppkey % 7 = 0 THEN '01 15, 1997'
       ELSE strftime(l_shipdate, '%m %d, %Y') END AS raw_time,
  CASE WHEN l_returnflag = 'R' THEN '' WHEN rating_v >= 4 THEN '1' WHEN rating_v IS NOT NULL THEN '0.0'
       ELSE 'none' END AS raw_class,
  {_METRIC_CELL_SQL} AS raw_metrics,
  CASE WHEN l_suppkey % 41 = 0 THEN '' WHEN (l_suppkey + l_linenumber) % 5 = 0 THEN '1' ELSE '0' END AS raw_label
 FROM cleaned)"""
