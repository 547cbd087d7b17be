"""Data-quality audit of raw review rows, one result per source file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.fixed_values import (
    EARLIEST_UNIX,
    HELPFUL_PATTERN,
    LATEST_UNIX,
    METRIC_COLUMN,
    METRIC_KEYS,
    VERY_LONG_TEXT,
    VERY_SHORT_BATCH,
)
from candor.functions.columns import contains_any, divide, extract, is_missing, one_row, strip, text_key, to_number
from candor.operators.dedup import first_rows
from candor.sources import quoted_csv

SOURCE = "source_file"
DATE_FORMATS = ["M d, yyyy", "yyyy-MM-dd", "M/d/yyyy"]
DUPLICATE_KEYS = {
    "duplicate_id": ["_id"],
    "duplicate_triple": ["reviewerID", "asin", "unixReviewTime"],
    "duplicate_text_pair": ["reviewerID", "asin", "reviewText"],
    "duplicate_row": ["reviewerID", "asin", "unixReviewTime", "reviewText", "overall"],
}


def missing_profile(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells per column, and their share of the rows in percent."""
    wide = raw.groupBy(SOURCE).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(is_missing(F.col(c))).alias(c) for c in columns]
    )
    long = wide.unpivot([SOURCE, "n_rows"], columns, "column", "missing")
    return long.withColumn("pct", divide(F.col("missing") * 100.0, F.col("n_rows")))


def empty_rows(raw: DataFrame, columns: list[str]) -> DataFrame:
    every = reduce(lambda a, b: a & b, [is_missing(F.col(c)) for c in columns])
    return raw.groupBy(SOURCE).agg(F.count_if(every).alias("empty_rows"))


def value_counts(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per stripped value of each column."""
    cells = raw.select(SOURCE, *[F.coalesce(strip(F.col(c)), F.lit("")).alias(c) for c in columns])
    return (
        cells.unpivot([SOURCE], columns, "column", "value")
        .groupBy(SOURCE, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def numeric_profile(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Range, mean, population deviation, and cells that are present but not numbers."""
    cells = raw.select(SOURCE, *columns).unpivot([SOURCE], columns, "column", "cell")
    v = to_number(F.col("cell"))
    return cells.groupBy(SOURCE, "column").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.count(v).alias("n"), F.count_if(v.isNull() & ~is_missing(F.col("cell"))).alias("non_numeric"),
    )


def rating_domain(raw: DataFrame) -> DataFrame:
    v = to_number(F.col("overall"))
    return raw.groupBy(SOURCE).agg(
        F.count_if((v < 1) | (v > 5)).alias("not_1_to_5"), F.count_if(v != F.bround(v)).alias("non_integer")
    )


def unix_plausibility(raw: DataFrame) -> DataFrame:
    """Times before 1995, after 2019, or not numbers; and the observed range as ISO text."""
    v = to_number(F.col("unixReviewTime"))
    bad = (v < EARLIEST_UNIX) | (v > LATEST_UNIX)
    iso = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
    return raw.groupBy(SOURCE).agg(
        (F.count_if(bad) + F.count_if(v.isNull() & ~is_missing(F.col("unixReviewTime")))).alias("implausible"),
        F.date_format(F.timestamp_seconds(F.min(v)), iso).alias("min_iso"),
        F.date_format(F.timestamp_seconds(F.max(v)), iso).alias("max_iso"),
    )


def date_check(raw: DataFrame) -> DataFrame:
    """Date strings that do not parse, and dates that differ from the UTC day of the unix time."""
    cell = strip(F.col("reviewTime"))
    parsed = F.coalesce(*[F.try_to_timestamp(cell, F.lit(f)) for f in DATE_FORMATS])
    day = F.to_date(F.timestamp_seconds(to_number(F.col("unixReviewTime"))))
    return raw.groupBy(SOURCE).agg(
        F.count_if(parsed.isNull() & ~is_missing(F.col("reviewTime"))).alias("unparseable"),
        F.count_if(F.to_date(parsed) != day).alias("day_mismatch"),
    )


def text_profile(raw: DataFrame) -> DataFrame:
    text = F.col("reviewText")
    size = F.when(~is_missing(text), F.length(text))
    summary = is_missing(F.col("summary"))
    return raw.groupBy(SOURCE).agg(
        F.count(size).alias("n"), F.min(size).alias("min"), F.max(size).alias("max"), F.avg(size).alias("mean"),
        F.count_if(is_missing(text)).alias("empty"),
        F.count_if(size < VERY_SHORT_BATCH).alias("very_short"),
        F.count_if(size > VERY_LONG_TEXT).alias("very_long"),
        F.count_if(size.isNotNull() & (strip(text) == "")).alias("whitespace_only"),
        F.count_if(text.contains("�")).alias("replacement_char_rows"),
        F.count_if(summary).alias("summary_missing"), F.count_if(~summary).alias("summary_present"),
    )


def helpful_quality(raw: DataFrame) -> DataFrame:
    cell = strip(F.col("helpful"))
    a, b = (to_number(extract(cell, HELPFUL_PATTERN, i)) for i in (1, 2))
    ok = a.isNotNull() & b.isNotNull()
    missing = is_missing(F.col("helpful"))
    return raw.groupBy(SOURCE).agg(
        F.count_if(missing).alias("missing"), F.count_if(ok).alias("ok"),
        F.count_if(~missing & ~ok).alias("unparseable"),
        F.count_if((a < 0) | (b < 0)).alias("negative"), F.count_if(a > b).alias("votes_gt_total"),
        F.count_if((a % 1 != 0) | (b % 1 != 0)).alias("non_integer"),
        F.avg(F.when(ok, a)).alias("mean_votes"), F.avg(F.when(ok, b)).alias("mean_total"),
    )


def _as_json(cell: Column) -> Column:
    """A literal dict in single quotes as JSON text. Only cells that hold one of Python's words go through the patterns."""
    plain = F.translate(strip(cell), "'", '"')
    words = {"None": "null", "True": "true", "False": "false"}
    out = plain
    for word, json_word in words.items():
        out = F.regexp_replace(out, rf"\b{word}\b", json_word)
    return F.when(contains_any(cell, words), out).otherwise(plain)


def _metric_status(cell: Column) -> Column:
    """Each cell is parsed once: what parses and begins with a brace is a dict."""
    return (
        F.when(is_missing(cell), "missing").when(F.try_parse_json(_as_json(cell)).isNull(), "unparseable")
        .when(strip(cell).startswith("{"), "ok").otherwise("wrong_type")
    )


def metric_status(raw: DataFrame, column: str = METRIC_COLUMN) -> DataFrame:
    """How the dict cells parse: missing, ok, unparseable, wrong_type. Every cell is read."""
    return raw.groupBy(SOURCE, _metric_status(F.col(column)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def metric_key_profile(raw: DataFrame, column: str = METRIC_COLUMN) -> DataFrame:
    """Key frequency and the range and mean of its numbers, over the parsed dicts."""
    cells = raw.filter(_metric_status(F.col(column)) == "ok").select(
        SOURCE, F.explode(F.from_json(_as_json(F.col(column)), "map<string,string>")).alias("key", "cell")
    )
    v = F.when(F.col("key").isin(METRIC_KEYS), to_number(F.col("cell")))
    return cells.groupBy(SOURCE, "key").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"),
    )


def cross_tabs(raw: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows per source and pair of values."""
    cell = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    items = F.array(*[F.struct(F.lit(f"{a} x {b}").alias("pair"), cell(a).alias("a"), cell(b).alias("b")) for a, b in pairs])
    return (
        raw.select(SOURCE, F.explode(items).alias("i")).groupBy(SOURCE, "i.pair", "i.a", "i.b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def id_format(raw: DataFrame) -> DataFrame:
    oid = F.coalesce(F.col("_id").contains("$oid"), F.lit(False))
    return raw.groupBy(SOURCE).agg(
        F.count_if(oid).alias("mongo_oid_like"), F.count_if(~oid & ~is_missing(F.col("_id"))).alias("plain_or_other")
    )


def distinct_counts(raw: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; `approximate=True` is the cheap one-shuffle mode."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return raw.groupBy(SOURCE).agg(*[count(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


def duplicate_hits(raw: DataFrame, key_sets: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows beyond the first of each key, for several keys. Keys are compared by 256-bit digests."""
    sets = key_sets or DUPLICATE_KEYS
    cells = {
        name: text_key(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))
        for name, cols in sets.items()
    }
    digests = raw.select(SOURCE, *[c.alias(n) for n, c in cells.items()])
    return digests.groupBy(SOURCE).agg(
        *[(F.count(F.lit(1)) - F.countDistinct(n)).alias(n) for n in sets]
    )


def line_delta(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Physical lines that are no header, and how many more they are than the records that parse."""
    lines = quoted_csv.line_counts(spark, path).agg(F.sum("n_lines").alias("n_lines"))
    rows = quoted_csv.records(spark, path).withColumn("header", quoted_csv.is_header(columns))
    parsed = quoted_csv.parse(rows, columns, "_bad", ["header"])  # headers and good records in one reading
    counts = parsed.agg(F.count_if("header").alias("n_headers"), F.count_if(~F.col("header") & F.col("_bad").isNull()).alias("n_good"))
    both = lines.select("n_lines", one_row(counts).alias("c")).select("n_lines", "c.*")
    data = F.col("n_lines") - F.col("n_headers")
    return both.select(data.alias("data_lines"), (data - F.col("n_good")).alias("delta"))


def _value_pairs(raw: DataFrame, a: str, b: str) -> DataFrame:
    return raw.groupBy(
        SOURCE, strip(F.col(a)).alias("a"), F.when(~is_missing(F.col(b)), strip(F.col(b))).alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))


def functional_dependency(raw: DataFrame, a: str = "overall", b: str = "class") -> DataFrame:
    """Whether each value of `a` goes with at most one present value of `b`."""
    per = _value_pairs(raw, a, b).groupBy(SOURCE, "a").agg(F.count("b").alias("k"))
    return per.groupBy(SOURCE).agg((F.max("k") <= 1).alias("deterministic"), F.max("k").alias("max_values"))


def label_independence(raw: DataFrame, a: str = "overall", b: str = "label") -> DataFrame:
    """A label counts as independent when at least three values of `a` carry mixed labels."""
    per = _value_pairs(raw, a, b).groupBy(SOURCE, "a").agg(F.count("b").alias("k"))
    mixed = F.count_if(F.col("k") > 1)
    return per.groupBy(SOURCE).agg(mixed.alias("mixed_values"), (mixed >= 3).alias("independent"))


def class_rules(raw: DataFrame, a: str = "overall", b: str = "class") -> DataFrame:
    """Numeric values of `a` with their majority class (1 or 0); ties go to the smaller text."""
    pairs = _value_pairs(raw, a, b).filter(F.col("b").isNotNull())
    top = first_rows(pairs, [SOURCE, "a"], [F.desc("n"), "b"], 1)
    v = to_number(F.col("a"))
    cls = F.when(F.col("b").isin("1", "1.0"), 1).when(F.col("b").isin("0", "0.0"), 0)
    return top.select(SOURCE, v.alias("value"), cls.alias("majority_class")).filter(
        F.col("value").isNotNull() & F.col("majority_class").isNotNull()
    ).distinct()


def _ordered_pairs(items: Column) -> Column:
    """All (a, b) with a < b of a short array: file names, never rows."""
    return F.flatten(
        F.transform(
            items,
            lambda a: F.transform(F.filter(items, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )


def key_overlap(raw: DataFrame, keys: list[str]) -> DataFrame:
    """|A ∩ B| and its share of both files, for every pair of files.

    Keys are folded to the set of files they occur in, and sets are counted before any pair is made,
    so pairs come from the few distinct file sets, never from rows.
    """
    digest = text_key(F.concat_ws("\x1f", *[F.coalesce(F.col(k), F.lit("")) for k in keys]))
    per_key = raw.select(digest.alias("k"), SOURCE).distinct().groupBy("k").agg(
        F.sort_array(F.collect_set(SOURCE)).alias("files")
    )
    sets = per_key.groupBy("files").agg(F.count(F.lit(1)).alias("n"))
    sizes = sets.select(F.explode("files").alias("file"), "n").groupBy("file").agg(F.sum("n").alias("size"))
    both = sets.select(F.explode(_ordered_pairs(F.col("files"))).alias("p"), "n").groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(
        F.sum("n").alias("intersection")
    )
    listed = sizes.groupBy().agg(F.sort_array(F.collect_list(F.struct("file", "size"))).alias("files"))
    every = listed.select(F.explode(_ordered_pairs(F.col("files"))).alias("p")).select(
        F.col("p.a.file").alias("a"), F.col("p.b.file").alias("b"),
        F.col("p.a.size").alias("len_a"), F.col("p.b.size").alias("len_b"),
    )
    out = every.join(both, ["a", "b"], "left")
    n = F.coalesce(F.col("intersection"), F.lit(0)).cast("bigint")
    return out.select(
        F.col("a").alias("file_a"), F.col("b").alias("file_b"), n.alias("intersection"), "len_a", "len_b",
        divide(n * 100.0, F.col("len_a")).alias("pct_of_a"), divide(n * 100.0, F.col("len_b")).alias("pct_of_b"),
    )


def schema_presence(spark: SparkSession, files: dict[str, DataFrame]) -> DataFrame:
    """Column x file presence, from the schemas alone."""
    names = sorted({c for df in files.values() for c in df.columns})
    rows = [(c, f, c in df.columns) for c in names for f, df in files.items()]
    return spark.createDataFrame(rows, "column string, file string, present boolean")


def head_sample(raw: DataFrame, order: list[str], n: int = 2) -> DataFrame:
    """The first rows of each source."""
    return first_rows(raw, [SOURCE], order, n)
