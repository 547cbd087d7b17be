"""Keep-first de-duplication, set operations and sampling."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVIEW_KEY = ["reviewerID", "asin", "unixReviewTime"]


def keep_first(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of every key. `order` must be total.

    Spark limits each key to one row per task before the shuffle, so a key with very many copies does
    not travel whole to one task. NULL keys compare as equal.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_rows(rows: DataFrame, group: list[str], order: list[str | Column], limit: int) -> DataFrame:
    """At most `limit` rows per group in a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")


def dropped_counts(rows: DataFrame, kept: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows read, kept and dropped per source."""
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("rows_read"), F.lit(0).alias("z"))
    survivors = kept.groupBy(F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("k"))
    both = counts.join(survivors, F.col(source).eqNullSafe(F.col("_s")), "left")
    k = F.coalesce(F.col("k"), F.lit(0))
    return both.select(
        source, "rows_read", k.cast("bigint").alias("rows_kept"),
        (F.col("rows_read") - k).cast("bigint").alias("rows_dropped"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name; a column a part lacks becomes NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(*keys).intersect(b.select(*keys))


def uniform_sample(rows: DataFrame, size: int, key: list[str], seed: int = 7) -> DataFrame:
    """A uniform sample of `size` rows (all rows if there are no more), the smallest by a seeded hash of `key`.

    Every task keeps its own `size` smallest, so no more than that leaves it.
    """
    place = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    return rows.withColumn("_place", place).orderBy("_place", *key).limit(size).drop("_place")
