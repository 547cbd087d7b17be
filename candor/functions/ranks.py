"""Exact ranks, running totals and quantiles without a one-task window.

Values are first folded to one row per distinct value (combined before the shuffle, so ties and hot
values cost nothing). Distinct values are then cut into ordered buckets by magnitude; a running total
is the total of the smaller buckets plus a running sum inside the bucket, so every bucket is its own
task and nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 64


def order_bucket(v: Column, steps: int = STEPS_PER_OCTAVE) -> Column:
    """A whole number that never decreases as the double `v` grows: octave, then steps inside it."""
    octave = F.floor(F.log2(F.abs(v)))
    step = F.floor(F.abs(v) / F.pow(F.lit(2.0), octave) * steps)
    size = (octave + 1100) * (2 * steps) + step
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("bigint")


def to_long(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep…, name, value): one row per cell of the numeric columns."""
    ids = keep or []
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(ids, columns, "name", "value")


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n), NULL values included as their own row."""
    return to_long(df, columns).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def running_totals(hist: DataFrame, group: str, value: str, sums: list[str]) -> DataFrame:
    """Add `<sum>_before`: the total of `sum` over strictly smaller values of the same group.

    `hist` has one row per (group, value). Groups are column names or labels, so the per-bucket totals
    that are broadcast stay at groups x buckets, whatever the number of rows.
    """
    placed = hist.filter(F.col(value).isNotNull()).withColumn("_bucket", order_bucket(F.col(value)))
    totals = placed.groupBy(group, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(
        F.broadcast(offsets), (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")), "inner"
    )
    for s in sums:
        out = out.withColumn(
            f"{s}_before", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))
        )
    return out.select(*hist.columns, *[f"{s}_before" for s in sums])


def exact_quantiles(hist: DataFrame, probabilities: list[float]) -> DataFrame:
    """(name, p, quantile): linear interpolation between neighbours, over a value histogram."""
    ranked = running_totals(hist, "name", "value", ["n"])
    totals = hist.filter(F.col("value").isNotNull()).groupBy("name").agg(F.sum("n").alias("total"))
    wanted = totals.select(
        F.col("name").alias("_name"), F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"), "total"
    ).select(
        "_name", "p", ((F.col("total") - 1) * F.col("p")).alias("_pos")
    ).select("_name", "p", "_pos", F.floor("_pos").alias("_lo"), F.ceil("_pos").alias("_hi"))
    first, last = F.col("n_before"), F.col("n_before") + F.col("n")
    hits = ranked.join(
        F.broadcast(wanted),
        (F.col("name") == F.col("_name"))
        & (
            ((F.col("_lo") >= first) & (F.col("_lo") < last))
            | ((F.col("_hi") >= first) & (F.col("_hi") < last))
        ),
        "inner",
    )
    low, high = F.min("value"), F.max("value")
    return hits.groupBy("name", "p").agg(
        (low + (high - low) * (F.max("_pos") - F.max("_lo"))).alias("quantile")
    )
