"""Statistics of the candidate label. It is an unverified label, kept apart from the feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.fixed_values import METRIC_KEYS
from candor.functions.columns import divide
from candor.functions.ranks import running_totals, to_long

METRICS = [f"bfr_{k}" for k in METRIC_KEYS]


def label_counts(rows: DataFrame, label: str = "candidate_label") -> DataFrame:
    """Label 0, label 1, invalid or missing, and the positive rate among the valid ones."""
    y = F.col(label)
    n0, n1 = F.count_if(y == 0), F.count_if(y == 1)
    return rows.agg(
        n0.alias("n_label0"),
        n1.alias("n_label1"),
        (F.count(F.lit(1)) - n0 - n1).alias("n_invalid"),
        divide(n1, n0 + n1).alias("positive_rate"),
    )


def cross_tab(rows: DataFrame, a: str, label: str = "candidate_label", missing: float | None = None) -> DataFrame:
    """Counts per (a, label); a missing `a` shows as `missing` when given."""
    left = F.coalesce(F.col(a), F.lit(missing)) if missing is not None else F.col(a)
    return rows.groupBy(left.alias(a), F.col(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def metric_means(rows: DataFrame, columns: list[str], label: str = "candidate_label") -> DataFrame:
    """One row per metric: count and mean for label 0 and 1, and their difference."""
    y, v = F.col(label), F.col("value")
    return (
        to_long(rows, columns, [label])
        .groupBy(F.col("name").alias("metric"))
        .agg(
            F.count(F.when(y == 0, v)).alias("n_label0"),
            F.count(F.when(y == 1, v)).alias("n_label1"),
            F.avg(F.when(y == 0, v)).alias("mean_label0"),
            F.avg(F.when(y == 1, v)).alias("mean_label1"),
        )
        .withColumn("mean_diff", F.col("mean_label1") - F.col("mean_label0"))
    )


def rank_auc(rows: DataFrame, columns: list[str], label: str = "candidate_label") -> DataFrame:
    """Mann-Whitney AUC of each column against the label, ties counted half. NULL with one class only."""
    y = F.col(label)
    hist = (
        to_long(rows, columns, [label])
        .filter(y.isin(0.0, 1.0) & F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("name", "value")
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    ranked = running_totals(hist, "name", "value", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.groupBy(F.col("name").alias("metric")).agg(
        divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )


def means_by_label(rows: DataFrame, columns: list[str], label: str = "candidate_label") -> DataFrame:
    """All means in one scan: one row per label."""
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in columns]
    )
