"""Profiles, histograms, correlations and outlier tags of the feature tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.fixed_values import HIGH_CORRELATION, PROFILE_PROBABILITIES
from candor.functions.columns import compact, divide, one_row
from candor.functions.ranks import exact_quantiles, running_totals, value_histogram
from candor.functions.selection import quantiles
from candor.session import ensure_checkpoint_dir


def column_profile(
    df: DataFrame, columns: list[str], probabilities: list[float] = PROFILE_PROBABILITIES
) -> DataFrame:
    """One row per column: counts, moments, range and exact quantiles. NaN counts as NULL.

    The numeric columns are written once to the shared folder, so all passes see the same values and the table
    behind them is computed once. No cell is shuffled: moments are one aggregate, quantiles come by range refinement.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/profile-{uuid.uuid4().hex}"
    number = lambda c: F.col(c).cast("double")
    df.select(*[F.when(~F.isnan(number(c)), number(c) + 0.0).alias(c) for c in columns]).write.parquet(path)
    table = spark.read.parquet(path)
    moments = {"known": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = table.agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in moments.items()]
    ).first()
    at = quantiles(table, probabilities, {c: row[f"known_{i}"] for i, c in enumerate(columns)})
    names = [_quantile_name(p) for p in probabilities]
    return spark.createDataFrame(
        [
            (c, row[f"known_{i}"], row["n"] - row[f"known_{i}"], *[row[f"{m}_{i}"] for m in ("mean", "std", "min", "max")], *at[c])
            for i, c in enumerate(columns)
        ],
        "column string, n_non_null bigint, n_null bigint, mean double, std double, min double, max double, "
        + ", ".join(f"{name} double" for name in names),
    )


def _quantile_name(p: float) -> str:
    return f"p{round(p * 100):02d}"


def approximate_profile(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """The same quantiles from mergeable sketches: one aggregation, bounded rank error."""
    ps = PROFILE_PROBABILITIES
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.percentile_approx("value", ps, accuracy).alias("q")).select(
        "column", *[F.col("q")[i].alias(_quantile_name(p)) for i, p in enumerate(ps)]
    )


def shares(df: DataFrame, key: str) -> DataFrame:
    """Counts per value and their share of all rows. The total comes from the small count table."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.select(key, "n", divide(F.col("n"), total.scalar()).alias("share"))


def by_rating(review_features: DataFrame) -> DataFrame:
    return review_features.groupBy("rating").agg(
        F.count(F.lit(1)).alias("n"), F.avg("review_length_chars").alias("mean_len"),
        F.median("review_length_chars").alias("median_len"), F.avg("helpful_votes").alias("mean_helpful"),
    )


def by_category(review_features: DataFrame) -> DataFrame:
    return review_features.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"),
        F.median("review_length_chars").alias("median_len"), F.avg("helpful_votes").alias("mean_helpful"),
    ).orderBy(F.desc("n"), "category")


def availability(review_features: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return review_features.agg(
        share("text_available").alias("text_share"), share("summary_available").alias("summary_share"),
        F.count_if(F.col("is_exact_duplicate_text")).alias("n_dup"),
        F.min("review_year").alias("ymin"), F.max("review_year").alias("ymax"),
    )


def reviewer_extras(reviewer_features: DataFrame) -> DataFrame:
    missing = F.col("rating_std").isNull()
    return reviewer_features.agg(
        F.count_if(F.col("review_count") == 1).alias("n_single"), F.count_if(missing).alias("null_std"),
        F.count_if(missing & (F.col("review_count") == 1)).alias("null_std_n1"),
        F.count_if(missing & (F.col("review_count") > 1)).alias("null_std_n_gt1"),
    )


def most_active(reviewer_features: DataFrame, n: int = 10) -> DataFrame:
    """Top-n report: the n most active reviewers, ties by id."""
    return reviewer_features.orderBy(F.desc("review_count"), "reviewerID").limit(n).select(
        "reviewerID", "review_count", "unique_products", "avg_rating", "review_span_days", "five_star_ratio"
    )


def thresholds(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """One row of exact quantiles of one column, named p.. ."""
    q = exact_quantiles(value_histogram(df, [column]), probabilities)
    return q.agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(_quantile_name(p)) for p in probabilities])


def product_extras(product_features: DataFrame) -> DataFrame:
    p99 = thresholds(product_features, "review_count", [0.99]).scalar()
    n = F.col("review_count")
    return product_features.withColumn("p99", p99).agg(
        F.count_if(n == 1).alias("n_single"), F.count_if(n > F.col("p99")).alias("n_high"),
        F.count_if((n >= 10) & (F.col("five_star_ratio") >= 0.95)).alias("n_conc"),
    )


def reviewer_outliers(reviewer_features: DataFrame) -> DataFrame:
    """One row per reviewer with its outlier tags."""
    q = one_row(thresholds(reviewer_features, "review_count", [0.25, 0.75, 0.95, 0.99]))
    n = F.col("review_count")
    upper = F.col("q.p75") + 1.5 * (F.col("q.p75") - F.col("q.p25"))
    return reviewer_features.select("reviewerID", "review_count", "extreme_rating_ratio", q.alias("q")).select(
        "reviewerID", (n > F.col("q.p95")).alias("high"), (n > F.col("q.p99")).alias("extreme"),
        ((n >= 5) & (F.col("extreme_rating_ratio") >= 0.95)).alias("pattern"), (n > upper).alias("iqr"),
    )


def outlier_counts(review_features: DataFrame, reviewer_features: DataFrame, product_features: DataFrame) -> DataFrame:
    """(tag, hits) over the three tables."""
    tags = reviewer_outliers(reviewer_features).agg(
        F.count_if("high").alias("reviewer_high"), F.count_if("extreme").alias("reviewer_extreme"),
        F.count_if("pattern").alias("reviewer_pattern"), F.count_if("iqr").alias("reviewer_iqr"),
    )
    ends = one_row(thresholds(review_features, "review_length_chars", [0.01, 0.99]))
    c = F.col("review_length_chars")
    lengths = review_features.select("review_length_chars", ends.alias("q")).agg(
        F.count_if((c < F.col("q.p01")) | (c > F.col("q.p99"))).alias("review_length")
    )
    top = thresholds(product_features, "review_count", [0.99]).scalar()
    products = product_features.select("review_count", top.alias("p99")).agg(
        F.count_if(F.col("review_count") > F.col("p99")).alias("product_high")
    )
    parts = [t.unpivot([], t.columns, "tag", "hits") for t in (tags, lengths, products)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def log_histogram(df: DataFrame, column: str, steps: int, plus_one: bool) -> DataFrame:
    """Counts per floor(ln(x [+1]) * steps) / steps; values outside the logarithm's domain fall in NULL."""
    x = F.col(column) + 1 if plus_one else F.col(column)
    bin_ = F.floor(F.ln(F.when(x > 0, x)) * steps).cast("double") / float(steps)
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rounded_histogram(df: DataFrame, column: str, digits: int) -> DataFrame:
    scale = 10.0**digits
    return df.groupBy((F.round(F.col(column) * scale) / scale).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r) for every pair a before b, each pair over the rows where both are present.

    One scan: every task folds its rows into k x k sums with matrix products, and only those sums are
    shuffled. Values are shifted by the column means first. Constant or empty pairs give NULL.
    """
    k = len(columns)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    centre = F.col("_mean")
    shifted = df.select(*columns, one_row(means).alias("_mean")).select(
        *[(F.col(c).cast("double") - centre.getField(c)).alias(c) for c in columns]
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            m = np.isfinite(x).astype(float)
            x = np.where(m > 0, x, 0.0)
            sq = x * x
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame(
            {"i": i, "j": j, **{name: sums[s][i, j] for s, name in enumerate(("n", "sa", "sb", "saa", "sbb", "sab"))}}
        )

    parts = shifted.mapInPandas(
        fold, "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double"
    ).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in ("n", "sa", "sb", "saa", "sbb", "sab")])
    names = F.array(*[F.lit(c) for c in columns])
    return parts.select(
        names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.col("n").cast("bigint").alias("n"),
        _correlation(F.col("n"), F.col("sa"), F.col("sb"), F.col("saa"), F.col("sbb"), F.col("sab")).alias("r"),
    )


def _correlation(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    real = (n > 1) & (va > 1e-12 * F.greatest(saa, F.lit(1e-300))) & (vb > 1e-12 * F.greatest(sbb, F.lit(1e-300)))
    return F.when(real, (sab - sa * sb / n) / F.sqrt(F.when(real, va * vb)))


def high_pairs(correlations: DataFrame, limit: float = HIGH_CORRELATION) -> DataFrame:
    return correlations.filter(F.abs("r") >= limit).orderBy(F.desc(F.abs("r")), "a", "b")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, rho): Pearson of the average ranks of all rows where both columns are present.

    Which rows a pair uses depends only on its columns that have NULLs, so a column is ranked once for every such
    set of rows: once in all if nothing is NULL. Ranks come from running totals over the distinct values, so no
    task holds a whole column, and go back to their rows as one array, from which all pairs are summed in the map
    tasks; no row is multiplied by pairs. Values are compared to 9 decimals, so that the order in which floats were
    summed does not split ties.
    """
    rows = df.select(*[(F.round(F.col(c).cast("double"), 9) + 0.0).alias(c) for c in columns])
    present = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    nullable = {c for c in columns if present[c] < present["n"]}
    sets: dict[frozenset[str], list[tuple[str, str]]] = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            sets.setdefault(frozenset(nullable & {a, b}), []).append((a, b))
    used = {s: [c for c in columns if any(c in pair for pair in pairs)] for s, pairs in sets.items()}
    cells = [
        F.when(
            F.lit(True) if not s else reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in sorted(s)]),
            F.struct(F.lit(k).alias("rows"), F.array(*[
                F.struct(F.lit(f"{k},{j}").alias("cell"), F.lit(j).alias("j"), F.col(c).alias("x")) for j, c in enumerate(used[s])]).alias("cells")))
        for k, s in enumerate(used)
    ]
    held = rows.withColumn("id", F.monotonically_increasing_id()).select("id", F.inline(compact(cells)))
    long = held.select("id", "rows", F.inline("cells"))
    hist = long.groupBy("cell", "x").agg(F.count(F.lit(1)).alias("m"))
    ranks = running_totals(hist, "cell", "x", ["m"]).select("cell", "x", (F.col("m_before") + (F.col("m") + 1) / 2.0).alias("rank"))
    ranked = long.join(ranks, ["cell", "x"]).groupBy("id", "rows").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "rank"))), lambda c: c["rank"]).alias("r"))
    at = lambda j: F.get("r", F.lit(j))
    out = []
    for k, (s, pairs) in enumerate(sets.items()):
        place = {c: j for j, c in enumerate(used[s])}
        own = lambda v, k=k: F.when(F.col("rows") == k, v)
        for a, b in pairs:
            x, y = at(place[a]), at(place[b])
            out.append(F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(own(F.lit(1))).cast("double").alias("n"),
                *[F.sum(own(v)).alias(name) for name, v in (("sa", x), ("sb", y), ("saa", x * x), ("sbb", y * y), ("sab", x * y))]))
    sums = ranked.agg(F.array(*out).alias("pairs")).select(F.inline("pairs")).where("n > 0")
    return sums.select(
        "a", "b", F.col("n").cast("bigint").alias("n"),
        _correlation(F.col("n"), F.col("sa"), F.col("sb"), F.col("saa"), F.col("sbb"), F.col("sab")).alias("r"),
    )
