import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.functions import selection
from candor.operators.eda import column_profile

PROBABILITIES = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
COLUMNS = ["even", "ties", "two", "narrow", "wide", "holes", "none", "same", "edges"]


@pytest.fixture(scope="module")
def values(spark):
    """Spread, tied, skewed, missing and infinite values; 0 and -0 are one value."""
    i = F.col("id")
    step = (i * 7919) % 40009
    return spark.range(0, 40009, 1, 6).select(
        step.cast("double").alias("even"),
        (step % 7).cast("double").alias("ties"),
        F.when(step % 1000 == 0, step / 1e3).otherwise(F.when(step % 2 == 0, 3.0).otherwise(5.0)).alias("two"),
        (1e9 + step / 1e6).alias("narrow"),
        (F.pow(F.lit(-1.5), (step % 300).cast("double"))).alias("wide"),
        F.when(step % 3 == 0, (step % 811) - 400.0).when(step % 3 == 1, F.lit(float("nan"))).alias("holes"),
        F.lit(None).cast("double").alias("none"),
        F.lit(2.5).alias("same"),
        F.when(step % 400 == 0, float("inf")).when(step % 400 == 1, float("-inf")).when(step % 2 == 0, -0.0).otherwise(0.0).alias("edges"),
    )


def check(profile, pdf):
    rows = {r["column"]: r for r in profile.collect()}
    assert list(rows) == COLUMNS
    for c in COLUMNS:
        v = pdf[c].to_numpy(dtype=float)
        v = np.sort(v[~np.isnan(v)])
        assert (rows[c]["n_non_null"], rows[c]["n_null"]) == (len(v), len(pdf) - len(v))
        for p in PROBABILITIES:
            got = rows[c][f"p{round(p * 100):02d}"]
            if not len(v):
                assert got is None
                continue
            at = (len(v) - 1) * p
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert got == (low if low == high else low + (high - low) * (at - math.floor(at))), (c, p)


def test_quantiles_equal_sorting(spark, values):
    check(column_profile(values, COLUMNS, PROBABILITIES), values.toPandas())


def test_poor_sketches_cost_passes_not_exactness(spark, values, monkeypatch):
    """With eight-item sketches the chosen values often miss the rank; counts notice and the range is cut elsewhere."""
    monkeypatch.setattr(selection, "SKETCH_SIZE", 32)
    monkeypatch.setattr(selection, "GRID", 100)
    few = values.sample(False, 0.02, 3)
    pdf = few.toPandas()
    check(column_profile(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), values.schema), COLUMNS, PROBABILITIES), pdf)


def test_empty_table(spark, values):
    rows = column_profile(values.limit(0), COLUMNS, [0.5]).collect()
    assert [(r["n_non_null"], r["n_null"], r["mean"], r["p50"]) for r in rows] == [(0, 0, None, None)] * len(COLUMNS)
