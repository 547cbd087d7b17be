"""Exact order statistics of many columns by range refinement: no cell is moved, only sketches and counts are.

A pass gives every open range a quantile sketch, whose items name two values near the wanted rank. The next pass
counts exactly how many values lie below, at, between and above them, so a rank is only ever settled by counts, and
sketches the part that holds it. A pass leaves under one hundredth of a range open, so 10^12 values take about seven
passes over one stored table. What a task sends is bounded by the number of wanted ranks, not by its rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_SIZE = 2048  # rank error of about 0.0014
GRID = 1000  # quantiles read from a sketch
MARGIN = 0.003  # how far from the wanted rank the two values are taken
SLICES = 64  # tasks that merge the sketches of the scan before the last one does


@dataclass(frozen=True)
class Range:
    """Values of `column` strictly between `low` and `high` (None: no bound), and the part to look at."""

    column: str
    low: float | None
    high: float | None
    a: float | None = None
    b: float | None = None

    def inside(self) -> Column:
        v = F.col(self.column)
        held = v.isNotNull()
        if self.low is not None:
            held = held & (v > self.low)
        return held if self.high is None else held & (v < self.high)


@dataclass(frozen=True)
class Wanted:
    """The value at `place` (from 0) of the `n` sorted values of `range`."""

    range: Range
    n: int
    place: int


def order_statistics(table: DataFrame, places: dict[str, set[int]], known: dict[str, int]) -> dict[tuple[str, int], float]:
    """The values at the given places (from 0) of each sorted double column; `known` counts its values that are not NULL.

    `table` is read once per pass and must give the same values each time: pass a stored table.
    """
    found: dict[tuple[str, int], float] = {}
    still = {(c, p): Wanted(Range(c, None, None), known[c], p) for c, ps in places.items() for p in ps}
    while still:
        ranges = sorted({w.range for w in still.values()}, key=repr)
        counts = _count(table, ranges)
        left = {}
        for key, wanted in still.items():
            step = _narrow(wanted, *counts[wanted.range])
            if isinstance(step, Wanted):
                left[key] = step
            else:
                found[key] = step
        still = left
    return found


def _count(table: DataFrame, ranges: list[Range]) -> dict[Range, tuple[list[int], list[float] | None]]:
    """Per range: counts below a, at a, between, at b; and quantiles of what lies between (of the range without a)."""
    aggs: list[Column] = []
    for i, r in enumerate(ranges):
        v, inside = F.col(r.column), r.inside()
        if r.a is not None:
            for j, held in enumerate((v < r.a, v == r.a, (v > r.a) & (v < r.b), (v == r.b) & F.lit(r.a < r.b))):
                aggs.append(F.count_if(inside & held).alias(f"n{i}_{j}"))
        if r.a is None or r.a < r.b:
            open_ = inside if r.a is None else inside & (v > r.a) & (v < r.b)
            aggs.append(F.kll_sketch_agg_double(F.when(open_, v), F.lit(SKETCH_SIZE)).alias(f"s{i}"))
    sliced = table.groupBy((F.spark_partition_id() % SLICES).alias("slice")).agg(*aggs)
    counters = [c for c in sliced.columns if c.startswith("n")]
    sketches = [c for c in sliced.columns if c.startswith("s") and c != "slice"]
    merged = sliced.agg(*[F.sum(c).alias(c) for c in counters], *[F.kll_merge_agg_double(c).alias(c) for c in sketches])
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    row = merged.select(*counters, *[
        F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, grid)).alias(c) for c in sketches
    ]).first().asDict()
    out = {}
    for i, r in enumerate(ranges):
        out[r] = ([row[f"n{i}_{j}"] or 0 for j in range(4)] if r.a is not None else [], row.get(f"s{i}"))
    return out


def _narrow(wanted: Wanted, counts: list[int], quantiles: list[float] | None) -> Wanted | float:
    """The value wanted, or the smaller range that holds it."""
    r, place = wanted.range, wanted.place
    if r.a is None:
        return _aim(wanted, quantiles)
    below, at_a, between, at_b = counts
    if place < below:
        return Wanted(Range(r.column, r.low, r.a), below, place)
    place -= below
    if place < at_a:
        return r.a
    place -= at_a
    if place < between:
        return _aim(Wanted(Range(r.column, r.a, r.b), between, place), quantiles)
    place -= between
    if place < at_b:
        return r.b
    return Wanted(Range(r.column, r.b, r.high), wanted.n - sum(counts), place - at_b)


def _aim(wanted: Wanted, quantiles: list[float]) -> Wanted | float:
    """Choose the two values to count next. A sketch of few values holds them all and answers at once."""
    at = (wanted.place + 0.5) / wanted.n
    if wanted.n <= min(GRID // 2, SKETCH_SIZE):
        return quantiles[round(at * GRID)]
    a = quantiles[max(math.floor((at - MARGIN) * GRID), 0)]
    b = quantiles[min(math.ceil((at + MARGIN) * GRID), GRID)]
    return replace(wanted, range=replace(wanted.range, a=a, b=b))


def quantiles(table: DataFrame, probabilities: list[float], known: dict[str, int]) -> dict[str, list[float | None]]:
    """Per column of `known`: exact quantiles, interpolated between neighbours; None without values."""
    def ends(n: int, p: float) -> tuple[int, int, float]:
        at = (n - 1) * p
        return math.floor(at), math.ceil(at), at - math.floor(at)

    places: dict[str, set[int]] = defaultdict(set)
    for c, n in known.items():
        for p in probabilities if n else []:
            places[c].update(ends(n, p)[:2])
    found = order_statistics(table, places, known)
    out: dict[str, list[float | None]] = {}
    for c, n in known.items():
        out[c] = []
        for p in probabilities:
            if not n:
                out[c].append(None)
                continue
            low, high, part = ends(n, p)
            a, b = found[c, low], found[c, high]
            out[c].append(a if a == b else a + (b - a) * part)
    return out
