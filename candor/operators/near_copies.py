"""Near-duplicate texts within a product, exact and without emitting pairs.

Equal texts are folded first, so a large group of copies is one row with a count. Products with few
distinct texts are one block, and where every product has few reviews these are dealt by product at once. Larger ones are cut into tiles of bounded size by text length (only equal
and neighbouring length classes can match) and by hash; a block is a pair of compatible tiles, so no
task ever holds more than two tiles and a hot product spreads over many tasks. Before the texts of a large
product travel, sketches of their pieces are compared, many tiles at a time, and a text only goes to the blocks
where some other text may be near it. Blocks return one row per matched text, not per matched pair.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.fixed_values import NEAR_DUPLICATE_RATIO
from candor.functions.columns import text_key
from candor.functions.similarity import Block, Sketches, joined, seeds, sketch_kinds, sketches
from candor.functions.skew import attach_by_key
from candor.operators.products import GROUP, join_by_product
from candor.session import cut_lineage, stored

TILE = 256
BLOCK = [*GROUP, "kind", "class", "i", "j"]
COARSE = 16  # tiles whose sketches are compared by one task
RUN_TEXTS, RUN_CHARS, RUN_PAIRS = 8192, 1 << 20, 1 << 20  # blocks compared at once, unless one block alone is larger
OUT = "platform string, product_id string, text_id binary, before string, after string, pairs long, other binary, n long"


def place() -> Column:
    """Text that sorts like (review_date, review_id), undated reviews first. No place begins another one."""
    date = F.coalesce(F.date_format("review_date", "yyyyMMddHHmmssSSSSSS"), F.lit(""))
    return F.concat(date, F.lit("|"), F.translate(F.coalesce(F.col("review_id"), F.lit("")), "|", "}"), F.lit("|"))


def sequence(text_id: Column) -> Column:
    """The place of a review; equal places are split by text."""
    return F.concat(place(), F.coalesce(F.hex(text_id), F.lit("")))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("text").isNotNull()).select(
        *GROUP, text_key(F.col("text")).alias("text_id"), "text", place().alias("place"))


def _fold(texts: DataFrame, *keys: str) -> DataFrame:
    return texts.groupBy(*keys, *GROUP, "text_id").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(product, text_id): one row per distinct stripped text, with its copies and first and last place."""
    return _fold(_texts(rows))


def _length_class(text: Column, threshold: float) -> Column:
    """Texts whose lengths allow the threshold lie in the same or in neighbouring classes."""
    return F.floor(F.ln(F.greatest(F.length(F.lower(text)), F.lit(1))) / _widest(threshold)).cast("int")


def _widest(threshold: float) -> float:
    return math.log((2 - threshold) / threshold) * 1.001


def _tiled(texts: DataFrame, threshold: float, tile: int, **skew: int) -> DataFrame:
    """Each text with its length class and tile, the tiles of its class and its neighbours, and whether its product is `whole`: one block."""
    placed = texts.withColumn("class", _length_class(F.col("text"), threshold))
    size = placed.groupBy(*GROUP, "class").agg(F.count(F.lit(1)).alias("m"))
    by_class = Window.partitionBy(*GROUP).orderBy("class")
    every = Window.partitionBy(*GROUP)
    neighbour = lambda shift, step: F.when(
        shift("class").over(by_class) == F.col("class") + step, F.ceil(shift("m").over(by_class) / tile)
    )
    plan = size.select(
        *GROUP, "class", "m", (F.sum("m").over(every) <= tile).alias("whole"), F.ceil(F.col("m") / tile).alias("own"),
        F.coalesce(neighbour(F.lag, -1), F.lit(0)).alias("prev"), F.coalesce(neighbour(F.lead, 1), F.lit(0)).alias("next"),
    )
    return attach_by_key(placed, plan, [*GROUP, "class"], "m", ["text_id"], null_safe=GROUP, **skew).withColumn(
        "tile", F.pmod(F.xxhash64("text_id"), F.col("own"))
    )


def _units() -> Column:
    """The pairs of coarse tiles a text takes part in, as (kind, class, i, j, side)."""
    coarse = lambda n: F.ceil(F.col(n) / COARSE)
    c, t = F.col("class"), F.floor(F.col("tile") / COARSE)
    unit = lambda kind, of, i, j, side: F.struct(
        F.lit(kind).alias("kind"), of.cast("int").alias("class"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"),
        F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"),
    )
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(
        F.array().cast("array<bigint>"))
    same = F.transform(
        up_to(coarse("own")),
        lambda j: unit("same", c, F.least(t, j), F.greatest(t, j), F.when(j == t, 0).when(t < j, 1).otherwise(2)),
    )
    upper = F.transform(up_to(coarse("next")), lambda j: unit("next", c, t, j, 1))
    lower = F.transform(up_to(coarse("prev")), lambda j: unit("next", c - 1, j, t, 2))
    return F.concat(same, upper, lower)


SKETCHED = "platform string, product_id string, text_id binary, class int, own long, prev long, next long, tile long, " \
    "length long, seeds long, kind_own long, kind_below long, sketch_own binary, sketch_below binary"


def _sketched(tiled: DataFrame, threshold: float, autojunk: bool) -> DataFrame:
    """The sketches of the texts: one for its own length class, and one for the class below if that takes another."""
    columns = [*GROUP, "text_id", "class", "own", "prev", "next", "tile"]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            texts = [t.lower() for t in pdf["text"].tolist()]
            codes, length = joined(texts)
            ends = np.cumsum(length)
            shortest = lambda c: np.floor(np.exp(c * _widest(threshold))).astype(np.int64)
            own = sketch_kinds(shortest(pdf["class"].to_numpy()), autojunk)
            below = sketch_kinds(shortest(pdf["class"].to_numpy() - 1), autojunk)
            made = {"own": [None] * len(pdf), "below": [None] * len(pdf)}
            for name, kinds, wanted in (("own", own, np.ones(len(pdf), bool)), ("below", below, (below != own) & (pdf["prev"].to_numpy() > 0))):
                for kind in np.unique(kinds[wanted]).tolist():
                    at = np.flatnonzero(wanted & (kinds == kind))
                    rows = sketches(np.concatenate([codes[ends[k] - length[k]: ends[k]] for k in at]), length[at], kind)
                    for k, row in zip(at.tolist(), rows):
                        made[name][k] = row.tobytes()
            yield pdf[columns].assign(
                length=length, seeds=seeds(codes, length, autojunk), kind_own=own, kind_below=below, sketch_own=made["own"], sketch_below=made["below"])

    return tiled.select(*columns, "text").mapInPandas(sketch, SKETCHED)


FLAGGED = "platform string, product_id string, kind string, class int, i long, j long, side int, text_id binary"


def _flagged(tiled: DataFrame, threshold: float, autojunk: bool) -> DataFrame:
    """(block, side, text_id): the texts that may be near another text of the block."""
    u = F.col("u")
    below = (u["class"] < F.col("class")) & F.col("sketch_below").isNotNull()
    units = _sketched(tiled, threshold, autojunk).withColumn("u", F.explode(_units())).select(
        *GROUP, u["kind"].alias("kind"), u["class"].alias("class"), u["i"].alias("i"), u["j"].alias("j"), u["side"].alias("side"),
        "text_id", "tile", "length", "seeds", F.when(u["class"] < F.col("class"), F.col("kind_below")).otherwise(F.col("kind_own")).alias("sketched"),
        F.when(below, F.col("sketch_below")).otherwise(F.col("sketch_own")).alias("sketch"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        length, tile, side = (pdf[c].to_numpy() for c in ("length", "tile", "side"))
        bits = np.frombuffer(b"".join(pdf["sketch"].tolist()), np.uint8).reshape(len(pdf), -1)
        sketch = Sketches(bits, length, pdf["seeds"].to_numpy(), int(pdf["sketched"].iloc[0]), threshold)
        m, two = len(pdf), int(np.searchsorted(side, 2))
        local = tile % COARSE
        met = np.zeros((m, COARSE), bool)  # whether a text may be near one of these tiles of the other side
        for k in range(two):
            found = sketch.partners(k, k + 1 if side[k] == 0 else two, m)
            if len(found):
                met[k, local[found]] = True
                met[found, local[k]] = True
        row, other = np.nonzero(met)
        own, other = tile[row], tile[row] // COARSE * COARSE + other if side[0] == 0 else _across(pdf, side, row, other)
        same = pdf["kind"].iloc[0] == "same"
        first = own <= other if same else side[row] == 1
        out = pdf[[*GROUP, "kind", "class"]].iloc[row].reset_index(drop=True)
        return out.assign(
            i=np.where(first, own, other), j=np.where(first, other, own),
            side=np.where(same & (own == other), 0, np.where(first, 1, 2)).astype(np.int32), text_id=pdf["text_id"].iloc[row].tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_blocks(batches, BLOCK):
            if len(pdf) > 1:
                yield compare(pdf)

    return units.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "side", "length").mapInPandas(run, FLAGGED)


def _across(pdf: pd.DataFrame, side: np.ndarray, row: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The tiles of the other coarse tile of a block."""
    i, j = (int(pdf[c].iloc[0]) for c in ("i", "j"))
    return np.where(side[row] == 1, j, i) * COARSE + other


def _whole_blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """One frame per block of sorted batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if len(pdf) == 0:
            continue
        starts = [*_starts(pdf, keys), len(pdf)]
        for lo, hi in zip(starts[:-1], starts[1:]):
            part = pdf.iloc[lo:hi]
            if held and not _same_key(held[-1], part, keys):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _same_key(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    return all(a[k].iloc[-1] == b[k].iloc[0] or (pd.isna(a[k].iloc[-1]) and pd.isna(b[k].iloc[0])) for k in keys)


def blocks(texts: DataFrame, threshold: float, tile: int = TILE, autojunk: bool = True, **skew: int) -> DataFrame:
    """Each text once per block where it may have a near copy: (product, block, side). `texts` is read twice: pass a stored table."""
    tiled = _tiled(texts, threshold, tile, **skew)
    columns = ["text_id", "text", "n", "first", "last"]
    whole = tiled.filter("whole").select(
        *GROUP, F.lit("whole").alias("kind"), F.lit(0).alias("class"), F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"),
        F.lit(0).alias("side"), *columns)
    flagged = _flagged(tiled.filter("NOT whole"), threshold, autojunk)
    renamed = texts.select(*[F.col(c).alias(f"_{c}") for c in [*GROUP, *columns]])
    on = [flagged[g].eqNullSafe(renamed[f"_{g}"]) for g in GROUP] + [flagged["text_id"] == renamed["_text_id"]]
    return whole.unionByName(flagged.join(renamed, on).select(*BLOCK, "side", *[F.col(f"_{c}").alias(c) for c in columns]))


def _pairs(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that one block compares."""
    last = np.repeat(ends, ends - starts)
    i = np.arange(starts[0], ends[-1])
    partners = last - i - 1
    left = np.repeat(i, partners)
    right = np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners) + left + 1
    a, b = side[left], side[right]
    keep = ((a == 0) & (b == 0)) | (a * b == 2)
    return left[keep], right[keep]


def _runs(starts: np.ndarray, ends: np.ndarray, chars: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive blocks to compare at once: as many as stay within the bounds, at least one."""
    size = ends - starts
    total = np.concatenate([[0], np.cumsum(chars)])
    costs = [(np.cumsum(c), limit) for c, limit in (
        (size, RUN_TEXTS), (total[ends] - total[starts], RUN_CHARS), (size * (size - 1) // 2, RUN_PAIRS))]
    lo = 0
    while lo < len(starts):
        hi = min(int(np.searchsorted(c, (c[lo - 1] if lo else 0) + limit, side="right")) for c, limit in costs)
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)


def _match_blocks(text_id, text, n, first, last, side, starts, ends, threshold: float, autojunk: bool) -> list[tuple]:
    """Matched texts of some blocks as (row, before, after, pairs, other).

    `before` is the last place up to which the text has a later near copy, `after` the first place from
    which it has an earlier one; `pairs` counts review pairs. Where only one order of two interleaved
    texts matches, `other` names the later text and the pairs are counted from the rows afterwards.
    """
    base = int(starts[0])
    block = Block(text[base: ends[-1]], threshold, autojunk)
    left, right = _pairs(starts - base, ends - base, side[base: ends[-1]])
    keep = np.flatnonzero(block.enough_characters(left, right))
    keep = keep[block.share_pieces(left[keep], right[keep])]
    found: dict[int, list] = {}
    extra: list[tuple[int, int]] = []
    sequence = lambda places, k: places[k] + bytes(text_id[k]).hex().upper()

    def mark(earlier: int, later: int) -> None:
        a, b = found.setdefault(earlier, ["", None, 0]), found.setdefault(later, ["", None, 0])
        a[0] = max(a[0], sequence(last, later))
        b[1] = sequence(first, earlier) if b[1] is None else min(b[1], sequence(first, earlier))

    for i, j in zip(left[keep].tolist(), right[keep].tolist()):
        if not block.worth_testing(i, j):
            continue
        x, y = base + i, base + j
        if sequence(first, y) < sequence(first, x):
            i, j, x, y = j, i, y, x
        in_order, out_of_order = sequence(first, x) < sequence(last, y), sequence(first, y) < sequence(last, x)
        forward = in_order and block.near(i, j)
        backward = out_of_order and block.near(j, i)
        if forward:
            mark(x, y)
        if backward:
            mark(y, x)
        if in_order and out_of_order and forward != backward:
            extra.append((x, y) if forward else (y, x))
        elif forward or backward:
            found[x][2] += n[x] * n[y]
    return [(k, *v, None) for k, v in found.items()] + [(a, "", None, 0, text_id[b]) for a, b in extra]


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the sorted rows begin a new block."""
    new = np.ones(len(pdf), bool)
    new[1:] = False
    for k in keys:
        c = pdf[k].to_numpy()
        new[1:] |= (c[1:] != c[:-1]).astype(bool)
    return np.flatnonzero(new)


def _crowded(rows: DataFrame, tile: int) -> bool:
    """Whether a product has more reviews with text than fit into one tile."""
    return not rows.groupBy(*GROUP).agg(F.count("text").alias("n")).filter(F.col("n") > tile).isEmpty()


def near_texts(
    rows: DataFrame, threshold: float = NEAR_DUPLICATE_RATIO, autojunk: bool = True, tile: int = TILE, **skew: int
) -> DataFrame:
    """One row per text that has a near copy, plus one row per one-way pair of interleaved texts.

    Blocks are shuffled by their key and read in sorted order; a task holds one block and one batch at a time.
    The matches are written to the checkpoint folder, as all that uses them reads them several times.
    """
    if _crowded(rows, tile):
        texts = stored(distinct_texts(rows), "near-texts")
        keys, folded = BLOCK, blocks(texts, threshold, tile, autojunk, **skew).repartition(*BLOCK)
    else:
        # The texts of a product are folded where they meet. The second shuffle by the same key costs nothing: Spark leaves it out.
        dealt = _texts(rows).withColumn("product", F.xxhash64(*GROUP)).repartition("product")
        keys, folded = ["product", *GROUP], _fold(dealt, "product").repartition("product")

    def solve(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        several = ends - starts > 1
        starts, ends = starts[several], ends[several]
        out = []
        if len(starts):
            rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)])  # without the blocks of one text
            pdf, ends = pdf.iloc[rows], np.cumsum(ends - starts)
            starts = np.concatenate([[0], ends[:-1]])
            platform, product, text_id, text, n, first, last = (
                pdf[c].tolist() for c in (*GROUP, "text_id", "text", "n", "first", "last"))
            side = pdf["side"].to_numpy() if "side" in pdf else np.zeros(len(pdf), np.int64)
            chars = np.array([len(t) for t in text])
            for lo, hi in _runs(starts, ends, chars):
                for k, before, after, pairs, other in _match_blocks(
                        text_id, text, n, first, last, side, starts[lo:hi], ends[lo:hi], threshold, autojunk):
                    out.append((platform[k], product[k], text_id[k], before, after, pairs, other, n[k]))
        return pd.DataFrame(out, columns=[*GROUP, "text_id", "before", "after", "pairs", "other", "n"])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            starts = _starts(pdf, keys)
            yield solve(pdf, starts[:-1], starts[1:])
            held = pdf.iloc[starts[-1]:]
        if held is not None:
            yield solve(held, np.array([0]), np.array([len(held)]))

    return cut_lineage(folded.sortWithinPartitions(*keys).mapInPandas(match, OUT))


def pair_counts(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """(product, found): pairs of reviews whose texts are near copies, for products that have some matched text."""
    direct = matches.groupBy(*GROUP).agg(F.sum("pairs").alias("found"))
    one_way = matches.filter(F.col("other").isNotNull())
    if one_way.isEmpty():
        return direct
    later = _ordered_pairs(rows, one_way).withColumnRenamed("pairs", "found")
    return direct.unionByName(later).groupBy(*GROUP).agg(F.sum("found").alias("found"))


def near_pairs(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """(product, near_duplicate_pairs): pairs of reviews, i before j, whose texts are near copies; 0 where none are."""
    pairs = F.coalesce("found", F.lit(0).cast("long")).alias("near_duplicate_pairs")
    return join_by_product(rows.select(*GROUP).distinct(), pair_counts(rows, matches)).select(*GROUP, pairs)


def _ordered_pairs(rows: DataFrame, one_way: DataFrame) -> DataFrame:
    """Row pairs (earlier text first) of the one-way pairs, counted by slices of the order.

    Slices are prefixes of the place, so they are ordered; pairs across slices come from slice totals,
    pairs inside a slice from a running count.
    """
    seq = rows.filter(F.col("text").isNotNull()).select(
        *[F.col(g).alias(f"_{g}") for g in GROUP], place().alias("_place"), text_key(F.col("text")).alias("_t")).withColumn(
        "seq", F.concat("_place", F.hex("_t"))).drop("_place")
    sides = one_way.select(
        *GROUP, "text_id", "other",
        F.explode(F.array(
            F.struct(F.col("text_id").alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b")),
            F.struct(F.col("other").alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b")),
        )).alias("s"),
    )
    on = [sides[g].eqNullSafe(seq[f"_{g}"]) for g in GROUP] + [F.col("s.t") == F.col("_t")]
    marked = sides.join(seq, on).select(
        *GROUP, "text_id", "other", F.col("s.a").alias("a"), F.col("s.b").alias("b"), "seq", F.left("seq", F.lit(8)).alias("slice"))
    key = [*GROUP, "text_id", "other"]
    running = Window.partitionBy(*key, "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("earlier", F.coalesce(F.sum("a").over(running), F.lit(0))).groupBy(*key, "slice").agg(
        F.sum(F.col("b") * F.col("earlier")).alias("inside"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    across = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return inside.withColumn("pairs", F.col("inside") + F.col("b") * F.coalesce(F.sum("a").over(across), F.lit(0))).groupBy(
        *GROUP).agg(F.sum("pairs").alias("pairs"))


def near_bounds(matches: DataFrame) -> DataFrame:
    """(product, text_id): its copies, the last place before and the first place after which a review of the text has a near copy."""
    return matches.filter(F.col("other").isNull()).groupBy(*GROUP, "text_id").agg(
        F.max("before").alias("before"), F.min("after").alias("after"), F.max("n").alias("n"))


def is_near() -> Column:
    """The review has a near copy among the product's other reviews. Needs `text_id` and its bounds."""
    seq = sequence(F.col("text_id"))
    return F.coalesce(seq < F.col("before"), F.lit(False)) | F.coalesce(seq > F.col("after"), F.lit(False))


def with_near_flag(rows: DataFrame, matches: DataFrame, **skew: int) -> DataFrame:
    """Add `near`: the review has a near copy among the product's other reviews."""
    keyed = rows.withColumn("text_id", F.when(F.col("text").isNotNull(), text_key(F.col("text"))))
    out = attach_by_key(keyed, near_bounds(matches), [*GROUP, "text_id"], "n", ["review_id", "reviewer_id", "review_date"], null_safe=GROUP, **skew)
    return out.withColumn("near", is_near()).select(*rows.columns, "near")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
