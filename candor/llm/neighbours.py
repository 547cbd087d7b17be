"""Approximate nearest neighbours by cosine: multi-probe p-stable hashing, then exact distances.

Vectors are scaled to length one, where the order by cosine is the order by Euclidean distance. Each of
`tables` hash tables rounds `functions` Gaussian projections to cells of `width`; the cells of all functions
name a bucket. A query visits its own bucket and, table by table, the `probes - 1` perturbed buckets that are
most likely to hold its neighbours: sets of steps to a neighbouring cell in the order of their summed squared
distances to the cell borders (Lv et al. 2007). What the tables find is merged and ranked by the exact cosine
in double precision, computed in the same way for every pair, so equal vectors tie exactly.

Equal vectors are one class: of each, the index holds the k + 1 smallest ids, which are all that the k best of
any query can name, and equal queries are searched once, for the k + 1 best with themselves. The products of a
bucket are taken in blocks of BLOCK_PAIRS, however many queries visit it.

Buckets are dealt to groups of about `group_rows` index rows; a group that holds more (one bucket may hold
very many vectors) is split by vector, and its queries visit every split. Each group returns the best per
query, so no candidate list leaves a task. Queries that meet fewer than `k` others are compared with every
vector, group by group, so nothing is missing when there are few.

Vectors that are null, empty, zero or hold a null or non-finite component, and vectors of another length than
most, take no part; nor do rows with a null id. Rows that repeat an id count once (the larger vector in array
order). Ties go to the smaller id. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.common import attach, columns, parts_for, written

TABLES = 8
FUNCTIONS = 6
WIDTH = 1.5
PROBES = 128
GROUP_ROWS = 4096
BLOCK_PAIRS = 1 << 20
EXACT_PAIRS = 1 << 16
FOUND = "query_id long, vec_id long, score double"


def probe_sets(gaps: np.ndarray, width: float, probes: int) -> list[list[tuple[int, int]]]:
    """The `probes` most promising sets of (function, step) for a query `gaps` above its cells' lower borders."""
    steps = sorted([(g * g, i, -1) for i, g in enumerate(gaps)] + [((width - g) ** 2, i, 1) for i, g in enumerate(gaps)])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(steps):
            grown = cost + steps[last + 1][0]
            heapq.heappush(heap, (grown - steps[last][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (grown, (*chosen, last + 1)))
        moves = [steps[c][1:] for c in chosen]
        if len({i for i, _ in moves}) == len(moves):
            out.append(moves)
    return out


class Hashes:
    """The projections of all tables, drawn from a fixed seed."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.functions, self.width = tables, functions, width
        self.lines = rng.standard_normal((dim, tables * functions))
        self.shifts = rng.uniform(0, width, tables * functions)
        self.mix = rng.integers(1, 2**40, functions, dtype=np.int64) | 1

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and places above their lower borders, both of shape (rows, tables, functions)."""
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        at = (unit @ self.lines + self.shifts).reshape(len(vectors), self.tables, self.functions)
        cell = np.floor(at / self.width).astype(np.int64)
        return cell, at - cell * self.width

    def bucket(self, cell: np.ndarray) -> np.ndarray:
        """One number per row of cells; cells of unit vectors are small, so nothing overflows."""
        return (cell * self.mix).sum(-1)


def usable(vector: Column, dim: int | None = None) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        vector, lambda x: x != 0)
    ok = vector.isNotNull() & (F.size(vector) > 0) & fine
    return ok if dim is None else ok & (F.size(vector) == dim)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each with the same order of additions."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _exact(qs: np.ndarray, vs: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact cosines of the pairs (rows, cols), EXACT_PAIRS at a time."""
    cuts = range(0, len(rows), EXACT_PAIRS)
    return np.concatenate([np.zeros(0)] + [
        _cosines(qs[rows[i : i + EXACT_PAIRS]], vs[cols[i : i + EXACT_PAIRS]]) for i in cuts])


def best_pairs(
    q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, q_at: np.ndarray, v_at: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best vectors (rows v_at) of each query (rows q_at): fast products first, then exact for the near best."""
    vs, out = v[v_at], []
    ids_at, unit = v_ids[v_at], (vs / np.linalg.norm(vs, axis=1)[:, None]).T
    each = max(1, BLOCK_PAIRS // max(len(v_at), 1))
    for lo in range(0, len(q_at), each):
        own = q_at[lo : lo + each]
        qs = q[own]
        fast = (qs / np.linalg.norm(qs, axis=1)[:, None]) @ unit
        edge = np.partition(fast, -k, axis=1)[:, -k] if fast.shape[1] > k else np.full(len(fast), -2.0)
        rows, cols = np.nonzero(fast >= (edge - 1e-9)[:, None])
        score = _exact(qs, vs, rows, cols)
        ids = ids_at[cols]
        order = np.lexsort((ids, -score, rows))
        rows, ids, score = rows[order], ids[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append((q_ids[own][rows[keep]], ids[keep], score[keep]))
    return out


def _frame(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """One group's finds, cut to the k best per query."""
    if not parts:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    q, ids, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pd.DataFrame({"query_id": q[keep], "vec_id": ids[keep], "score": score[keep]})


def index(vectors: DataFrame, hashes: Hashes, groups: int) -> DataFrame:
    """`tab, grp, bucket, vec_id, vec`: every vector once per table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            bucket = hashes.bucket(hashes.cells(_matrix(f["vec"]))[0])
            for t in range(hashes.tables):
                yield pd.DataFrame({
                    "tab": np.int32(t), "grp": (bucket[:, t] % groups).astype(np.int32), "bucket": bucket[:, t],
                    "vec_id": f["vec_id"], "vec": f["vec"]})

    return vectors.mapInPandas(run, "tab int, grp int, bucket long, vec_id long, vec array<double>")


def probe(queries: DataFrame, hashes: Hashes, groups: int, probes: int) -> DataFrame:
    """`tab, grp, query_id, vec, buckets`: the buckets a query visits in one group, all in one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            cell, gap = hashes.cells(_matrix(f["vec"]))
            rows = []
            for i, (vec_id, vec) in enumerate(zip(f["vec_id"], f["vec"], strict=True)):
                for t in range(hashes.tables):
                    own, mix = int(hashes.bucket(cell[i, t])), hashes.mix.tolist()
                    sets = probe_sets(gap[i, t], hashes.width, probes)
                    visit = np.unique(np.array([own + sum(mix[j] * d for j, d in s) for s in sets], np.int64))
                    grp = visit % groups
                    for g in np.unique(grp):
                        rows.append((t, int(g), vec_id, vec, visit[grp == g]))
            yield pd.DataFrame(rows, columns=["tab", "grp", "query_id", "vec", "buckets"])

    return queries.mapInPandas(run, "tab int, grp int, query_id long, vec array<double>, buckets array<long>")


def _search(k: int):
    def one(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return _frame([], k)
        order = np.argsort(v["bucket"].to_numpy(), kind="stable")
        bucket = v["bucket"].to_numpy()[order]
        v_ids, vm = v["vec_id"].to_numpy()[order], _matrix(v["vec"])[order]
        q_ids, qm = q["query_id"].to_numpy(), _matrix(q["vec"])
        want = np.concatenate(q["buckets"].to_list())
        owner = np.repeat(np.arange(len(q)), [len(b) for b in q["buckets"]])
        by = np.argsort(want, kind="stable")
        want, owner = want[by], owner[by]
        parts = []
        for b in np.unique(bucket):
            q_at = owner[np.searchsorted(want, b) : np.searchsorted(want, b, "right")]
            v_at = np.arange(np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right"))
            if len(q_at):
                parts += best_pairs(q_ids, qm, v_ids, vm, q_at, v_at, k)
        return _frame(parts, k)

    return one


def _scan(k: int):
    def one(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return _frame([], k)
        return _frame(best_pairs(
            q["query_id"].to_numpy(), _matrix(q["vec"]), v["vec_id"].to_numpy(), _matrix(v["vec"]),
            np.arange(len(q)), np.arange(len(v)), k), k)

    return one


def few_copies(rows: DataFrame, n: int) -> DataFrame:
    """The rows with the `n` smallest ids of each class of equal vectors; no task meets all of a class."""
    place = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("vec_id")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n).drop("place")


def search(
    table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES,
    group_rows: int = GROUP_ROWS, seed: int = 5,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest other rows found for each query.

    `is_query` is a predicate on `vec_id`. Every usable row is indexed, by itself or by its class.
    """
    rows = columns(table, vec_id=id_col, vec=vector_col).withColumn("vec", F.col("vec").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    rows = written(rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.max("vec").alias("vec")), "vectors")
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dim, n = common
    rows = rows.where(F.size("vec") == dim)
    hashes = Hashes(dim, tables, functions, width, seed)
    groups = parts_for(n, group_rows)
    members = rows.where(is_query)
    classes = written(members.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("members")), "classes")
    queries = classes.select("vec_id", "vec")
    few = written(few_copies(rows, k + 1), "few")
    indexed = index(few, hashes, groups)
    sizes = indexed.groupBy("tab", "grp").count()
    large = written(
        sizes.where(F.col("count") > 4 * group_rows).select(
            "tab", "grp", F.ceil(F.col("count") / group_rows).cast("int").alias("splits")), "large")
    one = F.coalesce("splits", F.lit(1))
    split = F.pmod(F.xxhash64("vec_id"), one).cast("int")
    left = probe(queries, hashes, groups, probes).join(large, ["tab", "grp"], "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), one - 1))).drop("splits")
    right = indexed.join(large, ["tab", "grp"], "left").withColumn("part", split).drop("splits")
    keys = ["tab", "grp", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda q, v: _search(k + 1)(q, v), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def merged(pairs: DataFrame) -> DataFrame:
        once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)

    first = written(merged(found), "found")
    short = queries.join(
        first.where(F.col("rank") == min(k + 1, n)).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    short = written(short.select(F.col("vec_id").alias("query_id"), "vec"), "short")
    result = first
    if not short.isEmpty():
        block = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
        q = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        every = q.groupBy("block").cogroup(few.withColumn("block", block).groupBy("block")).applyInPandas(
            lambda a, b: _scan(k + 1)(a, b), FOUND)
        result = first.join(short.select("query_id"), "query_id", "left_anti").select("query_id", "vec_id", "score", "rank").unionByName(
            merged(every).select("query_id", "vec_id", "score", "rank"))
    best_of = result.groupBy(F.col("query_id").alias("class")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    own = classes.select("vec", F.col("vec_id").alias("class"), "members").join(best_of, "class")
    found = attach(members.select("vec", F.col("vec_id").alias("query_id")), written(own.drop("class"), "best"), "vec", "members")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return found.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
