"""Helpers shared by the corpus operators.

Words everywhere are maximal runs of characters other than space, tab, line feed, vertical tab, form
feed and carriage return. Scratch tables go to the folder in `spark.checkpoint.dir`, so a lost executor
never recomputes past them; they are plain Parquet and may be deleted once the result is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import TypeVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.session import ensure_checkpoint_dir

T = TypeVar("T")
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet under the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """`rows` JOIN `groups` (one row per `key`, which is not null; `size` counts the group's rows).

    Groups with at least 1/`share` of all rows, of which there are at most `share`, are answered from a
    broadcast, so their rows are not shuffled. All others take the ordinary join.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * share >= total
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    from_hot = rows.join(F.broadcast(hot), key)
    from_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return from_hot.unionByName(from_cold)


def running_sum(
    rows: DataFrame, order: list[str], value: str, within: list[str], out: str, n_rows: int, each: int = 100_000
) -> DataFrame:
    """Add `out`: the sum of `value` over the earlier rows of the same `within` group in `order`.

    `order` starts with `within`. Rows are dealt by range of `order`, so a large group spans many tasks;
    each task sums its own rows and the totals of the tasks before it are added.
    """
    cols = [F.col(c).asc_nulls_last() for c in order]
    ranged = written(
        rows.repartitionByRange(parts_for(n_rows, each), *cols).withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    inside = Window.partitionBy("_part", *within).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part", *within).agg(F.sum(value).alias("_total")).select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_w_{c}") for c in within],
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on: Column = F.col("_part") == F.col("_p")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    joined = summed.join(offsets, on)
    return joined.select(*rows.columns, (F.col("_inside") + F.col("_offset")).alias(out))


_KEPT: dict[tuple, object] = {}


def kept(owner: str, make: Callable[..., T], *args) -> T:
    """`make(*args)`, kept in this worker process for the next tasks of `owner`; what others kept goes.

    Worker processes outlive a stage, so what one operator keeps would stand in the way of the next one.
    """
    release(owner)
    if (owner, *args) not in _KEPT:
        _KEPT[owner, *args] = make(*args)
    return _KEPT[owner, *args]


def release(but: str = "") -> None:
    """Drop what operators other than `but` keep in this worker process."""
    for key in [k for k in _KEPT if k[0] != but]:
        del _KEPT[key]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word. Nothing is kept: a memo of words costs more time than hashing anew, and memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values, so that any bits of the result can serve as a bucket."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, as bytes behind their lengths and types."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(2, "little") + head + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:2], "little")
    at, out = 2 + n, []
    for kind, size in (x.split(",") for x in blob[2:at].decode().split(";")):
        a = np.frombuffer(blob, np.dtype(kind), int(size), at)
        at += a.nbytes
        out.append(a)
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds `a`."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """`node`, `component` for every node of `links` (a, b): the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, then the label's own label, and is written
    out; paths of length n need about log n rounds. Labels meet links in shuffled joins that Spark may
    split, and minima are combined in the map tasks, so a node with very many links is no hot spot.
    """
    edges = written(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        far = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("far")
        )
        near = labels.join(far, "a").select("a", F.col("label").alias("was"), F.least("label", "far").alias("label"))
        up = labels.select(F.col("a").alias("label"), F.col("label").alias("up"))
        new = written(
            near.join(up, "label", "left").select("a", "was", F.least("label", F.coalesce("up", "label")).alias("label")),
            "labels",
        )
        labels = new.select("a", "label")
        if new.where("was <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def columns(df: DataFrame, **want: str) -> DataFrame:
    """Only the named columns, under the operator's own names; anything else in `df` plays no part."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in want.items()])


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of `df` has."""
    taken: Iterable[str] = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out

