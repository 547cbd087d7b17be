"""Merkle manifest of a dataset: a digest for every row, group and the whole, and a proof for every row.

A row's leaf is the hash of its columns, each length-prefixed, so no two rows share an input. Within a group
leaves ascend by id and get a rank; a node of level l covers the interval [lo, hi) of leaf ranks, 3^l wide but at
the end, and is the hash of the nodes of level l - 1 inside it. Groups' roots, in order of the group, are the
leaves of one more tree.

Levels are built six at a time: a task gets blocks of 3^6 consecutive units, whatever the size of a group, and
writes each family (the children of one node) as one row with its interval. The roots of blocks are the units of
the next six levels. A family is then joined with the families of the higher levels by group, level and number of
the interval (its bucket) where the interval contains its own; within such an ancestor, the children whose
intervals lie before or after it are its siblings there: the interval of the parent less the one that contains
it. Rows of a run share all that lies above them, so proofs are built per run of three and meet rows at the end.

Null columns count as `-`, a null group is a group of its own and comes first. Null ids come last, rows with one
id by their leaf, so repeated rows each have a place. Empty texts have length 0. Long texts are hashed once and do
not travel. An empty table gives no rows. A group of any size is many blocks. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import attach, columns, running_sum, written

FAN = 3
SPAN = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "key string, n long, block long, level int, bucket long, lo long, hi long, members array<string>"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that fields put in a row can be told apart."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row with these columns."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _levels(n: Column, span: int) -> Column:
    """How many of the next `span` levels a group of `n` units has."""
    return sum((F.when(n > FAN**l, 1).otherwise(0) for l in range(span)), F.lit(0))


def _families(units: DataFrame, span: int) -> DataFrame:
    """The families of `span` levels over `units` (key, n, rank, digest); the root of a block at level -1."""
    width = FAN**span

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, n = int(key[1]), int(rows["n"].iloc[0])
        nodes = rows.sort_values("rank")["digest"].tolist()
        out = []
        for level in range(span):
            if level and n <= FAN**level:
                break
            wide = FAN ** (level + 1)
            groups = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
            first = block * width // wide
            out += [(key[0], n, block, level, first + i, (first + i) * wide, min(n, (first + i + 1) * wide), g) for i, g in enumerate(groups)]
            if n > 1:
                nodes = [hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
        out.append((key[0], n, block, -1, block, block * width, min(n, (block + 1) * width), nodes))
        return pd.DataFrame(out, columns=["key", "n", "block", "level", "bucket", "lo", "hi", "members"])

    blocks = units.withColumn("block", F.expr(f"rank div {width}"))
    return written(blocks.groupBy("key", "block").applyInPandas(build, _NODES), "families")


def _beside(members: Column, lo: Column, hi: Column, wide: Column, at: Column) -> Column:
    """The digests of `members`, laid over [lo, hi) `wide` each, before and after the one that contains `at`."""
    spans = F.transform(members, lambda d, i: F.struct(
        d.alias("digest"), (lo + i * wide).alias("lo"), F.least(hi, lo + (i + 1) * wide).alias("hi")))
    return F.struct(
        F.array_join(F.transform(F.filter(spans, lambda s: s["hi"] <= at), lambda s: s["digest"]), "").alias("left"),
        F.array_join(F.transform(F.filter(spans, lambda s: s["lo"] > at), lambda s: s["digest"]), "").alias("right"))


def trees(units: DataFrame, span: int = SPAN) -> DataFrame:
    """The trees over `units` (`key`, not null; `n`, its number of units; `rank` from 0; `digest`).

    One row per run of three units: `key, n, run, members, above, root`; `above` has the siblings before and after
    the run (`left`, `right`) on each level over it, upwards.
    """
    width = FAN**span
    nodes = _families(units, span)
    runs = nodes.where("level = 0").select("key", "n", F.col("bucket").alias("run"), "block", "members")
    levels = F.explode(F.sequence(F.lit(1), _levels(F.col("n"), span) - 1))
    at = F.col("run") * FAN
    asked = runs.where(_levels(F.col("n"), span) > 1).select("key", "run", levels.alias("level")).select(
        "key", "run", "level", F.expr(f"{FAN} * run div cast(power({FAN}, level + 1) as bigint)").alias("bucket"))
    over = nodes.where("level > 0").select("key", "level", "bucket", "lo", "hi", "members")
    wide = F.pow(F.lit(FAN), F.col("level")).cast("long")
    found = asked.join(over, ["key", "level", "bucket"]).where((F.col("lo") <= at) & (at < F.col("hi")))
    above = found.select("key", "run", "level", _beside(F.col("members"), F.col("lo"), F.col("hi"), wide, at).alias("s")).groupBy("key", "run").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "s"))), lambda x: x["s"]).alias("above"))
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    low = runs.join(above, ["key", "run"], "left").withColumn("above", F.coalesce("above", none))
    tops = nodes.where("level = -1").select("key", F.col("n"), F.col("block").alias("rank"), F.col("members")[0].alias("digest"))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    if largest <= width:
        return low.join(tops.select("key", F.col("digest").alias("root")), "key").select("key", "n", "run", "members", "above", "root")
    high = trees(tops.withColumn("n", F.expr(f"(n + {width - 1}) div {width}")), span)
    high = written(high.withColumnsRenamed({"n": "blocks", "run": "part", "members": "others", "above": "far"}), "tops")
    joined = low.withColumn("part", F.expr(f"block div {FAN}")).join(high, ["key", "part"])
    return joined.select("key", "n", "run", "members", F.concat("above", _own("others", "blocks", "part", "block"), "far").alias("above"), "root")


def _own(members: str, n: str, run: str, rank: str) -> Column:
    """The lowest level of a unit's path: its run, or nothing if it is alone."""
    lo, one = F.col(run) * FAN, F.lit(1).cast("long")
    own = _beside(F.col(members), lo, F.least(F.col(n), lo + FAN), one, F.col(rank))
    return F.when(F.col(n) > 1, F.array(own)).otherwise(F.expr("cast(array() as array<struct<left: string, right: string>>)"))


def fold(start: Column, path: Column) -> Column:
    """The root that `start` and its siblings upwards give."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, upwards, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(
    docs: DataFrame, changed: Column | None = None, id_col: str = "doc_id", group_col: str = "source",
    fields: tuple[str, ...] = FIELDS, span: int = SPAN,
) -> DataFrame:
    """`id, leaf, changed, subroot, root, path` of every row.

    `changed` is a second digest of each row, carried along to be folded against the first one's path; by default
    it is the leaf. `path` has the siblings before and after (`left`, `right`) on each level, leaf to root.
    """
    own = leaf(*[F.col(f"`{f}`") for f in fields])
    group = F.col(f"`{group_col}`")
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("id"), field(group).alias("key"), group.isNotNull().alias("named"), group.cast("string").alias("group"),
        own.alias("leaf"), (own if changed is None else changed).alias("changed"), F.lit(1).alias("one"))
    leaves = written(leaves, "leaves")
    groups = leaves.groupBy("key", "named", "group").agg(F.count("*").alias("n"))
    ranked = written(running_sum(leaves, ["key", "id", "leaf"], "one", ["key"], "rank", leaves.count()), "ranked")
    sized = attach(ranked.select("key", "rank", F.col("leaf").alias("digest")), groups.select("key", "n"), "key", "n")
    runs = written(trees(sized, span), "runs")

    roots = runs.where("run = 0").select("key", F.col("root").alias("digest")).join(groups, "key").withColumn("one", F.lit(1))
    n_groups = groups.count()
    order = written(running_sum(roots, ["named", "group"], "one", [], "rank", n_groups), "groups")
    whole = written(trees(order.select(F.lit("").alias("key"), F.lit(n_groups).cast("long").alias("n"), "rank", "digest"), span), "whole")
    top = order.withColumn("part", F.expr(f"rank div {FAN}")).join(
        whole.select(F.col("run").alias("part"), F.col("n").alias("n_groups"), F.col("members").alias("others"), F.col("above").alias("far"), F.col("root").alias("whole")), "part")
    top = top.select("key", "n", F.concat(_own("others", "n_groups", "part", "rank"), "far").alias("far"), F.col("whole"))

    up = attach(runs.withColumnsRenamed({"n": "units", "root": "subroot"}), top, "key", "n")
    up = up.select("key", "run", "units", "members", F.concat("above", "far").alias("above"), "subroot", "whole")
    rows = ranked.withColumn("run", F.expr(f"rank div {FAN}")).join(up, ["key", "run"])
    return rows.select(
        "id", "leaf", "changed", "subroot", F.col("whole").alias("root"),
        F.concat(_own("members", "units", "run", "rank"), "above").alias("path"))


def verified(rows: DataFrame) -> DataFrame:
    """A manifest's rows with `folded_root`, what the changed leaf and the path give, and whether it is the root."""
    folded = rows.withColumn("folded_root", fold(F.col("changed"), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_of(docs: DataFrame, **names: str) -> DataFrame:
    """`manifest` of a table whose columns have other names than `FIELDS`."""
    return manifest(columns(docs, **names))
