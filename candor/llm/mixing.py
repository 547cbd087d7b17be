"""Mix sources to target weights: how many words of every document the mix takes.

Each source gets a share of the mix by weight, never more than `most` times its own size; what is left over
is shared again by weight among the others until no source is above. Inside a source the documents stand in
the order of a hash-random key; a range sort deals them over many tasks, prefix sums of their sizes are
added across tasks, and the source is cut at its exact budget: whole epochs first, then the documents that
lie before the cut, the last one in part.

Size is the number of words. Null texts have size 0. Sources are ordered by code point, null last, and a
null source is a source like any other. Documents that tie (repeated rows) are ordered by their size and
are otherwise alike. An empty table gives no rows; a mix of empty documents takes nothing. Other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import WORD, attach, columns, running_sum, spare, written

WEIGHTS = [3, 1, 2]


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: list[int] | None = None) -> DataFrame:
    """`source, source_size, target` from one row per source (`source, source_size`).

    Only four numbers per round reach the driver, however many sources there are.
    """
    weights = weights or WEIGHTS
    n = sizes.count()
    ranked = running_sum(sizes.withColumn("_one", F.lit(1)), ["source"], "_one", [], "_rank", n).drop("_one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most), "sources")
    level, full_before = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_cap") <= F.lit(level) * F.col("_w")
        everything, capped, open_weight, n_full = ranked.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("_cap")).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("_w"))), F.sum(full.cast("int")),
        ).first()
        if n_full == full_before or not open_weight:
            break
        full_before, level = n_full, (share * everything - capped) / open_weight
    even = F.col("_cap").cast("double") if level is None else F.least(
        F.col("_cap").cast("double"), F.lit(float(level)) * F.col("_w"))
    return ranked.select("source", "source_size", even.alias("target"))


def mix(
    docs: DataFrame, share: float = 1.5, most: int = 2, weights: list[int] | None = None, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of `docs`: `doc_id, size, source, source_size, target, before, taken`.

    `before` is the number of words of the source that stand before the document in its random order.
    """
    rows = columns(docs, doc_id=id_col, text=text_col, source=source_col)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = written(rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key")), "sized")
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    plan = targets(sums, share, most, weights)
    placed = running_sum(sized, ["source", "_key", "size"], "size", ["source"], "before", sized.count())
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("_docs"))
    both = attach(
        placed.withColumn("_name", named),
        written(plan.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
            named.alias("_name"), "source_size", "target", "_docs"), "plan"),
        "_name", "_docs",
    )
    budget = F.floor(F.col("target") + 1e-6)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return both.select(
        "doc_id", "size", "source", "source_size", "target", "before", taken.cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, share: float = 1.5, most: int = 2, weights: list[int] | None = None, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of `docs` the mix takes, with all their columns, as often as it takes them.

    Whole documents only: the one the budget cuts is taken if at least half of it is. Documents without words
    cost nothing and stay once. Rows that repeat an id share what the mix takes of that id.
    """
    got = mix(docs, share, most, weights, seed, id_col, text_col, source_col)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1)
    n, k, key = spare(docs, "_times", "_copy", "_key")
    per = got.groupBy(F.col("doc_id").alias(key)).agg(F.floor(F.sum(times) / F.count(F.lit(1)) + 0.5).cast("int").alias(n)).where(f"{n} > 0")
    both = docs.join(per, docs[id_col].eqNullSafe(F.col(key)))
    return both.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
