"""Attach per-key statistics to rows when one key may own a large part of the table.

A plain join sends every row of a key to one task. Here the heaviest keys (at least `hot_rows` rows
each, at most `hot_keys` of them, so the broadcast has a fixed upper size) are answered from a
broadcast, and their rows, like rows with a NULL key, are spread evenly over the shuffle instead of
meeting in one task. All other keys take the ordinary shuffled join. No row is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
HOT_KEYS = 10_000


def attach_by_key(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    size: str,
    spread_by: list[str],
    null_safe: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """LEFT JOIN `rows` with `stats` (one row per key; column `size` holds the key's row count).

    Every column of `stats` except the keys is added, `size` included. Keys named in `null_safe` match
    NULL with NULL; a NULL in any other key matches nothing. Rows of hot keys and rows that match nothing
    are placed by the hash of `spread_by` and of the task that read them, so they spread even where those
    columns are NULL.
    """
    null_safe = null_safe or []

    def equal(k: str, left: Column, right: Column) -> Column:
        return left.eqNullSafe(right) if k in null_safe else left == right

    values = [c for c in stats.columns if c not in keys]
    packed = stats.select(*keys, F.struct(*values).alias("_stat"))
    hot = (
        packed.filter(F.col(f"_stat.{size}") >= hot_rows)
        .orderBy(F.col(f"_stat.{size}").desc(), *keys)
        .limit(hot_keys)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("_stat").alias("_hot_stat"))
    )
    on_hot = [equal(k, rows[k], F.col(f"_hot_{k}")) for k in keys]
    marked = rows.join(F.broadcast(hot), on_hot, "left").drop(*[f"_hot_{k}" for k in keys])
    no_match = F.col("_hot_stat").isNotNull()
    for k in keys:
        if k not in null_safe:
            no_match = no_match | F.col(k).isNull()
    marked = marked.withColumn(
        "_place", F.when(no_match, F.xxhash64(F.spark_partition_id(), *spread_by).bitwiseOR(F.lit(1))).otherwise(F.lit(None).cast("bigint"))
    )
    for k in keys:
        marked = marked.withColumn(f"_key_{k}", F.when(F.col("_place").isNull(), F.col(k)))
    # Always 0, but read from the row: the optimizer folds a literal, and the join would then shuffle by the keys
    # alone, with every hot and every NULL row in one task.
    zero = F.least(F.lit(0).cast("bigint"), F.coalesce(F.col(f"_stat.{size}").cast("bigint"), F.lit(0).cast("bigint")))
    cold = packed.select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys], F.col("_stat").alias("_cold_stat"), zero.alias("_cold_place")
    )
    condition = [equal(k, F.col(f"_key_{k}"), F.col(f"_cold_{k}")) for k in keys]
    condition.append(F.coalesce(F.col("_place"), F.lit(0).cast("bigint")) == F.col("_cold_place"))
    joined = marked.join(cold, condition, "left")
    stat = F.coalesce(F.col("_hot_stat"), F.col("_cold_stat"))
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[stat.getField(v).alias(v) for v in values],
    )
