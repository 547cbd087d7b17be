"""Streaming forms of the chunk loops: first-seen filters, running counters, burst windows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from candor.operators.dedup import keep_first
from candor.session import ensure_checkpoint_dir


def first_seen(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within `delay`. State is bounded by the watermark, so a repeat
    later than that passes; `first_seen_exactly` is the exact form."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def running_counters(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mergeable running statistics per source."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def bursts(rows: DataFrame, group: list[str], time: str, width: str = "1 day", delay: str = "1 hour", at_least: int = 3,
           slide: str | None = None) -> DataFrame:
    """Windows in which one product or reviewer has at least `at_least` rows."""
    window: Column = F.window(time, width, slide) if slide else F.window(time, width)
    counts = rows.withWatermark(time, delay).groupBy(window.alias("w"), *group).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= at_least).select(
        *group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def read_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream the Parquet files of `folder` that match `name`."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available, then return the result table.

    Append streams use the Parquet sink; aggregates in complete mode replace one Parquet table per
    batch. Results and the query checkpoint live in the shared checkpoint folder.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def append_batches(stream: DataFrame, base: str, step) -> None:
    """Process everything available; `step(batch, batch_id)` writes under `base`, where the query's progress is kept too.

    A batch that is run again, after a lost driver or executor, gets the same id and the same rows, so a step that
    overwrites `batch=<id>` folders and reads only smaller ids gives the same tables again. A later call with the
    same `base` goes on where the last one ended.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(step).start().awaitTermination()


def earlier_batches(spark: SparkSession, path: str, schema: StructType, batch_id: int | None = None) -> DataFrame:
    """The rows of a table of `batch=<id>` folders, or those written before `batch_id`; empty before the first batch.

    Only folders of smaller ids are listed for reading, so what a failed try of this batch left is not seen.
    """
    if not folder_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType(schema.fields + [StructField("batch", LongType())])).parquet(path)
    return (rows if batch_id is None else rows.filter(F.col("batch") < batch_id)).drop("batch")


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_seen_exactly(stream: DataFrame, keys: list[str], order: list[str], base: str) -> DataFrame:
    """The first row of every key in order of arrival, by `order` (total) inside a batch; repeats never pass, however late.

    A batch is cut to one row per key, which Spark does in the scan tasks, and meets the keys of earlier batches in an
    anti join; so no key's rows gather in one task, and no state grows in memory. What a batch pays for exactness is
    one scan of the keys given out before, without the rest of their rows: choose few large batches. NULL keys are equal.
    """
    spark, out = stream.sparkSession, f"{base}/out"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = earlier_batches(spark, out, stream.schema, batch_id).select(*[F.col(k).alias(f"_{k}") for k in keys])
        new = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        rows = keep_first(batch, keys, order).join(seen, new, "left_anti")
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    append_batches(stream, base, step)
    return earlier_batches(spark, out, stream.schema)


def burst_windows(stream: DataFrame, group: list[str], time: str, base: str, width: str = "1 day",
                  delay: str = "1 hour", at_least: int = 3) -> DataFrame:
    """(group…, start, end, n, n_late, final): every window with at least `at_least` rows, open ones included.

    A window is final once a row at least `delay` after its end has arrived. Rows that come for a window that was
    final before their batch are counted all the same, and again in `n_late`, so a reader can tell corrected windows.
    Every batch adds its own counts per window; the sum over batches is the answer, whatever the order of arrival.
    Rows without a time take no part.
    """
    spark, counts, clock = stream.sparkSession, f"{base}/counts", f"{base}/clock"
    tick = StructType([StructField("last", TimestampType())])
    wait = F.expr(f"INTERVAL {delay}")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = earlier_batches(spark, clock, tick, batch_id).agg(F.max("last")).scalar()
        rows = batch.filter(F.col(time).isNotNull()).select(*group, F.window(time, width).alias("w"), F.col(time).alias("_t"))
        late = F.coalesce(F.col("w.end") + wait <= before, F.lit(False))
        rows.groupBy(*group, "w").agg(F.count(F.lit(1)).alias("n"), F.max("_t").alias("last")).select(
            *group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n",
            F.when(late, F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("n_late"), "last",
        ).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")
        written = spark.read.schema(tick).parquet(f"{counts}/batch={batch_id}")
        written.agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{clock}/batch={batch_id}")

    append_batches(stream, base, step)
    schema = StructType([stream.schema[g] for g in group] + [
        StructField("start", TimestampType()), StructField("end", TimestampType()),
        StructField("n", LongType()), StructField("n_late", LongType())])
    last = earlier_batches(spark, clock, tick).agg(F.max("last")).scalar()
    return earlier_batches(spark, counts, schema).groupBy(*group, "start", "end").agg(
        F.sum("n").alias("n"), F.sum("n_late").alias("n_late")
    ).filter(F.col("n") >= at_least).withColumn("final", F.coalesce(F.col("end") + wait <= last, F.lit(False)))
