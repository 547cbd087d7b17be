"""Exact duplicates of an incoming batch against immutable snapshots.

A snapshot keeps one row per distinct text (digest, smallest id, copies) in digest buckets, and one static
3-wise binary fuse filter per bucket (about 9 bits per text). An incoming batch is first grouped by itself;
its distinct digests are then screened against the filters of every earlier snapshot. Only digests that a
filter accepts join the snapshot's exact rows, and a match counts after its normalised bytes were compared.

Texts are equal when identical after replacing every run of white space (space, tab to carriage return) by
one space. Null counts as empty. Of equal texts the smallest id stays; a null id sorts first. Rows that
repeat an id with an equal text are one document: each returns a row, and only one of them is `kept`.
Copies inside one batch are told apart by SHA-256 and byte length. An empty table gives no rows. Other
columns play no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.common import SPACE, attach, columns, mixed, parts_for, spare, written

BUCKET_ROWS = 16_384


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


# --- binary fuse filter ---


def _geometry(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for `n` keys, after Graf and Lemire (2022)."""
    length = 1 << int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, int(np.ceil(n * factor / length)) - 1)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in three neighbouring segments: shape (3, n)."""
    first = (h >> np.uint64(32)) % np.uint64(segments)
    mask = np.uint64(length - 1)
    own = [h & mask, (h >> np.uint64(11)) & mask, mixed(h) & mask]
    return np.stack([(first + np.uint64(i)) * np.uint64(length) + o for i, o in enumerate(own)]).astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(40))).astype(np.uint8)


def build_filter(keys: np.ndarray, tries: int = 100) -> bytes:
    """The filter of 64-bit `keys` as bytes: seed, segment length, segments, one byte per slot."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _geometry(len(keys))
    size = (segments + 2) * length
    for seed in range(1, tries + 1):
        h = mixed(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        slots = _slots(h, length, segments)
        n = len(h)
        count = np.bincount(slots.ravel(), minlength=size)
        total = np.zeros(size, np.int64)
        np.add.at(total, slots.ravel(), np.tile(np.arange(n), 3))
        layers, left = [], n
        single = np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(total[single], return_index=True)
            layers.append((key, single[at]))
            left -= len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.tile(key, 3))
            single = np.unique(touched)
            single = single[count[single] == 1]
        if left == 0:
            table, prints = np.zeros(size, np.uint8), _fingerprint(h)
            for key, slot in reversed(layers):
                s = slots[:, key]
                table[slot] = 0
                table[slot] = prints[key] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
            return np.array([seed, length, segments], np.int64).tobytes() + table.tobytes()
    raise RuntimeError("no seed gives a filter")


def may_hold(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """False only for keys that were not in the filter (1 in 256 of the others passes too)."""
    seed, length, segments = (int(x) for x in np.frombuffer(blob[:24], np.int64))
    table = np.frombuffer(blob[24:], np.uint8)
    h = mixed(keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    s = _slots(h, length, segments)
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == _fingerprint(h)


# --- snapshots and batches ---


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, digest, n_bytes, n_rows`: one row per id and distinct text, without the texts."""
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("text", normalised(F.col("text")))
    return (
        rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"))
        .groupBy("doc_id", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("n_rows"))
    )


def _first_id() -> Column:
    """The smallest id of a group, null first."""
    return F.when(F.count("doc_id") < F.count(F.lit(1)), F.lit(None)).otherwise(F.min("doc_id"))


def group_batch(prints: DataFrame) -> DataFrame:
    """The batch grouped by itself: one row per distinct text, with the 64-bit key of the filters."""
    return prints.groupBy("digest", "n_bytes").agg(
        _first_id().alias("first_id"), F.sum("n_rows").alias("copies")
    ).withColumn("key", F.xxhash64("digest"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(buckets)).cast("int")


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """`bucket, filter`: one binary fuse filter per digest bucket of an immutable snapshot."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        blob = build_filter(rows["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "filter": [blob]})

    keyed = groups.select(_bucket(buckets).alias("bucket"), "key")
    return keyed.groupBy("bucket").applyInPandas(one, "bucket int, filter binary")


def screen(filters: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """The rows of `groups` that the snapshot's filters accept."""

    def one(f: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="bucket")
        if f.empty or rows.empty:
            return rows.iloc[:0]
        return rows[may_hold(f["filter"].iloc[0], rows["key"].to_numpy(np.int64).view(np.uint64))]

    left = filters.groupBy("bucket")
    right = groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
    return left.cogroup(right).applyInPandas(one, groups.schema)


def same_bytes(matches: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `matches` (digest, n_bytes, snap_id, first_id) whose two texts are equal byte for byte."""
    sides = matches.select("digest", "n_bytes", F.col("snap_id").alias("doc_id")).unionByName(
        matches.select("digest", "n_bytes", F.col("first_id").alias("doc_id")))
    texts = columns(docs, doc_id=id_col, text=text_col)
    wanted = sides.select(F.col("doc_id").alias("want")).distinct()
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("want")), "left_semi").withColumn(
        "text", normalised(F.col("text"))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    found = found.groupBy("doc_id", "digest").agg(F.min("text").alias("text"))
    s, f = sides.alias("s"), found.alias("f")
    met = s.join(f, F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.digest") == F.col("f.digest")))
    equal = met.groupBy("s.digest", "s.n_bytes").agg(F.count(F.lit(1)).alias("_n"), F.min("text").alias("_a"), F.max("text").alias("_b"))
    return matches.join(equal.where((F.col("_n") == 2) & (F.col("_a") == F.col("_b"))).select("digest", "n_bytes"), ["digest", "n_bytes"])


def dedup_batches(
    docs: DataFrame, prints: DataFrame, batches: list[Column], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Run the rows of `prints` through the store batch by batch; later batches meet earlier snapshots.

    `batches` are predicates on `doc_id` that part the ids in ascending order, so a snapshot's text always
    has the smaller id. Returns `doc_id, digest, n_bytes, n_rows, keep_id, group_size, batch`.
    """
    total = prints.count()
    buckets = parts_for(total, BUCKET_ROWS)
    snapshots: list[tuple[DataFrame, DataFrame]] = []
    groups: list[DataFrame] = []
    for where in batches:
        own = written(group_batch(prints.where(where)), "batch")
        rest, hits = own.withColumn("keep_id", F.col("first_id")).withColumn("home", F.lit(len(groups))), []
        for n, (rows, filters) in enumerate(snapshots):
            passed = screen(filters, own, buckets)
            r, p = rows.alias("r"), passed.alias("p")
            exact = r.join(p, (F.col("r.digest") == F.col("p.digest")) & (F.col("r.n_bytes") == F.col("p.n_bytes")))
            met = written(exact.select(
                "p.digest", "p.n_bytes", F.col("r.first_id").alias("snap_id"), F.col("p.first_id").alias("first_id")), "met")
            hits.append(same_bytes(met, docs, id_col, text_col).select(
                "digest", "n_bytes", F.col("snap_id"), F.lit(n).alias("snap")))
        if hits:
            hit = reduce(DataFrame.unionByName, hits)
            rest = rest.join(hit, ["digest", "n_bytes"], "left").withColumn(
                "keep_id", F.when(F.col("snap").isNull(), F.col("first_id")).otherwise(F.col("snap_id"))).withColumn(
                "home", F.coalesce("snap", "home")).drop("snap", "snap_id")
        rest = written(rest, "groups")
        groups.append(rest.withColumn("batch", F.lit(len(groups))))
        new = rest.where(F.col("home") == len(snapshots)).select("digest", "n_bytes", "first_id", "copies", "key")
        snapshots.append((new, written(snapshot_filters(new, buckets), "filters")))
    every = reduce(DataFrame.unionByName, groups)
    sizes = every.groupBy("digest", "n_bytes", "home").agg(F.sum("copies").alias("group_size"))
    every = every.join(sizes, ["digest", "n_bytes", "home"]).select(
        F.concat_ws("-", F.hex("digest"), "n_bytes", "batch").alias("group"), "digest", "n_bytes", "keep_id", "copies", "group_size", "batch")
    every = written(every, "result")
    of_batch = reduce(lambda c, n: c.when(batches[n], F.lit(n)), range(1, len(batches)), F.when(batches[0], F.lit(0)))
    rows = prints.select("doc_id", "n_rows", F.concat_ws("-", F.hex("digest"), "n_bytes", of_batch).alias("group"))
    return attach(rows, every, "group", "copies").drop("copies", "group")


def slices(prints: DataFrame, n: int) -> list[Column]:
    """`n` predicates that cut the ids into ascending slices of equal width; null ids fall in the first."""
    lo, hi = prints.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return [F.lit(True)]
    cuts = [lo + (hi - lo + 1) * i // n for i in range(1, n)]
    out, c = [], F.col("doc_id")
    for i in range(n):
        low = (c >= cuts[i - 1]) if i else F.lit(True)
        high = (c < cuts[i]) if i < n - 1 else F.lit(True)
        out.append((low & high) if i else (c.isNull() | high))
    return out


def exact_duplicates(
    docs: DataFrame, n_batches: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: `doc_id, keep_id, group_size, kept, text_sha256`.

    The ids are taken as `n_batches` arriving batches, in ascending order.
    """
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    every = dedup_batches(docs, prints, slices(prints, n_batches), id_col, text_col)
    rows = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, n_batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows whose id was dropped go by an anti join; rows that repeat an id with an equal text are cut to one.
    """
    found = written(exact_duplicates(docs, n_batches, id_col, text_col), "found")
    own = [F.col(f"`{c}`") for c in docs.columns]
    gone_id, gone_sha, nth = spare(docs, "_gone", "_sha", "_nth")
    gone = found.where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    again = found.groupBy(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("kept").cast("int")).alias("any")).where("n > 1 and any = 1").drop("n", "any")
    sha = F.sha2(normalised(F.col(f"`{text_col}`")), 256)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (sha == F.col(gone_sha))
    clean = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return clean
    some = docs.join(again, same, "left_semi")
    order = Window.partitionBy(F.col(f"`{id_col}`"), sha).orderBy(*own)
    return clean.unionByName(some.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*own))
