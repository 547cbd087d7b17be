"""Document fingerprints: quartile bucket digests of hashed byte triplets, and their likeness.

A text's UTF-8 bytes, with two zero bytes before and after, give one triplet per place. Each triplet is hashed
to one of `BUCKETS` counters. The counters' quartiles cut them into four classes, so a digest is one byte for
the length (steps of a quarter, capped) and two bits per bucket, in lowercase hex. The difference of two digests
is the sum of the class distances plus the capped length distance; two digests without any relation differ by
5/4 a bucket on average, and the score is bounded there: likeness is 1 for equal digests and 0 from there on.
The fingerprint depends on the text alone, so equal texts have equal ones.

Null texts are empty; an empty text has a digest. Long texts are counted whole, in blocks of bytes. Repeated rows
each give a row. An empty table gives no rows. Other columns play no part.

`with_next` pairs each row with the next one by id (null ids last; rows with one id by a hash of the text; after
the last row comes the first). Ids alone are sorted by range first, which gives ranges of about `range_rows` rows
and the first id of each; there are at most `MAX_RANGES`, so that these few ids may go to all tasks. Each row is
then sent once, to its range; a range's first row is sent to the range before as well.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.common import columns, parts_for

BUCKETS = 512
LENGTH_STEP, LENGTH_COST, LENGTH_CAP = 1.25, 4, 64
FARTHEST = BUCKETS * 5 // 4
BLOCK_BYTES = 1 << 20
RANGE_ROWS, MAX_RANGES = 2_000, 100_000


def _counts(texts: list[bytes]) -> np.ndarray:
    """How often each text's triplets fall into each bucket, one row per text."""
    data = np.frombuffer(b"\0\0" + b"\0\0".join(texts) + b"\0\0", np.uint8).astype(np.uint32)
    h = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    h *= np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    at = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, sizes)[: len(h)]
    return np.bincount(at + (h % np.uint32(BUCKETS)), minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)


def digests(texts: list[bytes]) -> list[str]:
    """The digest of each text."""
    out: list[str] = []
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 2
        # A block has many short texts or one long one; a row of counters is 4 kB.
        if held >= BLOCK_BYTES or i - first >= 1_000 or i == len(texts) - 1:
            out += _encode(texts[first : i + 1])
            first, held = i + 1, 0
    return out


def _encode(texts: list[bytes]) -> list[str]:
    counts = _counts(texts)
    cuts = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1], axis=1)
    cuts = cuts[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    code = (counts[:, :, None] > cuts[:, None, :]).sum(2).astype(np.uint8).reshape(len(texts), -1, 4)
    body = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
    sizes = np.fromiter(map(len, texts), np.float64, len(texts))
    length = np.minimum(255, np.round(np.log1p(sizes) / np.log(LENGTH_STEP))).astype(np.uint8)
    whole = np.concatenate([length[:, None], body], axis=1)
    return [row.tobytes().hex() for row in whole]


def scores(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness, 0 to 1, of digests pair by pair."""
    x, y = (np.frombuffer(bytes.fromhex("".join(d)), np.uint8).reshape(len(d), -1) for d in (a, b))
    gap = np.minimum(LENGTH_CAP, LENGTH_COST * np.abs(x[:, 0].astype(np.int64) - y[:, 0]))
    for shift in (0, 2, 4, 6):
        gap = gap + np.abs((x[:, 1:] >> shift & 3).astype(np.int64) - (y[:, 1:] >> shift & 3)).sum(1)
    return 1 - np.minimum(gap, FARTHEST) / FARTHEST


def fingerprint(text: Column) -> Column:
    """The digest of a text column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(digests(texts.tolist()), dtype=object)

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def likeness(a: Column, b: Column) -> Column:
    """How like two digests are, 0 to 1."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(scores(x.tolist(), y.tolist()) if len(x) else [], dtype="float64")

    return run(a, b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fingerprint` of every row."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def with_next(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`doc_id, text, fingerprint` of every row of the same columns, and `next_text, next_fingerprint`."""
    own = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("h")]
    ids = rows.select(*own)
    n = ids.count()
    ranges = parts_for(n, max(range_rows, parts_for(n, MAX_RANGES)))
    firsts = [
        tuple(r["at"]) for r in ids.repartitionByRange(ranges, "no_id", "id", "h")
        .groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("no_id", "id", "h")).alias("at")).collect()
    ]
    firsts.sort()
    last = len(firsts) - 1

    @F.pandas_udf("array<int>")
    def ranges_of(no_id: pd.Series, i: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for key in zip(no_id.tolist(), i.tolist(), h.tolist(), strict=True):
            at = bisect.bisect_right(firsts, key) - 1
            out.append([at, at - 1 if at else last] if firsts[at] == key else [at])
        return pd.Series(out, dtype=object)

    sent = rows.select("*", *own).select("*", F.posexplode(ranges_of("no_id", "id", "h")).alias("copy", "range"))
    ahead = Window.partitionBy("range").orderBy("copy", "no_id", "id", "h")
    both = sent.select(
        "doc_id", "text", "fingerprint", "copy",
        F.lead("text").over(ahead).alias("next_text"), F.lead("fingerprint").over(ahead).alias("next_fingerprint"))
    return both.where("copy = 0").drop("copy")


def edited_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """How the fingerprint of each text stands a change of its last half.

    The last floor(n / 2) code points are replaced by the first as many, or all, of the next row's text. Gives
    `doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`.
    """
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    paired = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"))), range_rows)
    edited = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    marked = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return marked.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
