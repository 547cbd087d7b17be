"""Find secrets in whole texts: three fixed patterns, and character Markov models for the rest.

Everything is DataFrame and SQL functions. Each pattern brackets its matches with two control characters
(any the text has are first exchanged for a third, which no pattern matches); splitting there gives the
lengths between matches, and running sums of the lengths give positions in code points.

The method: two first-order Markov models over the characters of keys, one trained on labelled random
strings (the values the patterns found), one on ordinary identifiers (other words of a bounded sample of
documents). A run of 16 or more such characters is reported as `random` if the log-likelihood ratio of the
models is at least `margin` and it does not overlap a pattern's span.

Null texts are empty; an empty text or table gives no spans (a row per input row all the same). Repeated
rows are scanned one by one. With nothing labelled the random model is uniform. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.common import columns, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: What is looked for in the texts; matches shorter than LEAST may be left out where that finds the same rest.
SCANS = PATTERNS | {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "random": r"[A-Za-z0-9+/_=-]{16,}"}
KINDS = list(SCANS)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
N = len(ALPHABET) + 1  # 0 stands for any other character
TRAIN_ROWS = 2_000
MARGIN = 12.0
#: Weight, in pairs, of the single-character frequencies that rare pairs of identifiers fall back to.
BACKOFF = 5.0
#: Weight, in pairs, of the even distribution that pairs of random strings fall back to.
UNIFORM = 50.0


def _items(text: Column, kind: str) -> Column:
    """The pieces between and of the matches, in order: (kind, position in the list, length, matched text)."""
    return F.when(
        F.instr(text, "\u0001") > 0,
        F.transform(
            F.split(text, "[\u0001\u0002]", -1),
            lambda x, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), i.alias("pos"), F.length(x).alias("len"),
                F.when(i % 2 == 1, x).alias("value"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<kind:int,pos:int,len:int,value:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`uid, doc_id, kind, pos, len, value`: the pieces of every text that has a match; one null piece else."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    clean = F.translate(F.coalesce(F.col("text"), F.lit("")), "\u0001\u0002", "\u0003\u0003")
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", clean.alias("text"))
    rows = rows.select("uid", "doc_id", *[
        F.regexp_replace("text", F.lit(p), F.lit("\u0001$0\u0002")).alias(f"m_{k}") for k, p in SCANS.items()])
    rows = rows.select("uid", "doc_id", F.concat(*[_items(F.col(f"m_{k}"), k) for k in KINDS]).alias("items"))
    return rows.select("uid", "doc_id", F.explode_outer("items").alias("x")).select("uid", "doc_id", "x.*")


def _passes(kind: Column, value: Column) -> Column:
    long = F.when(kind == 0, F.length(F.regexp_extract(value, ASSIGN, 2)) >= LEAST["assign"])
    for k in ("access", "hex"):
        long = long.when(kind == KINDS.index(k), F.length(value) >= LEAST[k])
    return long.otherwise(F.lit(True))


def _symbols(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pair_counts(values: DataFrame) -> DataFrame:
    s = values.select(_symbols(F.col("value")).alias("s")).where(F.size("s") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i) * N + F.element_at("s", i + 1))
    return s.select(F.explode(pairs).alias("pair")).groupBy("pair").count()


def train(scanned: DataFrame, docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratio of each ordered pair of characters: N * N numbers.

    Labelled random strings: values of at most `train_rows` matches of the fixed patterns. Ordinary identifiers: the
    words of fewer than 16 characters, outside all matches, of at most `train_rows` documents. Both are taken in the order of a hash.
    """
    values = scanned.where(F.col("value").isNotNull() & (F.col("kind") < 3) & _passes(F.col("kind"), F.col("value")))
    value = F.when(F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    good = values.select(value.alias("value")).orderBy(F.xxhash64("value"), "value").limit(train_rows)
    own = columns(docs, doc_id=id_col, text=text_col).where("text is not null").withColumns(
        {"by_id": F.xxhash64("doc_id"), "by_text": F.xxhash64("text")})
    # Only hashes meet in one task; they are at most `train_rows`, and the texts stay where they are.
    chosen = own.select("by_id", "by_text").orderBy("by_id", "by_text").limit(train_rows).distinct()
    some = own.join(F.broadcast(chosen), ["by_id", "by_text"], "left_semi")
    text = F.col("text")
    for p in SCANS.values():
        text = F.regexp_replace(text, F.lit(p), F.lit(" "))
    words = some.select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{3,15}"), 0)).alias("value"))
    table = []
    for frame in (good, words):
        counts = [0] * (N * N)
        for pair, n in _pair_counts(frame).collect():
            counts[pair] = n
        table.append(counts)
    secret, plain = table
    chars = [sum(plain[b::N]) for b in range(N)]
    single = [(n + 0.5) / (sum(chars) + 0.5 * N) for n in chars]
    ratio = []
    for a in range(N):
        n_secret, n_plain = (sum(c[a * N : (a + 1) * N]) for c in table)
        for b in range(N):
            p = (secret[a * N + b] + UNIFORM / N) / (n_secret + UNIFORM)
            q = (plain[a * N + b] + BACKOFF * single[b]) / (n_plain + BACKOFF)
            ratio.append(math.log(p / q))
    return ratio


def score(value: Column, ratio: list[float]) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")
    s = _symbols(value)
    steps = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.element_at(table, a * N + b + 1))
    return F.when(F.length(value) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda x, y: x + y))


def spans(scanned: DataFrame, ratio: list[float], margin: float = MARGIN) -> DataFrame:
    """`uid, doc_id, kind, start, end` of every span; docs without any have one row with null kind."""
    pieces = scanned.repartition("uid")
    before = Window.partitionBy("uid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long")
    placed = pieces.withColumn("start", F.when(F.col("kind").isNotNull(), start)).withColumn("end", F.col("start") + F.col("len"))
    good = F.when(F.col("kind") == 3, score(F.col("value"), ratio) >= margin).otherwise(_passes(F.col("kind"), F.col("value")))
    hit = placed.withColumn("hit", F.col("value").isNotNull() & good)
    base = F.col("hit") & (F.col("kind") < 3)
    order = Window.partitionBy("uid").orderBy("start", "kind", "pos")
    earlier = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(earlier, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end"))
    return hit.withColumn("apart", apart).withColumn(
        "hit", F.col("hit") & ((F.col("kind") < 3) | F.col("apart"))
    ).select("uid", "doc_id", F.when(F.col("hit"), F.col("kind")).alias("kind"), "start", "end")


def find_secrets(
    docs: DataFrame, margin: float = MARGIN, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, counts per kind, and `found`: array of (start, kind, end), sorted."""
    scanned = written(scan(docs, id_col, text_col), "scanned")
    ratio = train(scanned, docs, train_rows, id_col, text_col)
    found = spans(scanned, ratio, margin)
    is_kind = F.col("kind").isNotNull()
    return found.groupBy("uid", "doc_id").agg(
        *[F.sum((F.coalesce(F.col("kind"), F.lit(-1)) == i).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when(is_kind, F.struct("start", "kind", "end")))).alias("found"),
    ).drop("uid")


def listed(found: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
