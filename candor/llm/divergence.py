"""Source divergence audit: how far the words of each source stand from the other sources of its language.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Single-pass in-memory indexing:

1. A task counts postings (language, source, term: occurrences, documents) in memory until they hold `BLOCK_BYTES`,
   then spills them as runs sorted by term, one per language and hash shard of the term, cut into chunks.
2. The chunks of a shard come to one task in the order of their first terms, whatever run they are from. A heap
   merges the open chunks, so the task holds the chunks that overlap in terms and no whole shard. Terms of too
   few documents of their language go; the others are written with their counts by source. The number of shards
   is the square root of the bytes of text over `SHARD_BYTES`: every run has a chunk for every shard, so shards in
   proportion to the text would make chunks in proportion to its square.
3. With N the sum of a group's counts and V the number of its language's terms, a count c has the scaled chance
   p(c) = 1 + floor(10^9 (c + 1) / (N + V)); a group stands from another by f = floor((p - q)^2 / q).
4. Sums of f over all terms are made of what a term is worth that both lack, a correction for each term of the
   one and of the other (from how many terms have each count, so their number does not matter), and a correction
   for each pair of sources that share a term, streamed over the postings. Terms that a pair lacks cost nothing.

All arithmetic is in 64-bit integers: p by long division in three digits of 1000, exact for N + V below 9 * 10^15;
(p - q)^2 is at most 10^18, and so is a sum of f, as the p of a group sum to about 10^9.

Null text, language and source are ''. Groups without terms, or in a language without kept terms, have rows
with value 0. Empty texts have no terms; long ones are counted whole, very long terms by their bytes. Repeated rows
are documents of their own. Ties go to the smaller item in UTF-8 order. An empty table gives no rows. Other columns
play no part. A source or language of any size is spread over all shards.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.common import attach, columns, narrow, pack, unpack, written

SCALE = 1_000_000_000
BLOCK_BYTES = 64 << 20
CHUNK_TERMS = 4_096
SHARD_BYTES = 64 << 10
ENTRY_BYTES = 160  # a term's place in two counters, beside its letters

#: Letters lower-cased, bytes of longer characters kept, all else a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_RUNS = "shard int, lang string, first binary, sources array<string>, terms binary, numbers binary"
_FREQUENCIES = "lang string, term string, sources array<string>, counts array<long>, total long, documents long"


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order."""
    return text.encode().translate(_FOLD).split()


class Block:
    """Postings in memory: per language and source, occurrences and documents of each term."""

    def __init__(self, shards: int) -> None:
        self.shards = shards
        self.langs: dict[str, dict[str, tuple[Counter, Counter]]] = {}
        self.held = 0

    def add(self, lang: str, source: str, found: list[bytes]) -> None:
        counts, documents = self.langs.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
        own = set(found)
        self.held += sum(len(t) + ENTRY_BYTES for t in filterfalse(counts.__contains__, own))
        counts.update(found)
        documents.update(own)

    def spill(self) -> Iterator[pd.DataFrame]:
        """A run for each language, cut by shard, and an empty block."""
        for lang, groups in self.langs.items():
            run = sorted(set().union(*(counts for counts, _ in groups.values())))
            place = {term: i for i, term in enumerate(run)}
            names = sorted(groups)
            at, of, n, d = [], [], [], []
            for k, source in enumerate(names):
                counts, documents = groups[source]
                at.append(np.fromiter(map(place.__getitem__, counts), np.int64, len(counts)))
                of.append(np.full(len(counts), k, np.uint64))
                n.append(np.fromiter(counts.values(), np.uint64, len(counts)))
                d.append(np.fromiter(map(documents.__getitem__, counts), np.uint64, len(counts)))
            at, of, n, d = (np.concatenate(x) for x in (at, of, n, d))
            shard = np.fromiter(map(xxhash.xxh3_64_intdigest, run), np.uint64, len(run)) % np.uint64(self.shards)
            # Postings by shard, term and source.
            own = shard[at]
            order = np.lexsort((of, at, own))
            yield self._chunks(lang, names, run, shard, own[order], at[order], of[order], n[order], d[order])
        self.langs.clear()
        self.held = 0

    def _chunks(self, lang: str, names: list[str], run: list[bytes], shard, own, at, of, n, d) -> pd.DataFrame:
        out = []
        terms_of = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[terms_of], np.arange(self.shards, dtype=np.uint64), side="right")
        begins = np.concatenate([[0], ends[:-1]])
        lows = np.searchsorted(own, np.arange(self.shards, dtype=np.uint64))
        for s in range(self.shards):
            low = lows[s]
            for i in range(begins[s], ends[s], CHUNK_TERMS):
                here = terms_of[i : min(i + CHUNK_TERMS, ends[s])]
                high = low + np.searchsorted(at[low : lows[s + 1] if s + 1 < self.shards else len(at)], here[-1], side="right")
                each = np.diff(np.searchsorted(at[low:high], here), append=high - low)
                chunk = [run[j] for j in here.tolist()]
                out.append((s, lang, chunk[0], names, b"\n".join(chunk), pack(*(narrow(x) for x in (each, of[low:high], n[low:high], d[low:high])))))
                low = high
        return pd.DataFrame(out, columns=["shard", "lang", "first", "sources", "terms", "numbers"])


def runs(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Term-sorted runs of the postings of `docs` (text, lang, source)."""

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(shards)
        for frame in frames:
            for text, lang, source in zip(frame["text"], frame["lang"], frame["source"], strict=True):
                block.add(lang, source, terms(text))
                if block.held >= block_bytes:
                    yield from block.spill()
        yield from block.spill()

    return docs.mapInPandas(index, _RUNS)


class Chunk:
    """A stretch of one run: terms in order, each with its postings."""

    def __init__(self, sources: list[str], blob: bytes, numbers: bytes) -> None:
        self.sources, self.terms = list(sources), blob.split(b"\n")
        each, of, counts, documents = unpack(numbers)
        ends = np.cumsum(each, dtype=np.int64)
        self.documents = np.add.reduceat(documents.astype(np.int64), ends - each).tolist()
        self.ends, self.of, self.counts = ends.tolist(), of.tolist(), counts.tolist()

    def add_to(self, sums: dict[str, int], place: int) -> None:
        for i in range(self.ends[place - 1] if place else 0, self.ends[place]):
            source = self.sources[self.of[i]]
            sums[source] = sums.get(source, 0) + self.counts[i]


class Merge:
    """A heap over the open chunks of a shard and language; a term is met in all of them at once."""

    def __init__(self, least: int) -> None:
        self.least, self.seq = least, 0
        self.heap: list[tuple[bytes, int, int, Chunk]] = []

    def open(self, first: bytes, chunk: Chunk) -> None:
        self.seq += 1
        heapq.heappush(self.heap, (first, self.seq, 0, chunk))

    def drain(self, before: bytes | None) -> Iterator[tuple[bytes, dict[str, int], int]]:
        """The terms before `before` (None: all) of enough documents, with their occurrences by source."""
        heap, least = self.heap, self.least
        while heap and (before is None or heap[0][0] < before):
            term = heap[0][0]
            documents, met = 0, []
            while heap and heap[0][0] == term:
                _, seq, place, chunk = heap[0]
                documents += chunk.documents[place]
                met.append((chunk, place))
                if place + 1 < len(chunk.terms):
                    heapq.heapreplace(heap, (chunk.terms[place + 1], seq, place + 1, chunk))
                else:
                    heapq.heappop(heap)
            if documents >= least:
                sums: dict[str, int] = {}
                for chunk, place in met:
                    chunk.add_to(sums, place)
                yield term, sums, documents


def frequencies(spilled: DataFrame, shards: int, least: int) -> DataFrame:
    """Each language's terms of at least `least` documents, with occurrences by source."""
    names = ["lang", "term", "sources", "counts", "total", "documents"]

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        merge, at = Merge(least), None
        for frame in frames:
            for shard, lang, first, sources, blob, numbers in frame.itertuples(index=False, name=None):
                if at != (shard, lang):
                    yield from ((at[1], *x) for x in merge.drain(None))
                    at = (shard, lang)
                yield from ((lang, *x) for x in merge.drain(first))
                merge.open(first, Chunk(sources, blob, numbers))
        yield from ((at[1], *x) for x in merge.drain(None))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for lang, term, sums, documents in found(frames):
            out.append((lang, term.decode(), list(sums), list(sums.values()), sum(sums.values()), documents))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    dealt = spilled.repartitionById(shards, "shard").sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInPandas(run, _FREQUENCIES)


def chance(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), exactly; NULL if n + v is 0."""
    whole = F.nullif(n + v, F.lit(0))
    digits, rest = F.lit(0).cast("long"), (count + 1).cast("long")
    for _ in range(3):
        digits = digits * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return digits + 1


def stands(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exactly."""
    return F.call_function("div", (p - q) * (p - q), q)


def _worth(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the terms that two groups share change in the sum of the pair: rows of `groups, p, zero` per term.

    The groups of a language are few for most terms but not bounded, so sums are kept per batch for the groups met there.
    """
    for frame in frames:
        sizes = frame["groups"].map(len).to_numpy()
        met = np.unique(np.concatenate([np.zeros(0, np.int64), *frame["groups"]]))
        dense = len(met) <= 1_000
        sums = np.zeros(len(met) ** 2 if dense else 0, np.int64)
        for m in np.unique(sizes[sizes > 1]):
            g, p, z = (np.stack(frame.loc[sizes == m, c].tolist()).astype(np.int64) for c in ("groups", "p", "zero"))
            g = np.searchsorted(met, g)
            # Blocks of about a million pairs: some terms with all their groups, or some groups of one term.
            wide = max(1, (1 << 20) // m)
            for t in range(0, len(g), max(1, wide // m)):
                own = slice(t, t + max(1, wide // m))
                for a in range(0, m, wide):
                    at = slice(a, a + wide)
                    pa, za, pb, zb = p[own, at, None], z[own, at, None], p[own, None, :], z[own, None, :]
                    value = (_worth(pa, pb) - _worth(pa, zb) - _worth(za, pb) + _worth(za, zb)).ravel()
                    pair = (g[own, at, None] * len(met) + g[own, None, :]).ravel()
                    if dense:
                        np.add.at(sums, pair, value)
                    else:
                        yield _pairs(met, pair, value)
        if dense:
            pair = np.flatnonzero(sums)
            yield _pairs(met, pair, sums[pair])


def _pairs(met: np.ndarray, pair: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """Sums by pair; a group paired with itself has no worth and no row."""
    found, place = np.unique(pair, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, place, value)
    a, b = found // max(1, len(met)), found % max(1, len(met))
    return pd.DataFrame({"a": met[a], "b": met[b], "value": sums})[a != b]


def _groups(rows: DataFrame, kept: DataFrame, postings: DataFrame) -> DataFrame:
    """Every language and source: `g`, its sum of counts, its number of kept terms, and its language's sums."""
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    own = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("n_terms"))
    every = rows.groupBy("lang", "source").agg(F.count("*").alias("documents"))
    found = every.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left")
    numbers = found.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_terms", "v", "n_lang")])
    zero = F.coalesce(chance(F.lit(0), F.col("n"), F.col("v")), F.lit(1))
    return written(numbers.select("*", zero.alias("zero"), F.monotonically_increasing_id().alias("g")), "groups")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(
    docs: DataFrame, least: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """`lang, source, part, item, value, rank`.

    Part `pair`: each other source of the language and the sum of f against it. Part `term`: the `top` terms that the
    source has more often than its language, by f against the language.
    """
    rows = columns(docs, lang=lang_col, source=source_col, text=text_col)
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(math.sqrt(size / shard_bytes)))
    kept = written(frequencies(runs(rows, shards, block_bytes), shards, least), "frequencies")
    each = F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("count"))).alias("x")
    postings = kept.select("lang", "term", "total", each).select("lang", "term", "total", "x.source", "x.count")
    groups = _groups(rows, kept, postings)

    key = F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source").alias("key")
    known = groups.where("n_terms > 0").select(key, "g", "n", "v", "n_lang", "n_terms", "zero")
    met = attach(postings.select("*", key), known, "key", "n_terms")
    p = chance(F.col("count"), F.col("n"), F.col("v")).alias("p")
    q = chance(F.col("total"), F.col("n_lang"), F.col("v")).alias("q")
    scored = written(met.select("g", "lang", "source", "term", "zero", p, q), "postings")

    above = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), stands(F.col("p"), F.col("q")).alias("value"))
    by_term = _ranked(above).where(F.col("rank") <= top)

    one = groups.select("lang", F.col("g").alias("a"), F.col("source"), F.col("zero").alias("za"), "v")
    two = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"), F.col("zero").alias("zb"))
    pairs = written(one.join(two, "lang").where("a <> b"), "pairs")
    lacking = stands(F.col("za"), F.col("zb"))
    many = scored.groupBy("g", "p").agg(F.count("*").alias("times"))
    of_one = pairs.join(many, F.col("a") == F.col("g")).select(
        "a", "b", (F.col("times") * (stands(F.col("p"), F.col("zb")) - lacking)).alias("value"))
    of_two = pairs.join(many, F.col("b") == F.col("g")).select(
        "a", "b", (F.col("times") * (stands(F.col("za"), F.col("p")) - lacking)).alias("value"))
    cells = F.array_sort(F.collect_list(F.struct("g", "p", "zero")))
    shared = scored.groupBy("lang", "term").agg(cells.alias("x")).where(F.size("x") > 1).select(
        F.col("x.g").alias("groups"), F.col("x.p").alias("p"), F.col("x.zero").alias("zero"))
    parts = pairs.select("a", "b", (F.col("v") * lacking).alias("value")).unionByName(of_one).unionByName(of_two).unionByName(
        shared.mapInPandas(_corrections, "a long, b long, value long"))
    sums = parts.groupBy("a", "b").agg(F.sum("value").alias("value"))
    by_pair = _ranked(pairs.join(sums, ["a", "b"]).select("lang", "source", "item", "value"))
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return by_pair.withColumn("part", F.lit("pair")).select(shown).unionByName(by_term.withColumn("part", F.lit("term")).select(shown))
