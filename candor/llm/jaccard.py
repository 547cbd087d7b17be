"""N-gram Jaccard join: groups of documents linked by similar sets of word n-grams.

A document's set is its distinct n-grams of words (a shorter text is one n-gram). Two sets are linked when
100 * intersection >= percent * union; a component is everything reachable by links.

1. Documents with equal sets are one class, whatever their number; a class is named by 64 bits of its digest.
2. Tokens (n-gram hashes) travel once, packed, to the task of their hash range, which counts the classes each
   is in. Tokens of a single class cannot be shared, so only the others go back to their classes, with their
   counts. A class of size n with fewer than percent * n / 100 of those is linked with nothing and is done.
3. The global order of tokens is rare first (count, then hash). Linked sets share `k` tokens among their first
   n - ceil(percent * n / 100) + k, the extended prefix; only its shared tokens are indexed.
4. Every class is verified against the most central class of each of its indexed tokens (the one whose tokens
   most classes share): one pair per index entry, so a group of thousands of near copies becomes one component
   without being expanded into pairs. Further rounds take another class of each token, while they find links.
   Pairs whose shared tokens are too few for a link, or lie too late in the order, are not formed.
5. Tokens all of whose classes are now in one component are done. Of the others, tokens met in at most
   `rare` components are indexed one by one, and so are those whose pairs of classes cost less to test than the
   combinations cost to write (a row as much as `row_tests` tests; at most `MOST` classes, as one token may be one
   task's). The rest, the frequent ones, are indexed by combinations of k of them, since linked sets without any
   other common token share k frequent ones. Each class has a parity mark: one bit for each hash
   bucket of its shared tokens, flipped by every token. Marks that differ in d bits differ in d tokens at least,
   so a pair is not formed if that alone leaves too few in common. The other pairs across components are
   verified exactly: intersections need shared tokens only.

A token is kept in 48 bits and its range number, so a pair of sets meets a false match with a chance of about
10^-10 at any size of the corpus. The task of a range holds its tokens' entries, 14 bytes each; the number of
ranges follows the text, but one n-gram that very many different documents share is in one range.

Documents without words are linked with nothing. Null texts have no words. Rows are judged by their own
text, also where they repeat an id; a null id sorts first. An empty table gives no rows. Other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.common import (
    attach,
    columns,
    components,
    mixed,
    narrow,
    pack,
    parts_for,
    release,
    spare,
    unpack,
    word_hashes,
    written,
)

RARE = 32
ROW_TESTS = 256
MOST = 1 << 14
K = 2
ROUNDS = 5
SET_ROWS = 1 << 18
ENTRY = ["class", "size", "shared", "behind"]
MARK = [f"mark_{i}" for i in range(8)]
RANGE_TOKENS = 1 << 21
CHUNK_TOKENS = 1 << 19
NULL_ID = -(2**63)


def ngrams(text: str, n: int, fold_case: bool) -> np.ndarray:
    """The set of n-gram hashes of a text, sorted."""
    raw = text.encode()
    words = word_hashes((raw.lower() if fold_case else raw).split())  # bytes.lower changes A-Z alone
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i])
    return np.unique(h)


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest intersection a set of `size` can have with a linked one."""
    return -(-size * percent // 100)


def sketches(docs: DataFrame, n: int, fold_case: bool) -> DataFrame:
    """`doc_id, size, class` of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in frames:
            sets = [ngrams(t, n, fold_case) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy(), "size": np.array([len(s) for s in sets], np.int64),
                "class": np.array([class_of(s) for s in sets], np.int64)})

    return docs.mapInPandas(run, "doc_id long, size long, class long")


def token_blobs(docs: DataFrame, n: int, percent: int, fold_case: bool, ranges: int) -> DataFrame:
    """`rng, blob`: the tokens of each class, once per chunk of a task, packed by hash range.

    Sets too small to be linked with one that differs are left out.
    """

    def chunk_rows(classes: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        rng = (tokens % np.uint64(ranges)).astype(np.uint32)
        by = np.argsort(rng, kind="stable")
        tokens, owner, rng = tokens[by], owner[by], rng[by]
        low = mixed(tokens).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        names = np.array(classes, np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], rng[1:] != rng[:-1]]))
        blobs = []
        for lo, hi in zip(cuts, [*cuts[1:], len(rng)], strict=True):
            own, counts = np.unique(owner[lo:hi], return_counts=True)
            blobs.append(pack(names[own], narrow(counts), np.ascontiguousarray(low[lo:hi]).ravel()))
        return pd.DataFrame({"rng": rng[cuts].astype(np.int32), "blob": pd.Series(blobs, dtype=object)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        held: dict[int, np.ndarray] = {}
        n_held = 0
        for frame in frames:
            for text in frame["text"]:
                s = ngrams(text, n, fold_case)
                if len(s) == 0 or (len(s) + 1) * percent > len(s) * 100:
                    continue
                c = class_of(s)
                if c not in held:
                    held[c] = s
                    n_held += len(s)
                if n_held >= CHUNK_TOKENS:
                    yield chunk_rows(list(held), list(held.values()))
                    held, n_held = {}, 0
        if held:
            yield chunk_rows(list(held), list(held.values()))

    return docs.select("text").mapInPandas(run, "rng int, blob binary")


def shared_tokens(blobs: DataFrame, ranges: int) -> DataFrame:
    """`bucket, blob`: the tokens that several classes have, with these classes and their number, packed by class bucket."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in rows["blob"]]
        names = np.concatenate([np.repeat(c, k) for c, k, _ in parts])
        wide = np.zeros((len(names), 8), np.uint8)
        wide[:, :6] = np.concatenate([t for _, _, t in parts]).reshape(-1, 6)
        token = wide.view("<u8").ravel() | (np.uint64(int(rows["rng"].iloc[0]) % (1 << 16)) << np.uint64(48))
        order = np.argsort(token)
        t = token[order]
        twin = np.zeros(len(t), bool)
        twin[1:] = t[1:] == t[:-1]
        twin[:-1] |= twin[1:]
        order = order[twin]
        token, names = token[order], names[order]
        by = np.lexsort((names, token))
        token, names = token[by], names[by]
        if len(token):
            once = np.concatenate([[True], (token[1:] != token[:-1]) | (names[1:] != names[:-1])])
            token, names = token[once], names[once]
        _, place, count = np.unique(token, return_inverse=True, return_counts=True)
        count = count[place] if len(token) else count
        keep = count > 1
        token, names, count = token[keep], names[keep], count[keep]
        bucket = names % ranges
        by = np.lexsort((names, bucket))
        token, names, count, bucket = token[by], names[by], count[by], bucket[by]
        own, first = np.unique(bucket, return_index=True)
        blobs = [pack(names[a:b], token[a:b], narrow(count[a:b])) for a, b in zip(first, [*first[1:], len(names)], strict=True)]
        return pd.DataFrame({"bucket": own.astype(np.int32), "blob": pd.Series(blobs, dtype=object)})

    return blobs.groupBy("rng").applyInPandas(run, "bucket int, blob binary")


def parity_mark(tokens: np.ndarray) -> np.ndarray:
    """For each hash bucket, whether the number of tokens in it is odd, as the bits of a few longs."""
    n_bits = 64 * len(MARK)
    odd = np.bincount(tokens & (n_bits - 1), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def candidates_of(shared: DataFrame, classes: DataFrame, percent: int, k: int, ranges: int) -> DataFrame:
    """`class, size, shared, central, tokens, prefix, mark` of the classes that have enough shared tokens.

    `tokens` are the `shared` ones, rare first; `central` is the mean number of classes they are in, negated.
    """

    def run(sizes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(sizes) and len(rows):
            names, token, count = (np.concatenate(x) for x in zip(*[unpack(b) for b in rows["blob"]], strict=True))
            by = np.lexsort((token, count, names))
            names, token, count = names[by], token[by].view(np.int64), count[by]
            own, first, n_shared = np.unique(names, return_index=True, return_counts=True)
            size = pd.Series(sizes["size"].to_numpy(), index=sizes["class"]).loc[own].to_numpy()
            need = least_overlap(size, percent)
            for i in np.flatnonzero(n_shared >= need):
                at, r, n = first[i], int(n_shared[i]), int(size[i])
                length = max(r - int(need[i]) + k, 0)  # the class's own tokens come first in the order
                out.append((own[i], n, r, -count[at : at + r].mean(), token[at : at + r], token[at : at + min(length, r)], parity_mark(token[at : at + r])))
        frame = pd.DataFrame({c: [x[j] for x in out] for j, c in enumerate(("class", "size", "shared", "central"))})
        frame = frame.astype({"class": "int64", "size": "int64", "shared": "int64", "central": "float64"})
        return frame.assign(**{c: pd.Series([x[j] for x in out], dtype=object) for j, c in ((4, "tokens"), (5, "prefix"), (6, "mark"))})

    bucket = F.pmod(F.col("class"), F.lit(ranges)).cast("int")
    left = classes.select("class", "size", bucket.alias("bucket")).groupBy("bucket")
    return left.cogroup(shared.groupBy("bucket")).applyInPandas(
        run, "class long, size long, shared long, central double, tokens array<long>, prefix array<long>, mark array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    left, right = (sets.select(
        F.col("class").alias(c), F.col("size").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("t_a", "t_b"))
    union = F.col("n_a") + F.col("n_b") - common
    return written(both.where(common * 100 >= union * percent).select("a", "b"), "links")


def _may_link(a: str, b: str, percent: int, k: int, *bounds: Column) -> Column:
    """Whether two entries of one key can belong to a linked pair, by this and any further bounds of its intersection.

    No intersection is larger than the fewer of the shared tokens; and if the key is among the first k common
    tokens, as it is for some key of every linked pair, not larger than k and what either side has behind it.
    """
    most = F.least(*[F.col(f"{x}.shared") for x in (a, b)], *[F.col(f"{x}.behind") + k for x in (a, b)], *bounds)
    return most * 100 >= (F.col(f"{a}.size") + F.col(f"{b}.size") - most) * percent


def _with_component(entries: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("class"), "component")
    return entries.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _by_marks(a: str, b: str) -> Column:
    """The most tokens two classes can have in common by their marks."""
    differ = sum((F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in MARK), F.lit(0))
    return F.floor((F.col(f"{a}.shared") + F.col(f"{b}.shared") - differ) / 2)


def _pairs(entries: DataFrame, sets: DataFrame, key: str, percent: int, k: int) -> DataFrame:
    """Pairs of classes of different components that share a key."""
    open_keys = entries.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(
        "lo < hi").select(key)
    marks = sets.select("class", *[F.col("mark")[i].alias(m) for i, m in enumerate(MARK)])
    few = entries.join(open_keys, key, "left_semi").select(key, *ENTRY, "component")
    few = written(few.join(marks, "class"), "open")
    a, b = few.alias("a"), few.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.class") < F.col("b.class")) & (
        F.col("a.component") != F.col("b.component")) & _may_link("a", "b", percent, k) & _may_link("a", "b", percent, k, _by_marks("a", "b"))
    return a.join(b, on).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()


def blocks_of_sets(n: int, k: int, each: int = SET_ROWS) -> Iterator[np.ndarray]:
    """All increasing k-tuples of 0 .. n - 1, in at most `each` rows at a time."""

    def grown(sets: np.ndarray) -> Iterator[np.ndarray]:
        if sets.shape[1] == k:
            if len(sets):
                yield sets
            return
        more = n - 1 - sets[:, -1]  # how many tuples go on from each
        ends = np.cumsum(more)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, each):
            at = np.arange(lo, min(lo + each, int(ends[-1])))
            row = np.searchsorted(ends, at, "right")
            yield from grown(np.column_stack([sets[row], sets[row, -1] + 1 + at - (ends - more)[row]]))

    for lo in range(0, n, each):
        yield from grown(np.arange(lo, min(lo + each, n), dtype=np.int64)[:, None])


def _combined(entries: DataFrame, k: int) -> DataFrame:
    """Combinations of k frequent tokens of each class, as one key each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c, size, shared, comp, held in zip(*[frame[x] for x in ("class", "size", "shared", "component", "held")], strict=True):
                tokens = np.array([x["token"] for x in held], np.int64).view(np.uint64)
                behind = np.array([x["behind"] for x in held], np.int64)
                for sets in blocks_of_sets(len(held), k):
                    key = np.zeros(len(sets), np.uint64)
                    for j in range(k):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + tokens[sets[:, j]])
                    yield pd.DataFrame({
                        "combo": key.view(np.int64), "class": c, "size": size, "shared": shared,
                        "behind": behind[sets].min(1), "component": comp})

    grouped = entries.groupBy("class", "size", "shared", "component").agg(
        F.sort_array(F.collect_list(F.struct("token", "behind"))).alias("held")).where(F.size("held") >= k)
    return grouped.mapInPandas(run, "combo long, class long, size long, shared long, behind long, component long")


def _frequent(entries: DataFrame, rare: int, row_tests: int) -> DataFrame:
    """The tokens of more than `rare` components that cost less by combinations than one by one.

    One by one, a class is tested against all classes of the token; by combinations it gives a row for each other token
    of its own that may be frequent.
    """
    others = F.count(F.lit(1)).over(Window.partitionBy("class")) - 1
    crowded = entries.where(F.col("n_components") > rare).select("token", others.alias("others"))
    cost = crowded.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.avg("others").alias("others"))
    return cost.where(F.col("n") > F.least(F.col("others") * row_tests, F.lit(MOST))).select("token")


def links_between(sets: DataFrame, percent: int, rare: int, k: int, rounds: int = ROUNDS, row_tests: int = ROW_TESTS) -> DataFrame:
    """Links (a, b) that connect all classes of each component; `sets` as `candidates_of` returns them."""
    index = written(sets.select("class", "size", "shared", "central", F.posexplode("prefix").alias("pos", "token")).withColumn(
        "behind", (F.col("shared") - F.col("pos") - 1).cast("long")).drop("pos"), "index")
    entries = index.withColumn("component", F.col("class"))
    links, checked = None, None
    for turn in range(rounds):
        several = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        entries = written(entries.join(several.where("lo < hi").select("token"), "token", "left_semi"), "unsettled")
        first = F.col("central") if turn == 0 else F.xxhash64(F.lit(turn), "token", "class").cast("double")
        lead = entries.groupBy("token").agg(F.min(F.struct(first.alias("first"), *ENTRY, "component")).alias("lead"))
        own = entries.select("token", F.struct(*ENTRY, "component").alias("own")).join(lead, "token")
        stars = own.where((F.col("own.component") != F.col("lead.component")) & _may_link("own", "lead", percent, k)).select(
            F.least("lead.class", "own.class").alias("a"), F.greatest("lead.class", "own.class").alias("b")).distinct()
        stars = written(stars.join(checked, ["a", "b"], "left_anti") if checked else stars, "stars")
        new = verified(stars, sets, percent)
        links = links.unionByName(new) if links else new
        checked = checked.unionByName(stars) if checked else stars
        entries = written(_with_component(entries.drop("component"), links), "labelled")
        if new.count() * 20 < stars.count():
            break
    spread = entries.groupBy("token", "component").agg(F.lit(1).alias("one")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n_components")).where("n_components > 1")
    entries = written(entries.join(spread, "token"), "unsettled")
    frequent = written(_frequent(entries, rare, row_tests), "frequent")
    pairs = _pairs(entries.join(frequent, "token", "left_anti"), sets, "token", percent, k)
    if not frequent.isEmpty():
        many = _combined(entries.join(frequent, "token", "left_semi"), k)
        pairs = pairs.unionByName(_pairs(written(many, "combos"), sets, "combo", percent, k)).distinct()
    return links.unionByName(verified(pairs.join(checked, ["a", "b"], "left_anti"), sets, percent))


def similar_documents(
    docs: DataFrame, n: int = 5, percent: int = 80, fold_case: bool = True, rare: int = RARE, k: int = K,
    id_col: str = "doc_id", text_col: str = "text", row_tests: int = ROW_TESTS,
) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_shingles, class_id, component_id`.

    `class_id` is the smallest id with the same set, `component_id` the smallest id reachable by links. For
    documents without words both are the document's own id.
    """
    rows = columns(docs, doc_id=id_col, text=text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = written(sketches(rows, n, fold_case), "sketch")
    some = sketch.where("size > 0")
    classes = written(some.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.any_value("size").alias("size"), F.count(F.lit(1)).alias("n_docs")), "classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    ranges = parts_for(total, RANGE_TOKENS)
    shared = written(shared_tokens(token_blobs(rows, n, percent, fold_case, ranges), ranges), "shared")
    sets = written(candidates_of(shared, classes, percent, k, ranges), "sets")
    links = links_between(sets, percent, rare, k, row_tests=row_tests)
    member = components(links).select(F.col("node").alias("class"), "component")
    inside = classes.join(member, "class", "left").withColumn("component", F.coalesce("component", "class"))
    inside = written(inside, "inside")
    groups = written(inside.groupBy("component").agg(
        F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("n_classes")), "groups")
    named = written(attach(inside.select("class", "class_id", "n_docs", "component"), groups, "component", "n_classes").select(
        "class", "class_id", "component_id", "n_docs"), "named")
    linked = attach(some, named, "class", "n_docs").select("doc_id", "size", "class_id", "component_id")
    empty = sketch.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    every = linked.unionByName(empty)
    ids = [F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) for c in ("doc_id", "class_id", "component_id")]
    return every.select(ids[0], F.col("size").alias("n_shingles"), *ids[1:])


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, fold_case: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: those whose id is the smallest of a component.

    Rows that repeat an id stay or go together: they stay if one of them has the smallest id of its component.
    """
    found = similar_documents(docs, n, percent, fold_case, id_col=id_col, text_col=text_col)
    gone, = spare(docs, "_gone")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    drop = found.groupBy(F.col("doc_id").alias(gone)).agg(F.max(own).alias("stays")).where("not stays").select(gone)
    return docs.join(drop, docs[id_col].eqNullSafe(F.col(gone)), "left_anti")
