"""Remove passages that repeat: every window of `size` words, wherever it starts for the second time.

A window is `size` consecutive words of one document. Each word that lies in a window whose words also start
earlier (smaller id, or the same document and an earlier start) is removed; windows are judged on the input.
Overlapping and touching windows merge into maximal intervals, so each interval is cut once.

Windows are hashed by Rabin-Karp over 64-bit word hashes modulo 2^64, with two odd bases: one value places the
window in a hash range, 56 bits of the other are its key there. Ranges number in proportion to the text, so the
chance of a false match per window does not grow with the input (about 10^-11). Inside a scan task all but the
first start of a window are marked at once; only first starts travel, as packed arrays per hash range, so a
passage in very many documents sends one entry per task. The task of a range finds the first start of all and
sends the other starts on as packed marks by document. Marks are keyed by document bucket from the start, those
of a scan task too, so no task sees more of them than its share of the documents.

Null texts and texts of fewer than `size` words keep everything; null ids sort first. Rows that repeat an id
and a text are one document and agree. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import columns, mixed, narrow, pack, parts_for, unpack, word_hashes

SIZE = 20
RANGE_WINDOWS = 1 << 21
CHUNK_WORDS = 1 << 21
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NULL_ID = -(2**63)
KEY_BITS = np.uint64(56)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each window of `size` word hashes: sum of word * base^(size-1-place) modulo 2^64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 2**64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(inverse, len(words)), dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * _powers(base, len(words))[size - 1 :]


class Chunk:
    """The windows of some documents of one task: their keys, documents and starts."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.ids: list[int] = []
        self.shas: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, doc_id: int, sha: int, text: str) -> None:
        words = word_hashes(text.encode().split())
        if len(words) >= self.size:
            self.ids.append(doc_id)
            self.shas.append(sha)
            self.parts.append(tuple(mixed(window_hashes(words, self.size, b)) for b in BASES))
            self.n += len(self.parts[-1][0])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes, document ordinals and starts of all windows, in the order (id, start)."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i], self.shas[i]))
        self.ids, self.shas = [self.ids[i] for i in order], [self.shas[i] for i in order]
        self.parts = [self.parts[i] for i in order]
        counts = [len(p[0]) for p in self.parts]
        doc = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
        start = np.concatenate([np.arange(n, dtype=np.uint32) for n in counts])
        first, second = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        return first, second, doc, start

    def rows(self, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
        """First starts of the chunk as entries under their range, later starts as marks under `ranges` + their bucket."""
        if not self.ids:
            return
        first, second, doc, start = self.arrays()
        ids, shas = np.array(self.ids, np.int64), np.array(self.shas, np.int64)
        order = np.argsort(first, kind="stable")
        h = first[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.zeros(len(first), bool)
        later[order] = ~new
        same = np.zeros(len(first), bool)  # a repeated row: the same id and start as the first
        same[order] = (ids[doc[order]] == ids[doc[lead]]) & (start[order] == start[lead])
        at = np.flatnonzero(later & ~same)
        for bucket, marks in _by_bucket(ids[doc[at]], shas[doc[at]], start[at], ranges):
            yield ranges + bucket, b"", marks
        at = np.flatnonzero(~later)
        rng = (second[at] % np.uint64(ranges)).astype(np.int64)
        by = np.argsort(rng, kind="stable")
        at, rng = at[by], rng[by]
        key = first[at] >> (np.uint64(64) - KEY_BITS)
        cuts = np.flatnonzero(np.concatenate([[True], rng[1:] != rng[:-1]]))
        for lo, hi in zip(cuts, [*cuts[1:], len(rng)], strict=True):
            own = at[lo:hi]
            yield int(rng[lo]), _blob(key[lo:hi], doc[own], start[own], ids, shas), b""


def _blob(key: np.ndarray, doc: np.ndarray, start: np.ndarray, ids: np.ndarray, shas: np.ndarray) -> bytes:
    """Entries in document order: 7 bytes of key each, counts per document, gaps between starts."""
    docs, first, counts = np.unique(doc, return_index=True, return_counts=True)
    gaps = np.diff(start.astype(np.int64), prepend=0)
    gaps[first] = start[first]
    key7 = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).ravel()
    return pack(ids[docs], shas[docs], narrow(counts), narrow(gaps), key7)


def _entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Back to per-entry keys and starts, with the ids and text hashes of their documents."""
    ids, shas, counts, gaps, key7 = unpack(blob)
    counts, gaps = counts.astype(np.int64), gaps.astype(np.int64)
    runs = np.cumsum(gaps)
    ends = np.cumsum(counts)
    base = np.repeat(runs[ends - counts] - gaps[ends - counts], counts)
    key = np.zeros((len(gaps), 8), np.uint8)
    key[:, :7] = key7.reshape(-1, 7)
    return key.view("<u8").ravel(), runs - base, np.repeat(ids, counts), np.repeat(shas, counts)


def _marks(ids: np.ndarray, shas: np.ndarray, starts: np.ndarray) -> bytes:
    """Starts to mark, by document, each once however many rows repeat the document."""
    order = np.lexsort((starts, shas, ids))
    ids, shas, starts = ids[order], shas[order], starts[order].astype(np.int64)
    once = np.concatenate([[True], (starts[1:] != starts[:-1]) | (ids[1:] != ids[:-1]) | (shas[1:] != shas[:-1])])
    ids, shas, starts = ids[once], shas[once], starts[once]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (shas[1:] != shas[:-1])])
    at = np.flatnonzero(new)
    gaps = np.diff(starts, prepend=0)
    gaps[at] = starts[at]
    return pack(ids[at], shas[at], narrow(np.diff(np.append(at, len(ids)))), narrow(gaps))


def _by_bucket(ids: np.ndarray, shas: np.ndarray, starts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Marks by document bucket, from id and text, so that copies spread; all marks of a document have the same one."""
    if not len(ids):
        return
    bucket = (mixed(mixed(ids.view(np.uint64)) ^ shas.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    ids, shas, starts, bucket = ids[by], shas[by], starts[by], bucket[by]
    own, first = np.unique(bucket, return_index=True)
    for b, lo, hi in zip(own.tolist(), first, [*first[1:], len(ids)], strict=True):
        yield b, _marks(ids[lo:hi], shas[lo:hi], starts[lo:hi])


def _marked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text hashes and starts of marks."""
    ids, shas, counts, gaps = unpack(blob)
    counts, gaps = counts.astype(np.int64), gaps.astype(np.int64)
    ends = np.cumsum(counts)
    runs = np.cumsum(gaps)
    base = np.repeat(runs[ends - counts] - gaps[ends - counts], counts)
    return np.repeat(ids, counts), np.repeat(shas, counts), runs - base


def later_starts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries of one hash range, those whose key has an earlier start: ids, text hashes and starts."""
    parts = [_entries(b) for b in blobs]
    key = np.concatenate([p[0] for p in parts])
    order = np.argsort(key)
    k = key[order]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    key = key[order]
    start, ids, shas = (np.concatenate([p[i] for p in parts])[order] for i in (1, 2, 3))
    by = np.lexsort((start, ids, key))
    key, start, ids, shas = key[by], start[by], ids[by], shas[by]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
    later = (ids != ids[lead]) | (start != start[lead])
    return ids[later], shas[later], start[later]


def _words_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.xxhash64(text).alias("sha"), text.alias("text"))


def marks(docs: DataFrame, size: int, ranges: int) -> DataFrame:
    """`doc_id, sha, starts`: packed starts of the windows to remove, one row per document that has any."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = Chunk(size)

        def out() -> Iterator[pd.DataFrame]:
            for rng, entries, own in chunk.rows(ranges):
                yield pd.DataFrame({"rng": np.array([rng], np.int32), "entries": [entries], "marks": [own]})

        for frame in frames:
            for doc_id, sha, text in zip(frame["doc_id"], frame["sha"], frame["text"], strict=True):
                chunk.add(doc_id, sha, text)
                if chunk.n >= CHUNK_WORDS:
                    yield from out()
                    chunk = Chunk(size)
        yield from out()

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        key = int(rows["rng"].iloc[0])
        if key >= ranges:  # marks of scan tasks go on as they are
            found = [(key - ranges, b) for b in rows["marks"]]
        else:
            found = list(_by_bucket(*later_starts(list(rows["entries"])), ranges))
        return pd.DataFrame({
            "bucket": np.array([b for b, _ in found], np.int32), "blob": pd.Series([m for _, m in found], dtype=object)})

    def by_document(rows: pd.DataFrame) -> pd.DataFrame:
        ids, shas, starts = (np.concatenate(x) for x in zip(*[_marked(b) for b in rows["blob"]], strict=True))
        ids, shas, counts, gaps = unpack(_marks(ids, shas, starts))
        ends = np.cumsum(counts.astype(np.int64))
        cells = [pack(gaps[b - n : b]) for n, b in zip(counts.tolist(), ends.tolist(), strict=True)]
        return pd.DataFrame({"doc_id": ids, "sha": shas, "starts": pd.Series(cells, dtype=object)})

    rows = docs.select("doc_id", "sha", "text").mapInPandas(hashed, "rng int, entries binary, marks binary")
    packed = rows.groupBy("rng").applyInPandas(met, "bucket int, blob binary")
    return packed.groupBy("bucket").applyInPandas(by_document, "doc_id long, sha long, starts binary")


def intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal intervals covered by windows at the sorted `starts`."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    new = np.concatenate([[True], starts[1:] > starts[:-1] + size])
    last = np.concatenate([new[1:], [True]])
    return list(zip(starts[new].tolist(), (starts[last] + size).tolist(), strict=True))


def remove_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, n_words, n_removed, kept, removed`.

    `kept` is the words that stay, joined by one space; `removed` the intervals (start, end) of words cut.
    """
    rows = _words_of(columns(docs, doc_id=id_col, text=text_col))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per = marks(rows, size, parts_for(total // 6, RANGE_WINDOWS))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, blob in zip(frame["text"], frame["starts"], strict=True):
                words = text.encode().split()
                if blob is None:
                    out.append((len(words), 0, b" ".join(words).decode(), []))
                    continue
                gone = intervals(np.cumsum(unpack(blob)[0].astype(np.int64)), size)
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), [
                    {"start": a, "end": b} for a, b in gone]))
            done = pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "removed"])
            ids = pd.array(frame["doc_id"].to_numpy(np.int64), dtype="Int64")
            ids[frame["no_id"].to_numpy(bool)] = pd.NA
            done.insert(0, "doc_id", ids)
            yield done

    return rows.join(per, ["doc_id", "sha"], "left").select("doc_id", "no_id", "text", "starts").mapInPandas(
        cut, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")
