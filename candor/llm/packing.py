"""Pack token sequences into as few fixed-length training sequences as a bounded-space best fit can.

Every document is its tokens and one end token; a document longer than a sequence is cut into full pieces
and a rest. Pieces are dealt to tasks at random, in numbers fixed by `pieces_per_task`, and each task packs
its pieces as they come: a bitset keyed by free space finds the open bin that a piece fits best; a piece
that fits none opens a bin; when more than `open_bins` are open the fullest closes first. Memory per task
is the open bins. A full piece is a sequence of its own.

Null texts are empty (one end token). Repeated rows are packed one by one. An empty table gives no rows.
Very long texts are tokenised word by word, so no long token list is held but the document's own. Other
columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import columns, kept, parts_for

LENGTH = 2048
OPEN_BINS = 512
PIECES_PER_TASK = 40_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"

CACHE_BYTES = 96 << 20
WORD_BYTES = 200  # a word's place in the cache, beside its letters and ids

#: A line's Latin letters, then ASCII marks other than the apostrophe, then the rest. Letters and marks are
#: pre-tokens of their own, and their case does not matter.
_PARTS = re.compile(r"^([A-Za-zÀ-ÖØ-öø-įı-ɏ]*)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)(.*)$", re.MULTILINE)
#: The steps before the model of the tokenizers whose texts can be encoded word by word.
_NORMALIZERS = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A mark with an id of its own that no letters give; it parts the words of a line.
_BAR = "|"


def word_by_word(tokenizer) -> bool:
    """Whether a text's ids are its white-space separated words' ids in a row, whatever the case of the letters."""
    steps = json.loads(tokenizer.to_str())
    split = ((steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        (steps.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and split.get("pattern") == {"Regex": _SPLIT}
        and split.get("behavior") == "Removed" and steps.get("truncation") is None and steps.get("padding") is None
        and len(tokenizer.encode(_BAR, add_special_tokens=False).ids) == 1)


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all slices in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


class WholeTexts:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, tokenizer, end: int = 0) -> None:
        self.tokenizer, self.end = tokenizer, end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with its end token, and where each text ends."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids, lengths = _flat([[*e.ids, self.end] for e in found])
        return ids, np.cumsum(lengths)


class WordTokens(dict):
    """Token ids of white-space separated words, each encoded when it is first met, within `limit` bytes.

    A text's ids are its words' ids in order (`word_by_word`). A word has a number; `starts` and `lengths` say where
    in `pool` its ids are. The words met since the last cut are in the dictionary itself, those of the time before in
    `old`; at a cut, words not met since the one before go. New words of a batch are learned together: most are
    letters and marks, and only the different lower-case letters, marks and other words are given to the tokenizer,
    letters many at a time. Arrow splits a batch and numbers its different words, so only these are looked up.
    """

    def __init__(self, tokenizer, end: int = 0, limit: int = CACHE_BYTES) -> None:
        super().__init__()
        self.tokenizer, self.end, self.limit = tokenizer, end, limit
        self.bar = tokenizer.encode(_BAR, add_special_tokens=False).ids[0]
        self.new: list[bytes] = []
        self.old: dict[bytes, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.letters = 0

    def __missing__(self, word: bytes) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.starts) + len(self.new)
            self.new.append(word)
        self[word] = n
        return n

    def held(self) -> int:
        """Bytes of all words known."""
        return self.letters + WORD_BYTES * len(self.starts) + 4 * len(self.pool)

    def cut(self) -> None:
        """Keep the words met since the last cut."""
        n = np.fromiter(self.values(), np.int64, len(self))
        self.pool = self.pool[_slices(self.starts[n], self.lengths[n])]
        self.lengths = self.lengths[n]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.old = dict(zip(self, range(len(self)), strict=True))
        self.clear()
        self.letters = sum(map(len, self.old))

    def _of_letters(self, words: list[str], each: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters, given to the tokenizer many at a time."""
        lines = [f" {_BAR} ".join([*words[i : i + each], ""]) for i in range(0, len(words), each)]
        ids, _ = _flat([e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        bars = np.flatnonzero(ids == self.bar)
        return ids[ids != self.bar], np.diff(bars, prepend=-1) - 1

    def _learn(self) -> None:
        """Encode the words numbered since the last time, as one batch."""
        new, self.new = self.new, []
        letters, marks, rest = zip(*_PARTS.findall(b"\n".join(new).decode()), strict=True)
        letters = "\n".join(letters).lower().split("\n")
        odd = [i for i, r in enumerate(rest) if r]
        letters, marks = list(letters), list(marks)
        for i in odd:  # anything else goes to the tokenizer as it is
            letters[i], marks[i] = "", new[i].decode()
        plain = dict.fromkeys(letters)
        plain.pop("", None)
        ids, lengths = self._of_letters(list(plain))
        others = list(dict.fromkeys(marks))
        more, of_more = _flat([e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)])
        place = dict(zip(plain, range(len(plain)), strict=True))
        place[""] = len(plain)
        lengths = np.concatenate([lengths, [0], of_more]).astype(np.int64)
        ids = np.concatenate([ids, more])
        starts = np.cumsum(lengths) - lengths
        both = np.empty((len(new), 2), np.int64)
        both[:, 0] = np.fromiter(map(place.__getitem__, letters), np.int64, len(new))
        place = dict(zip(others, range(len(plain) + 1, len(lengths)), strict=True))
        both[:, 1] = np.fromiter(map(place.__getitem__, marks), np.int64, len(new))
        at = both.ravel()
        own = lengths[both].sum(1)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(own) - own])
        self.lengths = np.concatenate([self.lengths, own])
        self.pool = np.concatenate([self.pool, ids[_slices(starts[at], lengths[at])]])
        self.letters += sum(map(len, new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with its end token, and where each text ends."""
        if self.held() * len(self) > self.limit // 2 * len(self.starts):
            self.cut()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = pc.dictionary_encode(split.flatten())
        words, at = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy()
        bounds = split.offsets.to_numpy()
        if b"" in words:  # white space at either end of a text
            real = at != words.index(b"")
            bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
            at = at[real]
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))[at]
        if self.new:
            self._learn()
        size = self.lengths[n]
        ends = np.concatenate([[0], np.cumsum(size)])[bounds[1:]]
        ids = np.insert(self.pool[_slices(self.starts[n], size)], ends, self.end)
        return ids, ends + np.arange(1, len(ends) + 1)


def encoder(path: str, end: int = 0) -> WordTokens | WholeTexts:
    """A task's encoder for the tokenizer in a file: word by word where the tokenizer allows it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already keep the cores busy
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return WordTokens(tokenizer, end) if word_by_word(tokenizer) else WholeTexts(tokenizer, end)


def tokenize(docs: DataFrame, path: str, length: int = LENGTH, end: int = 0, batch_chars: int = 1 << 22) -> DataFrame:
    """The pieces of every document (`doc_id, text`): at most `length` ids each, full ones first."""

    def cut(doc_ids: list, texts: list[str]) -> pd.DataFrame:
        ids, ends = kept("packing", encoder, path, end).encode(texts)
        raw = memoryview(ids.astype("<u4")).cast("B")
        begins = np.concatenate([[0], ends[:-1]])
        counts = -(-(ends - begins) // length)
        piece = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        start = piece * length
        low = np.repeat(begins, counts) + start
        high = np.minimum(low + length, np.repeat(ends, counts))
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        return pd.DataFrame({
            "doc_id": pd.array(doc_ids, dtype="Int64").repeat(counts), "piece": piece.astype(np.int32), "start": start,
            "length": high - low, "ids_crc32": np.array(crc, np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            doc_ids, texts, held = [], [], 0
            for null, doc_id, text in zip(frame["no_id"], frame["doc_id"], frame["text"], strict=True):
                doc_ids.append(None if null else doc_id)
                texts.append(text)
                held += len(text)
                if held >= batch_chars:
                    yield cut(doc_ids, texts)
                    doc_ids, texts, held = [], [], 0
            if doc_ids:
                yield cut(doc_ids, texts)

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, PIECE_SCHEMA)


class BestFit:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.open_bins = length, open_bins
        self.bits = 0  # bit f is set while some open bin has f free places
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bin_id = self.free[free].pop()
        if not self.free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """The bin a piece goes to, and its offset there."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.length, self.n_bins
            self.n_bins += 1
        offset, left = self.length - free, free - size
        if left:
            self.free[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_id, offset


def pack(pieces: DataFrame, n_pieces: int, length: int = LENGTH, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add `sequence_id, offset` to pieces. `n_pieces` (roughly) sets the number of packing tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = BestFit(length, open_bins)
        for frame in frames:
            placed = [bins.place(int(n)) for n in frame["length"]]
            yield frame.assign(
                sequence_id=np.array([first + b for b, _ in placed], np.int64),
                offset=np.array([o for _, o in placed], np.int64),
            )

    order = ["_key", "doc_id", "piece", "length", "ids_crc32"]
    dealt = pieces.withColumn("_key", F.xxhash64("doc_id", "piece")).repartition(
        parts_for(n_pieces, pieces_per_task), "_key").sortWithinPartitions(*order).drop("_key")
    return dealt.mapInPandas(run, PACKED_SCHEMA)


def pack_documents(
    docs: DataFrame, path: str, length: int = LENGTH, end: int = 0, open_bins: int = OPEN_BINS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    return pack(tokenize(rows, path, length, end), rows.count(), length, open_bins)
