"""Exact near-duplicate test for bounded blocks of texts.

Two texts are near copies when difflib's ratio of their lower-case forms reaches the threshold. Three
bounds that can never reject a true match run first, as array operations: lengths, shared characters,
and shared pieces of 4, 5 and 6 characters. With S = len(a) + len(b) and ratio >= t, the matched
characters M are at least t*S/2 and at most (1-t)*S characters stay unmatched; each unmatched character
breaks at most k-1 of the M-k+1 matched pieces of k characters. Texts that pass are compared in order: what
difflib matches is a common subsequence, so the longest one, found 64 and more characters at a time in
Python's whole numbers, bounds M from above. First on the beginnings: if at most u and v characters of a and
b stay unmatched, the first q characters of b can only match the first q + u of a, and at least q - v do.

M characters in k blocks give at least M - (q-1)*k common pieces of q characters. Blocks are parted by unmatched
characters, so k <= S - 2M + 1. Where difflib leaves out b's frequent characters, it only finds a block by a character
that is not frequent in b, save one at the very beginning, so k is also at most 1 + the number of such characters.
`Sketches` holds the pieces of many texts as bits, which counts what any two share from above.
"""

from __future__ import annotations

import math
import sys
from difflib import SequenceMatcher

import numpy as np
from pyspark import cloudpickle

PIECES = (4, 5, 6)
CHAR_BINS = 128
SHORT = 512  # characters of two texts up to which no pieces are built
AUTOJUNK_FROM = 200  # characters of the later text from which difflib leaves out frequent ones
SKETCH_PIECE, SKETCH_SHORT_PIECE = 6, 4  # characters of a sketched piece: of texts with left out characters, of others
BITS_PER_PIECE, DENSE_FROM = 8, 1024  # half of that many bits from that many characters
CELLS = 1 << 24  # cells of the tables that are built at once


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pieces(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed pieces of `size` characters and their counts. Collisions only raise the overlap."""
    c = codes.astype(np.uint64)
    if len(c) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.zeros(len(c) - size + 1, np.uint64)
    for i in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + c[i: len(c) - size + 1 + i]
    return np.unique(key, return_counts=True)


def matched(threshold: float, total):
    """Characters that must match in two texts of `total` characters, at least."""
    return np.ceil(threshold * total / 2 - 1e-6)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the length of each."""
    return _code_points("".join(texts)), np.array([len(t) for t in texts], dtype=np.int64)


def _groups(length: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Runs of texts whose tables of `width` cells a text, and whose characters, stay small."""
    step = max(CELLS // max(width, 1), 1)
    out, lo, ends = [], 0, np.cumsum(length)
    while lo < len(length):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right"))
        hi = max(min(hi, lo + step), lo + 1)
        out.append((lo, hi))
        lo = hi
    return out


def seeds(codes: np.ndarray, length: np.ndarray, autojunk: bool) -> np.ndarray:
    """Per text, how many of its characters difflib can find a block by when it is the later text."""
    out = length.copy()
    if not autojunk or len(codes) == 0:
        return out
    alphabet = np.zeros(int(codes.max()) + 1, bool)
    alphabet[codes] = True
    place = np.cumsum(alphabet) - 1
    size, ends = int(place[-1]) + 1, np.cumsum(length)
    for lo, hi in _groups(length, size):
        own = place[codes[ends[lo] - length[lo]: ends[hi - 1]]]
        n = np.bincount(np.repeat(np.arange(hi - lo) * size, length[lo:hi]) + own, minlength=(hi - lo) * size).reshape(-1, size)
        rare = np.where(n <= length[lo:hi, None] // 100 + 1, n, 0).sum(axis=1)
        out[lo:hi] = np.where(length[lo:hi] >= AUTOJUNK_FROM, rare, length[lo:hi])
    return out


def sketches(codes: np.ndarray, length: np.ndarray, kind: int) -> np.ndarray:
    """The pieces of each text as a row of bits, one bit a piece."""
    piece, bits = kind % 16, 1 << (kind // 16)
    out = np.zeros((len(length), bits // 8), np.uint8)
    ends, drop = np.cumsum(length), np.uint64(64 - (bits.bit_length() - 1))
    for lo, hi in _groups(length, bits):
        c, n = codes[ends[lo] - length[lo]: ends[hi - 1]].astype(np.uint64), length[lo:hi]
        if len(c) < piece:
            continue
        key = np.zeros(len(c) - piece + 1, np.uint64)
        for i in range(piece):
            key = key * np.uint64(0x9E3779B97F4A7C15) + c[i: len(c) - piece + 1 + i]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        text = np.repeat(np.arange(hi - lo), n)[: len(key)]
        whole = np.arange(len(key)) + piece <= np.cumsum(n)[text]
        held = np.zeros((hi - lo) * bits, bool)
        held[text[whole] * bits + (key[whole] >> drop).astype(np.int64)] = True
        out[lo:hi] = np.packbits(held.reshape(hi - lo, bits), axis=1)
    return out


def sketch_kinds(length: np.ndarray, autojunk: bool) -> np.ndarray:
    """How texts of these and more characters are sketched: the characters of a piece and the bits of a row, as one number."""
    bits = np.ceil(np.log2(np.maximum(length, 128) * np.where(length < DENSE_FROM, BITS_PER_PIECE, BITS_PER_PIECE // 2))).astype(np.int64)
    return bits * 16 + np.where(autojunk & (length >= AUTOJUNK_FROM), SKETCH_PIECE, SKETCH_SHORT_PIECE)


class Sketches:
    """Sketched texts that may be compared by one method: how many pieces two share at most, and must share."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, seeds: np.ndarray, kind: int, threshold: float):
        self.words = np.ascontiguousarray(bits).view(np.uint64)
        self.length, self.seeds, self.piece, self.threshold = length, seeds, kind % 16, threshold
        # pieces that left no bit of their own
        self.lost = np.maximum(length - self.piece + 1, 0) - np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)

    def missing(self, i, j):
        """How many bits i and j must share at least. 0 or less says nothing."""
        total = self.length[i] + self.length[j]
        m = matched(self.threshold, total)
        blocks = np.minimum(total - 2 * m, np.maximum(self.seeds[i], self.seeds[j])) + 1
        return m - (self.piece - 1) * blocks - np.minimum(self.lost[i], self.lost[j])

    def lengths_allow(self, i, j):
        return np.minimum(self.length[i], self.length[j]) >= matched(self.threshold, self.length[i] + self.length[j])

    def may_match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of texts, whether they may be near copies."""
        keep = self.lengths_allow(i, j)
        at = np.flatnonzero(keep)
        step = max(CELLS // 8 // max(self.words.shape[1], 1), 1)
        for lo in range(0, len(at), step):
            a, b = i[at[lo: lo + step]], j[at[lo: lo + step]]
            shared = np.bitwise_count(self.words[a] & self.words[b]).sum(axis=1, dtype=np.int64)
            keep[at[lo: lo + step]] = shared >= self.missing(a, b)
        return keep

    def partners(self, i: int, lo: int, hi: int) -> np.ndarray:
        """The texts from lo up to hi, sorted by length, that may be near copies of text i."""
        n = int(self.length[i])
        # the shortest and the longest text whose length allows it; checked exactly below
        a = lo + int(np.searchsorted(self.length[lo:hi], math.floor(n * self.threshold / (2 - self.threshold)) - 1))
        b = lo + int(np.searchsorted(self.length[lo:hi], math.ceil(n * (2 - self.threshold) / self.threshold) + 1, side="right"))
        if a >= b:
            return np.empty(0, np.int64)
        shared = np.bitwise_count(self.words[a:b] & self.words[i]).sum(axis=1, dtype=np.uint32)
        j = np.arange(a, b)
        return j[(shared >= self.missing(i, j)) & self.lengths_allow(i, j)]


class Block:
    """Texts with the arrays the bounds need: those of one block, or of several small ones."""

    def __init__(self, texts: list[str], threshold: float, autojunk: bool = True):
        self.texts = [t.lower() for t in texts]
        self.threshold = threshold
        self.autojunk = autojunk
        self.length = np.array([len(t) for t in self.texts], dtype=np.int64)
        self._ends = np.cumsum(self.length)
        self._all = _code_points("".join(self.texts))
        self.seeds = seeds(self._all, self.length, autojunk)
        bins = np.repeat(np.arange(len(texts)) * CHAR_BINS, self.length) + self._all % CHAR_BINS
        self.chars = np.bincount(bins, minlength=len(texts) * CHAR_BINS).reshape(-1, CHAR_BINS).astype(np.int32)
        self._pieces: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._places: tuple[int, dict[str, int]] = (-1, {})

    def codes(self, i: int) -> np.ndarray:
        return self._all[self._ends[i] - self.length[i]: self._ends[i]]

    def pieces(self, i: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, size) not in self._pieces:
            self._pieces[i, size] = _pieces(self.codes(i), size)
        return self._pieces[i, size]

    def enough_characters(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of texts, whether their lengths and shared characters allow a near copy."""
        needed = self.threshold * (self.length[i] + self.length[j]) / 2 - 1e-6
        keep = np.minimum(self.length[i], self.length[j]) >= needed
        at = np.flatnonzero(keep)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo: lo + (1 << 16)]
            keep[part] = np.minimum(self.chars[i[part]], self.chars[j[part]]).sum(axis=1) >= needed[part]
        return keep

    def share_pieces(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of texts, whether the sketches of their pieces allow a near copy. The shorter text names the method."""
        keep = np.ones(len(i), bool)
        kinds = sketch_kinds(np.minimum(self.length[i], self.length[j]), self.autojunk)
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            used, at = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
            codes = np.concatenate([self.codes(int(k)) for k in used])
            sketch = Sketches(sketches(codes, self.length[used], kind), self.length[used], self.seeds[used], kind, self.threshold)
            keep[own] = sketch.may_match(at[: len(own)], at[len(own):])
        return keep

    def candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        """The members of `others` that may be near copies of text i."""
        if len(others) == 0:
            return others
        others = others[self.enough_characters(np.full(len(others), i), others)]
        return np.array([j for j in others if self.may_match(i, int(j))], dtype=np.int64)

    def may_match(self, i: int, j: int) -> bool:
        """The bounds on pieces and on what matches in order. Short texts go by the order alone, which is quicker there."""
        total = int(self.length[i] + self.length[j])
        return (total < SHORT or self._enough_pieces(i, j, total)) and self._enough_in_order(i, j)

    def worth_testing(self, i: int, j: int) -> bool:
        """The bound that pays before the exact test: of short texts the order, of long ones the pieces."""
        total = int(self.length[i] + self.length[j])
        return self._enough_in_order(i, j) if total < SHORT else self._enough_pieces(i, j, total)

    def same_start(self, i: int, j: int) -> bool:
        """Whether the common beginning alone reaches the threshold."""
        x, y = self.codes(i), self.codes(j)
        shorter = min(len(x), len(y))
        differ = np.flatnonzero(x[:shorter] != y[:shorter])
        return 2.0 * (differ[0] if len(differ) else shorter) / (len(x) + len(y)) >= self.threshold

    def _enough_pieces(self, i: int, j: int, total: int) -> bool:
        least = self.threshold * total / 2
        for size in PIECES:
            needed = least - (size - 1) * min(total - 2 * least, max(int(self.seeds[i]), int(self.seeds[j]))) - (size - 1) - 1e-6
            if needed <= 0:
                return True
            ka, na = self.pieces(i, size)
            kb, nb = self.pieces(j, size)
            _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            if int(np.minimum(na[ia], nb[ib]).sum()) < math.floor(needed):
                return False
        return True

    def places(self, i: int) -> dict[str, int]:
        """For every character of text i, the whole number whose bits are its places. Kept for one text."""
        if self._places[0] != i:
            codes = self.codes(i)
            found = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}
            self._places = (i, found)
        return self._places[1]

    def _in_order(self, i: int, j: int, width: int, height: int) -> int:
        """Length of the longest common subsequence of the first `width` characters of text i and `height` of text j."""
        every = (1 << width) - 1
        places, v = self.places(i), every
        get = {c: places.get(c, 0) & every for c in set(self.texts[j][:height])}
        for c in self.texts[j][:height]:
            u = v & get[c]
            v = ((v + u) | (v - u)) & every
        return width - v.bit_count()

    def _enough_in_order(self, i: int, j: int) -> bool:
        """Whether enough characters can match in order."""
        a, b = len(self.texts[i]), len(self.texts[j])
        needed = math.ceil(self.threshold * (a + b) / 2 - 1e-6)
        u, v = a - needed, b - needed
        q = 5 * (v + 1)
        if 2 * q < b and self._in_order(i, j, min(a, q + u), q) < q - v:
            return False
        return self._in_order(i, j, a, b) >= needed

    def near(self, i: int, j: int) -> bool:
        """The exact test with i as the earlier text. Not symmetric in general."""
        a, b = self.texts[i], self.texts[j]
        if a == b:
            return True
        # difflib matches the longest common piece, whatever its characters, unless it leaves out frequent ones
        if (not self.autojunk or len(b) < AUTOJUNK_FROM) and self.same_start(i, j):
            return True
        return self._ratio_reaches(i, j)

    def _found(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Where difflib finds blocks, with i as the earlier text: equal characters (i's place, j's place, equal ones in a row up to here).

        Only characters that are not left out, sorted by the places. None if they are too many for a table.
        """
        x, y = self.codes(i), self.codes(j)
        at = np.argsort(y, kind="stable")
        held, start, n = np.unique(y[at], return_index=True, return_counts=True)
        if self.autojunk and len(y) >= AUTOJUNK_FROM:
            n = np.where(n <= len(y) // 100 + 1, n, 0)
        where = np.minimum(np.searchsorted(held, x), len(held) - 1)
        count = np.where(held[where] == x, n[where], 0)
        if int(count.sum()) > CELLS // 4:
            return None
        p = np.repeat(np.arange(len(x)), count)
        q = at[np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + start[where[p]]]
        key = p * (len(y) + 1) + q
        before = np.minimum(np.searchsorted(key, key - len(y) - 2), max(len(key) - 1, 0))
        follows = np.flatnonzero((key[before] == key - len(y) - 2) & (q > 0)) if len(key) else before
        run = [1] * len(key)
        for k, previous in zip(follows.tolist(), before[follows].tolist()):
            run[k] = run[previous] + 1
        return p, q, np.array(run, dtype=np.int64)

    def _ratio_reaches(self, i: int, j: int) -> bool:
        """Whether difflib's ratio reaches the threshold: its blocks, found one by one until that is settled."""
        found = self._found(i, j)
        if found is None:
            return SequenceMatcher(None, self.texts[i], self.texts[j], self.autojunk).ratio() >= self.threshold
        p, q, run = found
        x, y = self.codes(i), self.codes(j)
        total = len(x) + len(y)
        reaches = lambda m: 2.0 * m / total >= self.threshold
        size, left = 0, min(len(x), len(y))  # what matched, and what still may
        todo = [(0, len(x), 0, len(y))]
        while todo and not reaches(size):
            if not reaches(size + left):
                return False
            alo, ahi, blo, bhi = todo.pop()
            left -= min(ahi - alo, bhi - blo)
            lo, hi = np.searchsorted(p, [alo, ahi])
            inside = lo + np.flatnonzero((q[lo:hi] >= blo) & (q[lo:hi] < bhi))
            a, b, k = alo, blo, 0
            if len(inside):
                runs = np.minimum(run[inside], np.minimum(p[inside] - alo, q[inside] - blo) + 1)
                best = int(np.argmax(runs))
                k = int(runs[best])
                a, b = int(p[inside[best]]) - k + 1, int(q[inside[best]]) - k + 1
            back = _equal(x[alo:a][::-1], y[blo:b][::-1])
            a, b, k = a - back, b - back, k + back
            k += _equal(x[a + k: ahi], y[b + k: bhi])
            if k:
                size += k
                for part in ((alo, a, blo, b), (a + k, ahi, b + k, bhi)):
                    if part[0] < part[1] and part[2] < part[3]:
                        todo.append(part)
                        left += min(part[1] - part[0], part[3] - part[2])
        return reaches(size)


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many characters are equal at the beginning."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differ = x[at: min(at + step, n)] != y[at: min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return n


# Ship this small module with the tasks, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
