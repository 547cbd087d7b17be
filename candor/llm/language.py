"""Language of whole texts by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed against it greedily: each
phrase is the longest match that starts where the last phrase ended, plus the letter that broke it. The
language that needs the fewest phrases per character wins; ties go to the language with the smaller name.

Texts are lower-cased, every trained letter of any script is a symbol of its own, letters not trained on share
one, and every run of other characters is one space. Long texts are parsed in blocks of `BLOCK` symbols, the same ones for every
language, so a task holds blocks, not parses. An automaton is a table of next states for the most frequent
symbols and a sorted list of edges for all others, so its size follows the training text and not the alphabet; a
step that has no edge counts a phrase and goes on from the root, so many blocks advance together.

Training takes one part of each of at most TRAIN_TEXTS texts per language, at a place and in an order that hashes
choose (parts under SHORT_PIECE characters come last), and at most `train_symbols` symbols for all languages
together, so the broadcast tables have a fixed size. Null texts and texts without a letter are `und` with score
0, as is everything if nothing is labelled; only null texts and texts without a letter are not kept. Rows are judged one by one, so repeated rows agree; an empty
table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.common import columns, release

TRAIN_SYMBOLS = 160_000
TRAIN_TEXTS = 200
TABLE_SYMBOLS = 48
SHORT_PIECE = 20
BLOCK = 4096
UNKNOWN = "und"


class Alphabet:
    """Letters to symbols: 0 is a space, 1 any letter not trained on, the rest the trained letters, frequent ones first."""

    def __init__(self, texts: list[str]) -> None:
        points = np.frombuffer("".join(texts).lower().encode("utf-32-le", "replace"), np.uint32)
        seen, n = np.unique(points, return_counts=True)
        letters = [(-int(k), int(p)) for p, k in zip(seen, n, strict=True) if chr(p).isalpha()]
        self.letters = [p for _, p in sorted(letters)]

    def table(self) -> np.ndarray:
        """Symbol of every code point."""
        out = np.zeros(0x110000, np.min_scalar_type(1 + len(self.letters)))
        for lo in range(0, 0x110000, 0x1000):
            if not 0xD800 <= lo < 0xE000:
                out[lo : lo + 0x1000] = [chr(p).isalpha() for p in range(lo, lo + 0x1000)]
        out[self.letters] = np.arange(2, 2 + len(self.letters))
        return out


def symbols(texts: list[str], table: np.ndarray) -> list[np.ndarray]:
    """Each text as symbols: lower case, one 0 between words and around the text; empty without letters."""
    out = []
    for text in texts:
        s = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        keep = s > 0
        keep[1:] |= keep[:-1]
        s = s[keep]
        out.append(s if len(s) and s.any() else s[:0])
    return out


class Automaton(NamedTuple):
    """Steps: 2 * next state + 1 if the step ends a phrase. Symbols under the table's width have a cell in each state's
    row, the edges of all others are sorted by state and symbol."""

    table: np.ndarray
    edges: np.ndarray
    targets: np.ndarray

    def steps(self, state: np.ndarray, symbol: np.ndarray, size: int) -> np.ndarray:
        if not len(symbol) or symbol.max() < size:
            return self.table[state * size + symbol]
        out = self.table[state * size + np.minimum(symbol, size - 1)]
        far = np.flatnonzero(symbol >= size)
        out[far] = 1
        if len(self.edges):
            key = (state[far] << 32) | symbol[far]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[far[hit]] = self.targets[at[hit]]
        return out


def automaton(train: np.ndarray, size: int) -> Automaton:
    """Suffix automaton of `train`, with table cells for the symbols under `size`.

    A missing edge goes back to the root, where the next phrase starts after the symbol that broke the match.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in train.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.ones((len(nxt), size), np.int32)
    state = np.repeat(np.arange(len(nxt)), [len(d) for d in nxt])
    edge = np.fromiter((c for d in nxt for c in d), np.int64)
    target = 2 * np.fromiter((t for d in nxt for t in d.values()), np.int64)
    near = edge < size
    table[state[near], edge[near]] = target[near]
    key, target = (state[~near] << 32) | edge[~near], target[~near].astype(np.int32)
    order = np.argsort(key)
    return Automaton(table.ravel(), key[order], target[order])


def phrases(blocks: list[np.ndarray], table: Automaton, size: int) -> np.ndarray:
    """Number of phrases of each block, all blocks advancing one symbol at a time. Blocks go long to short."""
    lengths = np.array([len(b) for b in blocks])
    width = int(lengths[0])
    grid = np.zeros((len(blocks), width), blocks[0].dtype)
    for row, b in zip(grid, blocks, strict=True):
        row[: len(b)] = b
    grid = np.ascontiguousarray(grid.T).astype(np.int64)
    alive = np.searchsorted(-lengths, -np.arange(width))  # blocks longer than t: a prefix
    state, ends = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    for t in range(width):
        n = int(alive[t])
        step = table.steps(state[:n], grid[t, :n], size)
        ends[:n] += step & 1
        state[:n] = step >> 1
    return ends + (state > 0)


def train_texts(docs: DataFrame, train_symbols: int) -> list[tuple[str, list[str]]]:
    """Labelled texts per language, in hash order, about `train_symbols` characters in all."""
    labelled = docs.where("lang is not null and text is not null")
    langs = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not langs:
        return []
    each = train_symbols // len(langs)
    size = max(each // 8, 200)  # at least eight texts teach a language
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    piece = F.substring(F.col("text"), place, F.lit(size))
    order = Window.partitionBy("lang").orderBy(F.length("piece") < SHORT_PIECE, F.xxhash64("piece"), "piece")
    rows = (
        labelled.select("lang", piece.alias("piece")).where(F.length("piece") > 0)
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= TRAIN_TEXTS)
        .withColumn("before", F.sum(F.length("piece")).over(
            Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)))
        .where((F.col("n") == 1) | (F.col("before") < each)).select("lang", "n", "piece").collect()
    )
    out: dict[str, list[str]] = {lang: [] for lang in langs}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        out[r["lang"]].append(r["piece"])
    return [(lang, texts) for lang, texts in out.items() if texts]


class Model:
    """Alphabet, languages and their automata."""

    def __init__(self, trained: list[tuple[str, list[str]]], train_symbols: int) -> None:
        self.langs = [lang for lang, _ in trained]
        alphabet = Alphabet([t for _, texts in trained for t in texts])
        self.size = min(TABLE_SYMBOLS, 2 + len(alphabet.letters))
        self.letters = alphabet.table()
        each = train_symbols // max(len(trained), 1)
        self.tables = [automaton(np.concatenate(symbols(texts, self.letters))[:each], self.size) for _, texts in trained]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(texts)
        best, score = [UNKNOWN] * n, [0.0] * n
        if not self.langs:
            return best, score
        coded = symbols(["" if t is None else t for t in texts], self.letters)
        blocks = [(i, s[at : at + BLOCK]) for i, s in enumerate(coded) for at in range(0, len(s), BLOCK)]
        if not blocks:
            return best, score
        blocks.sort(key=lambda b: -len(b[1]))
        owner = np.array([i for i, _ in blocks])
        only = [b for _, b in blocks]
        counts = np.stack([np.bincount(owner, phrases(only, t, self.size), n) for t in self.tables])
        for i in np.unique(owner):
            own = counts[:, i] / len(coded[i])
            k = int(np.argmin(own))
            best[i] = self.langs[k]
            score[i] = float((1 / own[k]) / (1 / own).sum()) if own[k] > 0 else 1.0
        return best, score


def fit(docs: DataFrame, train_symbols: int = TRAIN_SYMBOLS) -> Model:
    """A model of the non-null `lang` values of `docs` (`text, lang`)."""
    return Model(train_texts(docs, train_symbols), train_symbols)


def predict(text: Column, model_ref, batch_chars: int = 1 << 22) -> Column:
    """Struct (lang, score) per text; `model_ref` is a broadcast Model."""

    @F.pandas_udf("lang string, score double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        model = model_ref.value
        for s in series:
            langs: list[str] = []
            scores: list[float] = []
            held: list[str | None] = []
            size = 0
            for text in s:
                held.append(text)
                size += len(text or "")
                if size >= batch_chars:
                    a, b = model.predict(held)
                    langs, scores, held, size = langs + a, scores + b, [], 0
            a, b = model.predict(held)
            yield pd.DataFrame({"lang": langs + a, "score": scores + b})

    return run(text)


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: `doc_id, lang_pred, score`."""
    ref = docs.sparkSession.sparkContext.broadcast(model)
    rows = columns(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", predict(F.col("text"), ref).alias("p")).select(
        "doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a language, or a letter if nothing was labelled, with all their columns."""
    if not model.langs:
        return docs.where(F.col(f"`{text_col}`").rlike(r"\p{L}"))
    ref = docs.sparkSession.sparkContext.broadcast(model)
    return docs.where(predict(F.col(f"`{text_col}`"), ref)["score"] > 0)
