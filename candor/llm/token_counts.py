"""Token counts of whole texts with a SentencePiece model.

Arrow batches go to an encoder that returns lengths only. Inside a task texts are regrouped into batches of
about `batch_bytes`, and a text longer than `piece_bytes` is cut at safe boundaries: a space whose left
neighbour is neither a space nor U+2581. No entry of the vocabulary holds a U+2581 behind another character
(checked when the model is loaded), so no token crosses such a place, and the space that a piece would start
with is left to the dummy prefix the library adds. A stretch with no safe boundary stays whole.

Null texts are empty and have no tokens. Texts need not differ. An empty table gives no rows. Other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import columns

BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16
MARK = "▁"


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = (m.id_to_piece(i) for i in range(m.get_piece_size()))
    cut = not any(MARK in e.lstrip(MARK) for e in entries) and m.encode("a b", out_type=str) == ["▁a", "▁b"]
    return m, cut


def pieces(text: str, size: int) -> list[str]:
    """`text` cut at safe boundaries into pieces of at least `size` characters each (but the last)."""
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and text[at - 1] in (" ", MARK):
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 == len(text):
            break
        out.append(text[start:at])
        start = at + 1
    out.append(text[start:])
    return out


def _lengths(model, texts: list[str]) -> list[int]:
    return [len(ids) for ids in model.encode(texts, num_threads=1)]


def count_batches(batches: Iterator[pd.Series], path: str, batch_bytes: int, piece_bytes: int) -> Iterator[pd.Series]:
    model, cut = _model(path)
    for series in batches:
        totals = [0] * len(series)
        texts: list[str] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for owner, n in zip(owners, _lengths(model, texts), strict=True):
                totals[owner] += n
            texts.clear()
            owners.clear()
            held = 0

        for i, text in enumerate(series):
            for piece in pieces(text, piece_bytes) if cut and len(text) > piece_bytes else [text]:
                if held and held + len(piece) > batch_bytes:
                    flush()
                texts.append(piece)
                owners.append(i)
                held += len(piece)
        if texts:
            flush()
        yield pd.Series(totals, dtype="int64")


def n_tokens(text: Column, path: str, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> Column:
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return count_batches(batches, path, batch_bytes, piece_bytes)

    return count(F.coalesce(text, F.lit("")))


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_bytes, n_tokens, over_limit`."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    counted = rows.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        n_tokens(F.col("text"), path, batch_bytes, piece_bytes).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
