"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.fixed_values import MISSING_WORDS

# The code points Python's str.strip() and str.split() treat as white space.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"
NUMBER_PATTERN = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body`, keeping the expression small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks.

    Trimming a character set walks the whole text, so it only runs where an end is white space.
    """
    ends = F.left(c, F.lit(1)).isin(*WHITESPACE) | F.right(c, F.lit(1)).isin(*WHITESPACE)
    return F.when(ends, F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def strip_once(c: Column) -> Column:
    """`strip` for an argument that is itself an expression."""
    return let(c, strip)


def blank_to_null(c: Column) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return let(strip_once(c), lambda s: F.nullif(s, F.lit("")))


def is_missing(c: Column) -> Column:
    """TRUE for NULL, blank, and the words that stand for a missing cell."""
    s = strip(c)
    longest = max(len(w) for w in MISSING_WORDS)
    return s.isNull() | ((F.octet_length(s) <= longest) & F.lower(s).isin(MISSING_WORDS))


def to_number(c: Column) -> Column:
    """Decimal or scientific notation to double; anything else (also NaN words) to NULL."""
    return let(strip_once(c), lambda s: F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double")))


def to_whole(c: Column) -> Column:
    """An integer written as text, else NULL."""
    return let(strip_once(c), lambda s: F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """`regexp_extract` that gives NULL, not '', when nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_PATTERN))


def contains_any(c: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def divide(a: Column, b: Column) -> Column:
    """Double division, NULL on a zero or missing divisor."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c))


def half_even(c: Column) -> Column:
    """Whole number, ties to even."""
    return F.bround(c, 0).cast("int")


def entropy(shares: list[Column]) -> Column:
    """-sum p ln p in nats over the positive shares; NULL when the shares are NULL."""
    terms = [F.when(p > 0, p * F.ln(p)).when(p.isNotNull(), F.lit(0.0)) for p in shares]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.lit(0.0) - total


def compact(items: list[Column]) -> Column:
    """Array of the non-NULL items, in the given order."""
    return F.array_compact(F.array(*items))


def count_if(c: Column) -> Column:
    return F.count_if(c)


def text_key(c: Column) -> Column:
    """256-bit digest of a text: groups equal texts without shuffling the texts themselves."""
    return F.unhex(F.sha2(c, 256))


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct column (an uncorrelated scalar subquery)."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()
