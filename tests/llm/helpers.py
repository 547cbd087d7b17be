"""Plain versions of the corpus operators, for comparison on small tables."""

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def long_text(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991}" for i in range(n))


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and copies."""
    base = long_text(60, 3)
    copy = base.replace(" ", "\t \n", 5)
    near = base + " tail"
    return [
        (1, base, "en", "a", 1), (2, copy, "en", "a", 1), (3, near, None, "b", 2), (4, None, "en", None, None),
        (5, "", None, "b", 0), (6, "   ", "de", "c", 3), (7, long_text(30_000, 1), "en", "c", 9),
        (8, "x" * 50_000, None, None, 5), (9, base, "fr", "a", 1), (9, base, "fr", "a", 1), (9, "another text", "fr", "a", 1),
        (None, base, "en", "a", 1), (None, None, None, None, None), (10, "Ünïcode ⟨text⟩ 한국어 " * 30, "de", "z", 4),
        (11, "12345 !!! ???", "en", "z", 4), (12, "short one", "en", "z", 4), (13, "short one", "en", "z", 4),
        (14, "\u0001odd\u0002 \x85 control   characters\x00", "en", "z", 4),
    ]


def clashing(df):
    """The same rows with extra columns under names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("key", "_key", "digest", "size", "_part", "uid", "kind", "found", "group", "bucket", "token", "class", "_gone", "_times"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)
