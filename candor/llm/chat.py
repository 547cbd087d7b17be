"""Format conversations with a template and find each turn's text by black-box rendering.

A template is any function from a list of (role, text) to one string. Nothing is known of it: for each turn
the prefix that ends there is rendered and compared with the render before. What was added is the turn; the
render of the same prefix with an empty text shows which part of it is the turn's text. If an earlier
output is not a prefix of the next one, the template rewrites history: the conversation is marked
`rewrites`, and its spans are null.

The template here marks turns as `<turn role>`, newline, text, `</turn>`, newline; a backslash before each
backslash and angle bracket inside roles and texts makes it reversible.

Turns are ordered by turn (null first), then role and text; null roles and texts are empty; a null id is a
conversation of its own. Rows of one conversation meet in one task, which holds one conversation at a time;
prefixes are rendered one after another. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import columns

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
SPANS = "array<struct<start:long,end:long,text_start:long,text_end:long>>"
SCHEMA = f"conv_id long, n_turns long, roles array<string>, formatted string, rewrites boolean, spans {SPANS}"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_template(turns: list[Turn]) -> str:
    return "".join([f"<turn {escape(role)}>\n{escape(text)}</turn>\n" for role, text in turns])


_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text made by `marked_template`; anything left between turns is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def locate(turns: list[Turn], template: Template) -> tuple[str, bool, list[tuple[int, int, int, int]] | None]:
    """The whole output, whether the template rewrites history, and per turn its span and its text's span."""
    before, rewrites = template([]), False
    spans: list[tuple[int, int, int, int]] = []
    for i, (role, _) in enumerate(turns):
        after, empty = template(turns[: i + 1]), template([*turns[:i], (role, "")])
        if not (after.startswith(before) and empty.startswith(before)):
            rewrites = True
        elif not rewrites:
            at = len(before)
            head = _common(after[at:], empty[at:])
            tail = len(empty) - at - head
            spans.append((at, len(after), at + head, len(after) - tail))
        before = after
    return before, rewrites, None if rewrites else spans


def format_group(conv_id: int | None, rows: list[Turn], template: Template) -> tuple:
    formatted, rewrites, spans = locate(rows, template)
    cells = None if spans is None else [dict(zip(("start", "end", "text_start", "text_end"), s, strict=True)) for s in spans]
    return conv_id, len(rows), [r for r, _ in rows], formatted, rewrites, cells


def _frame(done: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(done, columns=["conv_id", "n_turns", "roles", "formatted", "rewrites", "spans"])
    return frame.assign(conv_id=pd.array([row[0] for row in done], dtype="Int64"))


def format_conversations(
    rows: DataFrame, template: Template = marked_template, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: `conv_id, n_turns, roles, formatted, rewrites, spans`."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Turn] = []
        current: tuple | None = None
        for frame in frames:
            done = []
            for null, conv, role, text in zip(frame["no_id"], frame["conv_id"], frame["role"], frame["text"], strict=True):
                key = (null, conv)
                if key != current:
                    if current is not None:
                        done.append(format_group(None if current[0] else current[1], held, template))
                    current, held = key, []
                held.append((role, text))
            if done:
                yield _frame(done)
        if current is not None:
            yield _frame([format_group(None if current[0] else current[1], held, template)])

    own = columns(rows, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = own.repartition("conv_id", "no_id").sortWithinPartitions("conv_id", "no_id", "turn", "role", "text")
    return ordered.drop("turn").mapInPandas(run, SCHEMA)
