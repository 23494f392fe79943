"""Scanners of bracketed text: balanced braces, formulas, rows at the top, masked comments; offsets count codepoints from 0.

A text is an array of codepoints.  A backslash escapes what follows, which the parity of its run tells for all places at
once; depths are differences of running counts, and a brace closes where the depth comes back.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def escaped(points: np.ndarray) -> np.ndarray:
    """Whether a place is escaped: the backslashes right before it are odd in number, those that are escaped themselves left out."""
    place = np.arange(len(points))
    slash = points == 92
    run = np.where(slash, place - np.maximum.accumulate(np.where(slash, -1, place)) if len(points) else place, 0)  # how many in a row end here
    out = slash & (run % 2 == 0)
    out[1:] |= ~slash[1:] & (run[:-1] % 2 == 1)
    return out


def brace_pairs(text: str) -> np.ndarray:
    """(start, stop, depth) of every balanced pair of braces: start is the opening one's place, stop the closing one's, depth counts from 1 at the outermost."""
    points = points_of(text)
    free = ~escaped(points)
    at = np.flatnonzero(((points == 123) | (points == 125)) & free)
    opens = points[at] == 123
    depth = np.cumsum(np.where(opens, 1, -1))
    level = np.where(opens, depth, depth + 1)
    order = np.lexsort((at, level))
    a, b = order[:-1], order[1:]
    good = opens[a] & ~opens[b] & (level[a] == level[b])
    pairs = np.stack([at[a[good]], at[b[good]]], 1) if len(at) else np.zeros((0, 2), np.int64)
    pairs = pairs[np.argsort(pairs[:, 0])]
    # How deep: pairs around it; a pair is a span, so those begun less those ended.
    around = np.searchsorted(pairs[:, 0], pairs[:, 0], "right") - np.searchsorted(np.sort(pairs[:, 1]), pairs[:, 0], "left")
    return np.column_stack([pairs, around])


_BRACES = re.compile(r"\\.|[{}]", re.S)


def closing_of(text: str) -> dict[int, int]:
    """The closing brace's place by the opening one's, of every balanced pair: brace_pairs without depths, in one pass that costs little on short texts."""
    out, opened = {}, []
    for m in _BRACES.finditer(text):
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}" and opened:
            out[opened.pop()] = m.start()
    return out


def dollar_spans(text: str) -> list[tuple[int, int]]:
    """(start, stop) of each formula in $...$ or $$...$$, stop behind its end; single dollars inside $$...$$ are its own."""
    points = points_of(text)
    at = np.flatnonzero((points == 36) & ~escaped(points))
    twice = np.r_[np.diff(at) == 1, False] if len(at) else np.zeros(0, bool)
    out, begin, double, after = [], None, False, -1
    for i, two in zip(at.tolist(), twice.tolist()):
        if i < after:
            continue
        if begin is None:
            begin, double, after = i, two, i + 1 + two
        elif not double or two:
            out.append((begin, i + 1 + double))
            begin, after = None, i + 1 + double
    return out


_TOKENS = re.compile(r"\\begin\s*\{[^}]*\}|\\end\s*\{[^}]*\}|\\\\|\\[{}]|[{}]")


def rows_of(body: str) -> list[str]:
    """The rows of an alignment, parted by its own double backslashes, not by those in groups or environments inside."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKENS.finditer(body)]
    step = np.array([1 if t.startswith("\\begin") or t == "{" else -1 if t.startswith("\\end") or t == "}" else 0 for _, _, t in tokens], int)
    depth = np.cumsum(step)
    cuts = [(a, b) for (a, b, t), d in zip(tokens, depth.tolist()) if t == "\\\\" and d == 0]
    return [body[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(body)])]


@lru_cache(64)
def _use_of(command: str) -> re.Pattern:
    return re.compile(rf"(?<!\\)(?:\\\\)*\\{re.escape(command)}(?:\[[^]]*\])?\s*\{{")


def command_values(text: str, command: str, closing: dict[int, int] | None = None) -> list[dict]:
    """(start, stop, value) of the argument in braces of each use of a command, one after another; arguments may nest.

    start and stop are the argument's places without its braces; a use whose argument isn't closed ends the search.
    closing: what closing_of gives, if it is known.
    """
    pattern, out, at = _use_of(command), [], 0
    if closing is None:
        closing = closing_of(text) if pattern.search(text) else {}
    while (m := pattern.search(text, at)) and m.end() - 1 in closing:
        stop = closing[m.end() - 1]
        out.append({"start": m.end(), "stop": stop, "value": text[m.end() : stop]})
        at = stop + 1
    return out


_LITERAL = re.compile(r"\\begin\s*\{(verbatim\*?|lstlisting|comment)\}.*?\\end\s*\{\1\}", re.S)
_INLINE = re.compile(r"\\verb\*?([^A-Za-z\s*])")


def masked(text: str) -> str:
    """text with comments and literal text blanked out; line ends and all offsets stay."""
    if "%" not in text and "\\verb" not in text and "\\begin" not in text:
        return text
    blank = lambda s: re.sub(r"[^\r\n]", " ", s)
    out, at = [], 0
    for m in _INLINE.finditer(text):
        line_end = next((i for i in (text.find("\n", m.end()),) if i >= 0), len(text))
        close = text.find(m[1], m.end(), line_end)
        if m.start() >= at and close >= 0:
            out += [text[at : m.start()], blank(text[m.start() : close + 1])]
            at = close + 1
    text = "".join(out) + text[at:]
    points = points_of(text)
    free = np.flatnonzero((points == 37) & ~escaped(points)).tolist()
    out, at = [], 0
    for i in free:
        if i >= at:
            end = re.compile(r"[\r\n]|\Z").search(text, i).start()
            out += [text[at:i], " " * (end - i)]
            at = end
    return _LITERAL.sub(lambda m: blank(m[0]), "".join(out) + text[at:])


def _column(f, kind: str):
    def column(text: Column) -> Column:
        return F.pandas_udf(lambda x: pd.Series([f(t) if isinstance(t, str) else None for t in x], dtype=object), kind)(text)

    return column


brace_spans = _column(lambda t: [dict(zip(("start", "stop", "depth"), map(int, r))) for r in brace_pairs(t)], "array<struct<start:int,stop:int,depth:int>>")
math_spans = _column(lambda t: [{"start": a, "stop": b} for a, b in dollar_spans(t)], "array<struct<start:int,stop:int>>")
alignment_rows = _column(rows_of, "array<string>")
blanked = _column(masked, "string")


def arguments(text: Column, command: str) -> Column:
    """array<struct<start, stop, value>> of a command's arguments."""
    return _column(lambda t: command_values(t, command), "array<struct<start:int,stop:int,value:string>>")(text)
