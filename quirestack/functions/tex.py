"""Plain text and metadata from TeX: commands unwrapped from the innermost out, accents composed, names from the source."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import closing_of, command_values, masked

# Accent commands and their combining marks, letters that are commands, commands that leave no text.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", '"': "\u0308", "r": "\u030a", "H": "\u030b", "v": "\u030c", "c": "\u0327", "k": "\u0328", "d": "\u0323", "b": "\u0331"}
LETTERS = {"i": "ı", "j": "ȷ", "ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å"}
# What signs stand for, and how what is left is tidied, one after another.
SIGNS = {r"\&": "&", r"\%": "%", r"\_": "_", "~": " ", "\\ ": " "}
TIDY = [(r"\\[A-Za-z@]+\*?", " "), (r"[{}$]", ""), (r"\s*,\s*", ", "), (r"(?:,\s*){2,}", ", "), (r"\s+", " ")]
_ACCENT = re.compile(r"\\(?:([`'^~=.\"])|([uvHcrkdb])(?![A-Za-z]))\s*(?:\{\s*(\\?[A-Za-z])\s*\}|(\\?[A-Za-z]))")
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|aa|AA|[ijoOlL])(?![A-Za-z])\s?")
_NOTE = re.compile(r"\\(?:thanks|footnote)(?:\[[^]]*\])?\s*(?=\{)")
_WRAPPED = re.compile(r"\\[A-Za-z@]+\*?(?:\[[^]]*\])?\{([^{}]*)\}")


def _accented(m: re.Match) -> str:
    base = (m[3] or m[4]).lstrip("\\")
    return unicodedata.normalize("NFC", base + ACCENTS[m[1] or m[2]])


def strip_tex(value: str, authors: bool = False) -> str:
    """The text of a TeX value: comments and notes gone, commands replaced by what they wrap until none wraps anything; authors are parted by commas."""
    value = masked(value)
    notes, out, at = list(_NOTE.finditer(value)), [], 0
    ends = closing_of(value) if notes else {}
    for m in notes:
        if m.start() >= at and m.end() in ends:
            out.append(value[at : m.start()])
            at = ends[m.end()] + 1
    value = re.sub(r"\\footnotemark(?:\[[^]]*\])?", "", "".join(out) + value[at:])
    value = _LETTER.sub(lambda m: LETTERS[m[1]], _ACCENT.sub(_accented, value))
    value = re.sub(r"\\and\b|\\\\+" if authors else r"\\\\+", ", " if authors else " ", value)
    for sign, meant in SIGNS.items():
        value = value.replace(sign, meant)
    found = 1
    while found:
        value, found = _WRAPPED.subn(r"\1", value)
    for pattern, put in TIDY:
        value = re.sub(pattern, put, value)
    return value.strip(" ,")


def _defined(tex: str, name: str, authors: bool) -> str:
    """What a command without arguments stands for by its last definition; a definition that only provides it doesn't replace another."""
    kinds = re.compile(rf"\\(newcommand|renewcommand|providecommand)\*?\s*(?:\{{\s*\\{re.escape(name)}\s*\}}|\\{re.escape(name)}(?![A-Za-z@]))\s*(?:\[0\]\s*)?(?=\{{)")
    ends, found = closing_of(tex), ""
    for m in kinds.finditer(tex):
        body = strip_tex(tex[m.end() + 1 : ends[m.end()]], authors) if m.end() in ends else ""
        if body and not (found and m[1] == "providecommand"):
            found = body
    return found


def first_value(tex: str, command: str, authors: bool = False, closing: dict[int, int] | None = None) -> str:
    """The first use of a command that leaves text; one that holds a single command stands for its definition."""
    for use in command_values(tex, command, closing):
        text = strip_tex(use["value"], authors)
        alias = re.fullmatch(r"\s*\\([A-Za-z@]+)\s*", use["value"])
        text = text or (_defined(tex, alias[1], authors) if alias else "")
        if text:
            return text
    return ""


def metadata_of(tex: str, name: str) -> dict:
    """title and authors of a source; without them the paper's name and 'Unknown authors'."""
    tex = masked(tex)
    closing = closing_of(tex)
    authors = first_value(tex, "author", authors=True, closing=closing)
    if not authors:
        authors = ", ".join(n for n in (strip_tex(v["value"]) for v in command_values(tex, "icmlauthor", closing)) if n)
    return {
        "title": first_value(tex, "title", closing=closing) or first_value(tex, "icmltitle", closing=closing) or f"arXiv {name}",
        "authors": authors or "Unknown authors",
    }


def metadata(tex: Column, name: Column) -> Column:
    """struct<title, authors> of a TeX source and the paper's name; null counts as an empty source."""

    def run(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        found = [metadata_of(x if isinstance(x, str) else "", y) for x, y in zip(t, n)]
        return pd.DataFrame({c: [m[c] for m in found] for c in ("title", "authors")}, columns=["title", "authors"], dtype=object)

    return F.pandas_udf(run, "title string, authors string")(tex, name)
