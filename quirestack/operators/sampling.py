"""Quotes sampled from passages by their digests, and which of them a new version has lost."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .matching import relocate

# A unit is a formula or a word; passages of fewer characters or units give no quote; context on both sides.
CHARACTERS, UNITS, AROUND = 40, 6, 32


_UNIT = re.compile(r"\$[^$]*\$|[^ \t\n\x0b\f\r$]+")


def _drawn(text: str, digest: str) -> list[dict]:
    """The quotes of one passage; digest: its 40 hexadecimal digits, of which fewer are shorter numbers."""
    units = [(m.start(), m.end()) for m in _UNIT.finditer(text)]
    n = len(units)
    if n < UNITS:
        return []
    number = int(digest, 16)
    drawn = lambda bits, size: (number >> bits) % size
    count = min(6 + drawn(0, 10), n)
    spans = [(min(n, max(0, n // 2 - count // 2) + count) - count, count)]
    formulas = [i for i, (at, _) in enumerate(units) if text[at] == "$"]
    if formulas:
        second = min(6 + drawn(16, 10), n)
        two = max(0, min(formulas[drawn(8, len(formulas))] - drawn(24, second), n - second)), second
        spans += [two] if two != spans[0] else []
    ends = [(units[a][0], units[a + k - 1][1]) for a, k in spans]
    return [{"n": i, "quote": text[a:b], "before": text[max(0, a - AROUND) : a], "after": text[b : b + AROUND]} for i, (a, b) in enumerate(ends)]


def sampled_quotes(passages: DataFrame, document: str, passage: str, text: str = "text") -> DataFrame:
    """(document, passage, n, quote, before, after): 6 to 15 whole units from the middle of each passage, and as many around a formula.

    A formula is one unit.  Everything is drawn from the SHA-1 of document and passage, taken as a number of 160 bits, so a
    passage gives the same quotes wherever it lies.  Short passages give none, and a second quote equal to the first is left out.
    """
    draw = F.pandas_udf(lambda t, d: pd.Series([_drawn(x, y) for x, y in zip(t, d)], dtype=object), "array<struct<n:int,quote:string,before:string,after:string>>")
    rows = passages.where(F.length(text) >= CHARACTERS).select(document, passage, F.col(text).alias("_t"), F.sha1(F.concat_ws(":", document, passage).cast("binary")).alias("_d"))
    return rows.select(document, passage, F.explode(draw("_t", "_d")).alias("_q")).select(document, passage, "_q.*")


def lost_quotes(quotes: DataFrame, passages: DataFrame, document: str, passage: str, spot: str) -> DataFrame:
    """(document, passage, n, quote, key): quotes of old passages that a document's new passages have neither word for word nor moved.

    quotes: as sampled_quotes gives them, with near, the old passage's spot.  passages: (key, document, passage, text, spot) of
    the new version.  key: what an allow-list names a loss by: the passage and eight digits of the quote's SHA-256.
    """
    asked = stored(quotes.withColumn("_q", F.struct(document, passage, "n")).withColumnRenamed("quote", "text"), "asked")
    texts = passages.withColumn("_p", F.struct(document, passage)).withColumn("spot", F.col(spot).cast("double"))
    # What still stands word for word in the passage of its own number is found; only the others are sought, in their documents.
    same = texts.select(document, passage, F.col("text").alias("_now"))
    gone = asked.join(same, [document, passage], "left").where("NOT coalesce(contains(_now, text), false)")
    gone = stored(gone.drop("_now"), "gone")
    found = relocate(gone, texts, "_q", "_p", within=document).where("found = 'not-found'").select("_q")
    lost = gone.join(found, "_q", "left_semi").select(document, passage, "n", F.col("text").alias("quote"))
    return lost.withColumn("key", F.concat_ws(":", F.lit("not-found"), F.col(passage).cast("string"), F.substring(F.sha2(F.col("quote").cast("binary"), 256), 1, 8)))
