"""Rules of an article's sections: terms in their order, register, words that mark model-written prose, citations of every point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import inputs as I
from . import rules

# What isn't the article's own prose, words that mark model-written prose, words that tones leave out, questions that they allow.
NOT_PROSE = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$|`[^`\n]+`|\"[^\"\n]*\"|“[^”\n]*”|\[[^\]]*\]"
MARKER_WORDS = "delv(?:e|es|ed|ing)|pivotal|intricate(?:ly)?|showcas(?:e|es|ed|ing)|underscor(?:e|es|ed|ing)|leverag(?:e|es|ed|ing)|seamless(?:ly)?"
YOU, WE = "you|your|yours|yourself", "we|our|ours"
CONTRACTION = r"\w+n['’]t|\w+['’](?:re|ve|ll|d|m)|(?:it|that|there|here|what|let|who|he|she)['’]s"
EXCLUDES = {"casual": [], "semi-formal": [YOU, CONTRACTION], "formal": [YOU, WE, CONTRACTION]}
QUESTIONS = {"casual": 1, "semi-formal": 0, "formal": 0}
_LETTER = r"[\p{L}\p{N}_]"


def word(pattern: str) -> str:
    """A pattern as whole words, in any script and case."""
    return rf"(?i)(?<!{_LETTER})(?:{pattern})(?!{_LETTER})"


def prose(x: Column) -> Column:
    """The text without quotes, mathematics, code and citations, a space in place of each."""
    return F.regexp_replace(x, NOT_PROSE, " ")


def section_faults(sections: DataFrame, terms: DataFrame, key: list[str], place: str, body: str, points: str, tone: str) -> DataFrame:
    """(key, place, rule, path) of every fault of a section.

    sections: body, points (array of strings, each of which must hold a citation in brackets) and tone; terms: (key, term, owner), the
    section at whose place a term is explained.  A term may not be used before; a tone leaves out its words and most questions.
    """
    sections = sections.withColumn("_plain", prose(F.col(body)))
    plain = F.col("_plain")
    by_tone = lambda f: F.coalesce(*[F.when(F.col(tone) == t, f(t)) for t in EXCLUDES])
    clean = by_tone(lambda t: ~F.coalesce(plain.rlike(word("|".join(EXCLUDES[t]))), F.lit(False)) if EXCLUDES[t] else F.lit(True))
    table = [
        rules.Rule("marker_words", body, ~plain.rlike(word(MARKER_WORDS))), rules.Rule("tone", body, clean),
        rules.Rule("questions", body, F.regexp_count(plain, F.lit("[?]")) <= by_tone(lambda t: F.lit(QUESTIONS[t]))),
    ]
    found = rules.issues(sections, [*key, place], table).select(*key, place, "rule", "path")
    each = sections.select(*key, place, F.posexplode(points).alias("_at", "_point"))
    uncited = each.where(~F.coalesce(F.col("_point").rlike(r"\[[^\]]+\]"), F.lit(False))).select(*key, place, F.lit("citation").alias("rule"), F.concat(F.lit(f"{points}["), F.col("_at").cast("string"), F.lit("]")).alias("path"))
    early = sections.select(*key, place, F.col(body).alias("_body")).join(terms, key).where(F.col(place) < F.col("owner"))
    early = early.where(I.uses_term(F.col("_body"), F.col("term"))).select(*key, place, F.lit("later_term").alias("rule"), F.col("term").alias("path"))
    return found.unionByName(uncited).unionByName(early)
