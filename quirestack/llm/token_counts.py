"""Count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary pieces that end at each character; dynamic programming carries
the best score and its number of pieces.  No segmentation is ever stored.  The public piece file holds
pieces with scores, and these are read as a unigram vocabulary: a character that is no piece costs the
least score less UNKNOWN_PENALTY and counts as its UTF-8 bytes (byte fallback), and of equal scores the
path whose last piece is longest wins.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Bytes of segments whose counts a worker keeps, about, and characters of one.  Beyond them the cache starts
#: afresh and longer segments are counted each time; results don't depend on it.
CACHE_BYTES, LONG = 32 << 20, 1 << 10


class Counter:
    """Token counts under pieces (piece, score): exactly those of a unigram tokenizer with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]], keep: int = CACHE_BYTES):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        scores = [float(s) for _, s in pieces]
        self.unknown = min(scores) - UNKNOWN_PENALTY
        inner = {c for piece, _ in pieces if len(piece) > 1 for c in piece}
        # Paths before and after a cut that no piece spans are independent, and whole-numbered scores
        # add up without rounding, so segments may be counted apart.  Otherwise texts stay whole.
        exact = all(s == int(s) for s in scores)
        self.by_line = exact and "\n" not in inner
        self.by_space = exact and not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.longest = max(len(piece) for piece, _ in pieces)
        self.keep, self.cache, self.held = keep, {}, 0

    def segment(self, text: str) -> int:
        """Pieces on the best path of one segment; only as many positions are held as the longest piece reaches back."""
        n = len(text)
        if not n:
            return 0
        ring = self.longest + 1
        best = [0.0] * ring
        count = [0] * ring
        reached = 0  # positions up to here are final
        length_1, found, unknown = False, False, self.unknown
        top = top_count = 0.0
        matches = self.automaton.iter(text)
        end, (length, score) = next(matches, (n, (0, 0.0)))
        while reached < n:
            found = length_1 = False
            while end == reached:  # matches that end at this character, longest first
                start = (end + 1 - length) % ring
                s = best[start] + score
                if not found or s > top:
                    top, top_count, found = s, count[start] + 1, True
                length_1 |= length == 1
                end, (length, score) = next(matches, (n, (0, 0.0)))
            if not length_1:
                s = best[reached % ring] + unknown
                if not found or s > top:
                    top, top_count = s, count[reached % ring] + len(text[reached].encode("utf-8", "replace"))
            reached += 1
            best[reached % ring], count[reached % ring] = top, top_count
        return count[n % ring]

    def _cached(self, segment: str) -> int:
        n = self.cache.get(segment)
        if n is None:
            n = self.segment(segment)
            self.held += len(segment) + 100
            if self.held > self.keep:
                self.cache.clear()
                self.held = len(segment) + 100
            if len(segment) <= LONG:
                self.cache[segment] = n
        return n

    def count(self, text: str) -> int:
        """Pieces of a whole text; an empty text has none."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        lines = text.split("\n") if self.by_line else [text]
        total = (len(lines) - 1) * self._cached("\n")
        get = self.cache.get
        for line in lines:
            if self.by_space:
                if SPACE + SPACE in line:
                    parts = re.findall(f"^[^{SPACE}]+|{SPACE}+[^{SPACE}]*", line)
                else:
                    head, *rest = line.split(SPACE)
                    parts = [head, *[SPACE + w for w in rest]] if head else [SPACE + w for w in rest]
                counts = list(map(get, parts))
                if None in counts:
                    counts = [self._cached(p) if c is None else c for p, c in zip(parts, counts)]
                total += sum(counts)
            else:
                total += self.segment(line)
        return total


def pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a piece file and their scores; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


_COUNTERS: dict[str, Counter] = {}


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a text column as long; null and empty texts have none."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(pieces(path))
        count = _COUNTERS[path].count
        return pd.Series([count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return run(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens) for every row, repeated rows and null keys included; other columns are left aside."""
    return docs.select(F.col(key), token_count(F.col(text), path).alias("n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
