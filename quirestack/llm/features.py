"""Features of whole texts, computed for many texts at once from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .common import Prefix, mix, words_of

# Separators of words: ASCII white space; and everything in ASCII but letters.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = True
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LINE = np.zeros(256, bool)
LINE[0x0A] = True

# Byte groups whose shares describe a text: each ASCII punctuation mark alone, and larger groups.
_GROUP = np.zeros(256, np.int64)
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_GROUP[_MARKS] = np.arange(len(_MARKS)) + 1
_GROUP[0x41:0x5B] = len(_MARKS) + 1
_GROUP[0x61:0x7B] = len(_MARKS) + 2
_GROUP[0x30:0x3A] = len(_MARKS) + 3
_GROUP[0x20] = len(_MARKS) + 4
_GROUP[0x0A] = len(_MARKS) + 5
_GROUP[0x80:] = len(_MARKS) + 6
_GROUPS = len(_MARKS) + 7
#: Number of values stats() gives for a text.
STATS = _GROUPS + 7
#: Places of some of them: the shares of '!', '*' and capitals, repeated words, repeated lines.
EXCLAMATIONS, ASTERISKS, CAPITALS = (int(_GROUP[ord(c)]) for c in "!*A")
REPEATED_WORDS, REPEATED_LINES = _GROUPS + 2, _GROUPS + 4


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its hashes and of its distinct hashes."""
    total = np.diff(first)
    text = np.repeat(np.arange(len(total)), total)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return total, np.bincount(t[new], minlength=len(total))


def stats(part: list[bytes]) -> np.ndarray:
    """STATS values for each text; an empty text has zeros."""
    n = len(part)
    sizes = np.array([len(x) for x in part], np.int64)
    data = np.frombuffer(b"".join(part), np.uint8)
    text = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text * _GROUPS + _GROUP[data], minlength=n * _GROUPS).reshape(n, _GROUPS)
    some = np.maximum(sizes, 1)[:, None]
    out = np.zeros((n, STATS))
    out[:, :_GROUPS] = np.log1p(50 * counts / some)
    low, start, end, first = words_of(part, WHITE)
    rolled = Prefix(low)
    words, distinct = _distinct(rolled.hash(start, end), first)
    _, l_start, l_end, l_first = words_of(part, LINE)
    lines, distinct_lines = _distinct(rolled.hash(l_start, l_end), l_first)
    letters = np.add.reduceat(np.append(end - start, 0), np.minimum(first[:-1], len(start))) * (words > 0)
    out[:, _GROUPS] = np.log1p(sizes)
    out[:, _GROUPS + 1] = distinct / np.maximum(words, 1)
    out[:, _GROUPS + 2] = np.log1p(words) - np.log1p(distinct)
    out[:, _GROUPS + 3] = distinct_lines / np.maximum(lines, 1)
    out[:, _GROUPS + 4] = np.log1p(lines) - np.log1p(distinct_lines)
    out[:, _GROUPS + 5] = np.log1p(letters / np.maximum(words, 1))
    out[:, _GROUPS + 6] = np.log1p(words / np.maximum(lines, 1))
    return out


#: Lengths in bytes of the word beginnings that count as terms beside whole words.
STEMS = (4, 5, 6, 7, 8)


def terms(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, term hash, context hash) of every occurrence, and each text's number of words: words without case and marks, and their beginnings.

    The context is the word before, 0 at a text's beginning.
    """
    low, start, end, first = words_of(part, NOT_LETTER)
    rolled = Prefix(low)
    text = np.repeat(np.arange(len(part)), np.diff(first))
    word = rolled.hash(start, end)
    before = np.zeros(len(word), np.uint64)
    before[1:] = word[:-1]
    before[first[:-1][first[:-1] < len(word)]] = 0
    owner, found, context = [text], [word], [before]
    for k in STEMS:
        long = end - start > k
        owner.append(text[long])
        found.append(mix(rolled.hash(start[long], start[long] + k) + np.uint64(k)))
        context.append(before[long])
    return np.concatenate(owner), np.concatenate(found).view(np.int64), np.concatenate(context).view(np.int64), np.diff(first)


#: How often a term must be found for each of its levels: at least so many times, and once in so many words.
LEVELS = ((1, 10**9), (2, 10**9), (3, 10**9), (2, 150), (2, 60), (3, 30))


def levels(owner: np.ndarray, found: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, term): the levels that each term reaches in each text, once each."""
    order = np.lexsort((found, owner))
    o, f = owner[order], found[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(f)))
    o, f = o[at], f[at]
    rare = words[o] / np.maximum(count, 1)
    text, feature, term = [], [], []
    for k, (least, every) in enumerate(LEVELS):
        hit = (count >= least) & (rare <= every)
        text.append(o[hit])
        term.append(f[hit])
        feature.append(mix(f[hit].view(np.uint64) + np.uint64(k)).view(np.int64))
    return np.concatenate(text), np.concatenate(feature), np.concatenate(term)
