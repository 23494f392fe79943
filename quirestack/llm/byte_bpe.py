"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression.  Every codepoint gets a class from a table, every class
stands for a transition function of a small automaton, and the functions of a whole batch are
composed by a blocked associative scan, which yields the automaton's state, and with it the piece
boundaries, at every position at once.  Pieces are byte slices; merging a piece is cached.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of pieces and ids that a worker keeps, about.  Beyond it the cache starts afresh; results don't depend on it.
CACHE_BYTES = 64 << 20

# ---- pre-tokenisation ------------------------------------------------------------------------
# Unicode's White_Space property, and the endings that an apostrophe joins.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS_1 = "stmd"
ENDINGS_2 = ["re", "ve", "ll"]

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# Symbols: a class, seen with what follows it.  GLUE is a ' ' before a non-space; LAST another white
# space before a non-space; GAP white space before white space or the end; QUOTE_1 and QUOTE_2 an
# apostrophe with an ending of one or two letters after it.
GLUE, LAST, QUOTE_1, QUOTE_2 = 4, 5, 6, 7
SYMBOLS = 8
# States: what the current piece is.  IN_GAP: a run of white space whose next symbol may part it;
# OPEN: a ' ' that takes the run after it; TAIL_n: n letters of an ending are to come; SHUT: the next
# symbol starts a piece.
S_SHUT, S_OTHER, S_LETTER, S_NUMBER, S_GAP, S_OPEN, S_TAIL_1, S_TAIL_2 = range(8)
STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at the symbol."""
    if state == S_TAIL_2:
        return S_TAIL_1, False
    if state == S_TAIL_1:
        return S_SHUT, False
    if symbol == SPACE:
        return S_GAP, state != S_GAP
    if symbol == GLUE:
        return S_OPEN, True
    if symbol == LAST:
        return S_SHUT, True
    if symbol in (QUOTE_1, QUOTE_2):
        if state in (S_OTHER, S_OPEN):  # inside a run of other characters it is one of them
            return S_OTHER, False
        return (S_TAIL_1 if symbol == QUOTE_1 else S_TAIL_2), True
    run = {OTHER: S_OTHER, LETTER: S_LETTER, NUMBER: S_NUMBER}[symbol]
    return run, not (state == run or state == S_OPEN)


@lru_cache(1)
def _automaton():
    """(function of each symbol and of each symbol that opens a text, composition table, apply table, start flags).

    The functions reachable by composition form a small monoid, so a composition is one table look-up.
    """
    base = [tuple(_step(s, c)[0] for s in range(STATES)) for c in range(SYMBOLS)]
    base += [(_step(S_SHUT, c)[0],) * STATES for c in range(SYMBOLS)]  # a text's first symbol forgets what was before
    identity = tuple(range(STATES))
    index = {identity: 0}
    todo = list(dict.fromkeys(base))
    for f in todo:
        index.setdefault(f, len(index))
    grew = True
    while grew:
        grew = False
        for f, g in product(list(index), todo):
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(index)
                grew = True
    functions = list(index)
    if len(functions) >= 1 << 16:
        raise AssertionError("the automaton's functions don't fit the table")
    after = np.array([[index[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    start = np.array([[_step(s, c)[1] for c in range(SYMBOLS)] for s in range(STATES)], bool)
    return np.array([index[f] for f in base], np.uint16), after.ravel(), np.array(functions, np.uint8).ravel(), start.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pieces start, in the codepoints of texts laid end to end; first: where each non-empty text begins."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbol_fn, after, functions, start = _automaton()
    kind = _classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    follow = np.empty(n, np.uint8)  # the class after it; the end counts as white space
    follow[:-1] = kind[1:]
    follow[-1] = SPACE
    follow[opens[1:]] = SPACE
    symbol = kind.copy()
    before_text = (kind == SPACE) & (follow != SPACE)
    symbol[before_text] = LAST
    symbol[before_text & (points == 0x20)] = GLUE
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        end = np.append(first, n)[np.searchsorted(first, quote, "right")]  # of its text
        one = np.where(quote + 1 < end, points[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < end, points[np.minimum(quote + 2, n - 1)], 0)
        pair = np.zeros(len(quote), bool)
        for a, b in ENDINGS_2:
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[quote[pair]] = QUOTE_2
        symbol[quote[np.isin(one, [ord(c) for c in ENDINGS_1])]] = QUOTE_1
    height = min(96, n)
    width = -(-n // height)
    # Column j of the grid is block j: all blocks advance together, one row at a time.
    grid = np.zeros(width * height, np.uint16)
    grid[:n] = symbol_fn[symbol + np.uint8(SYMBOLS) * opens[:n]]
    scan = np.ascontiguousarray(grid.reshape(width, height).T)
    size = np.int32(len(functions) // STATES)
    at = np.empty(width, np.int32)
    for i in range(1, height):
        np.multiply(scan[i - 1], size, out=at, dtype=np.int32)
        at += scan[i]
        np.take(after, at, out=scan[i], mode="clip")
    total = scan[-1].tolist()
    entry, state, result = [], S_SHUT, functions.tolist()
    for f in total:
        entry.append(state)
        state = result[f * STATES + state]
    entry = np.array(entry, np.uint8)
    states = np.empty((height, width), np.uint8)
    states[0] = entry
    np.take(functions, scan[:-1].astype(np.int32) * STATES + entry, out=states[1:], mode="clip")
    before = np.ascontiguousarray(states.T).reshape(-1)[:n]
    flag = start[before * np.uint8(SYMBOLS) + symbol]
    flag[first] = True
    return np.flatnonzero(flag)


# ---- merging ---------------------------------------------------------------------------------


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by token and tokens by id, from a rank file."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


class Encoder:
    """Encodes batches of texts; keeps the ids of pieces it has met."""

    def __init__(self, path: str, keep: int = CACHE_BYTES):
        self.ranks, self.tokens = vocabulary(path)
        self.lengths = np.array([len(t) for t in self.tokens], np.int32)
        # The library joins the pairs of one piece; it never sees a whole text, nor its pattern.
        self.merge = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.keep, self.cache, self.held = keep, {}, 0

    def _packed(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of 32-bit integers."""
        if self.held > self.keep:
            self.cache.clear()
            self.held = 0
        cache, merge = self.cache, self.merge
        packed = list(map(cache.get, pieces))
        if None in packed:
            for i, p in enumerate(packed):
                if p is None:
                    piece = pieces[i]
                    if (p := cache.get(piece)) is None:
                        p = array("i", merge(piece)).tobytes()
                        self.held += len(piece) + len(p) + 150
                        if self.held <= self.keep:
                            cache[piece] = p
                    packed[i] = p
        return packed

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its token ids and the byte offset at which each token starts."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        starts = piece_starts(points, begin[sizes > 0])
        raw = joined.encode("utf-8", "surrogatepass")
        cuts = np.append(starts, len(points))
        if len(raw) != len(points):
            at = np.zeros(len(points) + 1, np.int32)
            np.cumsum(1 + (points > 0x7F).view(np.int8) + (points > 0x7FF).view(np.int8) + (points > 0xFFFF).view(np.int8), out=at[1:])
            cuts = at[cuts]
        cuts = cuts.tolist()
        packed = self._packed([raw[a:b] for a, b in zip(cuts, cuts[1:])])
        first = np.searchsorted(starts, np.append(begin, len(points))).tolist()
        out = []
        for a, b in zip(first, first[1:]):
            ids = np.frombuffer(b"".join(packed[a:b]), np.int32)
            offsets = np.cumsum(self.lengths[ids], dtype=np.int32) - self.lengths[ids]
            out.append((ids, offsets))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _bounded(batches, limit: int = 1 << 19):
    """(keys, texts) of Arrow batches in slices of about limit characters, so that output batches stay small."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            upto = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), limit, "right")))
            yield keys.slice(at, upto - at), [t or "" for t in texts.slice(at, upto - at).to_pylist()]
            at = upto


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def token_table(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, offsets, decoded) for every row, repeated rows and null keys included.

    offsets holds the byte at which each token starts in the UTF-8 text, so a decoded span can be
    traced to its place; decoded is what the ids stand for.  Null and empty texts have no ids and
    decode to no bytes.  Other columns of docs, whatever their names, are left aside.  path: a rank
    file that is at this place on every executor.
    """
    rows = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches):
        encoder = _encoder(path)
        for keys, texts in _bounded(batches):
            pairs = encoder.encode(texts)
            ids = [p[0] for p in pairs]
            decoded = pa.array([encoder.decode(i.tolist()) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, _lists(ids), _lists([p[1] for p in pairs]), decoded], ["k", "ids", "offsets", "decoded"])

    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, ids array<int>, offsets array<int>, decoded binary")
    return out.withColumnRenamed("k", key)


def decode(ids: Column, path: str) -> Column:
    """The bytes that a column of ids stands for; null ids give no bytes."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        tokens = vocabulary(path)[1]
        return pd.Series([b"".join(map(tokens.__getitem__, r.tolist())) if r is not None else b"" for r in rows], dtype=object)

    return run(ids)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    table = token_table(docs, public_tokenizers.path(VOCABULARY))
    return table.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
