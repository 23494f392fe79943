"""Interleaved document sequences: ordered text and media references from HTML, payloads joined by digest.

A document is an ordered array of parts; a part is either text or a reference to a medium, by the
digest of its payload, with its caption.  Media live in a table of their own, one row a digest, in a
lossless stored form.  References are resolved by an equi-join on the digest and put back in order,
so positions and captions stay aligned whether or not a payload is found.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

PART = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
#: Samples in a row of a stored image; payloads are padded to a multiple of it.
WIDTH = 64
# Elements whose text is not content, those that may stand in a head, elements that don't end a run of text, elements that refer to media.
SILENT = {"script", "style", "template", "noscript", "head", "title"}
IN_HEAD = {"meta", "link", "base", "title", "style", "script", "noscript", "template"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "wbr"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(HTMLParser):
    """Collects parts in document order; a figure's caption, before or after its media, goes to the media inside that figure.

    What stands in a silent element is dropped once that element is closed; a head ends at the first
    element that can't stand in it, and content of one that is never closed is kept.  A caption ends with
    its element or its figure; of one that is never closed the first run of text is the caption, the rest
    stays.  A caption without media stays where it stood, as text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.words: list[str] = []
        self.silent: list[tuple[str, int, list[str]]] = []  # (element, parts before it, words before it)
        self.figures: list[dict] = []

    def parse_marked_section(self, i, report=1):
        """Unknown sections end at the next '>', as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            at = self.rawdata.find(">", i)
            return at + 1 if at >= 0 else -1

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    def cut(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.parts.append(["text", text, None, None])

    def end_silent(self, at: int):
        tag, count, words = self.silent[at]
        del self.parts[count:], self.silent[at:]
        self.words = words
        for figure in self.figures:  # media inside are gone, too
            figure["media"] = [m for m in figure["media"] if any(m is p for p in self.parts)]

    def end_caption(self, whole: bool = True):
        """Takes the text since the caption began out of the parts: all of it, or its first run."""
        self.cut()
        figure = self.figures[-1]
        begin, figure["open"] = figure["open"], None
        if begin is None:
            return
        texts = [p for p in self.parts[begin:] if p[0] == "text"][: None if whole else 1]
        rest = [p for p in self.parts[begin:] if not any(p is t for t in texts)]
        self.parts[begin:] = rest
        if texts:
            figure["caption"], figure["at"] = " ".join([*([figure["caption"]] if figure["caption"] else []), *[t[1] for t in texts]]), begin

    def end_figure(self, whole: bool = True):
        self.end_caption(whole)
        figure = self.figures.pop()
        media = figure["media"] or [m for m in figure["within"] if m[3] is None]
        if figure["caption"]:
            for part in media:
                part[3] = figure["caption"]
            if not media:
                self.parts.insert(figure["at"], ["text", figure["caption"], None, None])
        if self.figures:
            self.figures[-1]["within"] += figure["media"] + figure["within"]

    def handle_starttag(self, tag, attrs):
        if self.silent and self.silent[-1][0] == "head" and tag not in IN_HEAD:
            self.end_silent(len(self.silent) - 1)
        if tag in SILENT:
            self.silent.append((tag, len(self.parts), list(self.words)))
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.figures[-1]["open"] = len(self.parts)
        elif tag in MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self.cut()
                part = ["media", None, given["src"], given.get("alt") or given.get("title")]
                self.parts.append(part)
                if self.figures:
                    self.figures[-1]["media"].append(part)
        elif tag not in INLINE:
            self.cut()
            if tag == "figure":
                self.figures.append({"media": [], "within": [], "open": None, "caption": None, "at": len(self.parts)})

    def handle_endtag(self, tag):
        if tag in SILENT:
            at = next((k for k in range(len(self.silent) - 1, -1, -1) if self.silent[k][0] == tag), None)
            if at is not None:
                self.end_silent(at)
        elif tag == "figcaption" and self.figures:
            self.end_caption()
        elif tag not in INLINE:
            self.cut()
            if tag == "figure" and self.figures:
                self.end_figure()

    def handle_data(self, data):
        self.words.append(data)

    def finish(self):
        self.close()
        # Scripts and styles run to the end of a page that doesn't close them; other silent elements had content.
        for at, (tag, _, _) in enumerate(self.silent):
            if tag in ("script", "style"):
                self.end_silent(at)
                break
        self.cut()
        while self.figures:
            self.end_figure(whole=False)


def parts_of(html: str) -> list[tuple]:
    reader = _Sequence()
    reader.feed(html)
    reader.finish()
    return [(i, *p) for i, p in enumerate(reader.parts)]


def sequence(html: Column) -> Column:
    """array<PART> of an HTML column, in reading order; null and empty pages have no parts, malformed ones those of _Sequence."""

    @F.pandas_udf(f"array<{PART}>")
    def run(pages: pd.Series) -> pd.Series:
        names = ("pos", "kind", "text", "ref", "caption")
        return pd.Series([[dict(zip(names, p)) for p in parts_of(h)] if isinstance(h, str) else [] for h in pages], dtype=object)

    return run(html)


# ---- stored form: an 8-bit grey PNG, WIDTH samples a row -------------------------------------
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """payload, a positive multiple of WIDTH bytes, as the samples of a grey image."""
    height = len(payload) // WIDTH
    if height == 0 or height * WIDTH != len(payload):
        raise ValueError("a payload is a positive multiple of the row width")
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row is led by its filter, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an image written by to_png; damaged bytes raise ValueError."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while at < len(stored):
        (size,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are written here")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Sample statistics and a 64-bit average hash of column means, as text."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    columns = x.reshape(-1, WIDTH).sum(0, dtype=np.int64)
    bits = int("".join("1" if c else "0" for c in columns * WIDTH > columns.sum()), 2)
    entropy = float(-(share * np.log2(share)).sum())
    return f"rows={len(x) // WIDTH};sum={int(x.sum(dtype=np.int64))};distinct={len(share)};entropy={entropy + 0.0:.6f};hash={bits:016x}"


#: Descriptions that a worker keeps while it describes payloads, so that copies near each other are stored once.
KEPT = 20_000

FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(payload: Column) -> Column:
    """The stored form of a payload column; null stays null."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([to_png(p) if p is not None else None for p in rows], dtype=object)

    return run(payload)


def _described(m: bytes) -> tuple:
    p = from_png(m)
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(p)


def describe(stored: Column) -> Column:
    """What is read back from a stored-form column: sizes, digests and the feature string."""

    @F.pandas_udf(FIELDS)
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_described(m) for m in rows], columns=[f.split()[0] for f in FIELDS.split(", ")])

    return run(stored)


def catalogue(payloads: DataFrame) -> DataFrame:
    """One row a digest of (digest, payload): the payload is stored, and what is read back is described; no payload is shuffled."""

    def run(frames):
        known = {}
        for frame in frames:
            rows = []
            for digest, payload in zip(frame["digest"], frame["payload"]):
                if digest not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[digest] = (digest, *_described(to_png(payload)))
                    rows.append(known[digest])
            yield pd.DataFrame(rows, columns=["digest", *[f.split()[0] for f in FIELDS.split(", ")]])

    return payloads.select("digest", "payload").mapInPandas(run, f"digest string, {FIELDS}").dropDuplicates(["digest"])


def resolve(sequences: DataFrame, media: DataFrame, key: str, parts: str = "parts", digest: str = "digest") -> DataFrame:
    """One row for each part: key, the part's fields, and media's columns where its reference is a digest in media.

    media has one row a digest.  Text parts and references that media lacks keep their place with
    null media columns, and aren't shuffled: only parts that name a digest are joined.  A digest that very many
    parts share is split by adaptive skew handling; the media side holds each payload once, however often it is referred to.
    """
    rows = sequences.select(F.col(key), F.explode_outer(parts).alias("_p")).select(key, "_p.*")
    rows = rows.withColumn("_digest", F.nullif(F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1), F.lit("")))
    found = media.withColumnRenamed(digest, "_digest")
    named = rows.where("_digest IS NOT NULL").join(found, "_digest", "left").drop("_digest")
    return named.unionByName(rows.where("_digest IS NULL").drop("_digest"), allowMissingColumns=True)


def text_payloads(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, payload, digest): each text as UTF-8 with zero bytes up to a positive multiple of WIDTH; null counts as empty."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long")
    padded = F.greatest(F.lit(WIDTH), F.ceil(size / WIDTH) * WIDTH).cast("int")
    rows = docs.select(F.col(key), size.alias("n_bytes"), F.rpad(raw, padded, F.lit(b"\x00")).alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def document_media(docs: DataFrame) -> DataFrame:
    """Every document as a one-figure page whose medium is its text's payload, stored, read back and resolved.

    Every row comes back, repeated rows and null ids included; equal texts share one medium.  The
    media table is described before the join, so payload bytes aren't shuffled.
    """
    payloads = text_payloads(docs)
    page = F.concat(F.lit('<article><figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>text of '), F.col("n_bytes"), F.lit(" bytes</figcaption></figure></article>"))
    pages = payloads.select(F.struct("doc_id", "n_bytes").alias("doc"), sequence(page).alias("parts"))
    media = catalogue(payloads)
    return resolve(pages, media, "doc").where("kind = 'media'").select("doc.*", "pos", "caption", *[c for c in media.columns if c != "digest"])


def page_sequences(pages: DataFrame, media: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, text, ref, caption, media columns) of every page's parts, text and media in reading order."""
    return resolve(pages.select(F.col(key), sequence(F.col(html)).alias("parts")), media, key)


def illustrated(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with a figure of their own put behind their first heading, and the payloads (digest, payload) the figures refer to.

    The given pages hold no media; a figure shows the page's address.  Of every third page the payload is missing.
    """
    digest = F.sha2(F.coalesce("url", F.lit("")).cast("binary"), 256)
    figure = F.concat(F.lit('</h1><figure><figcaption>Page '), F.col("page_id").cast("string"), F.lit('</figcaption><img src="sha256:'), digest, F.lit('"></figure>'))
    shown = pages.withColumn("html", F.concat(F.split_part("html", F.lit("</h1>"), F.lit(1)), figure, F.expr("substr(html, length(split_part(html, '</h1>', 1)) + 6)")))
    padded = F.rpad(F.coalesce("url", F.lit("")).cast("binary"), F.greatest(F.lit(WIDTH), F.ceil(F.octet_length("url") / WIDTH) * WIDTH).cast("int"), F.lit(b"\x00"))
    return shown, pages.where("page_id % 3 <> 0").select(digest.alias("digest"), padded.alias("payload"))


def media_page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 on web pages: text and media of every page in order, with captions and what the stored payloads hold."""
    shown, payloads = illustrated(small_batches(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return page_sequences(shown, catalogue(payloads)).select("page_id", "pos", "kind", "text", "ref", "caption", "payload_bytes", "payload_sha256")


def op5_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(documents(spark, sf_dir))
