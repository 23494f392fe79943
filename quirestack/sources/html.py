"""Readers of markup: blocks, links, metadata."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "table", "figure", "blockquote"}
AREAS = {"nav", "header", "footer", "article", "aside", "main"}
HIDDEN = {"script", "style", "title"}
# Marks of bibliographies, elements without content, hosts of venues, identifiers and licences.
BIBLIOGRAPHY = {"ltx_bibliography", "ltx_biblist", "ltx_bibitem", "bibliography", "references", "csl-bib-body", "csl-entry", "doc-bibliography", "doc-biblioentry", "biblioentry"}
#: Marks of the cell that holds a page's own comments.
COMMENTS = {"tablecell", "comments"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NEVER_OWN = ["arxiv.org", "doi.org", "dx.doi.org", "openreview.net", "aclanthology.org", "neurips.cc", "proceedings.neurips.cc", "creativecommons.org", "scholar.google.com", "w3.org"]


class _Reader(HTMLParser):
    """Blocks in order with the area they stand in and the heading before them; an unclosed block ends where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.tag, self.words, self.areas, self.heading, self.hidden = [], None, [], [], None, 0

    def flush(self):
        text = " ".join("".join(self.words).split())
        if self.tag and text:
            if self.tag[0] == "h":
                self.heading = text
            self.rows.append((len(self.rows), self.tag, text, self.areas[-1] if self.areas else None, self.heading))
        self.tag, self.words = None, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.flush()
            self.tag = tag
        elif tag in AREAS:
            self.flush()
            self.areas.append(tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.flush()
        elif tag in AREAS:
            self.flush()
            if tag in self.areas:
                del self.areas[len(self.areas) - 1 - self.areas[::-1].index(tag) :]

    def handle_data(self, data):
        if self.tag and not self.hidden:
            self.words.append(data)

    def parse_marked_section(self, i, report=1):
        """Unknown sections end at the next '>', as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            at = self.rawdata.find(">", i)
            return at + 1 if at >= 0 else -1


def _blocks(html: str) -> list[dict]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return [dict(zip(("pos", "tag", "text", "area", "section"), r)) for r in reader.rows]


def _all_blocks(html: pd.Series) -> pd.Series:
    return pd.Series([_blocks(h) if isinstance(h, str) else [] for h in html], dtype=object)


def html_blocks(html: Column) -> Column:
    """array<struct<pos, tag, text, area, section>> of a page; null pages have none."""
    return F.pandas_udf(_all_blocks, "array<struct<pos:int,tag:string,text:string,area:string,section:string>>")(html)


def blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    return pages.select(key, F.explode(html_blocks(html)).alias("b")).select(key, "b.*")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


class _Links(HTMLParser):
    """Links in order with the text before them and whether they stand in a bibliography or in the comments' cell; unclosed elements end with the one around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.before = [], [], ""

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        inside = " ".join(filter(None, (given.get(n) for n in ("class", "role", "epub:type"))))
        marks, around = set(inside.split()), self.open[-1] if self.open else (None, False, False)
        self.open.append((tag, around[1] or bool(BIBLIOGRAPHY & marks), around[2] or marks >= COMMENTS))
        if tag == "a" and given.get("href"):
            self.found.append({"pos": len(self.found), "href": given["href"], "before": self.before[-80:].lower(), "in_bibliography": self.open[-1][1], "in_comments": self.open[-1][2]})
        if tag in EMPTY:
            self.open.pop()

    def handle_endtag(self, tag):
        at = max((k for k, (t, _, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        self.before = (self.before + " ".join(data.split("\n")))[-400:]

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            at = self.rawdata.find(">", i)
            return at + 1 if at >= 0 else -1


def _all_links(html: pd.Series) -> pd.Series:
    def one(page):
        reader = _Links()
        if isinstance(page, str):
            reader.feed(page)
            reader.close()
        return reader.found

    return pd.Series([one(h) for h in html], dtype=object)


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, href, before, in_bibliography, in_comments) of every link: before holds the 80 characters of text before it, in lower case."""
    found = F.pandas_udf(_all_links, "array<struct<pos:int,href:string,before:string,in_bibliography:boolean,in_comments:boolean>>")(F.col(html))
    return pages.select(key, F.explode(found).alias("l")).select(key, "l.*")


def code_url(x: Column) -> Column:
    """A link as https without www., trailing marks and .git; repositories are cut to owner and name; null for hosts that never hold a paper's own code."""
    x = F.regexp_replace(F.trim(x), r"[.,;:)]+$", "")
    host = F.lower(F.regexp_extract(x, r"^https?://(?:www\.)?([^/:?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(x, r"^https?://[^/?#]+(/[^?#]*)?", 1), r"/+$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), r"/+$", "")
    forge = host.isin("github.com", "gitlab.com")
    path = F.when(forge, F.regexp_replace(F.regexp_extract(path, r"^(/[^/]+/[^/]+)", 1), r"\.git$", "")).otherwise(path)
    query = F.regexp_extract(x, r"(\?[^#]+)", 1)
    bad = (host == "") | host.isin(*NEVER_OWN) | ((host == "huggingface.co") & path.startswith("/papers/")) | (forge & (path == ""))
    return F.when(~bad, F.concat(F.lit("https://"), host, path, query))


def meta(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, name, values): named metadata in order of appearance."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("pos", "m"))
    value = lambda name: F.coalesce(*[F.nullif(F.regexp_extract("m", rf"(?i)\s{name}\s*=\s*{form}", 1), F.lit("")) for form in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")])
    named = rows.select(key, "pos", value("name").alias("name"), F.coalesce(value("content"), F.lit("")).alias("value")).where("name IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return named.groupBy(key, "name").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))
