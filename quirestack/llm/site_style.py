"""Main text of web pages by site style trees.

The elements of all pages of a host are merged into one tree: elements with the same tags, classes and ids from
the root down are one node.  A node's presentation counts how the pages lay out its children, its content which
texts it holds on how many pages.  Importance is entropy: what looks alike and says the same on every page of a site
has none.  It is composed from the leaves up, and branches whose every node is unimportant are removed from the pages.

Elements speak for themselves, too.  Menus, footers, forms and the like, told by tag, role, class or id, have no importance
whatever they say, and plain text of an element that is marked as the article is never unimportant: an article
that a site shows on several pages stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Branches below this importance are removed, on nodes of at least so many different pages.
THRESHOLD, PAGES = 0.2, 4
#: Weight of the parts in a node's importance, for each of its layouts, as published.
GAMMA = 0.9
#: Elements below this depth count as the node at this depth; their texts stay theirs.
DEPTH = 24

# Elements without text of their own, those that don't end a block, those whose text is no content, those told by role attributes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "td", "th", "input", "button", "select", "textarea", "script", "style", "svg", "template"}
SPACED = {"br", "td", "th", "img", "input", "button", "select", "textarea"}
NEVER = {"head", "title", "script", "style", "template", "noscript", "noframes", "iframe", "svg", "canvas", "object", "audio", "video", "map", "nav", "menu", "aside", "footer", "dialog", "button", "select", "option", "textarea", "datalist", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist", "status"}
# Words in classes and ids of what isn't the article, words that turn them around, names of elements that hold the article.
WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "alert", "alerts", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signin", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget"}
HEADING_WORDS = {"header"}
AROUND = {"has", "no", "with", "without", "free", "non", "not"}
ARTICLES = {"article", "article-body", "article-content", "articlebody", "content", "entry", "entry-content", "main", "main-content", "page-content", "post", "post-body", "post-content", "story", "story-body"}
# Start tags that end an open paragraph or item.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th", "tbody", "thead", "tfoot"}}
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

DROP, KEEP, ASK = 0, 1, 2
PAGE = "blocks array<struct<node:long,state:int,text:string>>, nodes array<struct<path:array<long>,style:long,share:double,text_share:double,kids:int>>"


# Patterns: a tag, comment or declaration; values in quotes may hold '>', a quote that nothing closes is a sign like others.
_TOKEN = re.compile(
    r"""<(?:([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)>|/([a-zA-Z][^\s/>]*)[^>]*>|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ASKED = re.compile("class|id|role|hidden|style|itemprop", re.I)
_RAW = {t: re.compile(f"</{t}(?=[\\s/>])|\\Z", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noframes", "xmp")}


class _Page:
    """Elements (tag, signature, parent, told, article) and blocks (element, text) of one page, in order.

    told: 2 if the element is never content, 1 if its class, id or role says that it isn't the article, 3 if it is a header, else 0.
    article: True if it is marked as the article, None if only its name says so.
    """

    def __init__(self, html: str):
        self.elements: list[tuple] = [("", "", -1, 0, False)]
        self.open: list[tuple] = [(0, "", False, 0)]  # element, tag, whether its text is left out, element that a text is a block of
        self.blocks: list[tuple] = []
        self.words: list[str] = []
        at, search = 0, _TOKEN.search
        while True:
            m = search(html, at)
            if m is None or m.start() > at:
                self.text(html[at : m.start()] if m else html[at:])
            if m is None:
                break
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                self.start(tag, m[2])
                if tag in _RAW:
                    at = _RAW[tag].search(html, at).start()
            elif m[3]:
                self.end(m[3].lower())
        self.cut()

    def cut(self):
        """Ends the block."""
        if self.words:
            text = " ".join("".join(self.words).split())
            self.words = []
            if text:
                self.blocks.append((self.open[-1][3], text))

    def text(self, data: str):
        if not self.open[-1][2]:
            self.words.append(unescape(data) if "&" in data else data)

    def start(self, tag: str, attributes: str):
        open_, inline = self.open, tag in INLINE
        if not inline:
            self.cut()
            for k in range(len(open_) - 1, 0, -1):  # a paragraph ends where a block begins
                if open_[k][1] == "p":
                    del open_[k:]
                    break
                if open_[k][1] not in INLINE:
                    break
        if tag in ENDS:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][1] in ENDS[tag]:
                    del open_[k:]
                    break
                if tag in SCOPE.get(open_[k][1], ()):
                    break
        if tag in SPACED:
            self.words.append(" ")
        if tag in VOID:
            return
        told, article, mark = 2 if tag in NEVER else 0, tag in ("article", "main"), tag
        if attributes and _ASKED.search(attributes):
            given = {n.lower(): unescape(x or y or z) for n, x, y, z in _ATTRIBUTE.findall(attributes)}
            names = f"{given.get('class', '')} {given.get('id', '')}"
            role = given.get("role", "").lower()
            if names != " ":
                parts = {w.lower() for w in _PARTS.findall(names)}
                if tag not in ("html", "body") and not told:
                    told = 1 if parts & WORDS and not parts & AROUND else 3 if parts & HEADING_WORDS else 0
                    if not told and not article and not inline and not ARTICLES.isdisjoint(names.lower().split()):
                        article = None
                mark = f"{tag}.{_DIGITS.sub('#', '.'.join(sorted(names.split())))}"
            if role in ROLES and not told:
                told = 1
            if role == "main" or given.get("itemprop", "").lower() == "articlebody":
                article = True
            if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
                told = 2
        if not told:
            told = 1 if tag == "form" else 3 if tag == "header" else 0
        e = len(self.elements)
        self.elements.append((tag, mark, open_[-1][0], told, article))
        open_.append((e, tag, inline and (open_[-1][2] or told in (1, 2)) or not inline and told == 2, open_[-1][3] if inline else e))

    def end(self, tag: str):
        open_, inline = self.open, tag in INLINE
        if not inline:
            self.cut()
        if tag not in VOID:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][1] == tag:
                    del open_[k:]
                    break
                if inline and tag not in ("td", "th") and open_[k][1] not in INLINE:
                    break
        if tag in SPACED:
            self.words.append(" ")


def _states(page: _Page) -> list[int]:
    """DROP, KEEP or ASK for every block: what tags, roles and names say of it, and whether the site is to be asked."""
    elements = page.elements
    n = len(elements)
    never = [False] * n
    for e in range(1, n):
        never[e] = never[elements[e][2]] or elements[e][3] == 2
    told = [e[3] for e in elements]

    def under(chosen: list[int], soft: bool) -> list[bool]:
        """Elements inside one of chosen that isn't in what is no content itself."""
        inside, bad = [False] * n, [False] * n
        picked = set(chosen)
        for e in range(1, n):
            up = elements[e][2]
            inside[e] = inside[up] or e in picked
            bad[e] = never[e] or bad[up] or (soft and told[e] == 1 and e not in holds)
        return [i and not b for i, b in zip(inside, bad)]

    filled = [False] * n
    for e, _ in page.blocks:
        while e >= 0 and not filled[e]:
            filled[e] = True
            e = elements[e][2]
    holds: set[int] = set()  # elements around an article
    chosen: list[int] = []
    for kind in (lambda x: x[0] == "article" or x[4] is True and x[0] != "main", lambda x: x[4] is True, lambda x: x[4] is None):
        found = [e for e in range(1, n) if kind(elements[e]) and filled[e] and not never[e] and told[e] != 1]
        # An article in what is told to be something else, such as a reader's comment, isn't the article, unless no other is there.
        soft = [False] * n
        for e in range(1, n):
            soft[e] = soft[elements[e][2]] or told[e] == 1 and elements[e][0] != "form"
        chosen = [e for e in found if not soft[e]] or found
        if chosen:
            break
    for e in chosen:
        while e > 0:
            e = elements[e][2]
            holds.add(e)
    for soft in (True, False):  # a page that its names would empty is read without them
        ok = under(chosen or [0], soft) if chosen else under(list(range(1, n)), soft)
        if not chosen:
            ok[0] = True
        if any(ok[e] for e, _ in page.blocks):
            break
    plain = [False] * n
    picked = set(chosen)
    for e in range(1, n):
        plain[e] = e in picked or plain[elements[e][2]] and "." not in elements[e][1]
    out = []
    for e, _ in page.blocks:
        if not ok[e]:
            out.append(DROP)
        elif _headed(elements, e, picked):
            out.append(DROP)
        else:
            out.append(KEEP if plain[e] else ASK)
    return out


def _headed(elements: list[tuple], e: int, picked: set[int]) -> bool:
    """Whether a block is in a header that stands outside the article."""
    head = False
    while e > 0:
        if e in picked:
            return False
        head = head or elements[e][3] == 3
        e = elements[e][2]
    return head


def _hash(*of) -> int:
    h = xxhash.xxh64_intdigest("\0".join(map(str, of)).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def read_page(html: str) -> tuple[list, list]:
    """(blocks, nodes) of a page: blocks (node, state, text) in order without dropped ones, nodes of the elements that hold them.

    A node (path, style, share, text_share, kids) is what this page adds to the tree: ids from the root down, a hash of its
    children, the parts that it and its own text are of their layouts, and whether it has children.
    """
    page = _Page(html)
    paths: dict[int, tuple] = {0: ()}

    def path_of(e: int) -> tuple:
        way = []
        while e not in paths:
            way.append(e)
            e = page.elements[e][2]
        for x in reversed(way):
            tag, mark, up, _, _ = page.elements[x]
            above = paths[up]
            paths[x] = above if len(above) >= DEPTH or tag in INLINE else (*above, _hash(above[-1] if above else 0, mark))
        return paths[way[0]] if way else paths[e]

    blocks, kids, texts = [], {}, set()
    for (e, text), state in zip(page.blocks, _states(page)):
        if state == DROP:
            continue
        path = path_of(e) or (_hash(0, "text"),)
        if path in texts:
            blocks.append((path[-1], state, text))
            continue
        blocks.append((path[-1], state, text))
        texts.add(path)
        for k in range(len(path), 0, -1):
            below = kids.setdefault(path[:k], set())
            if k < len(path):
                below.add(path[k])
    nodes = []
    for path, below in kids.items():
        own = path in texts
        up = path[:-1]
        whole = len(kids[up]) + (up in texts) if up else 1
        nodes.append((list(path), _hash(own, *sorted(below)), 1 / whole, 1 / (len(below) + 1) if own else 0.0, len(below)))
    return blocks, nodes


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns but html, with the columns of PAGE."""
    kept = [c for c in pages.columns if c != html]
    names = pages.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("node", pa.int64()), ("state", pa.int32()), ("text", pa.string())]))
        node = pa.list_(pa.struct([("path", pa.list_(pa.int64())), ("style", pa.int64()), ("share", pa.float64()), ("text_share", pa.float64()), ("kids", pa.int32())]))
        for batch in batches:
            read = [read_page(h.as_py()) if h.is_valid else ([], []) for h in batch.column(html)]
            blocks = [[dict(zip(("node", "state", "text"), b)) for b in r[0]] for r in read]
            nodes = [[dict(zip(("path", "style", "share", "text_share", "kids"), x)) for x in r[1]] for r in read]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(blocks, block), pa.array(nodes, node)], names=[*kept, "blocks", "nodes"])

    schema = ", ".join(f"`{c}` {names[c].dataType.simpleString()}" for c in kept)
    return pages.mapInArrow(run, f"{schema}, {PAGE}")


def host(url: Column) -> Column:
    """The host of an address in lower case; '' if it has none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def importance(rows: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content, composite, most) of every node of every site's tree; most: the greatest composite of its branch.

    rows: (key, host, blocks, nodes).  Pages of one host that say the same count once.  Entropies are over pages, so a node that
    looks alike on all has presentation 0, one whose texts are on all content 0; a node of one page has 1.  The composite
    of a node without children is its content; of others, presentation and the mean composite of their parts, weighted by
    GAMMA.  The recursion is unrolled: a descendant adds its own term times the weights on the way up to it.
    """
    texts = F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("text")))
    page = rows.select("key", "host", "nodes", F.array_distinct(texts).alias("texts"), F.xxhash64(F.transform("blocks", lambda b: b["text"])).alias("says"))
    page = page.join(page.groupBy("host", "says").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    found = page.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    looks = found.groupBy("host", "path", "style").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share"), F.sum("text_share").alias("text_share"), F.max("kids").alias("kids"))
    node = looks.groupBy("host", "path").agg(
        F.sum("n").alias("pages"), F.count(F.lit(1)).alias("looks"), F.sum(F.col("n") * F.log("n")).alias("nlogn"),
        F.sum("share").alias("share"), F.sum("text_share").alias("text_share"), F.max("kids").alias("kids"),
    )
    presentation = F.when(F.col("pages") > 1, 1 - F.col("nlogn") / F.col("pages") / F.log("pages")).otherwise(1.0)
    node = node.withColumn("node", F.element_at("path", -1)).withColumn("presentation", presentation)
    said = page.select("host", F.explode("texts").alias("x")).select("host", "x.*").groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("n"))
    said = said.groupBy("host", "node").agg(F.avg(F.log("n")).alias("logn"))
    node = node.join(said, ["host", "node"], "left")
    content = F.when(F.col("logn").isNull(), F.lit(None)).when(F.col("pages") > 1, 1 - F.col("logn") / F.log("pages")).otherwise(1.0)
    node = stored(node.withColumn("content", content).drop("nlogn", "logn"), "nodes")

    fade = F.pow(F.lit(GAMMA), F.col("looks").cast("double"))
    own = F.when(F.col("kids") == 0, F.coalesce("content", F.lit(1.0)))
    own = own.otherwise((1 - fade) * F.col("presentation") + fade * F.coalesce(F.col("text_share") / F.col("pages") * F.col("content"), F.lit(0.0)))
    up = node.select(F.col("host"), F.col("node").alias("up"), (F.log(fade) - F.log(F.col("pages").cast("double"))).alias("up_weight"))
    weighed = node.withColumn("own", own).withColumn("up", F.try_element_at("path", F.lit(-2))).join(up, ["host", "up"], "left")
    weighed = stored(weighed.withColumn("weight", F.coalesce(F.log("share") + F.col("up_weight"), F.lit(0.0))).drop("up", "up_weight"), "weights")
    ways = weighed.select("host", "node", F.explode("path").alias("x"))
    sums = ways.join(weighed.select("host", F.col("node").alias("x"), "weight"), ["host", "x"]).groupBy("host", "node").agg(F.sum("weight").alias("way"))
    placed = stored(weighed.join(sums, ["host", "node"]).select("host", "node", "path", "pages", "presentation", "content", "own", "way"), "ways")
    tops = placed.select("host", F.col("node").alias("x"), F.col("way").alias("top_way"))
    below = placed.select("host", "own", "way", F.explode("path").alias("x")).join(tops, ["host", "x"])
    whole = below.groupBy("host", F.col("x").alias("node")).agg(F.sum(F.col("own") * F.exp(F.col("way") - F.col("top_way"))).alias("composite"))
    scored = stored(placed.join(whole, ["host", "node"]).select("host", "node", "path", "pages", "presentation", "content", "composite"), "scored")
    most = scored.select("host", "composite", F.explode("path").alias("node")).groupBy("host", "node").agg(F.max("composite").alias("most"))
    return scored.drop("path").join(most, ["host", "node"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row of pages.

    Null and empty pages have an empty text, as have pages without content; null and odd addresses share the host ''.
    Repeated rows and keys are rows of their own. Broken markup is read as browsers do: blocks end where others begin, and what
    is never closed ends with the page.  Other columns are left aside.
    """
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.col(html).alias("html"))
    rows = stored(parsed(small_batches(rows)).withColumn("key", F.monotonically_increasing_id()), "parsed")
    noise = importance(rows.select("key", "host", "blocks", "nodes")).where(F.col("pages") >= PAGES).where(F.col("most") < THRESHOLD).select("host", "node")
    asked = F.exists("blocks", lambda b: b["state"] == ASK)
    open_nodes = F.array_distinct(F.transform(F.filter("blocks", lambda b: b["state"] == ASK), lambda b: b["node"]))
    gone = rows.where(asked).select("key", "host", F.explode(open_nodes).alias("node")).join(noise, ["host", "node"], "left_semi")
    gone = gone.groupBy("key").agg(F.collect_list("node").alias("gone"))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    left = F.array_join(F.transform(F.filter("blocks", lambda b: (b["state"] == KEEP) | F.col("gone").isNull() | ~F.array_contains("gone", b["node"])), lambda b: b["text"]), "\n\n")
    # Pages of which the site has nothing to say don't move.
    settled = rows.where(~asked).select("page", "url", text.alias("text"))
    pruned = rows.where(asked).select("key", "page", "url", "blocks").join(gone, "key", "left").select("page", "url", left.alias("text"))
    return settled.unionByName(pruned).select(F.col("page").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
