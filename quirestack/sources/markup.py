"""Markup as well-nested steps: elements as intervals, texts with formulas, safe rewriting.

An element is the interval of the numbers of all elements inside it, in the order in which they begin.  Inside, around,
outermost and nearest are conditions on intervals then, which joins and windows decide.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Elements without content, elements that end an open one of their kind, elements that never stay, attributes that never stay.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "figure", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "aside", "main", "form"}
FORBIDDEN = {"script", "iframe", "object", "embed", "form", "input", "button", "base"}
SCHEMES = {"http", "https", "mailto"}


class _Steps(HTMLParser):
    """(open, tag, attributes), (text, words) and (close, tag) of a page, well nested whatever the page forgets to close."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.steps: list[tuple] = []
        self.open: list[str] = []

    def updatepos(self, i, j):
        """Lines and columns aren't asked for."""
        return j

    def close_to(self, at: int):
        while len(self.open) > at:
            self.steps.append(("close", self.open.pop()))

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in ends:
                self.close_to(k)
                break
            if self.open[k] in BLOCKS | {"ul", "ol", "table"}:
                break
        self.steps.append(("open", tag, attrs))
        self.open.append(tag)
        if tag in EMPTY:
            self.close_to(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.close_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in self.open:
            self.close_to(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        self.steps.append(("text", data))

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            at = self.rawdata.find(">", i)
            return at + 1 if at >= 0 else -1


def steps_of(html: str) -> list[tuple]:
    reader = _Steps()
    reader.feed(html)
    reader.close()
    reader.close_to(0)
    return reader.steps


def text_of(steps: list[tuple]) -> str:
    """The text of steps, white space collapsed, with a formula's source between dollars in place of its parts."""
    out, inside = [], None
    for step in steps:
        if inside is not None:
            if step[0] == "open":
                inside[0] += 1
            elif step[0] == "close":
                inside[0] -= 1
                if not inside[0]:
                    out.append(f" ${inside[1]}$ " if inside[1] else f" {''.join(inside[2])} ")
                    inside = None
            else:
                inside[2].append(step[1])
        elif step[0] == "open" and step[1] == "math":
            given = dict(step[2])
            inside = [1, " ".join((given.get("alttext") or given.get("data-tex") or "").split()), []]
        elif step[0] == "text":
            out.append(step[1])
    return " ".join("".join(out).split())


def elements_of(html: str, texts: set[str] | None = None) -> list[tuple]:
    """(pre, end, parent, depth, tag, id, names, label, text) of every element: end is the number of the last element inside it.

    texts: tags of the elements whose text is wanted, all of them without it; other elements have a null text.
    """
    rows, stack, steps = [], [], steps_of(html)
    for k, step in enumerate(steps):
        if step[0] == "open":
            given = dict(step[2])
            rows.append([len(rows), None, stack[-1][0] if stack else None, len(stack), step[1], given.get("id"), " ".join(filter(None, (given.get("class"), given.get("role")))) or None, given.get("data-label"), None])
            stack.append((len(rows) - 1, k))
        elif step[0] == "close":
            pre, begin = stack.pop()
            rows[pre][1] = len(rows) - 1
            if texts is None or step[1] in texts:
                rows[pre][8] = text_of(steps[begin : k + 1]) if step[1] not in FORBIDDEN | {"style"} else ""
    return [tuple(r) for r in rows]


def safe(html: str) -> tuple[str, list[str]]:
    """(markup without active content, what was refused): elements that run or ask are gone with what they hold, handlers and frames' documents too.

    Links to other programs become text, doi: links their address; images and other resources stay only if they lie beside the page.
    What is written is well nested, its text escaped, so that it is its own safe form.
    """
    out, refused, drop, names = [], [], 0, []
    for step in steps_of(html):
        if step[0] == "text":
            if not drop:
                out.append(escape(step[1], quote=False))
        elif step[0] == "close":
            if step[1] in FORBIDDEN:
                drop -= 1
            elif not drop:
                name = names.pop()
                if name not in EMPTY:
                    out.append(f"</{name}>")
        elif step[1] in FORBIDDEN:
            drop += 1
            refused.append(step[1])
        elif not drop:
            tag, kept = step[1], []
            for name, value in step[2]:
                value = (value or "").strip()
                scheme = (re.match(r"([a-z][a-z0-9+.-]*):", re.sub(r"[\x00-\x20]", "", value).lower()) or [None, ""])[1]
                if not re.fullmatch(r"[a-z_][a-z0-9_.:-]*", name) or name.startswith("on") or name in ("srcdoc", "action", "formaction"):
                    refused.append(name)
                elif name in ("href", "src", "xlink:href", "data", "poster", "srcset"):
                    if name == "href" and tag == "a" and scheme == "doi":
                        kept.append((name, "https://doi.org/" + value.split(":", 1)[1]))
                    elif name == "href" and tag == "a" and (scheme and scheme not in SCHEMES or value.lower() == "mailto:"):
                        tag = "span"
                        refused.append(f"href {scheme}")
                    elif scheme and (name != "href" or scheme not in SCHEMES):
                        refused.append(f"{name} {scheme}")
                    else:
                        kept.append((name, value.replace("\\_", "_") if scheme in ("http", "https") else value))
                else:
                    kept.append((name, value))
            names.append(tag)
            out.append(f"<{tag}{''.join(f' {n}=\"{escape(v)}\"' for n, v in kept)}>")
    return "".join(out), refused


ELEMENT = "pre int, end int, parent int, depth int, tag string, id string, names string, label string, text string"


#: Elements, and characters of their texts, in a batch that a task returns, about.
BATCH_ROWS, BATCH_TEXT = 20_000, 4 << 20


def elements(pages: DataFrame, key: str, html: str = "html", texts: set[str] | None = None) -> DataFrame:
    """(key, ELEMENT) of every element; null and empty pages have none.  texts: see elements_of."""
    kinds = [pa.int32() if f.endswith(" int") else pa.string() for f in ELEMENT.split(", ")]
    names = [key, *[f.split()[0] for f in ELEMENT.split(", ")]]

    def run(batches):
        for batch in batches:
            keys, at, rows, size = batch.column(0), [], [], 0
            made = lambda: pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names)  # noqa: B023, E731
            for i, page in enumerate(batch.column(1)):
                page = page.as_py()
                found = elements_of(page, texts) if isinstance(page, str) else []
                at += [i] * len(found)
                rows += found
                size += sum(len(r[8] or "") for r in found)
                if len(rows) >= BATCH_ROWS or size >= BATCH_TEXT:
                    yield made()
                    at, rows, size = [], [], 0
            if rows:
                yield made()

    rows = pages.select(key, F.col(html).cast("string"))
    kind = StructType([rows.schema[key], *[StructField(n, IntegerType() if t == pa.int32() else StringType()) for n, t in zip(names[1:], kinds)]])
    return rows.mapInArrow(run, kind)


def rewritten(html: Column) -> Column:
    """struct<html, refused> of markup made safe; null stays null."""
    run = lambda x: pd.DataFrame([safe(h) if isinstance(h, str) else (None, []) for h in x], columns=["html", "refused"])
    return F.pandas_udf(run, "html string, refused array<string>")(html)


def _ended(key: str, which: Column, itself: bool = False) -> Column:
    """Where those elements end that begin before an element, the farthest one; one that ends at or behind it holds it, as elements nest."""
    w = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    return F.max(F.when(which, F.col("end"))).over(w)


def outermost(rows: DataFrame, key: str) -> DataFrame:
    """Elements of rows that stand in no other of them: those that begin after all before them have ended."""
    return rows.withColumn("_ended", _ended(key, F.lit(True))).where("_ended IS NULL OR pre > _ended").drop("_ended")


def inside(rows: DataFrame, key: str, sought: Column, around: Column, columns: list[str], itself: bool = True) -> DataFrame:
    """The rows where `sought` holds, with `columns` of the nearest row where `around` does that holds them, as in_..., null without one.

    An element holds itself if `itself`.  Elements begin and end in one order; where so many are open, the nearest is the
    last that was opened as the so manieth.  So two sorted passes over a page decide, and no element is paired with those around it.
    """
    begin, here = (0, 1) if itself else (1, 0)
    at = lambda spot, what: F.struct(F.col(spot).alias("at"), F.lit(what).alias("what"))
    steps = F.array_compact(F.array(F.when(around, at("pre", begin)), F.when(sought, at("pre", here)), F.when(around, at("end", 2))))
    each = rows.withColumn("_s", F.explode(steps))
    kept = [c for c in rows.columns if c != key]
    row, opens = F.col("_s.what") == here, F.col("_s.what") == begin
    each = each.select(key, "_s", *[F.when(row, F.col(c)).alias(c) for c in kept], F.when(opens, F.struct(*columns)).alias("_around"))
    order = lambda *by: Window.partitionBy(key, *by).orderBy("_s.at", "_s.what").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_open", F.sum(F.when(opens, 1).when(row, 0).otherwise(-1)).over(order()))
    each = each.withColumn("_around", F.last("_around", ignorenulls=True).over(order("_open"))).where(row)
    return each.select(*rows.columns, *[F.col(f"_around.{c}").alias(f"in_{c}") for c in columns])


def resolved_ids(rows: DataFrame, key: str) -> DataFrame:
    """rows with new_id and conflict: of elements that share an id the outer one keeps it, and of those beside each other the last.

    An element inside another of its id loses it, as does an empty span that only marks the label of others; earlier ones get
    '-duplicate-1' and so on, a conflict where the page has such an id already.  Ids with white space become a digest.
    """
    same, all_ = Window.partitionBy(key, "id").orderBy("pre"), Window.partitionBy(key, "id")
    marks = (F.col("tag") == "span") & (F.col("label") == F.col("id")) & (F.col("text") == "") & (F.col("pre") == F.col("end"))
    named = rows.withColumn("_named", F.coalesce(F.col("id") != "", F.lit(False))).withColumn("_marks", F.coalesce(marks, F.lit(False))).withColumn("_n", F.count(F.lit(1)).over(all_))
    real = F.when(~F.col("_marks"), F.col("end"))
    named = named.withColumn("_held", F.max(real).over(same.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("pre"))
    named = named.withColumn("_gone", (F.col("_n") > 1) & (F.col("_marks") | F.coalesce("_held", F.lit(False))))
    place = F.count_if(~F.col("_gone")).over(same.rowsBetween(Window.unboundedPreceding, 0))
    last = F.count_if(~F.col("_gone")).over(all_)
    made = F.when(F.col("_gone"), None).when(place < last, F.concat("id", F.lit("-duplicate-"), place.cast("string"))).otherwise(F.col("id"))
    named = named.withColumn("_made", F.when(F.col("_named"), made))
    # Every id that stands on the page meets the new ones that look like it.
    asks = F.col("_named") & (F.col("_made") != F.col("id"))
    name = lambda c, own: F.struct(F.col(c).alias("name"), F.lit(own).alias("own"))
    met = named.withColumn("_m", F.explode(F.when(asks, F.array(name("id", True), name("_made", False))).otherwise(F.array(name("id", True)))))
    met = met.withColumn("_taken", F.max("_m.own").over(Window.partitionBy(key, "_m.name")))
    met = met.where(~F.col("_m.own") | ~F.coalesce(asks, F.lit(False)))
    new = F.when(F.col("_made").rlike(r"\s"), F.concat(F.lit("anchor-"), F.substring(F.sha2(F.col("_made").cast("binary"), 256), 1, 20))).otherwise(F.col("_made"))
    return met.select(*rows.columns, new.alias("new_id"), F.coalesce(asks & F.col("_taken"), F.lit(False)).alias("conflict"))


def sections(rows: DataFrame, key: str, passages: list[str]) -> DataFrame:
    """(key, section, parent, title, passages, chars) of every section or article that holds passages itself.

    A passage is an outermost element of the given tags; it belongs to the nearest section or article around it.  parent: the nearest
    of these further out that has passages, null at the top.  title: the first heading among the passages.
    """
    passage, holder = F.col("tag").isin(*passages), F.col("tag").isin("section", "article")
    # Of texts only headings and lengths are moved.
    heading = F.when(passage & F.col("tag").rlike("^h[1-6]$"), F.struct("pre", "text")).alias("heading")
    wanted = rows.where(passage | holder).select(key, "pre", "end", holder.alias("holder"), passage.alias("passage"), heading, F.when(passage, F.length("text")).alias("chars"))
    wanted = wanted.withColumn("passage", F.col("passage") & F.coalesce(F.col("pre") > _ended(key, F.col("passage")), F.lit(True)))
    found = inside(wanted, key, F.col("passage"), F.col("holder"), ["pre", "end"]).where("in_pre IS NOT NULL")
    own = found.groupBy(key, F.col("in_pre").alias("pre"), F.col("in_end").alias("end")).agg(F.min("heading").alias("h"), F.count(F.lit(1)).alias("passages"), F.sum("chars").alias("chars"))
    own = inside(own, key, F.lit(True), F.lit(True), ["pre"], itself=False)
    return own.select(key, F.col("pre").alias("section"), F.col("in_pre").alias("parent"), F.col("h.text").alias("title"), "passages", "chars")


def abstracts(rows: DataFrame, key: str, passages: list[str]) -> DataFrame:
    """(key, status, texts) of every page: passages inside what is marked as the abstract, without those of authors, licences and notes."""
    passage, words = F.col("tag").isin(*passages), F.split(F.lower(F.coalesce("names", F.lit(""))), r"\s+")
    marked = F.array_contains(words, "abstract") | F.coalesce(F.lower("id") == "abstract", F.lit(False)) | (F.col("tag") == "abstract")
    other = F.arrays_overlap(words, F.array(*map(F.lit, ("author", "authors", "affiliation", "license", "copyright", "center"))))
    # An abstract's and a note's end only; of texts only those of passages are moved.
    each = rows.select(key, "pre", "end", passage.alias("_passage"), marked.alias("_marked"), other.alias("_other"), F.when(passage, F.col("text")).alias("text"))
    each = each.withColumn("_ended", _ended(key, F.col("_passage"))).withColumn("_in", _ended(key, F.col("_marked"), True)).withColumn("_not", _ended(key, F.col("_other"), True))
    held = lambda c: F.coalesce(F.col(c) >= F.col("pre"), F.lit(False))
    kept = F.col("_passage") & ~held("_ended") & held("_in") & ~held("_not") & ~F.coalesce(F.lower("text").rlike("^(author note|license|copyright)"), F.lit(True))
    texts = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(kept, F.struct("pre", "text")))).alias("t"))
    none = F.size("t") == 0
    return texts.select(key, F.when(none, "unavailable").otherwise("identified").alias("status"), F.transform("t", lambda x: x["text"]).alias("texts"))
