"""Expressions for what users and papers write: links, ids, names, sentences, tables, references."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_id, squash, words

# The form of a paper's id, hosts and the paths under which they show papers.
PAPER_ID = r"(?:[0-9]{4}\.[0-9]{4,5}|[A-Za-z][A-Za-z.-]*/[0-9]{7})(?:v[1-9][0-9]*)?"
ROUTES = {"arxiv.org": "abs|pdf|html", "alphaxiv.org": "abs|pdf|html|overview", "huggingface.co": "papers", "hf.co": "papers", "paperswithcode.co": "paper|abs|pdf"}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Phrases before a link that mark it as the paper's own, and those that do so only without a citation.
STRONG = ["our code", "code is available", "code available", "code and models", "code and notebooks", "code:", "code,", "we release", "project page", "the code we used", "releasing"]
WEAK = ["available at", "can be found at", "implementation", "open-source"]
CODE_HOSTS = ["github.com", "gitlab.com", "huggingface.co"]
# Where a failure was raised, in order.
STAGES = [
    ("extract", r" (?:extract_source|safe_extract)$"), ("root", r" find_root_tex$"), ("pass", r" prepare_\w+$"), ("math", r" repair_math$|math_fallback"), ("document", r"^papers/document\.py"),
    ("validate", r" (?:validate_epub|_finalize_epub|_repair_cross_file_fragments|_validate_\w+)$"), ("pandoc", r" convert_source$"), ("latexml", r"^papers/worker\.py:\d+ (?:run|latexml)$"), ("arxiv-html", r"arxiv_html"),
]


def paper_link(x: Column) -> Column:
    """struct<id, reason> of an id or link: one of both is null."""
    x = F.trim(x)
    url = r"^([a-z]+)://(?:www\.)?([^/:@?#]+)(?::443)?/([^?#]*)"
    host, raw = F.lower(F.regexp_extract(x, url, 2)), F.regexp_extract(x, url, 3)
    path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    found = F.lit("")
    for name, routes in ROUTES.items():
        found = F.when(host == name, F.regexp_extract(path, rf"^(?:{routes})/({PAPER_ID})(?:\.pdf)?/?$", 1)).otherwise(found)
    plain = x.rlike(f"^{PAPER_ID}$")
    reason = (
        F.when(host == "paperswithcode.com", "search by title").when((F.regexp_extract(x, url, 1) != "https") | ~host.isin(*ROUTES), "not a paper link").when(found == "", "no identifier")
    )
    return F.when(plain, F.struct(x.alias("id"), F.lit(None).cast("string").alias("reason"))).otherwise(F.struct(F.when(reason.isNull(), found).alias("id"), reason.alias("reason")))


def paper_date(x: Column) -> Column:
    """struct<year, month, key, label> that an id tells, null where its month doesn't exist; archives of before 2000 count from 1990."""
    form = r"(?i)^(?:([a-z][a-z.-]*)/)?([0-9]{2})([0-9]{2})\.?[0-9]{3,5}(?:v[0-9]+)?$"
    yy, mm = F.regexp_extract(x, form, 2).try_cast("int"), F.regexp_extract(x, form, 3).try_cast("int")
    year = yy + F.when((F.regexp_extract(x, form, 1) != "") & (yy > 90), 1900).otherwise(2000)
    label = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.when(mm.between(1, 12), mm).otherwise(1)), year.cast("string"))
    return F.when(mm.between(1, 12), F.struct(year.alias("year"), mm.alias("month"), (year * 100 + mm).alias("key"), label.alias("label")))


def author_pairs(x: Column) -> Column:
    """array<struct<last, first>> of 'Last, First, Last, First'; what can't be paired is one name as it stands."""
    parts = F.transform(F.split(F.trim(x), ","), lambda p: F.trim(p))
    whole = (F.size(parts) % 2 == 0) & ~F.exists(parts, lambda p: p == "")
    pairs = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(parts), F.lit(2)).cast("int") - 1), lambda i: F.struct(parts[i * 2].alias("last"), parts[i * 2 + 1].alias("first")))
    one = F.array(F.struct(F.trim(x).alias("last"), F.lit(None).cast("string").alias("first")))
    return F.when(F.trim(x) == "", F.array().cast("array<struct<last:string,first:string>>")).when(whole, pairs).otherwise(one)


def author_names(x: Column) -> Column:
    return F.transform(author_pairs(x), lambda p: F.concat_ws(" ", p["first"], p["last"]))


def byline(x: Column) -> Column:
    """One or two last names, or the first 'et al.'."""
    last = F.transform(author_pairs(x), lambda p: F.when(p["first"].isNotNull(), p["last"]).otherwise(F.element_at(words(F.split_part(p["last"], F.lit(","), F.lit(1))), -1)))
    return F.when(F.size(last) > 2, F.concat(F.get(last, 0), F.lit(" et al."))).otherwise(F.array_join(last, " and "))


def sentences(x: Column) -> Column:
    """Runs that end at '.', '!' or '?' before white space, or at a blank line; blank ones are left out."""
    return F.filter(F.split(x, r"(?<=[.!?])\s+|\n\s*\n"), lambda s: F.trim(s) != "")


#: What a word is made of, in any script; a word ends where none of it stands.
_WORD = r"[\p{L}\p{M}\p{N}_]"


def term_pattern(term: str) -> str:
    """A term as a whole word, singular or plural, in any case; signs in it stand for themselves."""
    quoted = " ".join(term.split()).replace("\\E", "\\E\\\\E\\Q")
    return rf"(?iu)(?<!{_WORD})\Q{quoted}\E(?:e?s)?(?!{_WORD})"


def uses_term(x: Column, term: Column) -> Column:
    """Whether x holds the term of a column as a whole word, see term_pattern."""
    quoted = F.replace(F.regexp_replace(F.trim(term), r"\s+", " "), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.rlike(x, F.concat(F.lit(rf"(?iu)(?<!{_WORD})\Q"), quoted, F.lit(rf"\E(?:e?s)?(?!{_WORD})")))


def explains(x: Column, term: str) -> Column:
    """Whether a sentence explains a term: it opens with the term and a verb that defines, or names it."""
    word = term_pattern(term)[5:]
    return x.rlike(r"(?iu)\b(?:called|named|known as)\s+[\"“]?" + word) | x.rlike(r"(?iu)^(?:(?:a|an|the)\s+)?" + word + r"[\"”]?(?:\s*\[[^\]]*\])*\s+(?:is|are|means|refers to)\b")


def _dashes_of(text: str) -> list[str]:
    space, out, end = " \t\n\v\f\r", [], 0
    for m in _DASH.finditer(text):
        at = m.start()
        left, right = text[at - 1 : at], text[at + 1 : at + 2]
        if m[0] == "\u2013" and left and right and left in space and right in space and at - 1 >= end:
            begin, stop = at - 1, at + 2
        elif m[0] == "\u2014" or left.isalpha() or right.isalpha():
            begin, stop = at, at + 1
        else:
            continue
        out.append(text[max(0, begin - 30) : stop + 30])
        end = stop
    return out


_DASH = re.compile("[\u2013\u2014]")


def dashes(x: Column) -> Column:
    """Each em dash, and en dash beside a letter of any script or between spaces, with up to 30 characters on both sides, other dashes among them.

    One pass over the text; spaces beside a dash belong to it, so that dashes share none.  Null stays null.
    """
    return F.pandas_udf(lambda t: pd.Series([_dashes_of(v) if isinstance(v, str) else None for v in t], dtype=object), "array<string>")(x)


def table_cells(x: Column) -> Column:
    """Cells of a Markdown table row; pipes in code, mathematics and behind a backslash part nothing."""
    inner = F.regexp_replace(F.trim(x), r"^\||\|$", "")
    cells = F.regexp_extract_all(inner, F.lit(r"(?:`[^`]*`|\$[^$\n]+\$|\\\||[^|])+"), F.lit(0))
    return F.transform(cells, lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def is_number(x: Column) -> Column:
    return x.rlike(r"^[−+-]?[0-9][0-9.,]*(?:\s*[–-]\s*[0-9][0-9.,]*)?\s*%?$")


def _spots(text: str, query: str) -> list[int]:
    out, at = [], text.find(query)
    while at >= 0:
        out.append(at + 1)
        at = text.find(query, at + len(query))
    return out


def occurrences(x: Column, query: str) -> Column:
    """Positions, from 1, at which query stands in x without case, apart from each other; one pass over the text.  Null stays null."""
    q = query.lower()
    return F.pandas_udf(lambda t: pd.Series([_spots(v, q) if isinstance(v, str) else None for v in t], dtype=object), "array<int>")(F.lower(x))


def stage_of(x: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(STAGES):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def is_transient(x: Column, markers: list[str]) -> Column:
    """A failure worth another try: it has a marker and isn't about authentication."""
    denied = F.contains(F.lower(x), F.lit("authentication")) | x.rlike("HTTP status 40[13]")
    return ~denied & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(x, m))


def attachment(x: Column) -> Column:
    """The disposition of a download: a name in ASCII and one percent-encoded."""
    name = squash(F.regexp_replace(x, r'[\x00-\x1f\x7f-\x9f"\\/:]', " "))
    encoded = F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit('attachment; filename="'), F.regexp_replace(name, "[^ -~]", "_"), F.lit("\"; filename*=UTF-8''"), encoded)


def applied(x: Column, edits: Column) -> Column:
    """x with edits (array<struct<old, new>>) made at once, null unless every old text stands in x exactly once and no two overlap."""
    at = lambda e: F.call_function("instr", x, e["old"])
    spans = F.transform(edits, lambda e: F.struct(at(e).alias("at"), F.length(e["old"]).alias("n"), e["new"].alias("new")))
    spans = F.array_sort(spans)
    once = F.forall(edits, lambda e: (F.length(e["old"]) > 0) & (at(e) > 0) & (F.call_function("instr", F.substr(x, at(e) + 1), e["old"]) == 0))
    apart = F.forall(F.sequence(F.lit(1), F.size(spans) - 1), lambda i: spans[i - 1]["at"] + spans[i - 1]["n"] <= spans[i]["at"])
    made = F.aggregate(F.reverse(spans), x, lambda a, s: F.concat(F.substr(a, F.lit(1), s["at"] - 1), s["new"], F.substr(a, s["at"] + s["n"])))
    return F.when(once & (F.size(edits) < 2), made).when(once & apart, made)


def unmarked(x: Column) -> Column:
    """Text without figure markers; the blank lines they leave are closed up."""
    return F.regexp_replace(F.regexp_replace(x, r"\{\{figure:[^}]+\}\}", ""), r"\n{3,}", "\n\n")


def bare_math(x: Column) -> Column:
    """Without one outer pair of delimiters of mathematics."""
    x = F.trim(x)
    out = x
    for left, right in [(r"\(", r"\)"), (r"\[", r"\]"), ("$", "$"), ("$$", "$$")]:
        n = len(left)
        out = F.when(x.startswith(left) & x.endswith(right) & (F.length(x) >= 2 * n), F.substr(x, F.lit(n + 1), F.length(x) - 2 * n)).otherwise(out)
    return out


def unfenced(x: Column) -> Column:
    """The inside of a fenced block, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def cited_id(x: Column) -> Column:
    """The paper id that a reference names behind a marker, without its version; null without one."""
    marked = r"(?i)(?:arxiv:\s*|corr,?\s+abs/|arxiv preprint,?\s+abs/|arxiv\.\s?org/(?:abs|pdf)/)(" + PAPER_ID + ")"
    return F.nullif(base_id(F.regexp_extract(x, marked, 1)), F.lit(""))


def fallback_title(x: Column) -> Column:
    """What to search for a reference: its second sentence if that has three words, else the entry; no number, no links, 300 characters."""
    entry = F.regexp_replace(F.regexp_replace(x, r"^\s*\[\d+\]\s*", ""), r"(?i)(?:\bURL:?\s+)?\S*(?:https?://|(?:ar|alpha)xiv\.org/)\S*", " ")
    second = F.get(F.split(squash(entry), r"(?<=[^\s.]{2})\.\s+"), 1)
    return F.substring(F.when(F.size(F.split(second, " ")) >= 3, second).otherwise(squash(entry)), 1, 300)


def own_link(before: Column) -> Column:
    """Whether the text before a link marks it as the paper's own."""
    has = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(before, p))
    return has(STRONG) | (has(WEAK) & ~before.rlike(r"\bet al\b|\[\d+(?:[,–-]\s*\d+)*\]"))


def unwrapped(x: Column) -> Column:
    """Text whose links, broken after a slash or a dash at the end of a line, are whole again; what follows the references is cut."""
    body = F.regexp_replace(x, r"(?s)(^|\n)[ \t]*(?:References|Bibliography)[ \t]*(?:\n.*|$)", "$1")
    breaks = F.sequence(F.lit(0), F.regexp_count(body, F.lit(r"[/-]\n\S")))  # a pass mends one break of a link
    return F.aggregate(breaks, body, lambda a, _: F.regexp_replace(a, r"(https?://\S*[/-])\n(?=\S)", "$1"))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether the items of a stand in b in this order."""
    return F.aggregate(b, F.lit(0), lambda i, x: F.when(F.get(a, i) == x, i + 1).otherwise(i)) == F.size(a)
