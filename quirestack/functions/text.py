"""Text expressions: columns in, columns out, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(x: Column) -> Column:
    """White space collapsed and trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


#: What SQL's trim takes off both ends: Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(x: Column) -> Column:
    """Without space separators at its ends, as SQL's trim; null stays null."""
    return F.trim(x, F.lit(SPACES))


def collapsed(x: Column) -> Column:
    """White space collapsed and trimmed as SQL does it: ASCII's without the vertical tab is collapsed, space separators are trimmed; null stays null."""
    return trimmed(F.regexp_replace(x, r"[\t\n\f\r ]+", " "))


def fingerprint(x: Column) -> Column:
    """Lower-cased ASCII letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def ascii_words(x: Column) -> Column:
    """ASCII letters and digits in lower case, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def words(x: Column) -> Column:
    """Non-blank words, parted by white space."""
    return F.filter(F.split(squash(x), " "), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x)).cast("long")


def all_words_in(hay: Column, query: str) -> Column:
    """Every white-space word of the query is a substring of hay, without case."""
    low = F.lower(hay)
    return F.forall(F.split(F.lower(F.trim(F.lit(query))), r"\s+"), lambda w: F.contains(low, w))


def reading_minutes(n_words: Column) -> Column:
    """At 200 words a minute, 1 at least, also of an unknown number."""
    return F.greatest(F.lit(1), F.round(n_words / 200)).cast("long")


def token_estimate(x: Column, chars_a_token: float) -> Column:
    return F.ceil(F.length(x) / F.lit(chars_a_token)).cast("long")


def base_id(x: Column) -> Column:
    return F.regexp_replace(x, r"v\d+$", "")


def version(x: Column) -> Column:
    """The trailing version number, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"v(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))


def tags(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"#[\p{L}\p{N}_-]+"), F.lit(0)))


def bracket_citations(x: Column) -> Column:
    """Passage ids inside square brackets, in order of first appearance."""
    groups = F.regexp_extract_all(x, F.lit(r"\[[^\]]*\]"), F.lit(0))
    ids = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"p\d{5}"), F.lit(0))))
    return F.array_distinct(ids)


def loose_citations(x: Column) -> Column:
    """Number of passage ids outside brackets."""
    return F.regexp_count(F.regexp_replace(x, r"\[[^\]]*\]", ""), F.lit(r"p\d{5}"))


def uncited(x: Column) -> Column:
    return F.regexp_replace(x, r" ?\[(?:p\d{5}(?:, ?)?)+\]", "")


def redacted(x: Column) -> Column:
    """Bearer tokens, keys and mail addresses masked, cut to 500 characters."""
    x = F.regexp_replace(x, r"(?i)bearer +[A-Za-z0-9._-]+", "Bearer ***")
    x = F.regexp_replace(x, r"\b(sk|key|token)-[A-Za-z0-9_-]{8,}", "***")
    x = F.regexp_replace(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "***@***")
    return F.substring(x, 1, 500)


def signature(x: Column) -> Column:
    """A failure's signature: its first line with labels, quoted names, source and run paths, and digits masked."""
    line = F.split_part(x, F.lit("\n"), F.lit(1))
    line = F.regexp_replace(line, r"[\w.-]+:[\w:.-]+", "LABEL")
    line = F.regexp_replace(line, r'"[^"]*"|\S+\.(?:tex|sty|cls|bib)\b|\S*/runs/[0-9a-f]{12}/\S*', "FILE")
    return F.trim(F.regexp_replace(line, r"\d+", "N"))


def short_title(x: Column) -> Column:
    head = F.trim(F.split_part(x, F.lit(":"), F.lit(1)))
    return F.when(F.contains(x, F.lit(":")) & F.length(head).between(4, 60), head).otherwise(x)


def title_key(x: Column) -> Column:
    return F.substring(fingerprint(x), 1, 30)


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def first_sentence(x: Column) -> Column:
    """The first sentence if it has 20 to 200 characters, else the first 120 characters."""
    found = F.regexp_extract(squash(x), r"^(.{19,199}?[.!?])( |$)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(squash(x), 1, 120))


def lead(x: Column) -> Column:
    """First letter raised."""
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))


def prose(x: Column) -> Column:
    """TeX source without comments, citations, references, commands and braces."""
    x = F.regexp_replace(x, r"(?m)(?<!\\)%.*$", "")
    x = F.regexp_replace(x, r"\\(?:cite|ref|label|eqref)[a-z]*\*?(?:\[[^\]]*\])*\{[^}]*\}", " ")
    x = F.regexp_replace(x, r"\\href\{[^}]*\}", " ")
    x = F.regexp_replace(x, r"\\[A-Za-z]+\*?", " ")
    return squash(F.regexp_replace(x, r"[{}$~]", " "))


def tex_escaped(x: Column) -> Column:
    """TeX specials escaped outside spans of mathematics ($...$)."""
    odd = lambda part: F.regexp_replace(part, r"([&%#_])", r"\\$1")
    return F.array_join(F.transform(F.split(x, r"\$", -1), lambda part, i: F.when(i % 2 == 0, odd(part)).otherwise(part)), "$")


def count_label(n: Column) -> Column:
    """1234 as 1.2k, 123456 as 123k, small counts as they are."""
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 100_000, F.concat(F.round(n / 1000, 1).cast("decimal(10,1)").cast("string"), F.lit("k")))
        .otherwise(F.concat(F.round(n / 1000).cast("long").cast("string"), F.lit("k")))
    )


def reference_title(x: Column) -> Column:
    """The title in a bibliography entry: quoted, else after the year, else the second sentence, else the entry; at most 300 characters."""
    x = squash(x)
    quoted = F.regexp_extract(x, "[\"\u201c]([^\"\u201d]+? [^\"\u201d]+?)[.,]?[\"\u201d]", 1)
    dated = F.regexp_extract(x, r"\((?:19|20)\d\d[a-z]?\)[.,]? ([^.]+)\.", 1)
    second = F.regexp_extract(x, r"^[^.]+\. ((?:[^ .]+ ){2,}[^ .]+)\.", 1)
    none = F.lit("")
    return F.substring(F.coalesce(F.nullif(quoted, none), F.nullif(dated, none), F.nullif(second, none), x), 1, 300)


def accepted_title(found: Column, entry: Column, wanted: Column) -> Column:
    """Whether a found title may stand for an entry: long enough, contained in it, and most of the extracted title."""
    f, e, w = fingerprint(found), fingerprint(entry), fingerprint(wanted)
    return (F.length(f) >= 12) & F.contains(e, f) & (F.length(f) >= 0.8 * F.length(w))


def heading_level(x: Column) -> Column:
    number = F.regexp_extract(x, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


def anchor_key(x: Column) -> Column:
    """A lossless anchor for a key: itself where it is plain, else its bytes."""
    return F.when(x.rlike("^[A-Za-z0-9_.:-]+$"), F.concat(F.lit("ref-"), x)).otherwise(F.concat(F.lit("refx-"), F.lower(F.hex(x.cast("binary")))))


def search_expression(x: Column, stop: list[str]) -> Column:
    """The AND of a query's words that aren't stop words."""
    kept = F.filter(words(F.lower(x)), lambda w: ~w.isin(stop))
    return F.array_join(F.transform(kept, lambda w: F.concat(F.lit("all:"), w)), " AND ")


def normal_url(x: Column) -> Column:
    """Scheme, www., fragment, trailing marks and .git dropped; the host lower-cased."""
    x = F.regexp_replace(x, r"^https?://(?:www\.)?", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[?#].*$", ""), r"[.,;)/]+$", "")
    x = F.regexp_replace(x, r"\.git$", "")
    host = F.split_part(x, F.lit("/"), F.lit(1))
    return F.concat(F.lower(host), F.substring(x, F.length(host) + 1, F.length(x)))
