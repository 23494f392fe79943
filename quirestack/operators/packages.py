"""Rules of a package of documents, checked over its listing: archive order, reading order, cover, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The first member and what it holds, stored without compression.
TYPE, HOLDS = "mimetype", "application/epub+zip"


def resolved(base: Column, link: Column) -> Column:
    """The member that a link of member `base` names, '' parts and . and .. taken away, '..' in front where it leaves the package."""
    path = F.split_part(link, F.lit("#"), F.lit(1))
    folder = F.regexp_replace(base, r"[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, F.url_decode(path)), "/"), lambda p: (p != "") & (p != "."))
    up = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("..")) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, p))
    return F.when(path == "", base).otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def faults(members: DataFrame, manifest: DataFrame, spine: DataFrame, links: DataFrame, ids: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """(key, rule, what) of everything wrong with each package.

    members: (key, pos, name, method, content) in archive order, content of small members or null; manifest: (key, item, name, media, properties);
    spine: (key, pos, item) in reading order; links: (key, name, link) of documents; ids: (key, name, id) that links may name;
    headings: (key, spot, text, numbered) in reading order over all documents.

    The type comes first, uncompressed, and is exact; names are unique; there is one cover, a packaged PNG; the reading order isn't
    empty and names manifest items whose members are there; local links name members, and ids in them; the abstract comes before the
    first numbered section, and there is one; references are there.

    Tables meet by grouping, not by joins: once by package, once by item, once by member.
    """
    fault = lambda when, rule, what: F.when(when, F.struct(F.lit(rule).alias("rule"), what.cast("string").alias("what")))
    told = lambda df, *faults_: df.select(key, F.explode(F.array_compact(F.array(*faults_))).alias("_f")).select(key, "_f.*")
    is_cover = F.array_contains(F.split(F.coalesce("properties", F.lit("")), r"\s+"), "cover-image")
    low, empty = F.lower(F.trim("text")), F.lit("")

    # What is counted for a package.
    seen = {"first": "struct<name:string,method:string,content:string>", "pos": "bigint", "cover": "int", "read": "int", "abstract": "int", "section": "int", "references": "boolean"}
    row = lambda df, **given: df.select(key, *[given.get(c, F.lit(None)).cast(kind).alias(f"_{c}") for c, kind in seen.items()])
    rows = row(members, first=F.struct("name", "method", "content"), pos=F.col("pos")).unionByName(row(manifest.where(is_cover), cover=F.lit(1))).unionByName(row(spine, read=F.lit(1)))
    rows = rows.unionByName(row(headings, abstract=F.when(low == "abstract", F.col("spot")), section=F.when(F.col("numbered"), F.col("spot")), references=low.isin("references", "bibliography")))
    package = rows.groupBy(key).agg(
        F.count("_first").alias("members"), F.min_by("_first", "_pos").alias("first"), F.count("_cover").alias("covers"), F.count("_read").alias("read"),
        F.min("_abstract").alias("abstract"), F.min("_section").alias("section"), F.max("_references").alias("references"),
    ).where("members > 0")
    typed = (F.col("first.name") == TYPE) & (F.col("first.method") == "stored") & F.coalesce(F.col("first.content") == HOLDS, F.lit(False))
    out = told(
        package, fault(~typed, "mimetype", F.col("first.name")), fault(F.col("covers") != 1, "covers", F.col("covers")), fault(F.col("read") == 0, "reading_order_empty", empty),
        fault(F.col("abstract").isNull(), "abstract_missing", empty), fault(F.col("abstract") > F.col("section"), "abstract_late", F.col("section")),
        fault(~F.coalesce("references", F.lit(False)), "references_missing", empty),
    )
    out = out.unionByName(told(manifest.where(is_cover), fault(F.col("media") != "image/png", "cover_kind", F.col("media"))))

    # Items in the reading order, and what they name.
    named = manifest.select(key, "item", F.struct("name").alias("_name"), F.lit(None).cast("int").alias("_read")).unionByName(spine.select(key, "item", F.lit(None).cast("struct<name:string>").alias("_name"), F.lit(1).alias("_read")))
    items = named.groupBy(key, "item").agg(F.collect_list("_name").alias("names"), F.count("_read").cast("int").alias("n")).where("n > 0")
    items = items.select(key, "item", "names", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("col")
    out = out.unionByName(told(items, fault((F.size("names") == 0) | F.col("item").isNull(), "reading_order_item", F.col("item"))))
    read = items.where("item IS NOT NULL").select(key, F.explode("names").alias("_n")).select(key, F.col("_n.name").alias("name"))

    # What names members, beside the members and their ids: all that concerns one member of a package stands together.
    at = lambda df, role, name="name", piece=None, link=None, n=F.lit(0): df.select(
        key, F.col(name).alias("name"), F.lit(role).alias("role"), (F.lit(None).cast("string") if piece is None else piece).alias("piece"), (F.lit(None).cast("string") if link is None else F.col(link)).alias("link"), n.cast("long").alias("n")
    )
    local = links.where(~F.col("link").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//)") & (F.col("link") != "")).withColumn("target", resolved(F.col("name"), F.col("link")))
    each = at(members.groupBy(key, "name").agg(F.count(F.lit(1)).alias("_n")), "member", n=F.col("_n"))
    for more in (
        at(manifest.where(is_cover), "cover"), at(read, "read"), at(ids, "id", piece=F.col("id")),
        at(local, "link", "target", F.url_decode(F.split_part("link", F.lit("#"), F.lit(2))), "link"),
    ):
        each = each.unionByName(more)
    of_member, of_piece = Window.partitionBy(key, "name"), Window.partitionBy(key, "name", "piece")
    each = each.withColumn("_there", F.max((F.col("role") == "member") & F.col("name").isNotNull() & F.col(key).isNotNull()).over(of_member))
    each = each.withColumn("_known", F.max(F.col("role") == "id").over(of_piece))
    role, away = F.col("role"), ~F.col("_there")
    return out.unionByName(told(
        each.where("role <> 'id'"), fault((role == "member") & (F.col("n") > 1), "member_twice", F.col("name")), fault((role == "cover") & away, "cover_missing", F.col("name")),
        fault((role == "read") & away, "reading_order_missing", F.col("name")), fault((role == "link") & away, "link_missing", F.col("link")),
        fault((role == "link") & ~away & (F.col("piece") != "") & ~F.col("_known"), "link_fragment", F.col("link")),
    ))


def numbered(headings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """headings with spot, their place over all documents, and numbered, whether they begin with a section's number."""
    w = Window.partitionBy(key).orderBy(*order)
    return headings.withColumn("spot", F.row_number().over(w)).withColumn("numbered", F.col("text").rlike(r"^\d+(\.\d+)*\s"))
