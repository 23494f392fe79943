"""Values of any shape and packages: leaves, first differences, search answers, rules over listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import packages, variants
from ..storage import stored
from ..tables import load

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tree(spark, d, changed=None):
    """(doc_id, v): a document as a nested value, its lines two levels down."""
    more = lambda i: F.lit(0) if changed is None else F.when(changed(i), 1).otherwise(0)
    made = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct((F.length(x) + more(i)).alias("n"), F.array(F.substring(x, 1, 1), F.substring(x, 2, 1)).alias("c")))
    return load(spark, d, "documents").select("doc_id", F.try_parse_json(F.to_json(F.struct(F.col("doc_id").alias("id"), made.alias("lines"), F.array().cast("array<string>").alias("none")))).alias("v"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k, len(string_split(coalesce(text, ''), chr(10))) AS m FROM documents)"


@query(f"""WITH {_LINES}
SELECT doc_id, '$.id' AS path, doc_id::VARCHAR AS value FROM documents UNION ALL SELECT doc_id, '$.none', NULL FROM documents
UNION ALL SELECT doc_id, '$.lines[' || k || '].n', length(x)::VARCHAR FROM l UNION ALL SELECT doc_id, '$.lines[' || k || '].c[' || i || ']', substr(x, i + 1, 1) FROM l, (SELECT unnest([0, 1]) AS i)""")
def nested_leaves(spark, d):
    """ARR-04: every leaf of nested values with its path."""
    rows = variants.leaves(_tree(spark, d), ["doc_id"], "v")
    return rows.select("doc_id", "path", F.try_variant_get("value", "$", "string").alias("value")).withColumn("value", F.when(F.col("path") != "$.none", F.col("value")))


@query(f"""WITH {_LINES} SELECT doc_id, '$.lines[' || k || '].n' AS path, length(x)::VARCHAR AS old, (length(x) + 1)::VARCHAR AS new FROM l WHERE k = doc_id % 7""")
def nested_differences(spark, d):
    """ARR-04: where two versions of a nested value differ first."""
    new = _tree(spark, d, lambda i: (i >= F.col("doc_id") % 7))
    return variants.first_difference(_tree(spark, d), new, ["doc_id"], "v")


_ANSWER = """CASE WHEN p_partkey % 3 = 0 THEN concat('{"results":[{"arxiv_id":"2401.', lpad(CAST(p_partkey AS STRING), 5, '0'), 'v3","title":" ', p_name, '   two ","authors":["', p_brand, '",5,"B  C"],"published":"2024-02-01"},{"arxiv_id":"none","title":"x"},7,{"arxiv_id":null}]}')
WHEN p_partkey % 3 = 1 THEN concat('{"data":[{"externalIds":{},"title":"no id"},{"externalIds":{"ArXiv":"hep-th/', lpad(CAST(p_partkey AS STRING), 7, '0'), '"},"title":"', p_name, '","authors":[{"name":"', p_brand, '"},{"id":1}],"year":', CAST(2000 + p_size AS STRING), ',"abstract":null}]}') ELSE 'no json' END"""


@query("""
SELECT p_partkey, 0 AS place, CASE WHEN p_partkey % 3 = 0 THEN '2401.' || lpad(p_partkey::VARCHAR, 5, '0') ELSE 'hep-th/' || lpad(p_partkey::VARCHAR, 7, '0') END AS arxiv_id,
  CASE WHEN p_partkey % 3 = 0 THEN trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' two' ELSE trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END AS title, CASE WHEN p_partkey % 3 = 0 THEN [p_brand, 'B C'] ELSE [p_brand] END AS authors,
  CASE WHEN p_partkey % 3 = 0 THEN 2024 ELSE (2000 + p_size)::INT END AS year, '' AS abstract, CASE WHEN p_partkey % 3 = 0 THEN 'results' ELSE 'data' END AS source FROM part WHERE p_partkey % 3 < 2""")
def search_answers(spark, d):
    """SRC-13: records of search answers of two services: valid ones, with white space squashed."""
    return variants.search_rows(load(spark, d, "part").selectExpr("p_partkey", f"{_ANSWER} AS body"), ["p_partkey"], "body")


@query("""
SELECT p_partkey, 'https://code/' || p_partkey AS url, p_size AS stars FROM part WHERE p_partkey % 4 <> 0""")
def official_code(spark, d):
    """SRC-13: the first official repository of an answer."""
    body = """concat('{"repositories":[{"is_official":false,"url":"https://other"},{"is_official":"true","url":"https://text"},', CASE WHEN p_partkey % 4 = 0 THEN '{"is_official":true}' ELSE concat('{"is_official":true,"url":"https://code/', p_partkey, '","num_stars":', p_size, '}') END, ',{"is_official":1,"url":"https://late"}]}')"""
    return variants.official_code(load(spark, d, "part").selectExpr("p_partkey", f"{body} AS body"), ["p_partkey"], "body")


_MADE = """m AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS low, l_quantity > 10 AS has_id FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)), o AS (SELECT DISTINCT k, top, low FROM m)"""


@query(f"""WITH {_MADE}
SELECT k, 'mimetype' AS rule, CASE WHEN k % 7 = 0 THEN 'text/d' || low || '.xhtml' ELSE 'mimetype' END AS what FROM o WHERE (k % 7 = 0 AND NOT (k % 19 = 0)) OR k % 11 = 0 AND NOT k % 7 = 0
UNION ALL SELECT k, 'mimetype', CASE WHEN low = top THEN 'cover.png' ELSE 'text/d' || nx || '.xhtml' END FROM (SELECT o.*, (SELECT min(n) FROM m WHERE m.k = o.k AND m.n > o.low) AS nx FROM o) WHERE k % 7 = 0 AND k % 19 = 0
UNION ALL SELECT k, 'covers', '0' FROM o WHERE k % 5 = 0
UNION ALL SELECT k, 'cover_kind', 'image/jpeg' FROM o WHERE k % 5 <> 0 AND k % 13 = 0
UNION ALL SELECT k, 'reading_order_item', 'i99' FROM o WHERE k % 17 = 0
UNION ALL SELECT k, 'reading_order_missing', 'text/d' || low || '.xhtml' FROM o WHERE k % 19 = 0
UNION ALL SELECT k, 'link_missing', '../text/./d' || (n + 1) || '.xhtml#s%201' FROM m WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.k = m.k AND x.n = m.n + 1 AND NOT (x.k % 19 = 0 AND x.n = x.low))
UNION ALL SELECT m.k, 'link_fragment', '../text/./d' || (m.n + 1) || '.xhtml#s%201' FROM m JOIN m x ON x.k = m.k AND x.n = m.n + 1 WHERE NOT x.has_id AND NOT (x.k % 19 = 0 AND x.n = x.low)
UNION ALL SELECT k, 'abstract_missing', '' FROM o WHERE k % 3 = 0
UNION ALL SELECT k, 'abstract_late', '1' FROM o WHERE k % 3 = 1
UNION ALL SELECT k, 'references_missing', '' FROM o WHERE k % 4 = 0""")
def package_faults(spark, d):
    """DOC-14: packages with planted faults: order of the archive, cover, reading order, links and their targets, abstract and references."""
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg((F.max("l_quantity") > 10).alias("has_id"))
    order = Window.partitionBy("k")
    docs = stored(lines.withColumn("top", F.max("n").over(order)).withColumn("low", F.min("n").over(order)), "packages")
    ends = docs.where("n <=> low").select("k", "top", "low")
    docs = docs.withColumn("name", F.concat(F.lit("text/d"), F.col("n").cast("string"), F.lit(".xhtml")))
    text, none = lambda x: F.lit(x).cast("string"), F.lit(None).cast("string")
    members = docs.where("NOT (k % 19 = 0 AND n = low)").select("k", (F.col("n") + 1).cast("long").alias("pos"), "name", text("deflated").alias("method"), none.alias("content"))
    members = members.unionByName(ends.select("k", F.when(F.col("k") % 7 == 0, 1000).otherwise(0).cast("long").alias("pos"), text("mimetype").alias("name"), F.when(F.col("k") % 11 == 0, "deflated").otherwise("stored").alias("method"), text("application/epub+zip").alias("content")))
    members = members.unionByName(ends.select("k", F.lit(500).cast("long").alias("pos"), text("cover.png").alias("name"), text("stored").alias("method"), none.alias("content")))
    manifest = docs.select("k", F.concat(F.lit("i"), F.col("n").cast("string")).alias("item"), "name", text("application/xhtml+xml").alias("media"), none.alias("properties"))
    manifest = manifest.unionByName(ends.where("k % 5 <> 0").select("k", text("cover").alias("item"), text("cover.png").alias("name"), F.when(F.col("k") % 13 == 0, "image/jpeg").otherwise("image/png").alias("media"), text("svg cover-image").alias("properties")))
    spine = docs.select("k", F.col("n").cast("long").alias("pos"), F.concat(F.lit("i"), F.col("n").cast("string")).alias("item")).unionByName(ends.where("k % 17 = 0").select("k", F.lit(99).cast("long").alias("pos"), text("i99").alias("item")))
    links = docs.select("k", "name", F.concat(F.lit("../text/./d"), (F.col("n") + 1).cast("string"), F.lit(".xhtml#s%201")).alias("link")).unionByName(docs.select("k", "name", text("https://far/").alias("link"))).unionByName(docs.select("k", "name", text("").alias("link")))
    ids = docs.where("has_id").select("k", "name", text("s 1").alias("id"))
    heads = ends.where("k % 3 <> 0").select("k", F.when(F.col("k") % 3 == 1, 5).otherwise(0).alias("at"), text(" Abstract").alias("text"))
    heads = heads.unionByName(ends.select("k", F.lit(1).alias("at"), text("1 Introduction").alias("text"))).unionByName(ends.where("k % 4 <> 0").select("k", F.lit(9).alias("at"), text("References").alias("text")))
    return packages.faults(members, manifest, spine, links, ids, packages.numbered(heads, "k", ["at"]), "k")
