"""Queries against their SQL on texts that the tables don't hold."""

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from quirestack import registry
from quirestack.operators import matching

ODD = [
    None, "", " ", "\n\t ", "\u00a0", "\u2003 \u3000", "a", " a  b ", "a\x0bb \x0b", "\x0b", "\u00a0 a \u00a0 b \u2009", "a\u00a0b", "\u0085a\u0085", "\u200ba\u200b ",
    "a\r\n\fb", "a\x1cb\x00c", "\u180ea\u180e", "\u00e9 \u0301x \U0001f600", "w " * 100, "w " * 99 + "w\n", "w " * 300, "w\u00a0" * 300, "\u3000" * 50 + "w" + " \u2028" * 50,
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Makes a table of documents: (folder, connection)."""

    def made(rows):
        place = str(tmp_path_factory.mktemp("odd"))
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{place}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{place}/documents.parquet/*.parquet')")
        return place, con

    return made


def test_squash_words_count(spark, tables):
    place, con = tables(list(enumerate(ODD)))
    assert oracle.compare(registry.queries()["squash_words_count"](spark, place), con, registry.oracle_sql()["squash_words_count"]) == len(ODD)


LINES = [
    (0, "first\n\u00a0\n \u3000\nlast"), (1, "one line only"), (2, "\n \u2009\n"), (3, None), (4, ""), (5, "the same\nthe same"), (6, "a\n\t\nb\r\n\x0b\nthe end"), (7, "it ends\nas it begins: it ends\nbut it ends"),
    (None, "no id\nat all"), (8, "twice\nthe same\ntext"), (8, "twice\nthe same\ntext"), (9, "once\n\u00a0\nwith text"), (9, None), (10, "\u00e9" * 40 + "\n" + "\U0001f600" * 40), (11, "tail here\nand tail\ntail"),
]


def test_relocate_pairs(spark, tables, monkeypatch):
    """Lines that are blank in SQL, missing and repeated ids; what stands word for word in its document isn't sought among all others."""
    monkeypatch.setattr(matching, "relocate", None)
    place, con = tables(LINES)
    assert oracle.compare(registry.queries()["relocate_pairs"](spark, place), con, registry.oracle_sql()["relocate_pairs"]) == 9


def test_relocate_in_rows_is_relocate_across(spark):
    docs = {"a": ["it began on a cold and windy morning", "nothing of note was said in between", "and it ended when the rain had stopped"], "b": ["and it ended when the rain had stopped", "it began on a cold and windy morning"]}
    docs |= {"c": docs["a"], "d": docs["a"], "e": [*docs["a"], *docs["a"]], "f": docs["a"], "g": docs["b"]}
    asked = [
        ("a", "a cold and windy morning", "and it ended when", 0.0), ("b", "a cold and windy morning", "and it ended when", 0.0), ("c", "a cold and windy mornin", "ended when the rain hed stopped", 0.0),
        ("d", "not there at all", "and it ended", 0.0), ("e", "cold and windy", "the rain had stopped", 4.0), ("f", "", "and it ended when", 0.0), ("g", "And it ended, when the rain", "it began on a cold", None),
    ]
    q = spark.createDataFrame(asked, "doc string, head string, tail string, near double")
    rows = q.join(spark.createDataFrame(list(docs.items()), "doc string, passages array<string>"), "doc")
    texts = spark.createDataFrame([(f"{d}{i}", d, i, t) for d, lines in docs.items() for i, t in enumerate(lines)], "p string, of string, spot int, text string")
    across = matching.relocate_across(q.withColumn("of", F.col("doc")), texts, "doc", "p", "of", "spot").collect()
    want = {r["doc"]: (r["p"], r["end_p"], r["found"], r["match"]) for r in across}
    place = lambda d, spot: None if spot is None else f"{d}{spot}"
    got = {r["doc"]: (place(r["doc"], r["spot"]), place(r["doc"], r["end_spot"]), r["found"], r["match"]) for r in matching.relocate_in_rows(rows, "doc").collect()}
    assert got == want
    assert got["a"] == ("a0", "a2", "found", None) and got["b"][2] == got["d"][2] == got["f"][2] == "not-found" and got["c"][2] == got["g"][2] == "moved" and got["e"] == ("e3", "e5", "found", None)
