"""Tokens of odd texts are those of the SQL."""

import pytest
from conftest import same_rows

from evenspan import plans  # noqa: F401
from evenspan.registry import ORACLES, QUERIES

TEXTS = [
    "", " ", "\n", "\t \n", "\na b", "a b\n", "\ta", "a\t", "a\r\nb\fc", " a  b ", "a\x0bb", "a\x1cb", "a\u0085b", "a\u00a0b", "\u00a0a b\u3000", "\u2003", "a\u2028b",
    "\u200ba b", "\ufeffa", "caf\u00e9 x", "\U0001f600 b", "a " * 200, "a b c", None,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "a b", "en"), (100, "x", "de"), (101, "y", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def views(d):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["c01_tokenize_job", "f05_tokens", "o08_all_sets", "u01_tokenizer_hook"])
def test_odd_texts(name, spark, odd):
    got, want = same_rows(QUERIES[name](spark, odd), views(odd), ORACLES[name])
    assert got == want


def test_all_sets_of_repeated_ids(spark, tmp_path):
    """Rows of one id, of the same length or of another, meet all others as the join of rows says, and never one another."""
    texts = ["a b", "a b", "c", "d e f", "x " * 50, "x " * 58]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(0, "a b", "en"), (0, "k", "en"), (2, "c", "en"), (3, "d", "en"), (-4, "e", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = same_rows(QUERIES["o08_all_sets"](spark, str(tmp_path)), views(str(tmp_path)), ORACLES["o08_all_sets"])
    assert got == want
