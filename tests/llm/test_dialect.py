"""Patterns that Java and Python don't write alike."""

import re

import pytest

from evenspan.llm import url_rules as U

URLS = ["http://a.org/p/wandering", "http://b.org/fooba", "http://b.org/foobar/x", "http://c.org/a]foo", "http://c.org/bfoo", "http://d.org/A.B", "http://e.org/q.e", None, "x"]


def rule(pattern, name="r"):
    return U.Rule(name, "block", pattern, 1)


def found(spark, *rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    return {r["page_id"] for r in U.url_filter(pages, rules).filter("verdict = 'block'").collect()}


@pytest.mark.parametrize(
    ("pattern", "want"),
    [(r"\p{L}+ing$", {0}), (r"(?<n>foo)bar", {2}), (r"[a-z&&[^b]]foo", set()), (r"/\Qq.e\E$", {6}), (r"/\0101\.B", {5}), (r"(?i)/a\.b$", {5}), (r"(?x) / foo bar", {2}), (r"/foob++a", {1, 2}), (r"/foo\h*ba", {1, 2})],
)
def test_java_patterns_have_their_results(spark, pattern, want):
    assert found(spark, rule(pattern)) == want
    assert found(spark, rule(pattern), rule(r"/wandering$", "s")) == want | {0}


@pytest.mark.parametrize("pattern", [r"(?P<n>foo)bar", "(", "[a", "a{2,1}"])
def test_others_are_told_before_anything_runs(spark, pattern):
    with pytest.raises(ValueError, match="rule r: .* is no Java regular expression"):
        found(spark, rule(pattern))


def test_tokens_are_read_where_both_agree():
    assert U.literals(r"^(?:[^/]*\.)?example\.com/en/") == {"example", "com", "en"}
    assert all(U.literals(p) == set() for p in (r"\p{L}+ing$", r"[a-z&&[^b]]/foo/", r"\Qfoo\E", r"(?i)/foo/", "(", re.escape("a") + "{2,1}"))
