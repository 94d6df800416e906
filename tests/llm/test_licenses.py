"""Licence scans against regular expressions and hand-made expressions."""

import random
import re

import pytest

lic = pytest.importorskip("evenspan.llm.licenses")


def slow_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in lic.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), sorted({x for _, x in hits})


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string, places string").repartition(3)
    return {r.doc_id: r for r in lic.scan_licenses(df, carry=["doc_id", "score"]).collect()}


def test_base_against_lists_of_words(spark):
    rnd = random.Random(3)
    parts = "Under the MIT License|under THE|mit license|Apache License, Version 2|.0|CC BY-NC|cc-by|nc|CC\nBY\tNC|é|ſ|K|  |--|version|2|cc by cc by nc|the\x00mit|İ|\U0001f600|mit".split("|")
    texts = ["".join(rnd.choice(parts) + rnd.choice((" ", " ", "", "-", "\x7f")) for _ in range(rnd.randrange(60))) for _ in range(300)] + [None, "", " ", "CC BY NC", "é"]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(t), t
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize(
    ("text", "want", "freedom"),
    [
        ("MIT", "mit", 1.0),
        ("mit or gpl-3.0-only", "(mit or gpl-3.0-only)", 1.0),
        ("MIT AND GPL-3.0-only", "(mit and gpl-3.0-only)", 0.45),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT AND Apache-2.0", "(gpl-2.0-only with classpath-exception-2.0 or (mit and apache-2.0))", 0.95),
        ("(MIT OR AGPL-3.0) AND (LGPL-2.1+ OR BSD-3-Clause)", "((mit or agpl-3.0) and (lgpl-2.1+ or bsd-3-clause))", 1.0),
        ("((GPL-3.0)) and then some prose", "gpl-3.0", 0.45),
        ("MIT and (so on)", "mit", 1.0),
        ("MIT OR (Apache-2.0 AND", "(mit or apache-2.0)", 1.0),
        ("MIT) OR GPL-3.0", "mit", 1.0),
        ("LicenseRef-own", "licenseref-own", 0.3),
        ("MIT.", "mit", 1.0),
        ("MIT OR\nGPL-3.0", "mit", 1.0),
    ],
)
def test_expressions(text, want, freedom):
    labels, left, plain = lic.evaluate(lic.postfix(f": {text}", 0))
    assert (plain, round(left, 9)) == (want, freedom)


def test_what_is_no_expression():
    assert [lic.postfix(x, 0) for x in ("", ": OR MIT", ": prose", ": ()", ": (", " and")] == [[]] * 6


def test_random_expressions_against_python():
    """Brackets, precedence: the value equals that of Python's own parser with min and max."""
    rnd = random.Random(4)
    names = ["MIT", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "CC-BY-NC-4.0", "Own-1"]

    class V(float):
        __or__ = lambda a, b: V(max(a, b))
        __and__ = lambda a, b: V(min(a, b))

    def made(depth):
        if depth == 0 or rnd.random() < 0.3:
            n = rnd.choice(names)
            return n, f"V({lic.freedom_of(lic.label_of(n))})"
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        op = rnd.choice((" OR ", " AND "))
        text, code = a + op + b, x + {" OR ": "|", " AND ": "&"}[op] + y
        return (f"({text})", f"({code})") if rnd.random() < 0.5 else (text, code)

    for _ in range(300):
        text, code = made(4)
        assert lic.evaluate(lic.postfix(text, 0))[1] == pytest.approx(float(eval(code)))


def test_labels_of_the_method(spark):
    got = scan(
        spark,
        [
            "This work is licensed under the GNU General Public License, version 3.",
            "é // SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x; // SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0",
            "Licensed under CC BY-NC 4.0.",
            "SPDX-License-Identifier: nothing here",
            "A license is not a licence.",
            "x" * 3_000_000 + " under the MIT license " + "word " * 500_000,
        ],
    )
    assert got[0].labels == ["gpl-3"] and got[0].n_base == 0 and got[0].freedom == 0.45
    assert got[1].labels == ["apache-2", "gpl-2", "mit"] and got[1].base_labels == [] and got[1].freedom == pytest.approx(0.65)
    assert got[1].expressions == ["(mit or apache-2.0)", "gpl-2.0-or-later with classpath-exception-2.0"]
    assert got[2].labels == ["cc-by-nc"] == got[2].base_labels and got[2].freedom == 0.2
    assert got[3].labels == got[4].labels == [] and got[3].score == got[4].score == 0
    assert (got[5].n_words, got[5].first_word) == (500_005, 1)


def test_empty_table(spark):
    assert scan(spark, [])  == {}
