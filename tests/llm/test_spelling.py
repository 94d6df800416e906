"""Spelling variants against deletion neighbourhoods in Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

spelling = pytest.importorskip("evenspan.llm.spelling")
KIND = "doc_id long, text string, word string, n int"


def words_of(rows):
    found = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plainly(rows):
    w = words_of(rows)
    near, holes = defaultdict(set), defaultdict(set)
    for x in w:
        for i in range(len(x)):
            less = x[:i] + x[i + 1 :]
            if less in w:
                near[x].add(less)
                near[less].add(x)
            holes[i, less].add(x)
    for group in holes.values():
        for x in group:
            near[x] |= group - {x}
    form = {}
    for x, others in near.items():
        if others and w[best := min(others, key=lambda y: (-w[y], y))] >= 10 * w[x]:
            form[x] = best
    out = []
    for x, n in w.items():
        root = x
        while root in form:
            root = form[root]
        out.append((x, form.get(x), root, n, len(near[x]), w.get(form.get(x))))
    return sorted(out)


def found(spark, rows, parts=3):
    out = spelling.spelling_variants(spark.createDataFrame(rows, KIND).repartition(parts))
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out.collect())


def test_random_words_of_few_letters(spark):
    rnd = random.Random(1)
    pool = ["".join(rnd.choices("abé", k=rnd.randrange(7, 10))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(pool, k=40)), None, i) for i in range(80)]
    assert found(spark, rows) == plainly(rows)


def test_chains_of_forms_lead_to_the_last(spark):
    text = "lantern1 " * 1300 + "lanterm " * 120 + "lantexm " * 11 + "LANTEXMSÉ? " + "lantexmsÉ-" * 2
    rows = [(5, text, "", 0), (6, "lanterns " * 2, None, None)]
    got = {r[0]: r for r in found(spark, rows)}
    assert got["lantexm"][2] == "lantern" and got["lantexm"][1] == "lanterm"
    assert found(spark, rows) == plainly(rows)


def test_words_of_equal_letters_in_other_orders(spark):
    """Thousands of words with one key: halves keep all but near ones apart."""
    rnd = random.Random(2)
    letters = list("aaaaabbbbbcc")
    pool = {"".join(rnd.sample(letters, len(letters))) for _ in range(1500)}
    pool |= {x[:k] + "c" + x[k + 1 :] for x in list(pool)[:200] for k in (0, 6, 11)} | {x[:k] + x[k + 1 :] for x in list(pool)[:200] for k in (0, 6, 11)}
    rows = [(None, " ".join(pool), None, 0)] * 2
    assert found(spark, rows) == plainly(rows)


def test_edges(spark):
    long = "ab" * 5_000
    rows = [(None, None, None, None), (1, "", "", 1), (2, "ÀÉ×÷ÿAZ " * 2, "x", 1), (3, f"{long} {long}x {long}x {long}", None, 0), (4, "ābcdefgh \U0001f600bcdefghiĀbcdefgh bcdefghi", None, 0)]
    assert found(spark, rows + rows) == plainly(rows + rows)
    assert found(spark, []) == []


def test_tasks_that_send_what_they_have_often(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = [(i, "wonders wondert wonderà wonderss bewonders", None, i) for i in range(40)]
    assert found(spark, rows) == plainly(rows)
