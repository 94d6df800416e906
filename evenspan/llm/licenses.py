"""Licence scans: notice phrases and identifier tags by Aho-Corasick, expressions behind tags by shunting-yard.

A text is looked at as words (A-Z lower-cased, runs of digits, letters a-z and characters beyond ASCII). One automaton, built
once in a task, finds all phrases in one pass. The phrases of the base are all reported; of the other notices those that lie
within a longer one are not. Behind an identifier tag the text itself is read: licence names, brackets and the operators
``or``, ``and``, ``with`` (rising precedence, any case) up to what can't go on an expression. It is brought into postfix
order and evaluated: ``or`` leaves the freer of two, ``and`` the less free, ``with`` lifts a copyleft licence by a step.

Defined results: a null or empty text has no words, no labels and a score of 0; an unclosed bracket ends with the
expression, a bracket never opened ends it, an operator without a right side is left out; a name that isn't known counts
only if it has a digit or a hyphen; a tag with no expression gives no label. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .batches import with_columns
from .common import tidy

# The phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wordings of common notices and the labels that the method adds.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license": "apache-2",
    "apache license version 2": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "boost software license": "bsl-1",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license v 2": "mpl-2",
    "eclipse public license": "epl",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAGS = ("spdx license identifier", "license expression")
# How free a licence leaves its user, by the start of its label; the longest start that fits counts.
FREEDOM = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "bsl": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0, "0bsd": 1.0, "apache": 0.95, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.65, "cc-by-sa": 0.5, "gpl": 0.45, "agpl": 0.35, "cc-by-nd": 0.25, "cc-by-nc": 0.2, "reserved": 0.0,
}
UNKNOWN, LIFT = 0.3, 0.2
#: How surely a place tells of a licence.
SURE = {"base": 0.9, "notice": 0.9, "tag": 0.98}
WEAK = {"reserved": 0.4, "public-domain": 0.6, "cc-by": 0.6, "cc0": 0.6}

_LOW = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_GAPS = re.compile(rb"  +")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: What an expression is made of, after blanks, colons and the like.
_PIECE = re.compile(r"[ \t]*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.+-]*))")
_LEAD = re.compile(r"[ \t]*[:=]?[ \t]*[\"']?")
_BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(name: str) -> str:
    """The label of a licence's name in an expression: lower case, a version as its first number, no only or later."""
    low = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    return re.sub(r"-(\d+)(\.\d+)+$", r"-\1", low) if not low.startswith("cc") else re.sub(r"-\d+(\.\d+)*$", "", low)


def freedom_of(label: str) -> float:
    known = [k for k in FREEDOM if label == k or label.startswith(k + "-")]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def _known(name: str) -> bool:
    label = label_of(name)
    return any(label == k or label.startswith(k + "-") for k in FREEDOM) or bool(re.search(r"\d|-", name))


def postfix(text: str, start: int) -> list[str]:
    """The expression that begins at ``start`` of ``text``, by shunting-yard: names and operators in postfix order."""
    out: list[str] = []
    waiting: list[str] = []
    at, operand = _LEAD.match(text, start).end(), False  # operand: whether the last piece was one
    while m := _PIECE.match(text, at):
        opened, closed, name = m.groups()
        low = (name or "").rstrip(".-").lower()
        if opened and not operand:
            waiting.append("(")
        elif closed and operand and "(" in waiting:
            while (op := waiting.pop()) != "(":
                out.append(op)
        elif operand and low in _BINDS:
            # the right side has to follow, or the operator is prose
            follows = _PIECE.match(text, m.end())
            right = (follows.group(3) or "").rstrip(".-") if follows else ""
            if not follows or follows.group(2) or (right and (right.lower() in _BINDS or not (_known(right) or low == "with"))):
                break
            if follows.group(1):  # a bracket must hold a licence
                inner = _PIECE.match(text, follows.end())
                while inner and inner.group(1):
                    inner = _PIECE.match(text, inner.end())
                if not inner or not inner.group(3) or not _known(inner.group(3).rstrip(".-")):
                    break
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = False
        elif name and not operand and low not in _BINDS and (_known(low) or (waiting and waiting[-1] == "with")):
            out.append(low)
            operand = True
        else:
            break
        at = m.end()
    if not operand:
        return []
    return out + [op for op in reversed(waiting) if op != "("]


def evaluate(post: list[str]) -> tuple[list[str], float, str]:
    """Labels of the licences, the freedom that is left, and the expression with all its brackets."""
    stack: list[tuple[list[str], float, str]] = []
    for x in post:
        if x not in _BINDS:
            stack.append(([label_of(x)], freedom_of(label_of(x)), x))
            continue
        right, left = stack.pop(), stack.pop()
        if x == "with":  # the right side is an exception, no licence
            stack.append((left[0], min(1.0, left[1] + LIFT), f"{left[2]} with {right[2]}"))
        else:
            stack.append((left[0] + right[0], (max if x == "or" else min)(left[1], right[1]), f"({left[2]} {x} {right[2]})"))
    return stack[0]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def places(text: str, found) -> tuple[int, list[tuple[int, int, str]]]:
    """Number of words, and of each phrase that stands in the text: its first word, number of words, itself."""
    joined = _GAPS.sub(b" ", b" " + text.encode("utf-8", "replace").translate(_LOW) + b" ").decode()
    hits, word, at = [], 0, 0
    # by start: as all phrases have blanks at both ends, words are counted from one start to the next
    for start, (phrase, n) in sorted((end - len(phrase) - 1, (phrase, n)) for end, (phrase, n) in found.iter(joined)):
        word += joined.count(" ", at, start)
        at = start
        hits.append((word, n, phrase))
    return joined.count(" ") - 1, hits


_PLACE = StructType([StructField("label", StringType()), StructField("kind", StringType()), StructField("word", LongType()), StructField("words", IntegerType())])
FIELDS = [
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", ArrayType(StringType())), StructField("labels", ArrayType(StringType())), StructField("score", DoubleType()),
    StructField("expressions", ArrayType(StringType())), StructField("freedom", DoubleType()), StructField("places", ArrayType(_PLACE)),
]


def scanned(text: str | None, found) -> tuple:
    """The columns of ``FIELDS`` of one text."""
    if not text:
        return 0, 0, None, None, [], [], 0.0, [], None, []
    n, hits = places(text, found)
    base = [(w, BASE[p]) for w, _, p in hits if p in BASE]
    told = [(BASE[p], "base", w, k) for w, k, p in hits if p in BASE]
    free = [freedom_of(label) for _, label in base]
    reach = -1
    for w, k, p in sorted(((w, k, p) for w, k, p in hits if p in NOTICES), key=lambda x: (x[0], -x[1])):
        if w + k > reach:  # else it lies within one that began before it, or with it and is longer
            reach = w + k
            told.append((NOTICES[p], "notice", w, k))
            free.append(freedom_of(NOTICES[p]))
    expressions = []
    if tags := [(w, k) for w, k, p in hits if p in TAGS]:
        ends, want = {}, {w + k - 1 for w, k in tags}
        for i, m in enumerate(_WORD.finditer(text)):
            if i in want:
                ends[i] = m.end()
        for w, k in tags:
            if post := postfix(text, ends[w + k - 1]):
                labels, left, plain = evaluate(post)
                expressions.append(plain)
                free.append(left)
                told += [(x, "tag", w, k) for x in labels]
    unsure = {}
    for label, kind, *_ in told:
        unsure[label] = min(unsure.get(label, 1.0), 1 - (SURE[kind] if kind == "tag" else WEAK.get(label, SURE[kind])))
    score = 1.0
    for x in sorted(unsure.values()):
        score *= x
    starts = [w for w, _ in base]
    return (
        n, len(base), min(starts, default=None), max(starts, default=None), sorted({x for _, x in base}), sorted(unsure), 1 - score,
        expressions, min(free, default=None), sorted(told, key=lambda x: (x[2], x[3], x[0], x[1])),
    )


def _work() -> Callable[[list], list[list]]:
    found = automaton()
    return lambda texts: [list(x) for x in zip(*[scanned(t, found) for t in texts], strict=True)]


def scan_licenses(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns, if none are named) and n_words, n_base, first_word, last_word, base_labels, labels (sorted,
    distinct), score (how surely the text states a licence), expressions, freedom (of the strictest statement; null
    if there is none) and places (label, kind, first word, number of words). Columns of ``docs`` that have these
    names are replaced. One narrow pass."""
    with tidy(docs.sparkSession):
        return with_columns(docs, text, docs.columns if carry is None else carry, FIELDS, _work)
