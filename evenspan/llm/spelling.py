"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so that words of the same letters have the same key and one
letter more, less or exchanged changes the key by a value that depends on these letters alone. Keys are joined where
they meet after taking off one letter: a key less a letter equals the key of a word that lacks that letter
(addition, removal), or another key less another letter (exchange). Half of the letter order is checked by the join
itself: of two words that differ at one place one half is the same, so rows are filed under key and half, which keeps
words of like letters in other orders apart. The rest of the order is verified by the edit distance of the pairs.

Defined results: a null text has no words; a null id deletes nothing; rows that repeat count as often as they come; an
empty table gives no rows; among near words of equal count the smallest in code-point order is the form. Words of any
length take part. Every pair that is near is found, and no other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, small, stash, tidy

#: Words of fewer letters and of fewer occurrences take no part.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form has at least so many times the occurrences of its word.
TIMES = 10
#: Of the checksums of id and run, those that this divides cost the run a letter.
CUT = 31
POWER = 5
#: Different words that a task counts before it sends what it has.
HELD = 200_000


def spelled(docs: DataFrame, cut: int | None = CUT, least: int = LEAST_LETTERS) -> DataFrame:
    """``docs``: doc_id, text. word and n, counts by task: runs of letters of ASCII and Latin-1, A-Z lower-cased, less
    one letter where ``cut`` divides the checksum of id and run."""
    # a run of fewer letters gives no word of enough, so that it isn't looked at
    runs = re.compile(rb"[A-Za-z\xC0-\xFF]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found]), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                # every character outside Latin-1 becomes a question mark, which ends a run as it did
                of = Counter(runs.findall(text.encode("latin-1", "replace").lower()))
                seed = zlib.crc32(f"{key}:".encode()) if cut and key is not None else None
                for run, n in of.items():
                    if seed is not None:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                        if h % cut == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least:
                                continue
                    found[run] += n
                if len(found) >= HELD:
                    yield told()
                    found.clear()
        if found:
            yield told()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    return spelled(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _power(letter: Column) -> Column:
    return F.pow(F.ascii(letter).cast("double"), F.lit(POWER)).cast("long")


def filed(words: DataFrame) -> DataFrame:
    """``words``: word, n. A row for each word, letter taken off it (null: none) and half: at (where the row is
    filed), off, front (whether the first half is kept), cut (letters of that half), word, n."""
    letters = F.split("word", "")
    total = F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: a + _power(x))
    kept = F.struct(F.lit(None).cast("string").alias("off"), F.lit(0).cast("long").alias("less"))
    less = F.transform(F.array_distinct(letters), lambda x: F.struct(x.alias("off"), _power(x).alias("less")))
    rows = words.select("word", "n", F.length("word").alias("_long"), total.alias("_key"), F.explode(F.concat(F.array(kept), less)).alias("_o"))
    rest = F.col("_long") - F.when(F.col("_o.off").isNull(), 0).otherwise(1)
    rows = rows.select("word", "n", F.col("_o.off").alias("off"), (F.col("_key") - F.col("_o.less")).alias("_key"), rest.alias("_rest"), F.floor(rest / 2).cast("int").alias("cut"))
    front, back = F.substring("word", F.lit(1), F.col("cut")), F.right("word", F.col("_rest") - F.col("cut"))
    sides = F.array(F.struct(F.lit(True).alias("front"), front.alias("half")), F.struct(F.lit(False).alias("front"), back.alias("half")))
    rows = rows.select("word", "n", "off", "cut", "_key", "_rest", F.explode(sides).alias("_s"))
    return rows.select(F.xxhash64("_key", "_rest", "_s.front", "_s.half").alias("at"), "off", F.col("_s.front").alias("front"), "cut", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """``words``: word, n, each word once. Every pair of near words, once: a, a_n, b, b_n."""
    rows = stash(filed(words), "filed")
    mine = rows.filter("off is not null").select("at", F.col("off").alias("a_off"), "front", "cut", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = rows.select("at", F.col("off").alias("b_off"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    # a word with a letter less meets a word as it is, or one that lost another letter; of the latter each pair comes once
    meet = (mine.at == other.at) & (F.col("b_off").isNull() | ((F.col("a_off") != F.col("b_off")) & (F.col("a") < F.col("b"))))
    pairs = mine.join(other, meet)
    # where both halves agree the front half has the pair
    once = F.col("front") | (F.expr("substring(a, 1, cut)") != F.expr("substring(b, 1, cut)"))
    pairs = pairs.filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
    pairs._stashed = rows._stashed
    return pairs


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``words``: word, n, stashed. word, n, n_near, form, form_n: the form is the near word of most occurrences,
    if it has at least ``times`` those of the word."""
    pairs = near_words(words)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))
    # of most occurrences, then the smallest: the least of (-n, word)
    best = pairs.select(F.inline(ends)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("_best"))
    best = stash(best, "near")
    drop(pairs)
    out = words.join(small(best), "word", "left")
    fits = -F.col("_best.m") >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("_best.near")).alias("form"), F.when(fits, -F.col("_best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms``: word, form (not null). word and root, the last of the forms that follow each other. As counts grow
    by ``TIMES`` at least from a word to its form, chains are short; each round doubles the steps."""
    last = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = last.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        if last.join(small(on), F.col("root") == F.col("_w"), "left_semi").isEmpty():
            return last
        further = stash(last.join(small(on), F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        drop(last)
        last = further


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text. word, form, root, n, n_near, form_n of every word."""
    spark = docs.sparkSession
    with tidy(spark):
        words = stash(vocabulary(docs), "words")
        found = stash(variants(words), "variants")
        drop(words)
        last = roots(found.filter("form is not null"))
        out = found.join(small(last), "word", "left")
        return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
