"""Scan of SQL dumps by splits: a statement of any length is read by as many tasks as the file has splits.

Spark reads the file with ``),(`` as line end, so that byte ranges, borders that cross them and remote stores are Spark's
own matter. What is left is that titles may hold these characters too. A piece that ends within a string is put together with
the next. Whether a split begins within a string is known from the quotes of those before it: a first pass gives of each
split whether it turns that state round, or sets it (raw line feeds stand outside strings only, as dumps escape the others); a
second one cuts. A tuple that lies over the border of splits after all is put together from the pieces that they tell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BORDER = "),("
_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _state_after(piece: str, inside: bool) -> bool:
    """Whether a string is open after the piece."""
    head, feed, tail = piece.rpartition("\n")
    return ((inside and not feed) + _ESCAPED.sub("", tail).count("'")) % 2 == 1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """_file, _start (of the split), value, in the order of the file within a split."""
    return spark.read.option("lineSep", BORDER).text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The pieces of each split that a task reads, one after the other."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    for key, group in groupby(rows, key=lambda r: (r[0], r[1])):
        yield key, (r[2] for r in group)


def _starts(pieces: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """Of each split, whether it begins within a string, and the start of the split that has the beginning of that string's
    tuple. A line for each split comes to the driver, as the splits themselves do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), texts in _by_split(batches):
            closed, opened, never = False, True, True  # the state after, by the state before; whether one that began open stays so
            for t in texts:
                closed, opened = _state_after(t, closed), _state_after(t, opened)
                never = never and opened
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, start, closed, opened, never)], names=["file", "start", "closed", "opened", "never"])

    out, last, inside, owner = {}, None, False, 0
    for r in sorted(pieces.mapInArrow(run, "file string, start long, closed boolean, opened boolean, never boolean").collect()):
        inside = inside and r["file"] == last
        last = r["file"]
        out[(r["file"], r["start"])] = (inside, owner if inside else r["start"])
        if not (inside and r["never"]):
            owner = r["start"]
        inside = r["opened"] if inside else r["closed"]
    return out


def dump_tuples(spark: SparkSession, path: str) -> DataFrame:
    """value: a tuple of the dump between brackets, for ``files.dump_pages`` and ``files.dump_langlinks``. Where a statement
    ends and another begins, both tuples are one row, with what lies between. A gzip file is one split, as Spark can't cut it."""
    pieces = _pieces(spark, path)
    starts = _starts(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts in _by_split(batches):
            (inside, owner), held = starts[key], []
            part, done = inside, []  # part: what is held belongs to a tuple that began in an earlier split
            for t in texts:
                held.append(t)
                inside = _state_after(t, inside)
                if not inside:
                    done.append((owner if part else None, BORDER.join(held)))
                    held, part = [], False
                if len(done) >= 10_000:
                    yield told(key, done)
                    done = []
            if held:
                done.append((owner if part else key[1], BORDER.join(held)))
            if done:
                yield told(key, done)

    def told(key: tuple[str, int], done: list) -> pa.RecordBatch:
        n = len(done)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["file", "start", "owner", "value"])

    cut = pieces.mapInArrow(run, "file string, start long, owner long, value string")
    whole = cut.filter("owner is null").select("value")
    if any(inside for inside, _ in starts.values()):
        # parts over borders of splits, two for each border at most
        parts = cut.filter("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
        whole = whole.unionByName(parts.select(F.array_join(F.transform("p", lambda x: x["value"]), BORDER).alias("value")))
    else:
        whole = cut.select("value")
    return whole.select(F.concat(F.lit("("), "value", F.lit(")")).alias("value"))
