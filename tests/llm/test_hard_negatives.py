"""Hard negatives against a plain sort of all scores in Python's integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

hard = pytest.importorskip("evenspan.llm.hard_negatives")
KIND = "vec_id long, label int, embedding array<double>, rank int, anchor_id string"


def plainly(rows, positives=5, negatives=5):
    took = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        took.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(took):
        if i % 100:
            continue
        score = [max(-(1 << 60), min(1 << 60, sum(x * y for x, y in zip(v, w, strict=False)))) for _, _, w in took]
        order = sorted((n for n in range(len(took)) if n != a), key=lambda n: (-score[n], took[n][0]))
        for p in [n for n in order if took[n][1] == label][:positives]:
            fit = [n for n in order if took[n][1] != label and 80 * score[p] <= 100 * score[n] <= 100 * score[p]][:negatives]
            out += [(i, took[p][0], r, took[n][0], score[p], score[n]) for r, n in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame(rows, KIND).repartition(parts)
    out = hard.mine(df.select("vec_id", "label", "embedding", "rank", "anchor_id"), F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(r) for r in out.collect())


def vectors(n, seed, dims=6, close=0.6):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(3), [close + rnd.random() for _ in range(dims)], None, "x") for i in range(n)]


def test_against_sorting_everything(spark):
    rows = vectors(450, 1)
    assert mined(spark, rows) == plainly(rows) != []


def test_digits_slabs_and_blocks_of_any_size(spark, monkeypatch):
    rows = vectors(330, 2)
    want = plainly(rows)
    monkeypatch.setattr(hard, "SLAB", 2)  # the driver's loop; tasks have values of their own
    assert mined(spark, rows) == want


def test_ties_copies_and_a_hot_vector(spark):
    rows = vectors(120, 3) + [(1000 + i, i % 2, [1.0] * 6, 0, None) for i in range(300)]
    rows += rows[:7] + rows[100:101]  # rows that repeat, an anchor among them
    assert mined(spark, rows, parts=5) == plainly(rows) != []


def test_nulls_and_odd_numbers_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    bad = [(None, 1, [1.0] * 6, 1, ""), (300, None, [1.0] * 6, 1, ""), (400, 1, None, 1, ""), (500, 1, [1.0, None], 1, ""), (600, 1, [inf], 1, ""), (700, 1, [nan] * 6, 1, ""), (701, 1, [1e308], 1, "")]
    rows = vectors(220, 4) + bad + [(800, 1, [], 1, ""), (801, 1, [0.9], 1, ""), (802, 2, [1.0] * 9, 1, "")]
    assert mined(spark, rows) == plainly(rows) != []


def test_scores_beyond_what_floats_hold(spark):
    rnd = random.Random(5)
    rows = [(i, i % 2, [rnd.choice((1.0, 3e4, 2e5 + 1 / 256)) + rnd.randrange(50) / 256 for _ in range(4)], None, "") for i in range(0, 210, 7)]
    rows += [(100 * i, i % 2, [3e7 + i, 5.5e6, 1.0 + i, 2e12 * (i == 3)], None, "") for i in range(5)]
    assert mined(spark, rows) == plainly(rows) != []


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == [] == mined(spark, [(1, 1, [1.0], 1, "")])
    assert mined(spark, [(100, 1, [1.0], 1, "")]) == []
