"""Ranks, percentiles and samples without one task for all, against plain computations."""

import itertools
import random
from math import comb, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenspan.operators import design as D
from evenspan.operators import encode as E
from evenspan.operators import ranks as R
from evenspan.operators import stats as T
from evenspan.sources import sinks as K


def test_dense_numbers_across_blocks(spark):
    rng = random.Random(1)
    ids = sorted(rng.sample(range(10**6), 300)) + [10**12]  # one far from the others
    rows = [(i, "ab"[i % 2]) for i in ids]
    d = spark.createDataFrame(rows, "id long, g string")
    for block in (1000, 7):
        assert {r["id"]: r["n"] for r in R.dense_number(d, "id", "n", block=block).collect()} == {x: k for k, x in enumerate(ids)}
        got = {(r["g"], r["id"]): r["n"] for r in R.dense_number(d, "id", "n", ["g"], block=block).collect()}
        assert got == {(g, x): k for g in "ab" for k, x in enumerate(i for i, h in rows if h == g)}


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=400), np.zeros(20), -np.ones(7), rng.exponential(1e-6, 50)])
    rows = [("a", float(v)) for v in x] + [("b", 3.0), ("b", None), ("c", -2.0), ("c", 5.0)]
    d = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["p"], r["q"], r["m"]) for r in R.percentiles(d, ["g"], "x", {"p": 0.01, "q": 0.95, "m": 0.5}).collect()}
    assert got["a"] == pytest.approx(tuple(np.quantile(x, [0.01, 0.95, 0.5]))) and got["b"] == (3.0, 3.0, 3.0) and got["c"] == pytest.approx((-1.93, 4.65, 1.5))


def test_bits_rise_with_the_numbers(spark):
    import struct

    rng = np.random.default_rng(9)
    near = [2.0**e * f for e in (*range(-1074, 1024, 7), -1023, -1022, -1021, 1023) for f in (1.0, 1 - 2.0**-53, 1 + 2.0**-52, 1.5)]
    x = [v for v in (*near, *rng.normal(size=300), *np.exp(rng.uniform(-700, 700, 300)), 0.0, float("inf"), 5e-324, 1.7976931348623157e308) if v == v]
    x += [-v for v in x]
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    for r in d.withColumn("b", R.ordered_bits(F.col("x"))).collect():
        want = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["b"] == (-want if r["x"] < 0 else want), r["x"]


def test_percentiles_of_odd_values(spark, monkeypatch):
    monkeypatch.setattr(R, "FEW", 3)
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(5)
    x = {
        "equal": [0.7] * 500, "close": (0.9 + rng.integers(0, 900, 700) * 2.0**-50).tolist(), "ends": [1.0, 2.0, inf, -inf, 3.0, nan, None], "zeros": [0.0, -0.0, 1.0, -1.0, 0.0],
        "tiny": (rng.integers(1, 400, 300) * 5e-324).tolist(), "skewed": [1.0] * 400 + np.exp(rng.normal(size=300) * 200).tolist() + [-1e300], None: rng.normal(size=100).tolist(), "none": [None, nan],
    }
    d = spark.createDataFrame([(g, v) for g, vs in x.items() for v in vs], "g string, x double").repartition(5)
    shares = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r["g"]: [r[n] for n in shares] for r in R.percentiles(d, ["g"], "x", shares).collect()}
    assert set(got) == set(x) - {"none"}
    for g, row in got.items():
        v = sorted(y for y in x[g] if y is not None and y == y)
        for y, p in zip(row, shares.values(), strict=True):
            at = p * (len(v) - 1)
            lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
            want = lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))
            assert y == pytest.approx(want, rel=1e-12, nan_ok=True), (g, p)
    assert R.percentiles(d.filter("g = 'none'"), ["g"], "x", {"p": 0.5}).count() == 0
    assert R.percentiles(d.filter("g = 'close'"), [], "x", {"p": 0.5}).first()["p"] == pytest.approx(np.median(x["close"]))


def test_ranks_with_nulls_and_infinite_values(spark, monkeypatch):
    inf = float("inf")
    d = spark.createDataFrame([(1.0, 1), (None, 2), (2.0, 3), (inf, 4), (-inf, 5), (2.0, 6)], "x double, i int")
    for block in (R.BLOCK, 2):
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R.block_of, "__defaults__", (block,))
        got = {r["i"]: r["avg_rank"] for r in T.average_ranks(d, "x").collect()}
        assert got == {1: 2.0, 2: None, 3: 3.5, 4: 5.0, 5: 1.0, 6: 3.5}
        p = spark.createDataFrame([("p", 1.0, inf), ("p", 3.0, 1.0), ("p", 2.0, 2.0), ("p", None, 1.0), ("p", inf, inf), ("p", 0.5, 0.0)], "pair string, x double, y double")
        w = T.wilcoxon(p).first()
        assert (w["n"], w["w_plus"], w["w_minus"]) == (3, 3.0, 3.0)


def test_medians_of_lengths(spark):
    from evenspan.operators import corpus as C

    rows = [("a", 5), ("a", 1), ("a", 2), ("a", 100), (None, 7), ("b", None)]
    got = {r["language"]: (r["n"], r["median_len"], r["max_len"]) for r in C.length_summary(spark.createDataFrame(rows, "language string, token_length int")).collect()}
    assert got == {"a": (4, 3.5, 100.0), None: (1, 7.0, 7.0), "b": (1, None, None)}


def test_ranks_of_ties(spark):
    rng = random.Random(2)
    rows = [("p", i, rng.choice([1.0, 2.0, 3.5]), rng.choice([1.0, 2.5, 3.0, 4.0])) for i in range(80)]
    got = T.wilcoxon(spark.createDataFrame(rows, "pair string, doc_id int, x double, y double")).first()
    d = [x - y for _, _, x, y in rows if x != y]
    size = sorted(map(abs, d))
    rank = {s: np.mean([k + 1 for k, v in enumerate(size) if v == s]) for s in set(size)}
    assert got["n"] == len(d) and got["w_plus"] == pytest.approx(sum(rank[abs(v)] for v in d if v > 0)) and got["w_minus"] == pytest.approx(sum(rank[abs(v)] for v in d if v < 0))
    assert got["ties"] == sum(size.count(s) ** 3 - size.count(s) for s in set(size))


def pool(spark, n):
    return spark.createDataFrame([(i, 10 + i) for i in range(n)], "seg_id long, token_length int")


def test_as_many_sets_as_there_are(spark):
    for asked, want in ((150, 150), (400, 400), (5000, comb(30, 3))):
        got = [tuple(r["segs"]) for r in D.sampled_sets(pool(spark, 30), 3, asked).collect()]
        assert len(got) == want == len({tuple(sorted(s)) for s in got}) and all(len(set(s)) == 3 for s in got)
    capped = D.sampled_sets(pool(spark, 30), 3, 5000, max_total=60).collect()
    assert len(capped) == sum(30 + sum(c) <= 60 for c in itertools.combinations(range(30), 3))


def by_length(rows, k, cap):
    return [c for c in itertools.combinations(range(len(rows)), k) if cap is None or sum(rows[i] or 0 for i in c) <= cap]


@pytest.mark.parametrize(("k", "cap"), [(1, 5), (2, 9), (3, 14), (4, 20), (3, None), (5, 0), (3, -1)])
def test_every_set_that_fits_and_no_other(spark, k, cap):
    rng = random.Random(k)
    rows = [rng.choice((0, 1, 2, 3, 5, 8, 13, None)) for _ in range(14)]
    d = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(rows)] + [("s0", rows[0]), (None, 1)], "seg_id string, token_length int").repartition(3)
    want = {tuple(sorted(f"s{i}" for i in c)) for c in by_length(rows, k, cap)} if cap is None or cap >= 0 else set()
    if cap is None or cap >= 0:
        assert D.feasible_sets(d, k, cap) == len(want)
    got = D.sampled_sets(d, k, 10**6, cap, seed=3).collect()
    assert sorted(r["set_no"] for r in got) == list(range(len(want)))
    assert {tuple(sorted(r["segs"])) for r in got} == want and len(got) == len(want)
    few = D.sampled_sets(d, k, 7, cap, seed=3).collect()
    assert len(few) == min(7, len(want)) == len({tuple(sorted(r["segs"])) for r in few}) and {tuple(sorted(r["segs"])) for r in few} <= want


def test_few_sets_among_many_that_do_not_fit(spark):
    """Most of the pool is too long: sets are found all the same."""
    rows = [1] * 60 + [50] * 940
    d = spark.createDataFrame(list(enumerate(rows)), "seg_id long, token_length int")
    got = D.sampled_sets(d, 3, 50, max_total=3).collect()
    assert len(got) == 50 == len({tuple(sorted(r["segs"])) for r in got}) and all(x < 60 for r in got for x in r["segs"]) and D.feasible_sets(d, 3, 3) == comb(60, 3)


def test_draws_are_even(spark):
    rows = [1, 1, 2, 3, 3, 4]
    d = spark.createDataFrame(list(enumerate(rows)), "seg_id long, token_length int")
    every, seen = by_length(rows, 3, 7), {}
    for seed in range(60):
        for r in D.sampled_sets(d, 3, 3, 7, seed).collect():
            key = tuple(sorted(r["segs"]))
            seen[key] = seen.get(key, 0) + 1
    assert set(seen) == set(every) and max(seen.values()) < 5 * 180 / len(every)


def test_numbers_of_sets_beyond_64_bits(spark, monkeypatch):
    from evenspan.operators import sets as N

    big = N.SetCounts([(5, 10**6), (7, 10**6), (11, 400)], 5, 60)
    assert not big.exact and big.total == pytest.approx(comb(2 * 10**6 + 400, 5), rel=1e-9)
    n, i = big.sets(np.arange(500), 1)
    assert (n.sum(axis=1) <= 60).all() and all(len(set(zip(a, b, strict=True))) == 5 for a, b in zip(n.tolist(), i.tolist(), strict=True)) and i.max() > 500_000
    monkeypatch.setattr(N, "EXACT", 1)  # doubles for few sets too: what comes twice is drawn again
    rows = [1, 1, 2, 3, 3, 4, 5, 5]
    d = spark.createDataFrame(list(enumerate(rows)), "seg_id long, token_length int")
    got = D.sampled_sets(d, 3, 12, 8).collect()
    assert len({tuple(sorted(r["segs"])) for r in got}) == 12 and {tuple(sorted(r["segs"])) for r in got} <= set(by_length(rows, 3, 8)) and sorted(r["set_no"] for r in got) == list(range(12))


def test_lengths_in_blocks_of_tables():
    from evenspan.operators import sets as N

    rng = random.Random(8)
    lengths = [(n, rng.randrange(1, 4)) for n in range(1, 18)]
    c = N.SetCounts(lengths, 3, 25)
    n, i = c.sets(np.arange(c.total))
    got = {tuple(sorted(zip(a, b, strict=True))) for a, b in zip(n.tolist(), i.tolist(), strict=True)}
    flat = [(n, i) for n, m in lengths for i in range(m)]
    assert got == {tuple(sorted(s)) for s in itertools.combinations(flat, 3) if sum(x for x, _ in s) <= 25} and len(got) == c.total
    for of in (1, 2, 5, 37, 1000):
        assert sorted(N.dealt(np.arange(of), of, 4).tolist()) == list(range(of))


def test_a_short_pool_repeats_segments(spark):
    got = [r["segs"] for r in D.sampled_sets(pool(spark, 2), 3, 40).collect()]
    assert len({tuple(s) for s in got}) == 8 and {tuple(r["segs"]) for r in D.sampled_sets(pool(spark, 2), 3, 40, 31).collect()} == {(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)}
    assert len(got) == 40 and all(len(s) == 3 and set(s) <= {0, 1} for s in got) and D.sampled_sets(pool(spark, 0), 3, 5).count() == 0


@pytest.mark.parametrize("k", [1, 3, 6])
def test_all_orders(spark, k):
    sets = spark.createDataFrame([(0, [10 + i for i in range(k)])], "set_no long, segs array<long>")
    got = [tuple(r["segs"]) for r in D.permuted(sets, k).orderBy("perm").collect()]
    assert got == list(itertools.permutations(range(10, 10 + k))) and len(got) == factorial(k)


def test_aligned_corpus_is_written_or_not(spark, tmp_path):
    even = spark.createDataFrame([(i, i, la) for i in range(5) for la in ("en", "de")], "row_no int, aligned_id int, lang string")
    assert K.write_aligned(even, f"{tmp_path}/a") and spark.read.parquet(f"{tmp_path}/a").count() == 10
    assert not K.write_aligned(even.filter("row_no < 4 or lang = 'en'"), f"{tmp_path}/b") and not (tmp_path / "b").exists()


def test_text_directory(spark, tmp_path):
    from evenspan.sources import files as S

    (tmp_path / "one.txt").write_text("  a\nb \n")
    (tmp_path / "two words.txt").write_text("c")
    (tmp_path / "no.md").write_text("d")
    assert {(r["id"], r["text"]) for r in S.text_directory(spark, str(tmp_path)).collect()} == {("one", "a\nb"), ("two words", "c")}


def test_batches_are_padded(spark):
    d = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5, 6])], "b int, input_ids array<int>")
    got = sorted((r["b"], r["input_ids"], r["attention_mask"]) for r in E.collated(d, "b", pad_id=9).collect())
    assert got == [(0, [1, 2, 3], [1, 1, 1]), (0, [4, 9, 9], [1, 0, 0]), (1, [5, 6], [1, 1])]
    left = {tuple(r["input_ids"]) for r in E.collated(d, "b", left=True, multiple=4).collect()}
    assert left == {(0, 1, 2, 3), (0, 0, 0, 4), (0, 0, 5, 6)}


def test_choices_go_before_the_model(spark):
    assert E.overrides(model_pooling="mean")["calibrated_tokens"] == "all" and E.overrides("last", model_pooling="mean")["isolate_last"]
    assert E.overrides("last", isolate_last=False)["isolate_last"] is False
    with pytest.raises(ValueError):
        E.overrides("max")


def test_sequences_hold_every_embedding(spark, sf):
    from evenspan.plans import fixtures as X

    per = X.attention(spark, sf).filter("layer = 0 and head = 0 and q = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.max("k") + 1).alias("m")).collect()
    assert sum(r["n"] for r in per) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and all(r["n"] == r["m"] for r in per)


def test_all_sets_against_every_combination(spark, monkeypatch):
    """All sets that fit come once each, from blocks of any size, without a number or a draw for each."""
    lengths = [i % 5 for i in range(24)] + [9, None]
    d = spark.createDataFrame(list(enumerate(lengths)), "seg_id long, token_length int").repartition(3)
    for block in (1024, 2):
        monkeypatch.setattr(D, "BLOCK", block)
        for k in (1, 2, 3):
            want = sorted((s, sum(lengths[i] or 0 for i in s)) for s in itertools.combinations(range(26), k) if sum(lengths[i] or 0 for i in s) <= 6)
            assert sorted((tuple(r["segs"]), r["total"]) for r in D.all_sets(d, k, 6).collect()) == want
    assert D.all_sets(d, 2, -1).count() == 0 and D.all_sets(d.limit(0), 2, 6).count() == 0
