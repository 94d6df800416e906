"""Hand-sized cases of kernels, statistics and files."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenspan.functions import special
from evenspan.functions import vectors as V
from evenspan.operators import attention as A
from evenspan.operators import design as D
from evenspan.operators import stats as T
from evenspan.sources import files as S


def test_distributions_match_published_values():
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert special.t_ppf(0.975, 1) == pytest.approx(12.7062, abs=1e-4)
    assert special.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.norm_sf(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert special.wilcoxon_exact(6, 0) == pytest.approx(2 / 64)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.5, 40), st.floats(0.5, 40), st.floats(0.001, 0.999))
def test_beta_is_symmetric(a, b, x):
    assert special.beta_inc(a, b, x) + special.beta_inc(b, a, 1 - x) == pytest.approx(1, abs=1e-9)


def rows(att):
    return {(r["k"]): r["w_cal"] for r in att.collect()}


@pytest.fixture
def att(spark):
    w = [0.5, 0.1, 0.1, 0.2, 0.1]
    return spark.createDataFrame([("d", 0, 0, 0, k, x) for k, x in enumerate(w)], "doc_id string, layer int, head int, q int, k int, w double")


def test_calibrated_baskets_have_equal_mass(att):
    got = rows(A.calibrate(att, 2))
    assert [got[0], got[1] + got[2], got[3] + got[4]] == pytest.approx([1 / 3] * 3)
    assert got[3] / got[4] == pytest.approx(2)


def test_no_strength_is_the_raw_row(att):
    raw = [0.5, 0.1, 0.1, 0.2, 0.1]
    for got in (rows(A.calibrate(att, 2, strength=0.0)), rows(A.calibrate_isolated(att, 2, strength=0.0))):
        assert [got[k] for k in range(5)] == pytest.approx(raw)


def test_library_form_with_equal_share_is_the_embedder_form(att):
    a, b = rows(A.calibrate(att, 2)), rows(A.calibrate_isolated(att, 2, bos="equal", eos=None, strength=1.0))
    assert [a[k] for k in range(5)] == pytest.approx([b[k] for k in range(5)])


def test_shares_must_leave_room(att):
    with pytest.raises(ValueError):
        A.calibrate_isolated(att, 2, bos=0.5, eos=0.5)


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 12), st.integers(0, 60))
def test_relative_bins_partition(spark, bins, more):
    n = bins + more
    got = [r[0] for r in spark.range(n).select(A.relative_bin(F.col("id"), F.lit(n), bins)).orderBy("id").collect()]
    edges = [i * n // bins for i in range(bins + 1)]
    assert got == [max(i for i in range(bins) if edges[i] <= k) for k in range(n)]


def test_vectors(spark):
    r = spark.range(1).select(
        V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
        V.span_pool(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0))), F.lit(0), F.lit(2)), V.span_pool(F.array(F.array(F.lit(1.0))), F.lit(1), F.lit(1))).first()
    assert r[0] == pytest.approx(math.sqrt(0.5)) and r[1] is None and r[2] == [2.0] and r[3] is None


def test_two_positions_compare_last_with_itself(spark):
    s = spark.createDataFrame([(d, p, 0.5 + d * 0.1 - p * 0.2) for d in range(3) for p in range(2)], "doc_id int, pos int, sim double")
    w = {r["pair"]: (r["n"], r["p_value"]) for r in T.wilcoxon(T.position_pairs(s)).collect()}
    assert w["2_vs_last"] == (0, None) and w["1_vs_2"][0] == 3


def test_constant_means_have_no_gini(spark):
    m = spark.createDataFrame([(i, p, 0.5) for i in range(4) for p in range(3)], "item int, pos int, mean_sim double")
    assert T.gini(m).first()["gini"] == pytest.approx(0)
    assert T.gini_test(m, permutations=20).first()["p_value"] == pytest.approx(1)


def test_rounding_of_samples():
    assert D.rounded_sample(1000, 3) == 1002 and D.rounded_sample(6, 3) == 6


def test_text_directory(spark, tmp_path):
    (tmp_path / "b.txt").write_text("  two \n lines \n")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.md").write_text("no")
    got = {r["id"]: r["text"] for r in S.text_directory(spark, str(tmp_path)).collect()}
    assert got == {"a": "one", "b": "two \n lines"}


def test_csv_nulls(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,text\n1,a\n2,\n')
    assert {r["id"]: r["text"] for r in S.csv_documents(spark, str(tmp_path / "x.csv"), nulls="None").collect()} == {"1": "a", "2": "None"}
    with pytest.raises(ValueError):
        S.csv_documents(spark, str(tmp_path / "x.csv"), text_column="body")


def test_streaming_baskets_match_the_batch(spark, tmp_path):
    from evenspan.streaming.attention import streaming_baskets

    rows = spark.createDataFrame([(i % 2, i, float(i)) for i in range(40)], "layer int, k int, w double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_baskets(stream, 8).writeStream.outputMode("complete").format("memory").queryName("baskets").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("baskets").collect(), streaming_baskets(rows, 8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_entry_without_pipeline_folder():
    import __spark_entry__

    assert "a01_position_profile" in __spark_entry__.queries()
