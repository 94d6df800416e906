"""Tables of results, line by line."""

from evenspan.operators import tables as B


def lines(frame):
    return [r["line"] for r in frame.orderBy("line_no").collect()]


def test_blocks_columns_and_stars(spark):
    rows = [("en", 2, 0, 0.5, 0.0001), ("en", 2, 1, -0.75, 0.2), ("de", 2, 0, 0.25, None), ("en", 3, 0, 1.0, 0.03)]
    got = lines(B.coefficient_table(spark.createDataFrame(rows, "language string, n int, pos int, beta double, p_value double"), "Org/My_model", ["de", "en"]))
    body = got[got.index(r"    \midrule") + 1 : got.index(r"    \bottomrule")]
    assert body == [
        r"    \multirow{2}{*}{2} & intercept & 0.25 & 0.50*** \\", r"     & position 2 & -- & -0.75 \\",
        r"    \addlinespace[2ex]", r"    \multirow{1}{*}{3} & intercept & -- & 1.00* \\",
    ]
    assert got[0] == r"\begin{table}[tb]" and got[-1] == r"\end{table}" and got[-2] == r"  \label{tab:ols-coef-org-my-model}" and r"    $n$ & & de & en \\" in got


def test_other_tables(spark):
    one = spark.createDataFrame([("en", 10, 0.123, 0.004), ("en", 2, 0.5, 0.5)], "language string, n int, gini double, p_value double")
    assert [x for x in lines(B.gini_table(one, "m", ["en"])) if x.endswith(r"\\")][2:] == [r"    2 & 0.50 \\", r"    10 & 0.12** \\"]
    a = lines(B.anova_table(spark.createDataFrame([("en", 3, 0.0001, 0.25)], "language string, n int, p_value double, eta_sq double"), "m", ["en"]))
    assert r"    \multirow{2}{*}{3} & $p$ & <0.001 \\" in a and r"     & $\eta^2_G$ & 0.250 \\" in a
    d = lines(B.difference_table(spark.createDataFrame([("en", 3, "2_vs_last", 1.25, 0.04), ("en", 3, "1_vs_2", -2.0, None)], "language string, n int, pair string, rel_diff double, p_value double"), "m", ["en"]))
    assert [x for x in d if " vs " in x] == [r"    \multirow{2}{*}{3} & 1 vs 2 & -2.0 \\", r"     & 2 vs last & 1.3* \\"]
    t = lines(B.sample_table(spark.createDataFrame([("de", "fünf  & 6\n sieben"), ("en", "a_b")], "lang string, text string"), {"en": "English", "de": "German"}, 9))
    assert t[5:7] == [r"    \textbf{English} & {a\_b} \\", r"    \textbf{German} & {fünf \& 6} \\"]
