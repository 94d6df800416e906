"""Statistics of many runs in one plan are those of each run alone."""

import random

import pytest
from pyspark.sql import functions as F

from evenspan import jobs as J
from evenspan.operators import similarity as S
from evenspan.operators import stats as T


@pytest.fixture(scope="module")
def sims(spark):
    rnd = random.Random(3)
    rows = []
    for run, items, places in (("a", 9, 3), ("b", 14, 4), ("c", 5, 2)):
        rows += [(run, f"{i}_{k}", f"i{i}", p, rnd.choice((0.25, 0.5, rnd.random())) + 0.1 * p) for i in range(items) for k in range(3) for p in range(places)]
    rows.append(("a", "9_0", "lone", 0, 0.3))  # not balanced
    return spark.createDataFrame(rows, "run string, doc_id string, item string, pos int, sim double").cache()


def rounded(rows, drop=()):
    return sorted(repr([(c, round(v, 5) + 0.0 if isinstance(v, float) else v) for c, v in sorted(r.asDict().items()) if c not in drop]) for r in rows)


CASES = {
    "pairs": lambda s, by: T.position_pairs(s, by=by), "differences": lambda s, by: T.position_differences(T.position_pairs(s, by=by), by), "welch": lambda s, by: T.welch(T.position_pairs(s, by=by), by),
    "wilcoxon": lambda s, by: T.wilcoxon(T.position_pairs(s, by=by), by=by), "means": lambda s, by: T.item_means(s, by=by), "anova": lambda s, by: T.rm_anova(T.item_means(s, by=by), by),
    "regression": lambda s, by: T.clustered_ols(s, by=by), "gini": lambda s, by: T.gini(T.item_means(s, by=by), by), "gini_test": lambda s, by: T.gini_test(T.item_means(s, by=by), 200, by=by),
    "leakage": lambda s, by: S.leakage_test(s.withColumnRenamed("pos", "src").selectExpr("*", "abs(hash(doc_id)) % 3 dst").filter("src <> dst"), by),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_by_run(sims, name):
    together = CASES[name](sims, ["run"]).collect()
    for run in "abc":
        alone = CASES[name](sims.filter(f"run = '{run}'").drop("run"), []).collect()
        assert rounded([r for r in together if r["run"] == run], ("run",)) == rounded(alone) != []


def test_similarities_are_made_once(spark, sims):
    """The parts asked for come, and however many they are, a similarity is computed once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    d = sims.replace({"a": "m1__en__concat-size_3", "b": "m1__de__concat-size_3"}, subset="run").withColumn("sim", counted("sim"))
    runs = spark.createDataFrame([(r,) for r in ("m1__en__concat-size_3", "m1__de__concat-size_3", "notes")], "name string")
    parts = ["regression", "gini", "welch", "differences"]
    got = J.quantitative_results(runs, d, "m1", ["de", "en"], permutations=5, parts=parts)
    assert list(got) == parts and all({r["run"] for r in got[p].collect()} == {"m1__en__concat-size_3", "m1__de__concat-size_3"} for p in parts)
    assert 0 < made.value <= sims.count()
