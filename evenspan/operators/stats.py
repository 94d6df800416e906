"""Position statistics: differences, tests, analysis of variance, clustered regression, Gini.

Every function takes ``by``, columns that tell runs apart (never null): all runs go through one plan, and each has the rows it would
have alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distributions import f_greater, t_crit, t_two_sided, wilcoxon_p
from .ranks import block_of, sum_before

#: The compared pairs: first with second, first with last, second with last.
PAIRS = (("1_vs_2", 0, 1), ("1_vs_last", 0, -1), ("2_vs_last", 1, -1))


def _agg(rows: DataFrame, by: list[str] | tuple, *aggs: Column) -> DataFrame:
    """A row for each run, or one."""
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def _beside(rows: DataFrame, one: DataFrame, by: list[str] | tuple) -> DataFrame:
    """``rows`` with the columns of their run's row."""
    return rows.join(one, list(by)) if by else rows.join(F.broadcast(one))  # one row


def position_pairs(sims: DataFrame, key: str = "doc_id", by: list[str] | tuple = ()) -> DataFrame:
    """pair, key, x, y: the two similarities of each document for each compared pair of positions.

    With two positions the second is the last, and that pair compares a position with itself.
    """
    last = _agg(sims, by, F.max("pos").alias("_last"))
    at = lambda p: F.col("_last") if p < 0 else F.lit(p)
    wide = _beside(sims, last, by).groupBy(*by, key).agg(*[F.max(F.when(F.col("pos") == at(p), F.col("sim"))).alias(n) for n, p in (("first", 0), ("second", 1), ("last", -1))])
    name = {0: "first", 1: "second", -1: "last"}
    pairs = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(name[a]).alias("x"), F.col(name[b]).alias("y")) for n, a, b in PAIRS])
    return wide.select(*by, key, F.inline(pairs)).filter("x is not null and y is not null")


def position_differences(pairs: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Per pair: means, absolute (3 dp) and relative difference in % (1 dp) with the delta-method interval, and raw values.

    The relative difference is to the first of the pair; variances and covariance are of the sample.
    """
    g = pairs.groupBy(*by, "pair").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cxy"))
    mx, my, n = F.col("mx"), F.col("my"), F.col("n")
    var = F.pow(my / F.pow(mx, 2), 2) * F.col("vx") / n + F.pow(1 / mx, 2) * F.col("vy") / n - 2 * (my / F.pow(mx, 3)) * F.col("cxy") / n
    half = t_crit(n - 1) * F.sqrt(F.greatest(var, F.lit(0.0)))
    rel = 1 - my / mx
    g = g.withColumn("abs_raw", mx - my).withColumn("rel_raw", 100 * rel).withColumn("_h", 100 * half)
    return g.select(*by, "pair", "n", "abs_raw", "rel_raw", F.round("abs_raw", 3).alias("abs_diff"), F.round("rel_raw", 1).alias("rel_diff"),
                    (F.col("rel_raw") - F.col("_h")).alias("ci_low"), (F.col("rel_raw") + F.col("_h")).alias("ci_high"))


def welch(pairs: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Welch's t of x against y for each pair, two-sided."""
    g = pairs.groupBy(*by, "pair").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_samp("x") / F.count("x")).alias("a"), (F.var_samp("y") / F.count("y")).alias("b"))
    t = (F.col("mx") - F.col("my")) / F.sqrt(F.col("a") + F.col("b"))
    df = F.pow(F.col("a") + F.col("b"), 2) / ((F.pow("a", F.lit(2)) + F.pow("b", F.lit(2))) / (F.col("n") - 1))
    return g.select(*by, "pair", "n", t.alias("t"), df.alias("df")).withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))


def wilcoxon(pairs: DataFrame, key: str = "doc_id", by: list[str] | tuple = ()) -> DataFrame:
    """Signed-rank sums of x - y without zero differences, tie-averaged ranks; p NULL if nothing is left. An infinite
    difference ranks as the largest; pairs without a difference (null, NaN, infinite on both sides) are left out."""
    d = pairs.withColumn("d", F.col("x") - F.col("y")).filter("d <> 0 and not isnan(d)")
    # of each size of difference, how many there are: ranks follow from the counts of smaller sizes
    d = d.groupBy(*by, "pair", F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    d = sum_before(d.withColumn("b", block_of(d, "a")), [*by, "pair"], "a", "b", F.col("t"), "r").withColumn("rank", F.col("r") + 1 + (F.col("t") - 1) / 2)
    g = d.groupBy(*by, "pair").agg(
        F.sum("t").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("t") - F.col("up")) * F.col("rank")).alias("w_minus"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    every = pairs.select(*by, "pair").distinct().join(g, [*by, "pair"], "left")
    return every.select(*by, "pair", F.coalesce("n", F.lit(0)).alias("n"), "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("statistic"), "ties").withColumn("p_value", wilcoxon_p(F.col("n"), F.col("statistic"), F.col("ties")))


def average_ranks(rows: DataFrame, value: str, name: str = "avg_rank") -> DataFrame:
    """``rows`` with the rank of a number among all, ties averaged: ranks follow from the counts of smaller values. A row
    without a number (null) isn't counted and has no rank; NaN ranks after infinity, as Spark orders it."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_t"))
    ranks = sum_before(n.withColumn("_b", block_of(n, "_v")), [], "_v", "_b", F.col("_t"), "_r").select("_v", (F.col("_r") + 1 + (F.col("_t") - 1) / 2).alias(name))
    return rows.join(ranks, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")


def item_key(doc_id: Column) -> Column:
    """The unordered set of a document's segments, as sorted text."""
    return F.array_join(F.array_sort(F.split(doc_id, "_")), "_")


def item_means(sims: DataFrame, item: str = "item", by: list[str] | tuple = ()) -> DataFrame:
    """item, pos, mean_sim of items that have every position; an unbalanced item is left out."""
    g = sims.groupBy(*by, item, "pos").agg(F.avg("sim").alias("mean_sim"))
    n = _agg(g, by, F.countDistinct("pos").alias("_p"))
    g = _beside(g.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by, item))), n, by).filter("_n = _p")
    return g.select(*by, F.col(item).alias("item"), "pos", "mean_sim")


def rm_anova(means: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Repeated-measures analysis of variance on item by position means: F, degrees, p, generalised eta squared."""
    m = _beside(means, _agg(means, by, F.avg("mean_sim").alias("_g")), by)
    parts = [F.count(F.lit(1)).alias("n"), F.pow(F.avg("mean_sim") - F.first("_g"), 2).alias("q")]
    total = _agg(m, by, F.sum(F.pow(F.col("mean_sim") - F.col("_g"), 2)).alias("ss_total"))
    a = _agg(m.groupBy(*by, "pos").agg(*parts), by, F.sum(F.col("n") * F.col("q")).alias("ss_pos"), F.count(F.lit(1)).alias("p"))
    b = _agg(m.groupBy(*by, "item").agg(*parts), by, F.sum(F.col("n") * F.col("q")).alias("ss_subj"), F.count(F.lit(1)).alias("m"))
    one = _beside(_beside(a, b, by), total, by).withColumn("ss_err", F.col("ss_total") - F.col("ss_pos") - F.col("ss_subj"))
    d1, d2 = F.col("p") - 1, (F.col("p") - 1) * (F.col("m") - 1)
    out = one.select(
        *by, F.col("m").alias("n_items"), F.col("p").alias("n_positions"), d1.alias("df_effect"), d2.alias("df_error"),
        ((F.col("ss_pos") / d1) / (F.col("ss_err") / d2)).alias("f_value"), (F.col("ss_pos") / (F.col("ss_pos") + F.col("ss_subj") + F.col("ss_err"))).alias("eta_sq"))
    return out.withColumn("p_value", f_greater(F.col("f_value"), F.col("df_effect"), F.col("df_error")))


def clustered_ols(rows: DataFrame, item: str = "item", by: list[str] | tuple = ()) -> DataFrame:
    """Regression on categorical position, the first as reference, standard errors clustered by item.

    The model is saturated: coefficients are differences of position means. Residual sums of each (item,
    position) are the cluster scores; what is left is a matrix of positions by positions, which one grouped
    function handles. Intervals and p use t with N - K degrees of freedom.
    """
    cells = rows.groupBy(*by, item, "pos").agg(F.sum("sim").alias("s"), F.count(F.lit(1)).alias("n"))
    means = cells.groupBy(*by, "pos").agg((F.sum("s") / F.sum("n")).alias("mu"), F.sum("n").alias("np"))
    res = cells.join(means if by else F.broadcast(means), [*by, "pos"]).select(*by, item, "pos", (F.col("s") - F.col("n") * F.col("mu")).alias("e"))  # a row per position
    # sums over clusters of score products, for each pair of positions
    other = res.withColumnsRenamed({"pos": "q", "e": "f"})
    cross = res.join(other, [*by, item]).groupBy(*by, F.col("pos").alias("p"), "q").agg(F.sum(F.col("e") * F.col("f")).alias("m"))
    groups = _agg(cells, by, F.countDistinct(item).alias("g"))
    flat = _beside(cross.join(means.withColumnRenamed("pos", "p"), [*by, "p"]), groups, by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = sorted(pdf["p"].unique())
        k = len(pos)
        mu, n = (pdf.drop_duplicates("p").set_index("p").loc[pos, c].to_numpy(float) for c in ("mu", "np"))
        meat = pdf.pivot(index="p", columns="q", values="m").reindex(index=pos, columns=pos).fillna(0).to_numpy(float)
        g, total = int(pdf["g"].iloc[0]), n.sum()
        cov_means = (meat / n[:, None] / n[None, :]) * (g / (g - 1) * (total - 1) / (total - k) if g > 1 and total > k else np.nan)
        to = np.eye(k)
        to[1:, 0] = -1
        beta, cov = to @ mu, to @ cov_means @ to.T
        return pd.DataFrame({"pos": pos, "beta": beta, "se": np.sqrt(np.maximum(np.diag(cov), 0)), "adjusted_mean": mu, "mean_se": np.sqrt(np.maximum(np.diag(cov_means), 0)), "n_clusters": g, "df_resid": total - k})

    def solve_run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve(pdf)
        for i, (c, k) in enumerate(zip(by, key, strict=True)):
            out.insert(i, c, k)
        return out

    run = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    out = flat.groupBy(*by).applyInPandas(solve_run, run + "pos int, beta double, se double, adjusted_mean double, mean_se double, n_clusters long, df_resid double")
    half = t_crit(F.col("df_resid")) * F.col("se")
    p = t_two_sided(F.col("beta") / F.col("se"), F.col("df_resid"))
    return out.withColumn("ci_low", F.col("beta") - half).withColumn("ci_high", F.col("beta") + half).withColumn("p_value", F.when(F.col("se") > 0, p))


def _gini_of(v: str) -> Column:
    """Gini index of an array of sorted values: mean absolute difference over twice the mean, without pairs."""
    weighted = F.aggregate(F.transform(v, lambda x, i: (2 * (i + 1) - F.size(v) - 1) * x), F.lit(0.0), lambda s, x: s + x)
    return weighted / (F.size(v) * F.aggregate(v, F.lit(0.0), lambda s, x: s + x))


def gini(means: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Gini index of the position means, in one row. Positions are few."""
    m = means.groupBy(*by, "pos").agg(F.avg("mean_sim").alias("x"))
    return _agg(m, by, F.sort_array(F.collect_list("x")).alias("v")).select(*by, F.size("v").alias("n_positions"), _gini_of("v").alias("gini"))


#: Items whose permutations one task draws.
GINI_BLOCK = 4096


def gini_test(means: DataFrame, permutations: int = 10_000, seed: int = 42, by: list[str] | tuple = ()) -> DataFrame:
    """Gini index and permutation p (ge + 1) / (N + 1): positions are permuted within each item.

    Items fall into blocks by hash; each block adds its permuted sums for all permutations, and the blocks'
    sums meet. The draw of an item depends on the seed and its block within the run, so that reruns agree.
    """
    rows = means.groupBy(*by, "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean_sim"))), lambda s: s["mean_sim"]).alias("v"))
    blocks = _agg(rows, by, F.ceil(F.count(F.lit(1)) / GINI_BLOCK).alias("_blocks"))
    rows = _beside(rows, blocks, by).withColumn("b", F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int")).drop("_blocks")

    def permuted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("item")["v"].to_numpy())
        rng = np.random.default_rng([seed, int(key[-1])])
        out = np.empty((permutations + 1, x.shape[1]))
        out[0] = x.sum(axis=0)
        for k in range(1, permutations + 1):
            out[k] = rng.permuted(x, axis=1).sum(axis=0)
        return pd.DataFrame({c: v for c, v in zip(by, key, strict=False)} | {"k": np.arange(permutations + 1), "s": list(out)})

    run = "".join(f"{c} {means.schema[c].dataType.simpleString()}, " for c in by)
    sums = rows.groupBy(*by, "b").applyInPandas(permuted, run + "k int, s array<double>")
    total = sums.select(*by, "k", F.posexplode("s").alias("pos", "x")).groupBy(*by, "k", "pos").agg(F.sum("x").alias("x"))
    each = total.groupBy(*by, "k").agg(F.sort_array(F.collect_list("x")).alias("v")).select(*by, "k", _gini_of("v").alias("g"))
    both = _beside(each.filter("k > 0"), each.filter("k = 0").select(*by, F.col("g").alias("gini")), by)
    return both.groupBy(*by, "gini").agg(((F.sum((F.col("g") >= F.col("gini") - 1e-15).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
