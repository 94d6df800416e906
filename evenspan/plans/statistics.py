"""Queries A13 to A19, A47, W7: position statistics on the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as S
from ..operators import stats as T
from ..registry import query
from . import fixtures as X
from .similarity import SIMS_SQL, t_sql


def sims(spark, d):
    s = S.position_similarities(X.segments(spark, d), X.standalone(spark, d), X.document(spark, d))
    return s.withColumn("item", F.regexp_extract("doc_id", r"^(.*)_\d+$", 1))


WIDE_SQL = SIMS_SQL + """,
wd as (select doc_id, any_value(sim) filter (where pos = 0) s1, any_value(sim) filter (where pos = 1) s2, any_value(sim) filter (where pos = 2) s3 from sims group by doc_id),
pr(pair, x, y) as (select '1_vs_2', s1, s2 from wd union all select '1_vs_last', s1, s3 from wd union all select '2_vs_last', s2, s3 from wd)"""


@query("a13_position_differences", f"""with {WIDE_SQL},
 g as (select pair, count(*) n, avg(x) mx, avg(y) my, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) c from pr group by pair),
 h as (select *, {t_sql('n - 1')} * sqrt(greatest((my / mx ** 2) ** 2 * vx / n + vy / n / mx ** 2 - 2 * my / mx ** 3 * c / n, 0)) half from g)
 select pair, n, round(mx - my, 6) abs_raw, round(100 * (1 - my / mx), 5) rel_raw, round(mx - my, 3) abs_diff, round(100 * (1 - my / mx), 1) rel_diff,
  round(100 * (1 - my / mx) - 100 * half, 4) ci_low, round(100 * (1 - my / mx) + 100 * half, 4) ci_high from h""")
def a13(spark, d):
    r = T.position_differences(T.position_pairs(sims(spark, d)))
    return r.withColumns({"abs_raw": F.round("abs_raw", 6), "rel_raw": F.round("rel_raw", 5), "ci_low": F.round("ci_low", 4), "ci_high": F.round("ci_high", 4)})


@query("a14_welch_statistic", f"""with {WIDE_SQL}, g as (select pair, count(*) n, avg(x) mx, avg(y) my, var_samp(x) / count(*) a, var_samp(y) / count(*) b from pr group by pair)
 select pair, n, round((mx - my) / sqrt(a + b), 4) t, round((a + b) ** 2 / ((a ** 2 + b ** 2) / (n - 1)), 3) df from g""")
def a14(spark, d):
    return T.welch(T.position_pairs(sims(spark, d))).select("pair", "n", F.round("t", 4).alias("t"), F.round("df", 3).alias("df"))


@query("a14_welch_test")
def a14p(spark, d):
    return T.welch(T.position_pairs(sims(spark, d)))


@query("a15_wilcoxon_statistic", f"""with {WIDE_SQL}, dd as (select pair, x - y d from pr where x <> y),
 rk as (select pair, d, rank() over (partition by pair order by abs(d)) r, count(*) over (partition by pair, abs(d)) t from dd)
 select pair, count(*) n, sum(case when d > 0 then r + (t - 1) / 2.0::double else 0 end) w_plus, sum(case when d < 0 then r + (t - 1) / 2.0::double else 0 end) w_minus from rk group by pair""")
def a15(spark, d):
    return T.wilcoxon(T.position_pairs(sims(spark, d))).select("pair", "n", "w_plus", "w_minus")


@query("a15_wilcoxon_test")
def a15p(spark, d):
    return T.wilcoxon(T.position_pairs(sims(spark, d)))


@query("w07_tie_averaged_ranks", """with x as (select p_partkey, p_size, rank() over (order by p_size) r, count(*) over (partition by p_size) t from part)
 select p_partkey, r + (t - 1) / 2.0::double avg_rank from x""")
def w07(spark, d):
    return T.average_ranks(X.table(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "avg_rank")


ITEM_SQL = SIMS_SQL + ", im as (select item, pos, avg(sim) m from sims group by item, pos)"


@query("a16_item_means", f"with {ITEM_SQL} select item, pos, round(m, 6) mean_sim from im")
def a16(spark, d):
    return T.item_means(sims(spark, d)).withColumn("mean_sim", F.round("mean_sim", 6))


@query("a17_rm_anova_statistic", f"""with {ITEM_SQL}, g as (select avg(m) gm from im),
 p as (select sum(n * (a - gm) ** 2) ss_pos, count(*) k from (select pos, count(*) n, avg(m) a from im group by pos), g),
 s as (select sum(n * (a - gm) ** 2) ss_subj, count(*) mm from (select item, count(*) n, avg(m) a from im group by item), g),
 t as (select sum((m - gm) ** 2) ss_total from im, g)
 select mm n_items, k n_positions, round((ss_pos / (k - 1)) / ((ss_total - ss_pos - ss_subj) / ((k - 1) * (mm - 1))), 3) f_value, round(ss_pos / ss_total, 6) eta_sq from p, s, t""")
def a17(spark, d):
    return T.rm_anova(T.item_means(sims(spark, d))).select("n_items", "n_positions", F.round("f_value", 3).alias("f_value"), F.round("eta_sq", 6).alias("eta_sq"))


@query("a17_rm_anova")
def a17p(spark, d):
    return T.rm_anova(T.item_means(sims(spark, d)))


@query("a18_clustered_ols_coefficients", f"""with {SIMS_SQL}, mu as (select pos, avg(sim) m, count(*) np from sims group by pos),
 cell as (select item, pos, sum(sim) - count(*) * any_value(m) e from sims join mu using (pos) group by item, pos),
 cr as (select a.pos p, b.pos q, sum(a.e * b.e) meat from cell a join cell b using (item) group by 1, 2),
 k as (select count(distinct item) g, count(*) n, count(distinct pos) kk from sims),
 cv as (select p, q, meat / x.np / y.np * (g / (g - 1.0::double) * (n - 1) / (n - kk)) c from cr join mu x on x.pos = p join mu y on y.pos = q, k),
 base as (select m from mu where pos = 0)
 select mu.pos, round(case when mu.pos = 0 then mu.m else mu.m - base.m end, 6) beta,
  round(sqrt(case when mu.pos = 0 then v.c else v.c + z.c - 2 * w.c end), 6) se, round(mu.m, 6) adjusted_mean, g n_clusters
 from mu, base, k, cv v, cv z, cv w where v.p = mu.pos and v.q = mu.pos and z.p = 0 and z.q = 0 and w.p = mu.pos and w.q = 0""")
def a18(spark, d):
    r = T.clustered_ols(sims(spark, d))
    return r.select("pos", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round("adjusted_mean", 6).alias("adjusted_mean"), "n_clusters")


@query("a18_clustered_ols")
def a18p(spark, d):
    return T.clustered_ols(sims(spark, d))


@query("a19_gini_index", f"""with {ITEM_SQL}, p as (select pos, avg(m) x from im group by pos)
 select count(distinct a.pos) n_positions, round(sum(abs(a.x - b.x)) / (2 * count(distinct a.pos) ** 2 * avg(a.x)), 6) gini from p a, p b""")
def a19(spark, d):
    return T.gini(T.item_means(sims(spark, d))).select(F.col("n_positions").cast("long").alias("n_positions"), F.round("gini", 6).alias("gini"))


@query("a19_gini_test")
def a19p(spark, d):
    return T.gini_test(T.item_means(sims(spark, d)))


@query("f16_significance_stars", "select l_orderkey, l_linenumber, case when l_tax < 0.001 then '***' when l_tax < 0.01 then '**' when l_tax < 0.05 then '*' else '' end star from lineitem")
def f16(spark, d):
    from ..functions.titles import stars

    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stars(F.col("l_tax")).alias("star"))
