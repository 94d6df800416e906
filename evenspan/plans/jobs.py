"""Queries of the jobs C1 to C4, C7, C10, end to end on the fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import jobs as J
from ..operators import similarity as S
from ..registry import query
from . import fixtures as X
from .attention import ABS_SQL, MASS_SQL, REL, R
from .attention import S as S8
from .fixtures import ITEMS_SQL, LATE_SQL

CFG = {"source_lang": "en", "target_langs": ["de"], "source_target_segment_diffs": [0.9], "source_segment_range": [20, 900], "concat_size": 3, "sample_size": 20, "max_total_length": 2000, "seed": 5}


@query("c01_tokenize_job", r"select doc_id::varchar id, lang, len(string_split_regex(trim(text), '\s+'))::int + 2 length from documents")
def c01(spark, d):
    return J.tokenize(spark, {"dataset_path": f"{d}/documents.parquet", "id_column": "doc_id"}).select("id", "lang", "length")


def _tokenized(spark, d):
    t = J.tokenize(spark, {"dataset_path": f"{d}/documents.parquet", "id_column": "doc_id"})
    return t.join(X.tokenized(spark, d).select(F.col("doc_id").cast("string").alias("id"), "dataset_idx", "token_length"), "id")


@query("c02_indices_job")
def c02(spark, d):
    return J.create_indices(spark, CFG, X.tokenized(spark, d))


@query("c02_indices_invariants", "select true whole_orders, 3 k, true balanced")
def c02i(spark, d):
    r = J.create_indices(spark, CFG, X.tokenized(spark, d))
    per = r.groupBy("set_no").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("segs").alias("u"))
    place = r.select("set_no", F.posexplode("segs").alias("pos", "s")).groupBy("set_no", "pos", "s").count()
    return per.agg(((F.min("n") == 6) & (F.min("u") == 6)).alias("whole_orders")).join(F.broadcast(r.agg(F.max(F.size("segs")).alias("k")))).join(F.broadcast(place.agg((F.min("count") == F.max("count")).alias("balanced"))))  # one row each


@query("c03_c07_embedding_job")
def c03(spark, d):
    t = _tokenized(spark, d)
    cfg = CFG | {"target_lang": "de", "pooling": "mean", "separator_ids": [7]}
    docs = J.resolve_indices(spark, {"reference_config": cfg}, X.tokenized(spark, d))
    alone, _, late = J.compute_embeddings(spark, cfg, t, docs)
    return S.profile(S.late_similarities(late.select("doc_id", "pos", "seg_id"), alone, late))


#: Of each part of the attention job, how many rows it has and the sum of its values.
C04_SQL = f"""with {MASS_SQL}, inc as (select doc_id, layer, kn, sum(w) / 4 w from att group by all),
 trm as (select doc_id, layer, kn - 2 k, w, n - 2 n from inc join ln using (doc_id) where kn > 1 and kn < n){ABS_SQL},
 en as (select layer, avg(w) filter (kn = 1) f, avg(w) filter (kn = n) l from inc join ln using (doc_id) group by layer),
 br as (select layer, bin, avg(mw) mw from (select doc_id, layer, {REL} bin, avg(w) mw from trm where n >= {R} group by all) group by layer, bin),
 ma as (select qb, kb, avg(m) m from (select doc_id, (qn - 1) // {S8} qb, (kn - 1) // {S8} kb, avg(w) m from att group by all) group by qb, kb),
 mr as (select qb, kb, avg(m) m from (select doc_id, ({R} * qn - 1) // n qb, ({R} * kn - 1) // n kb, avg(w) m from att join ln using (doc_id) where n >= {R} group by all) group by qb, kb)
 select 'baskets_absolute' part, count(*) n, round(sum(mean_w), 5) total from ba union all select 'baskets_relative', count(*), round(sum(mw), 5) from br
 union all select 'bin_mass', count(*), round(sum(mass), 5) from ms union all select 'ends', count(*), round(sum(f + l), 5) from en
 union all select 'map_absolute', count(*), round(sum(m), 5) from ma union all select 'map_relative', count(*), round(sum(m), 5) from mr"""


@query("c04_attention_job", C04_SQL)
def c04(spark, d):
    parts = J.analyze_attention(spark, {"basket_size": 8, "rel_bins": 10}, X.attention(spark, d))
    value = {"ends": F.col("first_token") + F.col("last_token"), "bin_mass": F.col("mass")}
    rows = [f.agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum(value.get(k, F.col("mean_w"))), 5).alias("total")) for k, f in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query("c10_title_job", "select p_name || ' ' || p_partkey src, 'T' || (p_partkey % 1500) tgt from part where p_partkey % 1500 in (select p_partkey % 1500 from part group by 1 having count(*) = 1)")
def c10(spark, d):
    p = X.table(spark, d, "part")
    line = F.concat(F.lit("Portal:"), "p_name", F.lit("  "), "p_partkey", F.lit(" (x) ||| T"), F.col("p_partkey") % 1500)
    return J.clean_titles(p.select(F.col("p_partkey").alias("line_no"), line.alias("line")))


#: Runs of the example and the dimensions of their embeddings.
RUN_DIMS = {"m1__en__concat-size_3": 64, "m1__de__concat-size_3": 32}


@query("c09_quantitative_results", f"""with {ITEMS_SQL}, rn(run, dim) as (values ('m1__en__concat-size_3', 64), ('m1__de__concat-size_3', 32)),
 sr as (select run, doc_id, pos, list_cosine_similarity(dv[1:dim], v[1:dim]) sim from segs join docv using (doc_id), rn),
 wd as (select run, doc_id, any_value(sim) filter (where pos = 0) s1, any_value(sim) filter (where pos = 1) s2, any_value(sim) filter (where pos = 2) s3 from sr group by run, doc_id),
 pr(run, pair, x, y) as (select run, '1_vs_2', s1, s2 from wd union all select run, '1_vs_last', s1, s3 from wd union all select run, '2_vs_last', s2, s3 from wd)
 select run, 'differences ' || pair what, count(*) n, round(avg(x) - avg(y), 5) x from pr group by run, pair union all select run, 'profile ' || pos, count(*), round(avg(sim), 5) from sr group by run, pos""")
def c09(spark, d):
    got = _results(spark, d, permutations=1, parts=["differences", "profile"])
    a = got["differences"].select("run", F.concat(F.lit("differences "), "pair").alias("what"), "n", F.round("abs_raw", 5).alias("x"))
    return a.unionByName(got["profile"].select("run", F.concat(F.lit("profile "), "pos").alias("what"), "n", F.round("mean_sim", 5).alias("x")))


def _results(spark, d, **how):
    """The results of the example's runs, which differ in the dimensions that are used."""
    dims = spark.createDataFrame(list(RUN_DIMS.items()), "run string, dim int")
    sims = S.position_similarities(X.segments(spark, d), X.standalone(spark, d), X.document(spark, d), sorted(set(RUN_DIMS.values())))
    sims = sims.withColumn("item", F.regexp_extract("doc_id", r"^(.*)_\d+$", 1)).join(F.broadcast(dims), "dim")  # a row per run
    leaks = S.leakage_pairs(X.late(spark, d), X.standalone(spark, d), sorted(set(RUN_DIMS.values()))).join(F.broadcast(dims), "dim")
    runs = spark.createDataFrame([(r,) for r in (*RUN_DIMS, "m2__en__concat-size_3", "notes")], "name string")
    return J.quantitative_results(runs, sims, "m1", ["de", "en"], leaks, **how)


ALL_RESULTS_SQL = f"""with {LATE_SQL}, rn(run, dim) as (values ('m1__en__concat-size_3', 64), ('m1__de__concat-size_3', 32)),
 sr as (select run, doc_id, item, pos, list_cosine_similarity(dv[1:dim], v[1:dim]) sim from segs join docv using (doc_id), rn),
 wd as (select run, doc_id, any_value(sim) filter (where pos = 0) s1, any_value(sim) filter (where pos = 1) s2, any_value(sim) filter (where pos = 2) s3 from sr group by run, doc_id),
 pr(run, pair, x, y) as (select run, '1_vs_2', s1, s2 from wd union all select run, '1_vs_last', s1, s3 from wd union all select run, '2_vs_last', s2, s3 from wd),
 we as (select run, pair, count(*) n, (avg(x) - avg(y)) / sqrt(var_samp(x) / count(*) + var_samp(y) / count(*)) t from pr group by all),
 rk as (select run, pair, x - y d, rank() over (partition by run, pair order by abs(x - y)) r, count(*) over (partition by run, pair, abs(x - y)) c from pr where x <> y),
 wi as (select run, pair, count(*) n, sum(case when d > 0 then r + (c - 1) / 2.0::double else 0 end) w from rk group by all),
 im as (select run, item, pos, avg(sim) m from sr group by all), gm as (select run, avg(m) gm from im group by run),
 sp as (select run, sum(n * (a - gm) ** 2) s, count(*) k from (select run, pos, count(*) n, avg(m) a from im group by all) join gm using (run) group by run),
 ss as (select run, sum(n * (a - gm) ** 2) s, count(*) mm from (select run, item, count(*) n, avg(m) a from im group by all) join gm using (run) group by run),
 st as (select run, sum((m - gm) ** 2) s from im join gm using (run) group by run),
 an as (select run, mm n, (sp.s / (k - 1)) / ((st.s - sp.s - ss.s) / ((k - 1) * (mm - 1))) f from sp join ss using (run) join st using (run)),
 pm as (select run, pos, avg(m) x from im group by all),
 gi as (select a.run, count(distinct a.pos) n, sum(abs(a.x - b.x)) / (2 * count(distinct a.pos) ** 2 * avg(a.x)) g from pm a join pm b using (run) group by a.run),
 mu as (select run, pos, avg(sim) m, count(*) np from sr group by all),
 ce as (select run, item, pos, sum(sim) - count(*) * any_value(m) e from sr join mu using (run, pos) group by all),
 cr as (select a.run, a.pos p, b.pos q, sum(a.e * b.e) mt from ce a join ce b on a.run = b.run and a.item = b.item group by all),
 kk as (select run, count(distinct item) g, count(*) n, count(distinct pos) k from sr group by run),
 cv as (select cr.run, p, q, mt / x.np / y.np * (g / (g - 1.0::double) * (n - 1) / (n - k)) c from cr join mu x on x.run = cr.run and x.pos = p join mu y on y.run = cr.run and y.pos = q join kk on kk.run = cr.run),
 ol as (select mu.run, mu.pos, g n, sqrt(v.c + z.c - 2 * w.c) se from mu join kk using (run) join cv v on v.run = mu.run and v.p = mu.pos and v.q = mu.pos join cv z on z.run = mu.run and z.p = 0 and z.q = 0
  join cv w on w.run = mu.run and w.p = mu.pos and w.q = 0 where mu.pos > 0),
 lk as (select run, a.pos src, b.pos dst, list_cosine_similarity(a.v[1:dim], b.lv[1:dim]) sim from latev a join latev b on a.doc_id = b.doc_id and a.pos <> b.pos, rn),
 lg as (select run, count(*) n, avg(sim) filter (src < dst) f, avg(sim) filter (src > dst) b from lk group by run),
 rr as (select run, 'welch ' || pair what, n, round(t, 3) x from we union all select run, 'wilcoxon ' || pair, n, w from wi union all select run, 'anova', n, round(f, 3) from an union all select run, 'gini', n, round(g, 6) from gi
  union all select run, 'regression ' || pos, n, round(se, 6) from ol union all select run, 'forward', n, round(f, 6) from lg union all select run, 'backward', n, round(b, 6) from lg)
 select run, what, n::bigint n, x from rr"""


@query("c09_all_results", ALL_RESULTS_SQL)
def c09_all(spark, d):
    got = _results(spark, d, permutations=1, parts=["welch", "wilcoxon", "anova", "gini", "regression", "leakage"])
    say = lambda part, what, n, x: got[part].select("run", what.alias("what"), F.col(n).cast("long").alias("n"), x.alias("x"))
    named = lambda word, c: F.concat(F.lit(word), c)
    total = F.col("n_forward") + F.col("n_backward")
    leaks = got["leakage"].withColumn("n", total)
    rows = [
        say("welch", named("welch ", F.col("pair")), "n", F.round("t", 3)), say("wilcoxon", named("wilcoxon ", F.col("pair")), "n", F.col("w_plus")), say("anova", F.lit("anova"), "n_items", F.round("f_value", 3)),
        say("gini", F.lit("gini"), "n_positions", F.round("gini", 6)), got["regression"].filter("pos > 0").select("run", named("regression ", F.col("pos").cast("string")).alias("what"), F.col("n_clusters").alias("n"), F.round("se", 6).alias("x")),
        *[leaks.select("run", F.lit(c).alias("what"), "n", F.round(c, 6).alias("x")) for c in ("forward", "backward")],
    ]
    return reduce(DataFrame.unionByName, rows)


@query("c09_result_tests")
def c09_tests(spark, d):
    """The p-values of each run, which SQL has no distributions for."""
    got = _results(spark, d, permutations=1000, parts=["welch", "wilcoxon", "anova", "regression", "gini", "leakage_test"])
    p = lambda part, *key: got[part].select("run", F.concat_ws(" ", F.lit(part), *[F.col(k).cast("string") for k in key]).alias("what"), "p_value")
    return reduce(DataFrame.unionByName, [p("welch", "pair"), p("wilcoxon", "pair"), p("anova"), p("regression", "pos"), p("gini"), p("leakage_test")])


#: The tables of the example's runs, three segments each, in the order of lines: of a grid all lines but those with the title's words.
GRID_SQL = ALL_RESULTS_SQL.rsplit("\n select run", 1)[0] + r""",
 be as (select mu.run, mu.pos, mu.m - case when mu.pos = 0 then 0 else base.m end beta from mu join mu base on base.run = mu.run and base.pos = 0),
 la(run, lang) as (values ('m1__en__concat-size_3', 'en'), ('m1__de__concat-size_3', 'de')),
 ce2 as (select 'coefficients' tab, pos place, case when pos = 0 then 'intercept' else 'position ' || (pos + 1) end nm, lang, printf('%.2f', beta) x from be join la using (run) union all
  select 'gini', 0, '', lang, printf('%.2f', g) from gi join la using (run)),
 ro as (select tab, place, nm, max(x) filter (lang = 'de') de, max(x) filter (lang = 'en') en from ce2 group by all)
 select tab, case when tab = 'gini' then '3 & ' else case when place = 0 then '\multirow{3}{*}{3} & ' else ' & ' end || nm || ' & ' end || de || ' & ' || en || ' \\' line from ro"""


@query("k10_result_tables", GRID_SQL)
def k10_tables(spark, d):
    """The rows of the tables of coefficients and Gini indices; their stars rest on distributions, which SQL hasn't, and are left out."""
    from ..operators import tables as B

    got = _results(spark, d, permutations=1, parts=["regression", "gini"])
    of = lambda f: f.select(F.split("run", "__")[1].alias("language"), F.lit(3).alias("n"), *[c for c in f.columns if c != "run"])
    made = {"coefficients": B.coefficient_table(of(got["regression"]).withColumn("p_value", F.lit(None).cast("double")), "m1", ["de", "en"]), "gini": B.gini_table(of(got["gini"].drop("n")).withColumn("p_value", F.lit(None).cast("double")), "m1", ["de", "en"])}
    rows = [f.filter(r"line rlike '^    (\\\\multirow|3| &)'").select(F.lit(k).alias("tab"), F.trim("line").alias("line")) for k, f in made.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("line", F.when(F.col("line").startswith("&"), F.concat(F.lit(" "), "line")).otherwise(F.col("line")))
