"""Queries A42 to A52, J13 to J15, K10, C5 to C8: older analyses, reports, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import legacy as L
from ..operators import report as R
from ..operators import similarity as S
from ..registry import query
from . import fixtures as X
from .fixtures import ITEMS_SQL, LATE_SQL, TOKENS_SQL


@query("a42_mean_vectors", "with x as (select label, unnest(embedding)::double x, unnest(range(64)) i from embeddings) select label, i, round(avg(x), 6) x from x group by label, i")
def a42(spark, d):
    m = L.elementwise(X.standalone(spark, d), ["label"], "mean")
    return m.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("a43_std_vectors", "with x as (select label, unnest(embedding)::double x, unnest(range(64)) i from embeddings) select label, i, round(coalesce(stddev_samp(x), 0), 6) x from x group by label, i")
def a43(spark, d):
    m = L.elementwise(X.standalone(spark, d), ["label"], "std")
    return m.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("a44_j14_within_group", "select a.label, a.vec_id a, b.vec_id b, round(case when a.vec_id = b.vec_id then 1 else list_cosine_similarity(a.embedding::double[], b.embedding::double[]) end, 6) sim from embeddings a join embeddings b using (label)")
def a44(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("seg_id"), "embedding", "label")  # floats are made doubles where they are used
    return L.within_group_similarity(e, "label", "seg_id").withColumn("sim", F.round("sim", 6))


@query("a45_grouped_sequences", f"with {ITEMS_SQL} select doc_id, string_agg(seg_id::varchar, ',' order by pos) segs from segs group by doc_id")
def a45(spark, d):
    g = X.segments(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "seg_id"))).alias("s"))
    return g.select("doc_id", F.array_join(F.transform("s", lambda x: x["seg_id"].cast("string")), ",").alias("segs"))


SWITCH_SQL = ITEMS_SQL + """, ds as (select doc_id, item, any_value(seg_id) filter (where pos = 0) s1, any_value(seg_id) filter (where pos = 1) s2, any_value(seg_id) filter (where pos = 2) s3,
 any_value(v) filter (where pos = 0) v1, any_value(v) filter (where pos = 2) v3 from segs group by all),
 sw as (select a.doc_id, list_cosine_similarity(x.dv, a.v1) o1, list_cosine_similarity(x.dv, a.v3) o3, list_cosine_similarity(y.dv, a.v3) w1, list_cosine_similarity(y.dv, a.v1) w3
  from ds a join ds b on a.item = b.item and a.s1 = b.s3 and a.s3 = b.s1 and a.s1 < a.s3 join docv x on x.doc_id = a.doc_id join docv y on y.doc_id = b.doc_id)"""


def _switch(spark, d):
    segs = X.segments(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seg_id"))), lambda x: x["seg_id"]).alias("segs"))
    return L.switch_experiment(segs, X.document(spark, d), X.standalone(spark, d))


@query("a46_j15_switch_experiment", f"with {SWITCH_SQL} select doc_id, round(o1, 6) orig_first, round(o3, 6) orig_last, round(w1, 6) switch_first, round(w3, 6) switch_last, round(o1 - o3, 6) diff_orig, round(w1 - w3, 6) diff_switch from sw")
def a46(spark, d):
    s = _switch(spark, d)
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in s.columns if c != "doc_id"])


@query("a47_switch_summary", f"""with {SWITCH_SQL}, lg(cohort, x) as (select 'orig', o1 - o3 from sw union all select 'switch', w1 - w3 from sw), bt as (select * from lg union all select 'both', x from lg)
 select cohort, count(*) n, round(avg(x), 6) mean, round(stddev_samp(x), 6) std, round(min(x), 6) lo, round(quantile_cont(x, 0.25), 6) p25, round(median(x), 6) median, round(quantile_cont(x, 0.75), 6) p75, round(max(x), 6) hi,
  round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 3) t from bt group by cohort""")
def a47(spark, d):
    s = L.switch_summary(_switch(spark, d))
    return s.select("cohort", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "p25", "median", "p75", "hi")], F.round("t", 3).alias("t"))


@query("a47_switch_test")
def a47p(spark, d):
    return L.switch_summary(_switch(spark, d))


@query("a48_position_influence", f"with {LATE_SQL} select pos, round(avg(list_cosine_similarity(dv, lv)), 6) influence from latev join docv using (doc_id) group by pos")
def a48(spark, d):
    from ..functions.vectors import cosine

    j = X.late(spark, d).join(X.document(spark, d).withColumnRenamed("embedding", "dv"), "doc_id")
    return j.groupBy("pos").agg(F.round(F.avg(cosine(F.col("dv"), F.col("embedding"))), 6).alias("influence"))


@query("a49_cross_influence", f"""with {LATE_SQL} select a.pos src, b.pos dst, round(sum(list_cosine_similarity(a.v, b.lv)) / (select count(distinct doc_id) from segs), 6) influence from latev a join latev b using (doc_id) group by a.pos, b.pos""")
def a49(spark, d):
    return L.cross_influence(X.late(spark, d), X.standalone(spark, d)).withColumn("influence", F.round("influence", 6))


@query("a50_order_effect", f"""with {LATE_SQL}, x as (select doc_id, pos, unnest(v) a, unnest(lv) b from latev), g as (select doc_id, pos, corr(a, b) c, sqrt(sum((a - b) ** 2)) e from x group by all)
 select pos, round(avg(c), 5) correlation, round(avg(e), 5) distance from g group by pos""")
def a50(spark, d):
    return L.order_effect(X.late(spark, d), X.standalone(spark, d)).select("pos", F.round("correlation", 5).alias("correlation"), F.round("distance", 5).alias("distance"))


@query("a50_cross_correlation", f"""with {LATE_SQL}, du as (select doc_id, pos, unnest(lv) x, generate_subscripts(lv, 1) i from latev),
 cc as (select a.doc_id, a.pos src, b.pos dst, corr(a.x, b.x) c from du a join du b on a.doc_id = b.doc_id and a.i = b.i and a.pos <> b.pos group by all) select src, dst, round(avg(c), 6) correlation from cc group by src, dst""")
def a50b(spark, d):
    return L.cross_correlation(X.late(spark, d)).withColumn("correlation", F.round("correlation", 6))


@query("a51_self_and_others", f"""with {LATE_SQL}, p as (select a.doc_id, a.pos src, b.pos dst, list_cosine_similarity(a.v, b.lv) sim from latev a join latev b using (doc_id)),
 g as (select doc_id, src, avg(sim) filter (src = dst) own, avg(sim) filter (src <> dst) others from p group by all) select src pos, round(avg(own), 6) own, round(avg(others), 6) others from g group by src""")
def a51(spark, d):
    from ..functions.vectors import cosine

    late, s = X.late(spark, d), X.standalone(spark, d)
    same = late.join(s.select("seg_id", F.col("embedding").alias("v")), "seg_id").select("doc_id", F.col("pos").alias("src"), F.col("pos").alias("dst"), cosine(F.col("v"), F.col("embedding")).alias("sim"))
    r = L.self_and_others(S.leakage_pairs(late, s).unionByName(same))
    return r.select("pos", F.round("own", 6).alias("own"), F.round("others", 6).alias("others"))


@query("a52_principal_components")
def a52(spark, d):
    return L.principal_components(X.standalone(spark, d)).select("seg_id", "pca")


@query("j13_similarity_matrix", "select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) sim from embeddings a, embeddings b where a.vec_id % 100 = 0")
def j13(spark, d):
    e = X.standalone(spark, d)
    m = L.similarity_matrix(e.filter("seg_id % 100 = 0"), e.withColumnRenamed("seg_id", "key"))  # the stated queries against all
    return m.withColumn("sim", F.round("sim", 6))


@query("a20_model_collection", f"""with {ITEMS_SQL}, sims as (select pos, list_cosine_similarity(dv, v) sim from segs join docv using (doc_id)), r(model_name, lang_key, place, add) as (values ('m1', 'en', 1, 0), ('m1', 'en', 2, 1), ('m2', 'en_de', 3, 2)),
 k as (select model_name, lang_key, arg_max(add, place) add from r group by all) select 3 concat_size, lang_key, model_name, pos, round(avg(sim) + add, 5) mean_sim from k, sims group by lang_key, model_name, pos, add""")
def a20(spark, d):
    from ..operators.corpus import last_wins

    sims = S.position_similarities(X.segments(spark, d), X.standalone(spark, d), X.document(spark, d))
    runs = spark.createDataFrame([("m1", "en", 1, 0.0), ("m1", "en", 2, 1.0), ("m2", "en_de", 3, 2.0)], "model_name string, lang_key string, place int, add double")
    kept = F.broadcast(last_wins(runs, ["model_name", "lang_key"], "place"))  # a row per run: of equal keys the later path stays
    g = sims.groupBy("pos").agg(F.avg("sim").alias("m")).join(kept)
    return g.select(F.lit(3).alias("concat_size"), "lang_key", "model_name", "pos", F.round(F.col("m") + F.col("add"), 5).alias("mean_sim"))


@query("c05_configurations", "with l as (select distinct lang from documents) select lang source, null::varchar target from l union all select a.lang, b.lang from l a, l b where a.lang <> b.lang")
def c05(spark, d):
    return R.configurations(X.table(spark, d, "documents").select("lang").distinct())


@query("c08_sweep", "select n_nationkey as \"case\", s.p_size basket_size from nation, (select distinct p_size from part) s")
def c08(spark, d):
    return R.sweep(X.table(spark, d, "nation").select(F.col("n_nationkey").alias("case")), X.table(spark, d, "part").select(F.col("p_size").alias("basket_size")).distinct())


@query("k10_latex_table", rf"""with {TOKENS_SQL}, g as (select lang, count(*) n, avg(token_length) m, stddev_samp(token_length) s from tok group by lang),
 b as (select string_agg(lang || ' & ' || n || ' & ' || printf('%.3f', m) || ' & ' || printf('%.3f', s) || ' \\', chr(10) order by lang) t from g),
 w as (select '\begin{{table}}' || chr(10) || '\centering' || chr(10) || '\begin{{tabular}}{{lrrr}}' || chr(10) || '\hline' || chr(10) || 'language & n & mean\_len & std\_len \\' || chr(10) || '\hline' || chr(10) || t || chr(10) || '\hline' || chr(10) || '\end{{tabular}}' || chr(10) || '\caption{{Lengths}}' || chr(10) || '\end{{table}}' t from b),
 l as (select string_split(t, chr(10)) l from w) select generate_subscripts(l, 1)::int - 1 line_no, unnest(l) line from l""")
def k10(spark, d):
    from .corpus import meta
    from ..operators.corpus import length_summary

    text = R.latex_table(length_summary(meta(spark, d)).orderBy("language"), ["language", "n", "mean_len", "std_len"], "Lengths")
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line_no int, line string")


@query("c06_batch_runner", "select 'good' job, true ok union all select 'bad', false")
def c06(spark, d):
    run = R.run_all({"good": lambda: X.table(spark, d, "region").count(), "bad": lambda: X.table(spark, d, "no_such_table")})
    return spark.createDataFrame([(n, True) for n in run.done] + [(n, False) for n in run.failed], "job string, ok boolean")
