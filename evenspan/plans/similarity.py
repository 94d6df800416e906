"""Queries A1 to A12, A34, A36, A42 to A55: similarity and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as S
from ..registry import query
from . import fixtures as X
from .fixtures import ITEMS_SQL, LATE_SQL

#: t quantile .975 as a series in 1/df around the normal quantile, for the SQL side.
Z = 1.959963984540054


def t_sql(df: str) -> str:
    z = Z
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3, g4 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return f"({z!r}::double + {g1!r}::double / ({df}) + {g2!r}::double / ({df}) ** 2 + {g3!r}::double / ({df}) ** 3 + {g4!r}::double / ({df}) ** 4)"


SIMS_SQL = ITEMS_SQL + ", sims as (select doc_id, item, seg_id, pos, list_cosine_similarity(dv, v) sim from segs join docv using (doc_id))"


def _profile_sql(by: str, src: str) -> str:
    return f"""g as (select {by}, count(*) n, avg(sim) m, stddev_pop(sim) s from {src} group by {by})
select {by}, n, round(m, 6) mean_sim, round(s, 6) std_pop, round(m - {t_sql('n - 1')} * s / sqrt(n), 6) ci_low, round(m + {t_sql('n - 1')} * s / sqrt(n), 6) ci_high from g"""


def _rounded(df, *names: str):
    return df.withColumns({n: F.round(n, 6) for n in names})


PROFILE = ("mean_sim", "std_pop", "ci_low", "ci_high")


@query("a01_position_profile", f"with {SIMS_SQL}, {_profile_sql('pos', 'sims')}")
def a01(spark, d):
    return _rounded(S.profile(S.position_similarities(X.segments(spark, d), X.standalone(spark, d), X.document(spark, d))), *PROFILE)


LSIMS_SQL = LATE_SQL + ", lsims as (select pos, list_cosine_similarity(lv, v) sim from latev)"


@query("a02_late_profile", f"with {LSIMS_SQL}, {_profile_sql('pos', 'lsims')}")
def a02(spark, d):
    return _rounded(S.profile(S.late_similarities(X.segments(spark, d), X.standalone(spark, d), X.late(spark, d))), *PROFILE)


DIMS = (16, 32, 64)
DIM_SQL = ITEMS_SQL + ", dsims as (select dim, pos, list_cosine_similarity(dv[1:dim], v[1:dim]) sim from segs join docv using (doc_id), (select unnest([16, 32, 64]) dim))"


@query("a03_matryoshka_profile", f"with {DIM_SQL}, {_profile_sql('dim, pos', 'dsims')}")
def a03(spark, d):
    sims = S.position_similarities(X.segments(spark, d), X.standalone(spark, d), X.document(spark, d), list(DIMS))
    return _rounded(S.profile(sims, ["dim", "pos"]), *PROFILE)


# positions are compared as row numbers: filters on them are safe in the other engine
PAIRS_SQL = LATE_SQL + ", prs as (select a.doc_id, a.item, a.pos src, b.pos dst, list_cosine_similarity(a.v, b.lv) sim from latev a join latev b on a.doc_id = b.doc_id and a.pos <> b.pos)"


def _pairs(spark, d, dims=None):
    return S.leakage_pairs(X.late(spark, d), X.standalone(spark, d), dims)


@query("a08_directional_leakage", f"""with {PAIRS_SQL} select count(*) filter (src < dst) n_forward, round(coalesce(avg(sim) filter (src < dst), 0), 6) forward,
 count(*) filter (src > dst) n_backward, round(coalesce(avg(sim) filter (src > dst), 0), 6) backward from prs""")
def a08(spark, d):
    return _rounded(S.directional_leakage(_pairs(spark, d)), "forward", "backward")


T_SQL = """g as (select count(*) filter (src < dst) nf, avg(sim) filter (src < dst) mf, var_samp(sim) filter (src < dst) vf,
  count(*) filter (src > dst) nb, avg(sim) filter (src > dst) mb, var_samp(sim) filter (src > dst) vb from prs),
t as (select mf, mb, nf + nb - 2 df, (mf - mb) / sqrt(((nf - 1) * vf + (nb - 1) * vb) / (nf + nb - 2) * (1.0::double / nf + 1.0::double / nb)) t from g)
select round(mf, 6) forward, round(mb, 6) backward, round(t, 4) t, df from t"""


@query("a09_leakage_statistic", f"with {PAIRS_SQL}, {T_SQL}")
def a09(spark, d):
    return S.leakage_test(_pairs(spark, d)).select(F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"), F.round("t", 4).alias("t"), "df")


@query("a09_leakage_test")
def a09p(spark, d):
    return S.leakage_test(_pairs(spark, d))


POSL = "select src pos, round(coalesce(avg(sim) filter (src < dst), 0), 6) forward, round(coalesce(avg(sim) filter (src > dst), 0), 6) backward from prs group by src"


@query("a10_positional_leakage", f"with {PAIRS_SQL} {POSL}")
def a10(spark, d):
    return _rounded(S.positional_leakage(_pairs(spark, d)), "forward", "backward")


@query("a11_matryoshka_leakage", f"""with {LATE_SQL}, prs as (select dim, a.pos src, b.pos dst, list_cosine_similarity(a.v[1:dim], b.lv[1:dim]) sim
 from latev a join latev b on a.doc_id = b.doc_id and a.pos <> b.pos, (select unnest([16, 32, 64]) dim))
 select dim, src pos, round(coalesce(avg(sim) filter (src < dst), 0), 6) forward, round(coalesce(avg(sim) filter (src > dst), 0), 6) backward from prs group by dim, src""")
def a11(spark, d):
    return _rounded(S.positional_leakage(_pairs(spark, d, list(DIMS)), ["dim"]), "forward", "backward")


@query("a12_leakage_map", f"with {PAIRS_SQL} select src, dst, round(avg(sim), 6) mean_sim, count(*) n from prs group by src, dst")
def a12(spark, d):
    return _rounded(S.leakage_map(_pairs(spark, d)), "mean_sim")


@query("j11_range_self_join", f"with {PAIRS_SQL} select src, dst, count(*) n from prs where src < dst group by src, dst")
def j11(spark, d):
    return S.leakage_map(_pairs(spark, d)).filter("src < dst").select("src", "dst", "n")


@query("w06_later_and_earlier", f"with {PAIRS_SQL} select src pos, count(distinct dst) filter (dst > src) later, count(distinct dst) filter (dst < src) earlier from prs group by src")
def w06(spark, d):
    return S.later_and_earlier(_pairs(spark, d))


@query("p13_documents_with_pairs", f"with {PAIRS_SQL} select count(distinct doc_id) n_docs from prs")
def p13(spark, d):
    return _pairs(spark, d).agg(F.countDistinct("doc_id").alias("n_docs"))


@query("a54_leakage_line", f"with {PAIRS_SQL}, pl as ({POSL}) select round(avg(forward) filter (pos < 2), 5) forward, round(avg(backward) filter (pos > 0), 5) backward from pl")
def a54(spark, d):
    return S.leakage_line(S.positional_leakage(_pairs(spark, d))).select(F.round("forward", 5).alias("forward"), F.round("backward", 5).alias("backward"))


@query("a55_directional_limits", f"with {PAIRS_SQL} select round(greatest(min(sim) - 0.01, -1), 6) lo, round(least(max(sim) + 0.01, 1), 6) hi from prs")
def a55(spark, d):
    return _rounded(S.similarity_limits(_pairs(spark, d), "sim"), "lo", "hi")


@query("a34_axis_limits", f"""with {SIMS_SQL}, g as (select pos, count(*) n, avg(sim) m, stddev_pop(sim) s from sims group by pos),
 c as (select min(m - {t_sql('n - 1')} * s / sqrt(n)) lo, max(m + {t_sql('n - 1')} * s / sqrt(n)) hi from g)
 select round(lo - 0.05 * (hi - lo), 6) lo, round(hi + 0.05 * (hi - lo), 6) hi from c""")
def a34(spark, d):
    p = S.profile(S.position_similarities(X.segments(spark, d), X.standalone(spark, d), X.document(spark, d)))
    return _rounded(S.axis_limits(p), "lo", "hi")


@query("a36_influence_histogram", f"""with {PAIRS_SQL}, r as (select case when src < dst then 'forward' else 'backward' end direction, round(sim, 6) s from prs),
 ends as (select direction, min(s) lo, max(s) hi from r group by direction)
 select direction, (case when hi > lo then least(floor((s - lo) / (hi - lo) * 30), 29) else 0 end)::int bin, count(*) n from r join ends using (direction) group by all""")
def a36(spark, d):
    p = _pairs(spark, d).withColumn("sim", F.round("sim", 6)).withColumn("direction", F.when(F.col("src") < F.col("dst"), "forward").otherwise("backward"))
    return S.histogram(p, "sim", 30, ["direction"])


@query("j05_complete_documents", f"with {ITEMS_SQL} select pos, count(*) n, count(distinct doc_id) n_docs from segs where seg_id % 7 <> 0 and doc_id not in (select doc_id from segs where seg_id % 7 = 0) group by pos")
def j05(spark, d):
    some = X.standalone(spark, d).filter("seg_id % 7 <> 0")  # the others have no embedding
    return S.complete_segments(X.segments(spark, d), some).groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("j05_repeated_segment", f"""with {ITEMS_SQL}, twice as (select doc_id, case when pos = 1 then 0 else pos end pick, pos, seg_id from segs),
 s2 as (select t.doc_id, t.pos, s.seg_id from twice t join segs s on s.doc_id = t.doc_id and s.pos = t.pick)
 select p pos, count(*) n from (select max(pos) over (partition by doc_id, seg_id) p from s2) group by p""")
def j05b(spark, d):
    s = X.segments(spark, d)
    first = s.filter("pos = 0").select("doc_id", F.col("seg_id").alias("f"))
    # the second segment is the first once more
    twice = s.join(first, "doc_id").select("doc_id", "pos", F.when(F.col("pos") == 1, F.col("f")).otherwise(F.col("seg_id")).alias("seg_id"))
    return S.complete_segments(twice, X.standalone(spark, d)).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


@query("p16_truncation", "select vec_id, len(embedding[1:16]) n, round(list_sum(embedding[1:16]::double[]), 6) total from embeddings")
def p16(spark, d):
    from ..functions.vectors import truncate

    v = truncate(F.col("embedding"), 16)
    return X.standalone(spark, d).select(F.col("seg_id").alias("vec_id"), F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("f20_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def f20(spark, d):
    from ..functions.vectors import cosine

    a = X.standalone(spark, d)
    b = a.select((F.col("seg_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.select(F.col("seg_id").alias("vec_id"), F.col("embedding").alias("a")).join(b, "vec_id").select("vec_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("sim"))


@query("f21_l2_normalize", "select vec_id, round(sqrt(list_dot_product(v, v)), 6) before, 1.0::double after from (select vec_id, list_transform(embedding::double[], lambda x: 3 * x) v from embeddings)")
def f21(spark, d):
    from ..functions.vectors import l2_normalize, norm, scale

    v = scale(F.col("embedding"), 3)
    return X.standalone(spark, d).select(F.col("seg_id").alias("vec_id"), F.round(norm(v), 6).alias("before"), F.round(norm(l2_normalize(v)), 6).alias("after"))


@query("f25_distance_correlation", """with p as (select a.vec_id, a.embedding::double[] u, b.embedding::double[] v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
 x as (select vec_id, unnest(u) a, unnest(v) b from p)
 select vec_id, round(sqrt(sum((a - b) ** 2)), 6) distance, round(corr(a, b), 6) pearson from x group by vec_id""")
def f25(spark, d):
    from ..functions.vectors import euclidean, pearson

    a = X.standalone(spark, d)
    b = a.select((F.col("seg_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    j = a.select(F.col("seg_id").alias("vec_id"), F.col("embedding").alias("a")).join(b, "vec_id")
    return j.select("vec_id", F.round(euclidean(F.col("a"), F.col("b")), 6).alias("distance"), F.round(pearson(F.col("a"), F.col("b")), 6).alias("pearson"))
