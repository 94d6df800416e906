"""Queries A21 to A33 and the calibrations, on the attention fixture (baskets of 8 tokens, 10 relative bins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attention as A
from ..registry import query
from . import fixtures as X
from .fixtures import ATTENTION_SQL

S, R = 8, 10


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# tokens count from 1 in the SQL; arithmetic on row numbers stays in the last step that uses it
INC_SQL = ATTENTION_SQL + ", inc as (select doc_id, layer, kn, sum(w) / 4 w from att group by all), ln as (select doc_id, max(kn) m from inc group by all)"
TRIM_SQL = INC_SQL + ", trm as (select doc_id, layer, kn - 2 k, w, m - 2 n from inc join ln using (doc_id) where kn > 1 and kn < m)"


@query("a21_incoming_attention", f"with {INC_SQL} select doc_id, layer, kn - 1 k, round(w, 6) w from inc")
def a21(spark, d):
    return r6(A.incoming(X.attention(spark, d)), "w")


@query("a21_first_row_attention", f"with {ATTENTION_SQL} select doc_id, layer, kn - 1 k, round(sum(w) / 4, 6) w from att where qn = 1 group by doc_id, layer, kn")
def a21b(spark, d):
    return r6(A.incoming(X.attention(spark, d), first_row_only=True), "w")


@query("a22_end_tokens", f"with {INC_SQL} select layer, round(avg(w) filter (kn = 1), 6) first_token, round(avg(w) filter (kn = m), 6) last_token from inc join ln using (doc_id) group by layer")
def a22(spark, d):
    return r6(A.ends(A.incoming(X.attention(spark, d))), "first_token", "last_token")


ABS_SQL = f", bd as (select doc_id, layer, k // {S} bin, avg(w) mw, sum(w) sw from trm group by all), ba as (select layer, bin, avg(mw) mean_w, avg(sw) sum_w, count(*) n_docs from bd group by all)"


def _trim(spark, d):
    return A.trimmed(A.incoming(X.attention(spark, d)))


@query("a23_absolute_baskets", f"with {TRIM_SQL}{ABS_SQL} select layer, bin, round(mean_w, 6) mean_w, round(sum_w, 6) sum_w, n_docs from ba")
def a23(spark, d):
    return r6(A.absolute_baskets(_trim(spark, d), S), "mean_w", "sum_w")


REL = f"(({R} * (k + 1) - 1) // n)"


@query("a24_relative_baskets", f"""with {TRIM_SQL}, bd as (select doc_id, layer, {REL} bin, avg(w) mw, sum(w) sw from trm where n >= {R} group by all)
 select layer, bin, round(avg(mw), 6) mean_w, round(avg(sw), 6) sum_w, count(*) n_docs from bd group by layer, bin""")
def a24(spark, d):
    return r6(A.relative_baskets(_trim(spark, d), R), "mean_w", "sum_w")


def _spans(spark, d):
    docs = X.attention(spark, d).groupBy("doc_id").agg(F.max("k").alias("last"))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 1) / 12).cast("int"))).alias("article")).select("doc_id", "article", (1 + F.col("article") * 12).alias("start"), (13 + F.col("article") * 12).alias("end"))


@query("a25_article_attention", f"""with {TRIM_SQL}, bd as (select doc_id, layer, k // 12 article, sum(w) sw, avg(w) mw from trm group by all)
 select layer, article, round(avg(sw), 6) sum_w, round(avg(mw), 6) mean_w, count(*) n_docs from bd group by layer, article""")
def a25(spark, d):
    return r6(A.by_article(_trim(spark, d), _spans(spark, d)), "sum_w", "mean_w")


@query("a26_absolute_map", f"""with {ATTENTION_SQL}, bd as (select doc_id, (qn - 1) // {S} qbin, (kn - 1) // {S} kbin, avg(w) m from att group by all)
 select qbin, kbin, round(avg(m), 6) mean_w, count(*) n_docs from bd group by all""")
def a26(spark, d):
    return r6(A.absolute_map(X.attention(spark, d), S), "mean_w")


@query("a27_relative_map", f"""with {ATTENTION_SQL}, ln as (select doc_id, max(kn) n from att group by all),
 bd as (select doc_id, ({R} * qn - 1) // n qbin, ({R} * kn - 1) // n kbin, avg(w) m from att join ln using (doc_id) where n >= {R} group by all)
 select qbin, kbin, round(avg(m), 6) mean_w, count(*) n_docs from bd group by all""")
def a27(spark, d):
    return r6(A.relative_map(X.attention(spark, d), R), "mean_w")


ROLE = "case when {c} = 1 then 'first' when {c} = n then 'last' else (({c} - 2) // %d)::int::varchar end" % S
MASS_SQL = ATTENTION_SQL + f""", ln as (select doc_id, max(kn) n from att group by all),
 rl as (select doc_id, layer, head, qn, {ROLE.format(c='qn')} qb, {ROLE.format(c='kn')} kb, w from att join ln using (doc_id)),
 rw as (select doc_id, layer, head, qn, qb, kb, sum(w) w from rl group by all), dm as (select doc_id, layer, qb, kb, avg(w) m from rw group by all),
 ms as (select layer, qb, kb, avg(m) mass, count(*) n_docs from dm group by all)"""


@query("a28_bin_mass", f"with {MASS_SQL} select layer, qb, kb, round(mass, 6) mass, n_docs from ms")
def a28(spark, d):
    return r6(A.bin_mass(X.attention(spark, d), S), "mass")


@query("a29_layer_average", f"with {TRIM_SQL}{ABS_SQL} select bin, round(avg(mean_w), 6) mean_w, count(*) n_layers from ba where n_docs > 0 group by bin")
def a29(spark, d):
    return r6(A.layer_average(A.absolute_baskets(_trim(spark, d), S)), "mean_w")


@query("a30_layer_groups", f"""with {TRIM_SQL}{ABS_SQL}, gr(layer_group, lo, hi) as (values ('lower', 1, 1), ('upper', 2, 2), ('all', 1, 2))
 select layer_group, bin, round(avg(mean_w), 6) mean_w from ba join gr on layer + 1 between lo and hi group by layer_group, bin""")
def a30(spark, d):
    return r6(A.layer_groups(A.absolute_baskets(_trim(spark, d), S), {"lower": (1, 1), "upper": (2, 2), "all": (1, 2)}), "mean_w")


@query("a31_weighted_mass", f"with {MASS_SQL} select qb, kb, round(sum(mass * n_docs) / sum(n_docs), 6) mass, sum(n_docs)::bigint n_docs from ms group by qb, kb")
def a31(spark, d):
    return r6(A.weighted_mass(A.bin_mass(X.attention(spark, d), S), ["qb", "kb"]), "mass")


@query("a32_percentile_range", f"with {INC_SQL} select round(quantile_cont(w, 0.01), 6) lo, round(quantile_cont(w, 0.95), 6) hi from inc")
def a32(spark, d):
    return r6(A.value_range(A.incoming(X.attention(spark, d)), "w", 0.01, 0.95), "lo", "hi")


@query("a33_curve_comparison", f"""with {TRIM_SQL}{ABS_SQL}, cv as (select 'layer' || layer as label, bin, mean_w from ba union all select 'layer' || layer, 90, null from ba)
 select label, bin, round(avg(mean_w), 6) mean_w from cv where bin < 90 group by label, bin""")
def a33(spark, d):
    b = A.absolute_baskets(_trim(spark, d), S).select(F.concat(F.lit("layer"), "layer").alias("label"), "bin", "mean_w")
    tail = b.select("label", F.lit(90).alias("bin"), F.lit(None).cast("double").alias("mean_w"))  # a bin without values is cut
    return r6(A.compare_curves(b.unionByName(tail)), "mean_w")


@query("w08_basket_totals", f"""with {ATTENTION_SQL} select layer, b basket, round(sum(w), 5) total from (select layer, case when kn = 1 then 0 else 1 + (kn - 2) // {S} end b, w from att) group by layer, b""")
def w08(spark, d):
    a = X.attention(spark, d)
    b = F.when(F.col("k") == 0, F.lit(0)).otherwise(1 + F.floor((F.col("k") - 1) / S)).cast("int")
    return a.groupBy("layer", b.alias("basket")).agg(F.round(F.sum("w"), 5).alias("total"))


CAL_SQL = ATTENTION_SQL + f""", c0 as (select *, case when kn = 1 then 0 else 1 + (kn - 2) // {S} end b from att where qn = 1),
 c1 as (select *, w / sum(w) over (partition by doc_id, layer, head, b) c from c0), c2 as (select *, c / sum(c) over (partition by doc_id, layer, head) cn from c1)"""


@query("c_calibrate_embedder", f"with {CAL_SQL} select doc_id, layer, head, kn - 1 k, round(0.7::double * cn + 0.3::double * w, 6) w_cal from c2")
def cal(spark, d):
    r = A.calibrate(X.attention(spark, d), S, 0.7)
    return r.select("doc_id", "layer", "head", "k", F.round("w_cal", 6).alias("w_cal"))


@query("c_calibrate_legacy", ATTENTION_SQL.join(["with ", f""", c0 as (select *, (kn - 1) // {S} b from att where qn = 1),
 c1 as (select *, w / sum(w) over (partition by doc_id, layer, head, b) c from c0)
 select doc_id, layer, head, kn - 1 k, round(c / sum(c) over (partition by doc_id, layer, head), 6) w_cal from c1"""]))
def cal_legacy(spark, d):
    r = A.calibrate(X.attention(spark, d), S, cls_apart=False)
    return r.select("doc_id", "layer", "head", "k", F.round("w_cal", 6).alias("w_cal"))


@query("c_calibrate_library", ATTENTION_SQL.join(["with ", f""", ln as (select doc_id, max(kn) n from att group by all),
 l0 as (select att.*, n, ceil((n - 2) / {S}.0::double) + 2 parts, (kn - 2) // {S} b from att join ln using (doc_id) where qn = 1),
 l1 as (select *, sum(case when kn = 1 then w else 0 end) over r bos, 1 / parts eos, case when kn in (1, n) then 0 else w / sum(w) over (partition by doc_id, layer, head, case when kn in (1, n) then -1 else b end) end c
   from l0 window r as (partition by doc_id, layer, head)),
 l2 as (select *, case when kn = 1 then bos when kn = n then eos else greatest(0, 1 - bos - eos) * c / sum(c) over (partition by doc_id, layer, head) end c2 from l1)
 select doc_id, layer, head, kn - 1 k, round(0.5::double * c2 / sum(c2) over (partition by doc_id, layer, head) + 0.5::double * w, 6) w_cal from l2"""]))
def cal_library(spark, d):
    r = A.calibrate_isolated(X.attention(spark, d), S)
    return r.select("doc_id", "layer", "head", "k", F.round("w_cal", 6).alias("w_cal"))


@query("a39_short_sequences", r"""select count(*) filter (len(string_split_regex(trim(text), '\s+')) < 128) n_short, count(*) n_total from documents""")
def a39(spark, d):
    return A.sequence_counts(X.tokenized(spark, d), 128, "token_length")


@query("f28_bin_labels", "select r_regionkey, r_regionkey || ' (' || r_regionkey * 128 || '-' || (r_regionkey + 1) * 128 - 1 || ')' as label from region")
def f28(spark, d):
    from ..functions.titles import bin_label

    return X.table(spark, d, "region").select("r_regionkey", bin_label(F.col("r_regionkey"), 128).alias("label"))
