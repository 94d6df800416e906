"""Queries of scalar functions F9 to F19, F27, and labels A35, A37, A38."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles as N
from ..operators import report as R
from ..registry import query
from . import fixtures as X


def T(spark, d, name):
    return X.table(spark, d, name)


@query("f09_normalized_titles")
def f09(spark, d):
    return T(spark, d, "part").select("p_partkey", N.normalize_title(F.concat(F.lit("ﬁ "), F.col("p_name"), F.lit("\t① "))).alias("title"))


@query("f09_squeezed_titles", r"select doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), ' +', ' ', 'g'), ' ') title from documents")
def f09b(spark, d):
    return T(spark, d, "documents").select("doc_id", N.squeeze(F.col("text")).alias("title"))


@query("f10_stripped_titles", "select p_partkey, p_name || ' b (c)' title from part")
def f10(spark, d):
    return T(spark, d, "part").select("p_partkey", N.strip_title(F.concat(F.lit("Author:"), F.col("p_name"), F.lit(" (x)  b (c)"))).alias("title"))


@query("f11_unescaped", "select n_nationkey, replace(n_name, '_', ' ') || ' ''a\" - b' title from nation")
def f11(spark, d):
    return T(spark, d, "nation").select("n_nationkey", N.unescape_sql(F.concat(F.col("n_name"), F.lit("_\\'a\\\"_–_b"))).alias("title"))


@query("f12_f13_urls", "select n_nationkey, 'https://de.wikipedia.org/wiki/' || n_name || '_é' url, replace(n_name, '_', ' ') || ' é' title from nation")
def f12(spark, d):
    url = N.title_to_url(F.lit("de"), F.concat(F.col("n_name"), F.lit(" é")))
    coded = F.replace(url, F.lit("é"), F.lit("%C3%A9"))
    return T(spark, d, "nation").select("n_nationkey", url.alias("url"), N.url_to_title(coded).alias("title"))


@query("f14_language_of_file", "select doc_id, case when doc_id % 3 < 2 then lang end lang from documents")
def f14(spark, d):
    """Files named after documents: two forms that tell a language, and one that doesn't."""
    n, lang = F.col("doc_id"), F.col("lang")
    name = F.when(n % 3 == 0, F.concat(F.lit("titles-en-"), lang, F.lit(".txt"))).when(n % 3 == 1, F.concat(F.lit("titles."), lang, F.lit("-en.txt"))).otherwise(F.concat(F.lit("notes"), n, F.lit(".txt")))
    return T(spark, d, "documents").select("doc_id", N.language_of_file(name).alias("lang"))


@query("f15_latex_escape", r"""with t as (select p_partkey, p_name || ' 50% & {' || p_brand || '}^_' s from part), c as (select p_partkey, case when p_partkey % 3 = 0 and length(s) > 12 then left(s, 12) || '...' else s end s from t)
 select p_partkey, replace(replace(replace(replace(replace(replace(replace(s, '&', '\&'), '%', '\%'), '#', '\#'), '_', '\_'), '{', '\{'), '}', '\}'), '^', '\textasciicircum{}') s from c""")
def f15(spark, d):
    s = F.concat("p_name", F.lit("  50% &\n {"), "p_brand", F.lit("}^_ "))
    out = F.when(F.col("p_partkey") % 3 == 0, N.latex_escape(s, 12)).otherwise(N.latex_escape(s))
    return T(spark, d, "part").select("p_partkey", out.alias("s"))


@query("f17_strength_tags", r"select p_partkey, regexp_replace(regexp_replace(printf('%.3f', p_size / 8.0::double), '0+$', ''), '\.$', '') tag from part")
def f17(spark, d):
    return T(spark, d, "part").select("p_partkey", N.strength_tag(F.col("p_size") / 8).alias("tag"))


@query("f18_run_tags", r"select p_partkey, case p_partkey % 3 when 0 then 'LH' when 1 then 'L' else 'A' end || case p_partkey % 2 when 0 then '_CLS_' else '_ALL_' end || p_size || '_' || regexp_replace(regexp_replace(printf('%.3f', p_size / 64.0::double), '0+$', ''), '\.$', '') tag from part where p_size % 8 = 0")
def f18(spark, d):
    k = F.col("p_partkey")
    layers = F.when(k % 3 == 0, "last_half").when(k % 3 == 1, "last").otherwise("all")
    tokens = F.when(k % 2 == 0, "cls").otherwise("all")
    return T(spark, d, "part").filter("p_size % 8 = 0").select("p_partkey", N.run_tag(layers, tokens, F.col("p_size"), F.col("p_size") / 64).alias("tag"))


@query("f19_model_names", "select p_partkey, case when contains(lower(p_name), 'widget') then 'W' when contains(lower(p_name), 'red ') then 'RD' else p_name end short from part")
def f19(spark, d):
    return T(spark, d, "part").select("p_partkey", N.model_short(F.concat(F.lit("org/"), "p_name"), {"Widget": "W", "red ": "RD"}).alias("short"))


@query("f27_merged_settings", "select n_nationkey, 'a' k, n_name v from nation union all select n_nationkey, 'b', n_regionkey::varchar from nation union all select n_nationkey, 'c', (2 * n_nationkey)::varchar from nation")
def f27(spark, d):
    own = F.create_map(F.lit("a"), "n_name", F.lit("b"), F.col("n_regionkey").cast("string"))
    more = F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), (2 * F.col("n_nationkey")).cast("string"))
    v = T(spark, d, "nation").select("n_nationkey", own.alias("own"), more.alias("more"))
    # what is set already is kept
    kept = F.map_concat("own", F.map_filter("more", lambda k, _: ~F.map_contains_key("own", k)))
    return v.select("n_nationkey", F.explode(kept).alias("k", "v"))


@query("a35_range_ids", """with r as (select l_orderkey, l_linenumber, l_quantity::int // 10 lo from lineitem), f as (select lo, min(l_orderkey * 10 + l_linenumber) seen from r group by lo)
 select lo, 'SL' || row_number() over (order by seen, lo) range_id from f""")
def a35(spark, d):
    li = T(spark, d, "lineitem")
    return R.range_ids(li.select(F.floor(F.col("l_quantity").cast("int") / 10).cast("int").alias("lo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")), "lo", "at")


@query("a37_result_groups", "select p_brand, count(distinct p_size) n_sizes, max(p_size) most from part group by p_brand")
def a37(spark, d):
    return R.result_groups(T(spark, d, "part"), ["p_brand"], "p_size").withColumnsRenamed({"n_values": "n_sizes"})


@query("a38_calibration_labels", "select p_partkey, p_size || '—' || case p_partkey % 2 when 0 then '<s>' else 'all' end || '—' || case p_partkey % 3 when 0 then 'last_half' else 'last' end lab from part")
def a38(spark, d):
    k = F.col("p_partkey")
    lab = N.calibration_label(F.col("p_size"), F.when(k % 2 == 0, "cls").otherwise("all"), F.when(k % 3 == 0, "last_half").otherwise("last"))
    return T(spark, d, "part").select("p_partkey", lab.alias("lab"))