"""Queries of corpus construction: J1 to J10, J12, J16 to J18, P1 to P12, A4 to A7, A40, A41, O1 to O7, W2 to W4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import design as D
from ..operators.ranks import dense_number
from ..registry import query
from . import fixtures as X
from .fixtures import TOKENS_SQL

MIN_LEN, MAX_LEN = 100, 500


def T(spark, d, name):
    return X.table(spark, d, name)


# ---- metadata and lengths ----

META_SQL = r"""m as (select doc_id::varchar doc_id, rn dataset_rn, token_length, lang as language from tok)"""


def meta(spark, d):
    t = X.tokenized(spark, d).withColumn("length", F.col("token_length") + 2).withColumnRenamed("doc_id", "id")
    return C.metadata(t, language=F.col("lang"))


@query("p01_rename", "select doc_id::varchar id, length(text) n from documents")
def p01(spark, d):
    return T(spark, d, "documents").withColumnRenamed("doc_id", "id").select(F.col("id").cast("string").alias("id"), F.length("text").cast("long").alias("n"))


@query("p02_metadata", f"with {TOKENS_SQL}, {META_SQL} select doc_id, dataset_rn - 1 dataset_idx, token_length, language, '_NA' topic, '_NA' pair_id from m")
def p02(spark, d):
    return meta(spark, d)


@query("p03_length_range", f"with {TOKENS_SQL} select doc_id, token_length from tok where token_length between {MIN_LEN} and {MAX_LEN}")
def p03(spark, d):
    return D.length_range(X.tokenized(spark, d), MIN_LEN, MAX_LEN).select("doc_id", "token_length")


@query("p04_position_pools", f"""with {TOKENS_SQL}, r(pos, lo, hi) as (values (0, 50, 200), (1, 150, 400), (2, 300, 900))
 select pos, count(*) n, sum(token_length)::bigint total from tok join r on token_length between lo and hi group by pos""")
def p04(spark, d):
    p = D.position_pools(X.tokenized(spark, d), [(50, 200), (150, 400), (300, 900)])
    return p.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum("token_length").alias("total"))


@query("p05_language_pools", "select lang, count(*) n from documents where lang in ('en', 'de') group by lang")
def p05(spark, d):
    return T(spark, d, "documents").filter(F.col("lang").isin("en", "de")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


LANGS = ["de", "en", "es", "fr"]
WIDE_SQL = TOKENS_SQL + ", wd as (select rn, any_value(token_length) filter (where lang = 'de') de, any_value(token_length) filter (where lang = 'en') en, any_value(token_length) filter (where lang = 'es') es, any_value(token_length) filter (where lang = 'fr') fr from tok group by rn)"


@query("p06_wide_filter", f"""with {WIDE_SQL} select rn - 1 dataset_idx, de, en, es, fr from wd
 where en >= 50 and en <= 900 and de >= 20 and de between en * 0.2::double and en * 1.8::double and fr between en * 0.2::double and en * 1.8::double and es between en * 0.2::double and en * 1.8::double""")
def p06(spark, d):
    w = C.wide(X.tokenized(spark, d), LANGS, lang="lang")
    return C.wide_filter(w, {"en": (50, 900), "de": (20, None)}, "en", 0.8, LANGS).select("dataset_idx", *LANGS)


@query("j12_semi_join_on_wide", f"with {WIDE_SQL}, ok as (select rn from wd where en between 50 and 900) select t.lang, count(*) n from tok t join ok using (rn) group by t.lang")
def j12(spark, d):
    t = X.tokenized(spark, d)
    ok = C.wide_filter(C.wide(t, LANGS, lang="lang"), {"en": (50, 900)}).select("dataset_idx")
    return t.join(ok, "dataset_idx", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("a04_length_summary", f"""with {TOKENS_SQL} select lang as language, count(*) n, round(avg(token_length), 6) mean_len, median(token_length)::double median_len,
 round(stddev_samp(token_length), 6) std_len, min(token_length)::double min_len, max(token_length)::double max_len from tok group by lang""")
def a04(spark, d):
    return C.length_summary(meta(spark, d)).withColumns({"mean_len": F.round("mean_len", 6), "std_len": F.round("std_len", 6)})


@query("a05_length_deviation", f"""with {TOKENS_SQL}, a as (select rn, token_length, avg(token_length) over (partition by rn) m from tok)
 select rn - 1 dataset_idx, round(avg(abs(token_length - m)), 6) mad, count(*) n_langs from a group by rn""")
def a05(spark, d):
    return C.length_deviation(X.tokenized(spark, d)).withColumn("mad", F.round("mad", 6))


@query("a06_wide_pivot", f"with {WIDE_SQL} select rn - 1 dataset_idx, de, en, es, fr from wd")
def a06(spark, d):
    return C.wide(X.tokenized(spark, d), LANGS, lang="lang").select("dataset_idx", *LANGS)


#: Sets of three lines of an order that follow each other; what is left over of an order is a set of fewer.
SETS_SQL = """lines as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey % 200) rn, l_partkey % 200 seg from lineitem),
 sets as (select l_orderkey * 100 + (rn - 1) // 3 doc_id, (rn - 1) % 3 + 1 pos, seg from lines), full3 as (select doc_id from sets group by doc_id having count(*) = 3)"""


def _sets(spark, d):
    li = T(spark, d, "lineitem")
    orders = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 200).alias("seg")))), lambda x: x["seg"]).alias("s"))  # the lines of an order
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / 3).cast("int")), lambda i: F.slice("s", 3 * i + 1, F.lit(3)))
    return orders.select("l_orderkey", F.posexplode(cut).alias("i", "segs")).select((F.col("l_orderkey") * 100 + F.col("i")).alias("doc_id"), "segs")


@query("a07_length_by_position", f"""with {TOKENS_SQL}, {SETS_SQL}
 select sets.pos - 1 pos, count(*) n, round(avg(token_length), 6) mean_len, round(stddev_pop(token_length), 6) std_len
 from sets join full3 using (doc_id) join tok on tok.doc_id = seg group by sets.pos""")
def a07(spark, d):
    m = X.tokenized(spark, d).select(F.col("doc_id").alias("seg_id"), "token_length")
    return C.length_by_position(_sets(spark, d), m, 3).withColumns({"mean_len": F.round("mean_len", 6), "std_len": F.round("std_len", 6)})


@query("j10_parallel_lengths", f"""with {TOKENS_SQL}, s as (select rn, token_length sl from tok where lang = 'en'), tt(lang, tol) as (values ('de', 0.7::double), ('fr', 0.7::double))
 select rn - 1 dataset_idx from (select t.rn rn, count(distinct t.lang) n from tok t join tt using (lang) join s on s.rn = t.rn where token_length between sl * (1 - tol) and sl * (1 + tol) group by t.rn) where n = 2""")
def j10(spark, d):
    return D.parallel_lengths(X.tokenized(spark, d), "en", {"de": 0.7, "fr": 0.7})


@query("p12_pair_length_similar", f"""with {TOKENS_SQL} select a.rn - 1 dataset_idx from tok a join tok b on a.rn = b.rn and a.lang = 'en' and b.lang = 'fr'
 where abs(a.token_length - b.token_length) <= 0.15::double * greatest(a.token_length, b.token_length)""")
def p12(spark, d):
    t = X.tokenized(spark, d)
    a = t.filter("lang = 'en'").select("dataset_idx", F.col("token_length").alias("a"))
    b = t.filter("lang = 'fr'").select("dataset_idx", F.col("token_length").alias("b"))
    return a.join(b, "dataset_idx").filter(D.pair_length_similar(F.col("a"), F.col("b"))).select("dataset_idx")


@query("p11_total_cap", """select doc_id, total from (select l_orderkey doc_id, sum(l_quantity)::double total from lineitem group by 1) where total <= 100""")
def p11(spark, d):
    # an order's lines are a set, their quantities its lengths
    g = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum(F.col("l_quantity").cast("double")).alias("total"))
    return g.filter("total <= 100")


# ---- titles ----

PAIRS_SQL = "pairs as (select p_name || (p_partkey % 1500) src, p_brand || '-' || p_size || '-' || (p_partkey % 1300) tgt, p_partkey line_no from part)"


def _pairs(spark, d):
    p = T(spark, d, "part")
    return p.select(F.concat("p_name", F.col("p_partkey") % 1500).alias("src"), F.concat_ws("-", "p_brand", "p_size", F.col("p_partkey") % 1300).alias("tgt"), F.col("p_partkey").alias("line_no"))


@query("p07_unambiguous", f"""with {PAIRS_SQL}, u as (select distinct src, tgt from pairs)
 select src, tgt from u where src in (select src from u group by src having count(*) = 1) and tgt in (select tgt from u group by tgt having count(*) = 1)""")
def p07(spark, d):
    return C.unambiguous(_pairs(spark, d))


@query("p08_namespace_filter", "select page_id, url from pages where not regexp_matches(url, '(?i)wikipedia:|image:|talk:|file:|user:|help:|mediawiki:|\\.(?:jpg|jpeg|png|gif|svg)|#')")
def p08(spark, d):
    return T(spark, d, "pages").select("page_id", "url").filter(~F.col("url").rlike(C.NAMESPACE))


@query("p09_article_pairs", "select p_partkey, p_name, p_type from part where not regexp_matches(p_name, '(?i)template:|category:|#') and trim(p_name) <> '' and trim(p_type) <> ''")
def p09(spark, d):
    return C.articles_only(T(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type")


@query("p10_script_filter", "select doc_id from documents where not regexp_matches(text, '[ß-ÿ]')")
def p10(spark, d):
    return C.without_script(T(spark, d, "documents"), "text", "[ß-ÿ]").select("doc_id")


@query("w03_first_wins", f"with {PAIRS_SQL} select src, arg_min(tgt, line_no) tgt, min(line_no) line_no from pairs group by src")
def w03(spark, d):
    return C.first_wins(_pairs(spark, d), ["src"], "line_no")


@query("w04_last_wins", f"with {PAIRS_SQL} select src, arg_max(tgt, line_no) tgt, max(line_no) line_no from pairs group by src")
def w04(spark, d):
    return C.last_wins(_pairs(spark, d), ["src"], "line_no")


# titles: suppliers and customers of a nation stand for languages
@query("j01_in_all_languages", f"""with {TOKENS_SQL}, b as (select token_length k, lang, max(doc_id) v from tok group by all) select k from b group by k having count(*) = 4""")
def j01(spark, d):
    t = X.tokenized(spark, d).withColumnRenamed("token_length", "k")
    last = C.last_wins(t.select("k", "lang", "doc_id"), ["k", "lang"], "doc_id")
    return C.in_all_languages(last, "k", "lang", "doc_id", 4).select("k")


@query("j02_linked_titles", "select c_name src, o_orderkey::varchar tgt from customer join orders on c_custkey = o_custkey")
def j02(spark, d):
    pages = T(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"))
    links = T(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").cast("string").alias("title"))
    return C.linked_titles(pages, links)


@query("j03_semi_join", "select doc_id, lang from documents where doc_id in (select item_id from benchmark)")
def j03(spark, d):
    wanted = T(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return T(spark, d, "documents").select("doc_id", "lang").join(wanted, "doc_id", "left_semi")


@query("j04_merge_scan_semi", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 5)")
def j04(spark, d):
    ids = T(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return T(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("j06_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 16 = 0)")
def j06(spark, d):
    return T(spark, d, "customer").join(T(spark, d, "orders").filter("o_orderkey % 16 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j07_lookup_default", "select d.doc_id, coalesce(quality, -1) quality from documents d left join labels l using (doc_id)")
def j07(spark, d):
    return C.with_default(T(spark, d, "documents").select("doc_id"), T(spark, d, "labels"), "doc_id", "quality", -1)


@query("j08_lookup_null", "select d.doc_id, toxic from documents d left join labels l using (doc_id)")
def j08(spark, d):
    return C.with_default(T(spark, d, "documents").select("doc_id"), T(spark, d, "labels"), "doc_id", "toxic", None)


ALIGN_SQL = TOKENS_SQL + """, par as (select rn aligned_id, lang, doc_id wiki_pageid from tok), full4 as (select aligned_id from par group by 1 having count(distinct lang) = 4),
 num as (select aligned_id, row_number() over (order by aligned_id) row_rn from full4)"""


def aligned_fixture(spark, d):
    t = X.tokenized(spark, d)
    par = t.select((F.col("dataset_idx") + 1).alias("aligned_id"), "lang", F.col("doc_id").alias("wiki_pageid"))
    docs = T(spark, d, "documents")
    art = docs.select("lang", F.col("doc_id").alias("wiki_pageid"), F.lit(1).alias("src"), F.element_at(F.split("text", "\n", 2), 1).alias("title"), "text")
    return C.aligned(par, art.unionByName(art.filter("wiki_pageid % 3 = 0").withColumn("src", F.lit(2)).withColumn("title", F.lit("second"))), 4)


@query("j09_aligned_corpus", f"""with {ALIGN_SQL} select (row_rn - 1)::varchar || lang id, aligned_id, lang, wiki_pageid, case when wiki_pageid % 3 = 0 then 'second' else split_part(text, chr(10), 1) end title
 from par join num using (aligned_id) join documents d on d.doc_id = wiki_pageid""".replace("|| lang id", "|| par.lang id").replace("aligned_id, lang, wiki", "aligned_id, par.lang lang, wiki"))
def j09(spark, d):
    return aligned_fixture(spark, d).select("id", "aligned_id", "lang", "wiki_pageid", "title")


@query("a41_alignment_check", "select true same_length, true same_ids")
def a41(spark, d):
    return C.alignment_check(aligned_fixture(spark, d))


@query("w02_dense_number", "select doc_id, row_number() over (order by doc_id) - 1 row_no from documents where lang = 'de'")
def w02(spark, d):
    return dense_number(T(spark, d, "documents").filter("lang = 'de'").select("doc_id"), "doc_id", "row_no")


@query("a40_counts_and_rate", "select count(*) n, count(quality) n_found, round(count(quality)::double / count(*), 6) rate from documents d left join labels l using (doc_id)")
def a40(spark, d):
    j = C.with_default(T(spark, d, "documents").select("doc_id"), T(spark, d, "labels"), "doc_id", "quality", None)
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_found"), F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("rate"))


@query("j16_chained_lookup", """select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def j16(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    nation = T(spark, d, "nation")
    step1 = C.chained(s, [(nation, "n_nationkey", "n_name")])
    return C.chained(step1, [(nation, "n_nationkey", "n_regionkey"), (T(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "r_name")]).select("s_suppkey", "n_name", "r_name")


@query("s19_remote_key_lookup", "select o_orderkey, n_name from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def s19(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = T(spark, d, "customer")
    return C.chained(o, [(c, "c_custkey", "c_nationkey"), (T(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "n_name")]).select("o_orderkey", "n_name")


@query("j17_ordered_gather", f"with {SETS_SQL} select s.doc_id, string_agg(seg::varchar, '_' order by pos) ids from sets s join full3 using (doc_id) group by s.doc_id")
def j17(spark, d):
    from ..operators.assemble import gathered

    docs = X.tokenized(spark, d).select(F.col("doc_id").alias("seg_id"))
    g = gathered(_sets(spark, d).filter("size(segs) = 3"), docs)
    return g.filter("not missing").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seg_id"))), lambda x: x["seg_id"].cast("string")), "_").alias("ids"))


@query("j18_crosslingual_match", f"with {TOKENS_SQL} select token_length, min(doc_id) doc_id from tok where lang = 'en' and token_length in (select token_length from tok where lang = 'de') group by token_length")
def j18(spark, d):
    t = X.tokenized(spark, d)
    hit = t.filter("lang = 'en'").join(t.filter("lang = 'de'").select("token_length").distinct(), "token_length", "left_semi")
    return C.first_wins(hit.select("token_length", "doc_id"), ["token_length"], "doc_id")


# ---- set operations ----


@query("o01_list_order", "select lang, case lang when 'en' then 1 when 'de' then 2 else 3 end place, count(*) n from documents group by lang")
def o01(spark, d):
    order = F.array(F.lit("en"), F.lit("de"))
    g = T(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.when(F.array_contains(order, F.col("lang")), F.array_position(order, F.col("lang")).cast("int")).otherwise(3)).orderBy("place", "lang")


@query("o02_sorted_unique", "select distinct p_brand from part order by 1")
def o02(spark, d):
    return T(spark, d, "part").select("p_brand").distinct().orderBy("p_brand")


@query("o03_first_rows", "select doc_id from documents order by doc_id limit 10")
def o03(spark, d):
    return T(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(10)  # the limit is the operator


@query("o04_union", "select c_nationkey k from customer union all select s_nationkey from supplier")
def o04(spark, d):
    return T(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(T(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("o05_intersect", "select c_nationkey k from customer intersect select s_nationkey from supplier")
def o05(spark, d):
    return T(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(T(spark, d, "supplier").select("s_nationkey"))


@query("o06_except", "select doc_id from documents except select doc_id from labels")
def o06(spark, d):
    return T(spark, d, "documents").select("doc_id").subtract(T(spark, d, "labels").select("doc_id"))


@query("o07_distinct", "select distinct p_type, p_size from part")
def o07(spark, d):
    return T(spark, d, "part").select("p_type", "p_size").distinct()
