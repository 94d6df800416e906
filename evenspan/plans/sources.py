"""Queries of scans and sinks (S1 to S21, K1 to K12): what is written is read again, and lines are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..jobs import analyze_attention
from ..sources import files as S
from ..sources import sinks as K
from ..sources.dumps import dump_tuples
from ..sources.scratch import scratch_path
from . import fixtures as X
from .attention import ABS_SQL, TRIM_SQL
from .corpus import ALIGN_SQL, aligned_fixture
from .fixtures import ITEMS_SQL, TOKENS_SQL


def T(spark, d, name):
    return X.table(spark, d, name)


@query("s01_text_directory", "select n_nationkey::varchar id, n_name || ' text' text from nation")
def s01(spark, d):
    path = scratch_path(spark, "texts")
    n = T(spark, d, "nation")
    # a folder for each key, with one file: the file's name is the id
    n.select(F.concat(F.lit(" "), F.col("n_name"), F.lit(" text \n")).alias("value"), F.concat(F.col("n_nationkey").cast("string")).alias("file")).coalesce(1).write.partitionBy("file").text(path)
    return S.text_directory(spark, f"{path}/*").select(F.regexp_extract(F.col("folder"), "file=(.*)", 1).alias("id"), "text")


@query("s02_csv_scan", "select n_nationkey::varchar id, n_name text from nation")
def s02(spark, d):
    path = scratch_path(spark, "csv")
    T(spark, d, "nation").write.csv(path, header=True, escape='"')
    return S.csv_documents(spark, path, "n_nationkey", "n_name")


@query("s03_json_lines_scan", "select doc_id::varchar id, text, true ok from documents")
def s03(spark, d):
    path = scratch_path(spark, "jsonl")
    T(spark, d, "documents").select("doc_id", "text").write.json(path)
    return S.json_lines(spark, path, "doc_id", "text")


@query("s03_rejected_lines", "select count(*) filter (n_nationkey % 5 <> 0 and n_nationkey % 7 <> 0) accepted, count(*) filter (n_nationkey % 5 = 0 or n_nationkey % 7 = 0) rejected from nation")
def s03b(spark, d):
    path = scratch_path(spark, "mixed")
    k = F.col("n_nationkey")
    good = F.to_json(F.struct(k.alias("id"), F.col("n_name").alias("text")))
    line = F.when(k % 5 == 0, F.lit("{broken")).when(k % 7 == 0, F.to_json(F.struct(k.alias("id")))).otherwise(good)
    T(spark, d, "nation").select(line.alias("value")).write.text(path)
    return S.json_lines(spark, path).agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


@query("s04_k01_split_dataset", "select lang, count(*) n from documents where lang in ('de', 'fr') group by lang")
def s04(spark, d):
    path = scratch_path(spark, "splits")
    S.write_partitioned(T(spark, d, "documents"), path, "lang")
    return spark.read.parquet(path).filter(F.col("lang").isin("de", "fr")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("s05_k06_article_scan", "select doc_id, n_chars from documents where source = 'src3'")
def s05(spark, d):
    path = scratch_path(spark, "articles")
    T(spark, d, "documents").write.parquet(path)
    return spark.read.parquet(path).filter("source = 'src3'").select("doc_id", "n_chars")


def _pair_lines(spark, d):
    p = T(spark, d, "part")
    k = F.col("p_partkey")
    line = F.when(k % 10 == 0, F.col("p_name")).when(k % 10 == 1, F.concat_ws(" ||| ", "p_name", "p_brand", "p_type")).otherwise(F.concat_ws(" ||| ", "p_name", "p_brand"))
    return p.select(k.alias("line_no"), line.alias("line"))


@query("s06_title_pairs", "select p_partkey line_no, p_name src, case when p_partkey % 10 = 1 then p_brand || ' ||| ' || p_type else p_brand end tgt from part where p_partkey % 10 <> 0")
def s06(spark, d):
    return S.title_pairs(_pair_lines(spark, d))


@query("s07_title_pairs_strict", "select p_partkey line_no, p_name src, p_brand tgt from part where p_partkey % 10 not in (0, 1)")
def s07(spark, d):
    return S.title_pairs(_pair_lines(spark, d), strict=True)


def _table_lines(spark, d, cells, header="en ||| de ||| fr"):
    n = T(spark, d, "nation")
    head = spark.createDataFrame([(0, header)], "line_no long, line string")
    return n.select((F.col("n_nationkey") + 1).alias("line_no"), cells.alias("line")).unionByName(head)


@query("s08_language_table", "select n_nationkey + 1 line_no, lang, case lang when 'en' then n_name when 'de' then n_name || 'd' else n_name || 'f' end as \"value\" from nation, (values ('en'), ('de'), ('fr')) l(lang) where n_nationkey % 6 <> 0")
def s08(spark, d):
    name = F.col("n_name")
    full = F.concat_ws(" ||| ", name, F.concat(name, F.lit("d")), F.concat(name, F.lit("f")))
    return S.language_table(_table_lines(spark, d, F.when(F.col("n_nationkey") % 6 == 0, name).otherwise(full)))


@query("s08_requested_languages", "select n_nationkey + 1 line_no, lang, n_name || lang as \"value\" from nation, (values ('en'), ('fr')) l(lang) where n_nationkey % 4 <> 0")
def s08b(spark, d):
    name = F.col("n_name")
    fr = F.when(F.col("n_nationkey") % 4 == 0, F.lit("")).otherwise(F.concat(name, F.lit("fr")))
    return S.language_table(_table_lines(spark, d, F.concat_ws(" ||| ", F.concat(name, F.lit("en")), F.lit(""), fr)), ["en", "fr"])


@query("s09_ids_with_titles", "select n_nationkey + 1 line_no, lang, n_nationkey * 10 + i article_id, n_name || lang title from nation, (values ('en', 0), ('de', 1)) l(lang, i) where n_nationkey % 5 <> 0")
def s09(spark, d):
    k, name = F.col("n_nationkey"), F.col("n_name")
    ids = F.concat_ws(" ||| ", F.when(k % 5 == 0, F.lit("x")).otherwise((k * 10).cast("string")), (k * 10 + 1).cast("string"))
    titles = F.concat_ws(" ||| ", F.concat(name, F.lit("de")), F.concat(name, F.lit("en")))
    return S.ids_with_titles(S.language_table(_table_lines(spark, d, ids, "en ||| de")), S.language_table(_table_lines(spark, d, titles, "de ||| en")))


@query("s10_parallel_ids", "select n_nationkey + 1 aligned_id, lang, n_nationkey + i wiki_pageid from nation, (values ('en', 0), ('de', 100)) l(lang, i) where n_nationkey % 5 <> 0")
def s10(spark, d):
    k = F.col("n_nationkey")
    cells = F.concat_ws(" ||| ", k.cast("string"), F.when(k % 5 == 0, F.lit("")).otherwise((k + 100).cast("string")))
    return S.parallel_ids(S.language_table(_table_lines(spark, d, cells, "en ||| de")))


@query("s11_two_parquet_scans", "select doc_id, lang from documents where lang = 'de' union all select doc_id, lang from documents where doc_id % 2 = 0")
def s11(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "lang")
    return S.unioned(docs.filter("lang = 'de'"), docs.filter("doc_id % 2 = 0"))


@query("s12_dump_pages", "select n_nationkey page_id, replace(n_name, '_', ' ') || ' x''y' title from nation where n_nationkey % 3 <> 0")
def s12(spark, d):
    k = F.col("n_nationkey")
    one = F.concat(F.lit("("), k.cast("string"), F.lit(","), F.when(k % 3 == 0, F.lit("14")).otherwise(F.lit("0")), F.lit(",'"), F.col("n_name"), F.lit("_x\\'y',0,1)"))
    lines = T(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("INSERT INTO page VALUES "), F.array_join(F.collect_list(one), ",")).alias("value"))
    return S.dump_pages(lines)


@query("s12_dump_langlinks", "select n_nationkey page_id, replace(n_name || ' - ' || n_name, '_', ' ') title from nation where n_nationkey % 4 = 1")
def s12b(spark, d):
    k, name = F.col("n_nationkey"), F.col("n_name")
    lang = F.when(k % 4 == 2, F.lit("fr")).otherwise(F.lit("de"))
    title = F.when(k % 4 == 3, F.lit("")).when(k % 4 == 0, F.lit("")).otherwise(F.concat(name, F.lit("_–_"), name))
    one = F.concat(F.lit("("), k.cast("string"), F.lit(",'"), lang, F.lit("','"), title, F.lit("')"))
    return S.dump_langlinks(T(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(one), ",").alias("value")), "de")


@query("s12_dump_splits", "select p_partkey page_id, p_name || ' ),(' || p_partkey || ',0,'' x' title from part where p_partkey % 5 <> 0")
def s12c(spark, d):
    """Statements of many tuples, whose titles hold what separates tuples, written and read by splits."""
    k = F.col("p_partkey").cast("string")
    one = F.concat(F.lit("("), k, F.when(F.col("p_partkey") % 5 == 0, F.lit(",14,'")).otherwise(F.lit(",0,'")), "p_name", F.lit("_),("), k, F.lit(",0,\\'_x',0)"))
    lines = T(spark, d, "part").groupBy("p_size").agg(F.concat(F.lit("INSERT INTO `page` VALUES "), F.array_join(F.collect_list(one), ","), F.lit(";")).alias("value"))
    path = scratch_path(spark, "dump")
    lines.select("value").write.text(path)
    return S.dump_pages(dump_tuples(spark, path))


@query("s13_k02_metadata_map", f"with {TOKENS_SQL} select doc_id::varchar doc_id, rn - 1 dataset_idx, token_length, lang as language, '_NA' topic, '_NA' pair_id from tok")
def s13(spark, d):
    from .corpus import meta

    return S.metadata_map(S.metadata_json(meta(spark, d)))


@query("s14_k04_embedding_store", "select vec_id::varchar key, len(embedding) n from embeddings where label % 2 = 0")
def s14(spark, d):
    path = scratch_path(spark, "store")
    e = T(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "embedding", F.lit("run1").alias("run"), F.lit("standalone").alias("kind"), F.when(F.col("label") % 2 == 0, "cls").otherwise("mean").alias("pooling"))
    S.write_partitioned(e, path, "run", "kind", "pooling")
    return S.embeddings_where(spark.read.parquet(path), "run1", "cls", "standalone").select("key", F.size("embedding").cast("long").alias("n"))


@query("s15_k03_indices", f"with {ITEMS_SQL}, p as (select item, perm, string_agg(seg_id::varchar, '_' order by pos) ids from segs where perm = 0 group by item, perm) select ids from p")
def s15(spark, d):
    path = scratch_path(spark, "indices")
    segs = X.segments(spark, d).filter("perm = 0").groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seg_id"))), lambda x: x["seg_id"].cast("int")).alias("s"))
    # an indices file is one object by its format
    segs.agg(F.collect_list("s").alias("concat_indices"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("standalone_indices")).write.json(path)
    docs, _ = S.indices(spark, path)
    return docs.select(F.array_join(F.col("segs").cast("array<string>"), "_").alias("ids"))


def _run_names(spark, d):
    """name: runs after parts, two models in five languages or pairs, and names that are no run."""
    p, k = T(spark, d, "part"), F.col("p_partkey")
    lang = F.when(k % 5 == 0, "en").when(k % 5 == 1, "de").when(k % 5 == 2, "de_en").when(k % 5 == 3, "en_de").otherwise("it")
    name = F.concat(F.lit("m"), k % 2, F.lit("__"), lang, F.lit("__concat-size_"), "p_size", F.when(F.col("p_size") % 3 == 0, "__LH_CLS_128_1").otherwise(""))
    return p.select(name.alias("name")).unionByName(p.select(F.concat(F.lit("m1__notes "), "p_name").alias("name"))).distinct()


@query("s16_run_catalog", """with r as (select distinct case p_partkey % 5 when 0 then 'en' when 1 then 'de' when 2 then 'de_en' when 3 then 'en_de' else 'it' end k, p_size, p_partkey % 2 m from part)
 select 'm' || m || '__' || k || '__concat-size_' || p_size || case when p_size % 3 = 0 then '__LH_CLS_128_1' else '' end as name, k lang_key, p_size::int concat_size, case when contains(k, '_') then 'multi' else 'mono' end kind,
  case left(k, 2) when 'de' then 1 when 'en' then 2 else 3 end place_a, case when not contains(k, '_') then 0 when right(k, 2) = 'de' then 1 else 2 end place_b from r where m = 1""")
def s16(spark, d):
    return S.run_catalog(_run_names(spark, d), "m1", ["de", "en"]).drop("model")


@query("s17_run_info", "select distinct 'm' || (p_partkey % 2) model, case p_partkey % 5 when 0 then 'en' when 1 then 'de' when 2 then 'de_en' when 3 then 'en_de' else 'it' end lang_key, p_size::int concat_size from part")
def s17(spark, d):
    return S.run_catalog(_run_names(spark, d), "", ["de", "en"]).select("model", "lang_key", "concat_size")


@query("s18_k09_attention_json", f"with {TRIM_SQL}{ABS_SQL} select 'org_m1__basket-8__bins-10__all-rows__layers-2' as name, layer, bin, round(mean_w, 6) mean_w from ba")
def s18(spark, d):
    path = scratch_path(spark, "attention")
    name = spark.range(1).select(K.attention_name(F.lit("org/m1"), F.lit(8), F.lit(10), F.lit(False), F.lit(2))).first()[0]
    parts = analyze_attention(spark, {"basket_size": 8, "rel_bins": 10}, X.attention(spark, d))
    K.write_attention({k: parts[k] for k in ("baskets_absolute", "ends")}, path, name)
    got = K.read_attention(spark, path, name, "baskets_absolute", "layer int, bin int, mean_w double, sum_w double, n_docs long")
    return got.select(F.lit(name).alias("name"), "layer", "bin", F.round("mean_w", 6).alias("mean_w"))


@query("s20_sampled_rows", "select doc_id from documents order by md5('7|' || doc_id), doc_id limit 25")
def s20(spark, d):
    return S.sampled(T(spark, d, "documents").select("doc_id"), 25, "doc_id", 7)


@query("s21_article_text", "select conv_id wiki_id, string_agg(text, chr(10) order by turn) text from conversations group by conv_id")
def s21(spark, d):
    c = T(spark, d, "conversations")
    return S.article_text(c.select(F.col("conv_id").alias("wiki_id"), F.col("turn").alias("paragraph_id"), "text"))


@query("s_numbered_lines", "select line_no, line from (select n_nationkey line_no, n_name line from nation)")
def numbered(spark, d):
    path = scratch_path(spark, "lines")
    T(spark, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return S.numbered_lines(spark, path)


@query("k05_run_config", "select n_nationkey, n_name model, case when n_nationkey % 2 = 0 then 2 * n_nationkey else 64 end basket_size, 0.5::double strength from nation")
def k05(spark, d):
    """A file of settings for each run: what took effect goes over what was given."""
    path = scratch_path(spark, "config")
    k = F.col("n_nationkey")
    rows = T(spark, d, "nation").select(
        "n_nationkey", F.struct(F.col("n_name").alias("model"), F.lit(64).alias("basket_size")).alias("given"), F.struct(F.when(k % 2 == 0, 2 * k).alias("basket_size"), F.lit(0.5).alias("strength")).alias("effective"))
    return K.write_settings_of(rows, path, "n_nationkey").select("n_nationkey", "model", "basket_size", "strength")


@query("k07_gated_write", "select lang, count(*) n from documents group by lang having count(*) < 0")
def k07(spark, d):
    # languages of unequal size are not written
    docs = X.tokenized(spark, d).select(F.col("dataset_idx").alias("row_no"), F.col("dataset_idx").alias("aligned_id"), "lang", "doc_id")
    path = scratch_path(spark, "uneven")
    if not K.write_aligned(docs, path):
        return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(0)  # nothing was written, so there is nothing to read
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("k07_aligned_write", f"with {ALIGN_SQL} select par.lang lang, wiki_pageid, row_rn - 1 row_no from par join num using (aligned_id)")
def k07b(spark, d):
    path = scratch_path(spark, "aligned")
    K.write_aligned(aligned_fixture(spark, d).select("row_no", "aligned_id", "lang", "wiki_pageid", "title"), path)
    return spark.read.parquet(path).select("lang", "wiki_pageid", F.col("row_no").cast("long").alias("row_no"))


@query("k08_delimited_lines", "select n_nationkey || ' ||| ' || n_name || ' ||| ' as \"value\" from nation")
def k08(spark, d):
    return S.delimited(T(spark, d, "nation").withColumn("none", F.lit(None).cast("string")), ["n_nationkey", "n_name", "none"])


@query("k12_json_sink", "select doc_id, lang from documents")
def k12(spark, d):
    path = scratch_path(spark, "json")
    K.write_json_lines(T(spark, d, "documents").select("doc_id", "lang"), path)
    return spark.read.schema("doc_id long, lang string").json(path)
