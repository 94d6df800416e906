"""Experiment tables made from the driver's tables, in Spark and as SQL.

Items are groups of three embeddings of a label, documents the six orders of an item; a document's embedding
weighs its segments 1, 1/2, 1/3, and a segment within the document is 0.7 of itself and 0.3 of the document.
Attention is a softmax of dot products within sequences of a label's embeddings, four heads of 16 dimensions, two layers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import add, l2_normalize, scale, sum_rows
from ..operators.assemble import whitespace_pieces
from ..operators.design import permutation_table
from ..operators.ranks import dense_number

K = 3
#: Tokens of an attention sequence.
TOKENS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seg_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, item_no, slot, seg_id of items with all three segments."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = dense_number(e, "vec_id", "rn", ["label"]).withColumn("rn", F.col("rn") + 1)
    r = r.select("label", F.floor((F.col("rn") + 2) / 3).cast("int").alias("item_no"), ((F.col("rn") + 2) % 3).alias("slot"), F.col("vec_id").alias("seg_id"))
    full = r.groupBy("label", "item_no").count().filter(F.col("count") == K).drop("count")
    return r.join(full, ["label", "item_no"])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item, pos, seg_id: every order of every item."""
    orders = F.broadcast(permutation_table(spark, K))  # 18 rows
    r = items(spark, sf_dir).join(orders, "slot").withColumn("item", F.concat_ws("_", "label", "item_no"))
    return r.select(F.concat_ws("_", "item", "perm").alias("doc_id"), "item", "perm", "pos", "seg_id")


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, embedding."""
    s = segments(spark, sf_dir).join(standalone(spark, sf_dir), "seg_id")
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("v"))  # three rows each
    return g.select("doc_id", sum_rows(F.transform("v", lambda x: scale(x["embedding"], 1 / (x["pos"] + 1)))).alias("embedding"))


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, seg_id, embedding of each segment within its document."""
    s = segments(spark, sf_dir).join(standalone(spark, sf_dir).withColumnRenamed("embedding", "v"), "seg_id").join(document(spark, sf_dir), "doc_id")
    return s.select("doc_id", "pos", "seg_id", add(scale(l2_normalize(F.col("v")), 0.7), scale(l2_normalize(F.col("embedding")), 0.3)).alias("embedding"))


#: SQL of the same: e (embeddings as doubles), segs, docv (document vectors), latev.
ITEMS_SQL = """
e0 as (select vec_id, label, embedding::double[] v, row_number() over (partition by label order by vec_id) rn from embeddings),
e as (select vec_id, label, v, (rn + 2) // 3 item_no, (rn + 2) % 3 slot from e0),
ok as (select label, item_no from e group by all having count(*) = 3),
perms(perm, pos, slot) as (values (0,0,0),(0,1,1),(0,2,2),(1,0,0),(1,1,2),(1,2,1),(2,0,1),(2,1,0),(2,2,2),(3,0,1),(3,1,2),(3,2,0),(4,0,2),(4,1,0),(4,2,1),(5,0,2),(5,1,1),(5,2,0)),
segs as (select e.label || '_' || e.item_no || '_' || perm doc_id, e.label || '_' || e.item_no item, perm, pos, vec_id seg_id, v from e join ok using (label, item_no) join perms using (slot)),
docp as (select doc_id, any_value(v) filter (where pos = 0) a, any_value(v) filter (where pos = 1) b, any_value(v) filter (where pos = 2) c from segs group by doc_id),
docv as (select doc_id, list_transform(range(1, 65), lambda i: a[i] + b[i] / 2 + c[i] / 3) dv from docp)"""
LATE_SQL = ITEMS_SQL + """,
nrm as (select doc_id, item, pos, seg_id, v, dv, sqrt(list_dot_product(v, v)) nv, sqrt(list_dot_product(dv, dv)) nd from segs join docv using (doc_id)),
latev as (select doc_id, item, pos, seg_id, v, list_transform(range(1, 65), lambda i: 0.7::double * v[i] / nv + 0.3::double * dv[i] / nd) lv from nrm)"""


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, dataset_idx, seg_id, token_length of documents, whitespace tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.size(whitespace_pieces(F.col("text"))).alias("token_length"))
    # the fixture aligns languages by rank
    d = dense_number(d, "doc_id", "dataset_idx", ["lang"])
    return d.select("doc_id", "lang", "token_length", F.col("dataset_idx").cast("int").alias("dataset_idx"), F.concat(F.col("doc_id").cast("string"), "lang").alias("seg_id"))


TOKENS_SQL = r"""
t0 as (select doc_id, lang, len(string_split_regex(trim(text), '\s+')) token_length, row_number() over (partition by lang order by doc_id) rn from documents),
tok as (select doc_id, lang, token_length, rn, doc_id || lang seg_id from t0)"""


def attention(spark: SparkSession, sf_dir: str, layers: int = 2) -> DataFrame:
    """doc_id, layer, head, q, k, w over all embeddings: those of a label, in order, are cut into sequences of TOKENS,
    the last of which takes what is left over."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    e = dense_number(e, "vec_id", "rn", ["label"]).join(n, "label")
    seq = F.least(F.floor(F.col("rn") / TOKENS), F.greatest(F.floor(F.col("n") / TOKENS) - 1, F.lit(0)))
    e = e.withColumns({"seq": seq, "at": (F.col("rn") - seq * TOKENS).cast("int"), "doc_id": F.col("label").cast("long") * 1_000_000 + seq}).withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(3))))
    e = e.select("doc_id", "at", "head", F.slice("v", F.col("head") * 16 + 1, F.lit(16)).alias("v"))
    q = e.select("doc_id", "head", F.col("at").alias("q"), F.col("v").alias("qv"))
    k = e.select("doc_id", "head", F.col("at").alias("k"), F.col("v").alias("kv"))
    from ..functions.vectors import dot

    pairs = q.join(k, ["doc_id", "head"]).select("doc_id", "head", "q", "k", dot(F.col("qv"), F.col("kv")).alias("s"))
    r = pairs.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))).withColumn("x", F.exp((F.col("layer") + 1) * F.col("s")))
    total = F.sum("x").over(W.partitionBy("doc_id", "head", "layer", "q"))
    return r.select("doc_id", "layer", "head", "q", "k", (F.col("x") / total).alias("w"))


ATTENTION_SQL = """
a00 as (select label, vec_id, embedding::double[] v, row_number() over (partition by label order by vec_id) rn, count(*) over (partition by label) cnt from embeddings),
a01 as (select label::bigint * 1000000 + least((rn - 1) // {T}, greatest(cnt // {T} - 1, 0)) doc_id, vec_id, v from a00),
a0 as (select doc_id, v, row_number() over (partition by doc_id order by vec_id) rn from a01),
a1 as (select doc_id, rn, h.head, v[h.head * 16 + 1 : h.head * 16 + 16] v from a0, (select unnest(range(4)) head) h),
a2 as (select x.doc_id, x.head, x.rn qn, y.rn kn, list_dot_product(x.v, y.v) s from a1 x join a1 y on x.doc_id = y.doc_id and x.head = y.head),
a3 as (select doc_id, head, layer, qn, kn, exp((layer + 1) * s) x from a2, (select unnest(range(2)) layer)),
att as (select doc_id, layer, head, qn, kn, x / sum(x) over (partition by doc_id, head, layer, qn) w from a3)""".replace("{T}", str(TOKENS))
