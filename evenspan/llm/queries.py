"""The operators of this folder on their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hard_negatives, langid, licenses, linedup, mixing, ngram_join, quality, sharding, spelling, spotsigs, toxicity, url_rules
from .common import table


def vocabulary() -> str:
    """Where the word BPE vocabulary lies; a parameter of the operator, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary(), carry=["doc_id"], digest=True)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"))
    model = langid.learn(docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out") & F.col("lang").isNotNull()))
    return langid.identify(docs, model, carry=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(_remainder(5) != 0)
    model = toxicity.learn(docs, labels)
    return toxicity.score_toxicity(docs, model, carry=["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"])
    joined = {c: F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")}
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined.values(), "score", "expressions", "freedom")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), anchors=F.col("vec_id") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_quality_rules, op2_url_filters, op3_bpe, op4_spotsigs, op5_language_id, op6_line_dedup, op7_ngram_jaccard, op8_sharding, op9_mixing, op10_toxicity, op11_licenses, op12_hard_negatives, op13_spelling)
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in ops}
