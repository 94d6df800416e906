"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows it gets, and but for the last returns the columns of
``documents``. Between stages the rows are written to the shared folder and read again; a stage deletes the
tables that earlier stages of its own run left there, but for those that its input reads.

Defined results: a null text has no words, so the quality rules reject it; rows of one doc_id are rows of their
own throughout, and so are rows with a null one; of rows that repeat in all columns and have words one stays
after near duplicates; an empty table gives an empty result in every stage; columns beside those of
``documents`` are left out.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenspan.llm import bpe, linedup, mixing, ngram_join, quality
from evenspan.llm.common import drop_unread, noting, small, stash, table
from evenspan.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Of each application and folder of inputs, the tables that the stages of the run under way have written.
_runs: dict[tuple[str, str], list[str]] = {}


def _stage(work, first: bool = False):
    """``work`` as a stage: what earlier stages of its run wrote goes, unless ``docs`` reads it. A first stage
    begins a run; tables of other runs, and of operators called by others, are never touched."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = (spark.sparkContext.applicationId, sf_dir)
        paths = _runs[run_of] = [] if first else drop_unread(spark, _runs.get(run_of, []), docs)
        with noting(paths):
            return work(spark, docs, sf_dir)

    return run


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents of which nothing is left."""
    out = linedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.size("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id stays (a null id counts as largest, equal ids go by
    a hash of the row), and of rows that repeat in all columns one. Rows without words are in no group."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"))
    rows = docs.select(*COLUMNS, place.alias("_place"))
    near = ngram_join.near_documents(rows.select("_place", "text"), "_place").filter("n_shingles > 0")
    near = stash(near.groupBy(F.col("doc_id").alias("_at")).agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("times")), "groups")
    gone = stash(near.filter("_at <> first").select("_at"), "gone")
    kept = rows.join(small(gone), F.col("_place") == F.col("_at"), "left_anti")
    again = stash(near.filter("_at = first and times > 1").select("_at"), "again")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(small(again), F.col("_place") == F.col("_at"), "left_semi").dropDuplicates(["_place"])
    return kept.join(small(again), F.col("_place") == F.col("_at"), "left_anti").unionByName(once).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's epochs and the draw take them."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each row of the mix."""
    out = bpe.bpe_encode(docs, vocabulary(), carry=["doc_id", "lang", "source"], decode=False).select("doc_id", "lang", "source", "n_tokens", "ids")
    return stash(out, "bpe")  # written here, where Python gets few rows at once


STAGES = [
    ("quality_rules", _stage(quality_stage, first=True)), ("line_dedup", _stage(line_stage)), ("ngram_jaccard", _stage(near_stage)),
    ("mixing", _stage(mix_stage)), ("bpe", _stage(bpe_stage)),
]

#: Draws by hash and the vocabulary's merges are nothing SQL can state; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            with noting(_runs[spark.sparkContext.applicationId, sf_dir]):
                docs = stash(docs, name)
    return docs
