"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the mix by weight, but at most MAX_EPOCHS times its own size; what is above
is shared again by weight among the others. Whole epochs of a source are taken first. Of the rest, documents
are taken in the order of exponential keys, divided by the document's quality weight, until the sizes before
them use up the source's budget.

The order is not sorted in one task: keys are counted in buckets, the bucket in which a source's budget ends is
found from the buckets' sums, and only the documents of that bucket are ranked. Buckets are equal steps of the
key's logarithm, whose density is the same whatever the weights, so that none has more than a fraction of a
percent of a source; the more rows, the finer they are. What remains of a source is its number of epochs and one
cutting key, and documents are compared with that.

Defined results: a null text has size 0 and is taken 0 words; a null source is one source, last in order; rows
that repeat are numbered and drawn one by one; if all sizes are 0 all targets are 0; an empty table gives an
empty result; columns named as those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, small, stash, words

#: Weights of the sources in order of code points, repeating; share of all sizes; most epochs of a source.
WEIGHTS, SHARE, MAX_EPOCHS = (3.0, 1.0, 2.0), 1.5, 2.0
#: Buckets for each doubling of the key, at least, and rows for each more.
BUCKETS, BUCKET_ROWS = 256, 100_000
SEED = 20240


def quality_weight(text: Column) -> Column:
    """1 for text without symbols and digits, falling with their share of the characters, 0.05 at least."""
    t = F.coalesce(text, F.lit(""))
    noise = F.length(t) - F.length(F.translate(t, "#*$%&|<>0123456789", ""))
    return F.greatest(F.lit(0.05), 1 - 2 * noise / F.greatest(F.length(t), F.lit(1)))


def mix_targets(sizes: DataFrame) -> DataFrame:
    """``sizes``: source, source_size, one row per source. Adds weight and target.

    The sources are few beside the documents (a row each), so that one task orders them.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    s = stash(sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), place)), "sources")
    cap = F.col("source_size") * MAX_EPOCHS
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rate = None  # target is the lesser of cap and rate * weight
    while total:
        over = F.lit(False) if rate is None else F.lit(rate) * F.col("weight") > cap
        capped, free = s.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        # above the cap once, above it from then on: the rate only rises, so this ends after as many rounds as sources
        new = (SHARE * total - capped) / free
        if rate is not None and new <= rate:
            break
        rate = new
    return s.withColumn("target", F.least(cap, F.lit(float(rate or 0)) * F.col("weight")))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with size, source_size, target and copies: how often the mix has the row."""
    added = ["size", "source_size", "target", "copies"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    hashed = F.xxhash64(F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(text))
    rows = docs.select(F.struct(*carry).alias("_row"), F.col(source).alias("_s"), F.size(words(F.col(text))).cast("long").alias("size"), hashed.alias("_g"), quality_weight(F.col(text)).alias("_w"), F.spark_partition_id().alias("_p"))
    rows = numbered(stash(rows, "mix"), "_g", "_p", "_o").withColumn("_h", F.when(F.col("_o") == 0, F.col("_g")).otherwise(F.xxhash64("_g", "_o")))
    u = (F.shiftrightunsigned("_h", 11) + F.lit(0.5)) / float(1 << 53)
    rows = rows.withColumn("_k", F.greatest(-F.log(u) / F.col("_w"), F.lit(1e-300))).select("_row", "_s", "size", "_h", "_k")
    bucket = F.floor(F.log2("_k") * max(BUCKETS, rows.count() // BUCKET_ROWS))
    sums = stash(rows.groupBy(F.col("_s").alias("source"), bucket.alias("b")).agg(F.sum("size").alias("size")), "buckets")
    sources = stash(mix_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    sources = sources.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    at = sums.join(small(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("before", before).filter((F.col("before") < F.col("budget")) & (F.col("before") + F.col("size") >= F.col("budget")))
    at = at.select(F.col("source").alias("_c"), F.col("b").alias("_b"), "before", "budget")
    # in the bucket where the budget ends: the last document whose middle is within it
    inside = rows.withColumn("_b2", bucket).join(small(at), F.col("_s").eqNullSafe(F.col("_c")) & (F.col("_b2") == F.col("_b")))
    upto = F.col("before") + F.sum("size").over(W.partitionBy("_c", "_b").orderBy("_k", "_h"))
    inside = inside.withColumn("_u", upto).filter(F.col("_u") - F.col("size") / 2 <= F.col("budget"))
    cuts = at.join(inside.groupBy(F.col("_c").alias("_c2")).agg(F.max(F.struct("_k", "_h")).alias("cut")), F.col("_c").eqNullSafe(F.col("_c2")), "left").drop("_c2", "before", "budget")
    rule = sources.withColumnRenamed("source", "_rs").join(small(cuts), F.col("_rs").eqNullSafe(F.col("_c")), "left")
    rule = stash(rule.select("_rs", "source_size", "target", "epochs", "budget", F.col("_b").alias("_b"), F.col("cut._k").alias("_ck"), F.col("cut._h").alias("_ch"), F.col("_b").isNotNull().alias("_cut")), "cuts")
    out = rows.withColumn("_b2", bucket).join(small(rule), F.col("_s").eqNullSafe(F.col("_rs")))
    first = (F.col("_b2") < F.col("_b")) | ((F.col("_b2") == F.col("_b")) & F.coalesce((F.col("_k") < F.col("_ck")) | ((F.col("_k") == F.col("_ck")) & (F.col("_h") <= F.col("_ch"))), F.lit(False)))
    # no bucket ends the budget: it is 0
    picked = F.when(F.col("_cut"), first).otherwise(F.lit(False))
    copies = (F.col("epochs") + picked.cast("long")).cast("long")
    # in two steps, so that no name of the caller's is taken for one of these
    added = F.struct("size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")).alias("copies"))
    return out.select("_row", added.alias("_added")).select("_row.*", "_added.*")


def mixed_rows(docs: DataFrame, **names) -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken."""
    return (mix(docs, **names).filter("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, cast(copies as int))")))
            .select(*docs.columns))
