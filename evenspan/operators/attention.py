"""Attention aggregation in long form: doc_id, layer, head, q, k, w, with k and q counted from 0 over valid tokens.

Everything is a sum and a count, so partial aggregation runs before any shuffle; the document is in each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import percentiles


def incoming(att: DataFrame, first_row_only: bool = False) -> DataFrame:
    """doc_id, layer, k, w: attention into each token, heads averaged, over all query rows or the first only."""
    rows = att.filter("q = 0") if first_row_only else att
    return rows.groupBy("doc_id", "layer", "k").agg((F.sum("w") / F.countDistinct("head")).alias("w"))


def ends(inc: DataFrame) -> DataFrame:
    """Per layer, the mean incoming attention of first and last tokens over documents."""
    last = F.max("k").over(W.partitionBy("doc_id", "layer"))
    r = inc.withColumn("_last", last)
    return r.groupBy("layer").agg(F.avg(F.when(F.col("k") == 0, F.col("w"))).alias("first_token"), F.avg(F.when(F.col("k") == F.col("_last"), F.col("w"))).alias("last_token"))


def trimmed(inc: DataFrame, drop_first: bool = True, drop_last: bool = True) -> DataFrame:
    """Without the first and last tokens, k counted anew from 0; adds n_tokens, the tokens left."""
    last = F.max("k").over(W.partitionBy("doc_id", "layer"))
    r = inc.withColumn("_last", last)
    lo, hi = int(drop_first), F.col("_last") - int(drop_last)
    return r.filter((F.col("k") >= lo) & (F.col("k") <= hi)).withColumn("n_tokens", (hi - lo + 1).cast("int")).withColumn("k", (F.col("k") - lo).cast("int")).drop("_last")


def absolute_baskets(trim: DataFrame, size: int = 128) -> DataFrame:
    """layer, bin: averages over documents of the bin's mean and of its sum, and how many documents reach it."""
    doc = trim.groupBy("doc_id", "layer", F.floor(F.col("k") / size).cast("int").alias("bin")).agg(F.avg("w").alias("m"), F.sum("w").alias("s"))
    return doc.groupBy("layer", "bin").agg(F.avg("m").alias("mean_w"), F.avg("s").alias("sum_w"), F.count(F.lit(1)).alias("n_docs"))


def relative_bin(k: Column, n: Column, bins: int) -> Column:
    """The bin of token k of n, with edges (i * n) div bins; a document needs a token for each bin."""
    return F.floor((F.lit(bins) * (k + 1) - 1) / n).cast("int")


def relative_baskets(trim: DataFrame, bins: int = 20) -> DataFrame:
    long = trim.filter(F.col("n_tokens") >= bins)
    doc = long.groupBy("doc_id", "layer", relative_bin(F.col("k"), F.col("n_tokens"), bins).alias("bin")).agg(F.avg("w").alias("m"), F.sum("w").alias("s"))
    return doc.groupBy("layer", "bin").agg(F.avg("m").alias("mean_w"), F.avg("s").alias("sum_w"), F.count(F.lit(1)).alias("n_docs"))


def by_article(trim: DataFrame, spans: DataFrame, shift: int = 1) -> DataFrame:
    """layer, article: averages over documents of the attention within each span (doc_id, article, start, end).

    Spans count untrimmed tokens; they are shifted by the dropped first token and clamped at 0.
    """
    s = spans.select(F.col("doc_id").alias("_d"), "article", F.greatest(F.col("start") - shift, F.lit(0)).alias("_s"), F.greatest(F.col("end") - shift, F.lit(0)).alias("_e"))
    hit = trim.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("k") >= F.col("_s")) & (F.col("k") < F.col("_e")))
    doc = hit.groupBy("doc_id", "layer", "article").agg(F.sum("w").alias("s"), F.avg("w").alias("m"))
    return doc.groupBy("layer", "article").agg(F.avg("s").alias("sum_w"), F.avg("m").alias("mean_w"), F.count(F.lit(1)).alias("n_docs"))


def bin_map(att: DataFrame, bin_of) -> DataFrame:
    """qbin, kbin: mean attention of a block over layers and heads, then over documents. ``bin_of(column)`` gives a bin."""
    doc = att.groupBy("doc_id", bin_of(F.col("q")).alias("qbin"), bin_of(F.col("k")).alias("kbin")).agg(F.avg("w").alias("m"))
    return doc.groupBy("qbin", "kbin").agg(F.avg("m").alias("mean_w"), F.count(F.lit(1)).alias("n_docs"))


def absolute_map(att: DataFrame, size: int) -> DataFrame:
    return bin_map(att, lambda c: F.floor(c / size).cast("int"))


def relative_map(att: DataFrame, bins: int) -> DataFrame:
    n = att.groupBy("doc_id").agg((F.max("k") + 1).alias("_n")).filter(F.col("_n") >= bins)
    return bin_map(att.join(n, "doc_id"), lambda c: relative_bin(c, F.col("_n"), bins))


def role_bin(c: Column, n: Column, size: int) -> Column:
    """'first', 'last', or the number of the basket in between, as text: the last token is known by role, not by place."""
    return F.when(c == 0, F.lit("first")).when(c == n - 1, F.lit("last")).otherwise(F.floor((c - 1) / size).cast("int").cast("string"))


def bin_mass(att: DataFrame, size: int) -> DataFrame:
    """layer, qb, kb: attention mass of a block per query row, heads averaged, then averaged over documents."""
    n = att.groupBy("doc_id").agg((F.max("k") + 1).alias("_n"))
    r = att.join(n, "doc_id").withColumn("qb", role_bin(F.col("q"), F.col("_n"), size)).withColumn("kb", role_bin(F.col("k"), F.col("_n"), size))
    # one row per query first: the heads and query rows of a block are counted there
    row = r.groupBy("doc_id", "layer", "head", "q", "qb", "kb").agg(F.sum("w").alias("w"))
    doc = row.groupBy("doc_id", "layer", "qb", "kb").agg(F.avg("w").alias("mass"))
    return doc.groupBy("layer", "qb", "kb").agg(F.avg("mass").alias("mass"), F.count(F.lit(1)).alias("n_docs"))


def layer_average(baskets: DataFrame) -> DataFrame:
    """Mean over layers of each bin that any document reaches."""
    return baskets.filter("n_docs > 0").groupBy("bin").agg(F.avg("mean_w").alias("mean_w"), F.count(F.lit(1)).alias("n_layers"))


def layer_groups(baskets: DataFrame, groups: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean over the layers of each group (first and last layer, from 1, both included)."""
    spark = baskets.sparkSession
    g = spark.createDataFrame([(k, a, b) for k, (a, b) in groups.items()], "layer_group string, lo int, hi int")
    hit = baskets.join(F.broadcast(g), (F.col("layer") + 1 >= F.col("lo")) & (F.col("layer") + 1 <= F.col("hi")))  # a row per group
    return hit.groupBy("layer_group", "bin").agg(F.avg("mean_w").alias("mean_w"))


def weighted_mass(mass: DataFrame, by: list[str]) -> DataFrame:
    """Mass weighted by the documents behind it; 0 where there are none."""
    n = F.sum("n_docs")
    return mass.groupBy(*by).agg(F.when(n > 0, F.sum(F.col("mass") * F.col("n_docs")) / n).otherwise(0.0).alias("mass"), n.alias("n_docs"))


def value_range(values: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Interpolated percentiles of the values that are numbers."""
    return percentiles(values, [], value, {"lo": low, "hi": high})


def compare_curves(curves: DataFrame) -> DataFrame:
    """label, bin, mean_w of several runs, each cut after its last bin with a value."""
    top = F.max(F.when(F.col("mean_w").isNotNull() & ~F.isnan("mean_w"), F.col("bin"))).over(W.partitionBy("label"))
    return curves.withColumn("_top", top).filter("bin <= _top").drop("_top").groupBy("label", "bin").agg(F.avg("mean_w").alias("mean_w"))


# ---- calibration ----


def calibrate(att: DataFrame, size: int, strength: float = 1.0, first_row_only: bool = True, cls_apart: bool = True) -> DataFrame:
    """Each non-empty basket of keys gets equal mass, proportions within it stay; blended with the raw row.

    Key 0 is a basket of its own if ``cls_apart``; without, baskets start at key 0. Basket size and number
    cancel when rows are normalised, so a key's calibrated weight is w / basket sum / number of filled baskets.
    """
    rows = att.filter("q = 0") if first_row_only else att
    basket = F.when(F.col("k") == 0, F.lit(0)).otherwise(1 + F.floor((F.col("k") - 1) / size)) if cls_apart else F.floor(F.col("k") / size)
    key = ["doc_id", "layer", "head", "q"]
    r = rows.withColumn("basket", basket.cast("int"))
    total = F.sum("w").over(W.partitionBy(*key, "basket"))
    r = r.withColumn("_b", total).withColumn("_c", F.when(F.col("_b") > 0, F.col("w") / F.col("_b")).otherwise(0.0))
    r = r.withColumn("_s", F.sum("_c").over(W.partitionBy(*key)))
    return r.select(*key, "k", "w", (strength * F.col("_c") / F.col("_s") + (1 - strength) * F.col("w")).alias("w_cal"))


def calibrate_isolated(att: DataFrame, size: int, bos: float | str | None = "original", eos: float | str | None = "equal", strength: float = 0.5, first_row_only: bool = True) -> DataFrame:
    """The library form: begin and end tokens may stand apart with a share of their own, the content baskets divide the rest.

    A share is a number below 1, "equal" (one part of all baskets and isolated tokens) or "original" (the
    token's own part of the row); None leaves the token in the content.
    """
    fixed = sum(x for x in (bos, eos) if isinstance(x, int | float))
    if fixed >= 1:
        raise ValueError("fixed shares must sum to less than 1")
    key = ["doc_id", "layer", "head", "q"]
    n = att.groupBy("doc_id").agg((F.max("k") + 1).alias("_n"))
    r = (att.filter("q = 0") if first_row_only else att).join(n, "doc_id")
    is_bos = (F.col("k") == 0) if bos is not None else F.lit(False)
    is_eos = (F.col("k") == F.col("_n") - 1) if eos is not None else F.lit(False)
    lead = int(bos is not None)
    apart = lead + int(eos is not None)
    row = W.partitionBy(*key)
    r = r.withColumn("_iso", is_bos | is_eos).withColumn("_row", F.sum("w").over(row))
    parts = F.ceil((F.col("_n") - apart) / size) + apart

    def share(x, hit):
        if x is None:
            return F.lit(0.0)
        if x == "equal":
            return 1 / parts
        return F.sum(F.when(hit, F.col("w") / F.col("_row")).otherwise(0.0)).over(row) if x == "original" else F.lit(float(x))

    r = r.withColumn("_bos", share(bos, is_bos)).withColumn("_eos", share(eos, is_eos))
    r = r.withColumn("_rest", F.greatest(F.lit(0.0), 1 - F.col("_bos") - F.col("_eos")))
    r = r.withColumn("_basket", F.when(F.col("_iso"), F.lit(-1)).otherwise(F.floor((F.col("k") - lead) / size)).cast("int"))
    r = r.withColumn("_b", F.sum("w").over(W.partitionBy(*key, "_basket")))
    inner = F.when(~F.col("_iso") & (F.col("_b") > 0), F.col("w") / F.col("_b")).otherwise(0.0)
    r = r.withColumn("_i", inner).withColumn("_is", F.sum("_i").over(row))
    c = F.when(is_bos, F.col("_bos")).when(is_eos, F.col("_eos")).otherwise(F.when(F.col("_is") > 0, F.col("_rest") * F.col("_i") / F.col("_is")).otherwise(0.0))
    r = r.withColumn("_c", c).withColumn("_cs", F.sum("_c").over(row))
    return r.select(*key, "k", "w", (strength * F.col("_c") / F.col("_cs") + (1 - strength) * F.col("w")).alias("w_cal"))


def calibrated_layers(n_layers: int, which: str = "last_half") -> list[int]:
    """The layers that are calibrated: the upper half, or the last."""
    if which not in ("last_half", "last"):
        raise ValueError("calibrated layers are 'last_half' or 'last'")
    return list(range(n_layers // 2 if which == "last_half" else n_layers - 1, n_layers))


def sequence_counts(lengths: DataFrame, size: int, length: str = "valid_len") -> DataFrame:
    """How many sequences are shorter than a basket, and all."""
    return lengths.agg(F.count_if(F.col(length) < size).alias("n_short"), F.count(F.lit(1)).alias("n_total"))
