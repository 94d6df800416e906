"""Similarity of documents to their segments by position, and leakage between positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distributions import t_crit, t_greater
from ..functions.vectors import cosine, truncate


def complete_segments(segments: DataFrame, standalone: DataFrame) -> DataFrame:
    """doc_id, pos, seg_id, seg_emb of documents all of whose segments have an embedding.

    A segment that a document has twice is recorded both times at its last position.
    """
    doc, pair = W.partitionBy("doc_id"), W.partitionBy("doc_id", "seg_id")
    s = standalone.select("seg_id", F.col("embedding").alias("seg_emb"))
    joined = segments.select("doc_id", "pos", "seg_id").join(s, "seg_id", "left")
    joined = joined.withColumn("_have", F.count("seg_emb").over(doc)).withColumn("_all", F.count(F.lit(1)).over(doc))
    return joined.filter("_have = _all").withColumn("pos", F.max("pos").over(pair)).select("doc_id", "pos", "seg_id", "seg_emb")


def position_similarities(segments: DataFrame, standalone: DataFrame, document: DataFrame, dims: list[int] | None = None) -> DataFrame:
    """doc_id, seg_id, pos, (dim,) sim: cosine of the document's embedding with each of its segments'."""
    d = document.select("doc_id", F.col("embedding").alias("doc_emb"))
    return _sims(complete_segments(segments, standalone).join(d, "doc_id"), "doc_emb", "seg_emb", dims)


def late_similarities(segments: DataFrame, standalone: DataFrame, late: DataFrame, dims: list[int] | None = None) -> DataFrame:
    """The same with the segment's embedding within the document in place of the document's."""
    d = late.select("doc_id", "pos", F.col("embedding").alias("late_emb"))
    return _sims(complete_segments(segments, standalone).join(d, ["doc_id", "pos"]), "late_emb", "seg_emb", dims)


def _sims(joined: DataFrame, a: str, b: str, dims: list[int] | None) -> DataFrame:
    if dims is None:
        return joined.select("doc_id", "seg_id", "pos", cosine(F.col(a), F.col(b)).alias("sim"))
    wide = joined.withColumn("dim", F.explode(F.array(*map(F.lit, dims))))
    return wide.select("doc_id", "seg_id", "pos", "dim", cosine(truncate(F.col(a), F.col("dim")), truncate(F.col(b), F.col("dim"))).alias("sim"))


def profile(sims: DataFrame, by: list[str] | None = None, value: str = "sim") -> DataFrame:
    """n, mean, population std and 95 % interval of the mean for each group; with one value the interval is the mean."""
    by = by or ["pos"]
    g = sims.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_sim"), F.stddev_pop(value).alias("std_pop"))
    half = F.when(F.col("n") > 1, t_crit(F.col("n") - 1) * F.col("std_pop") / F.sqrt("n")).otherwise(F.lit(0.0))
    return g.withColumn("ci_low", F.col("mean_sim") - half).withColumn("ci_high", F.col("mean_sim") + half)


def leakage_pairs(late: DataFrame, standalone: DataFrame, dims: list[int] | None = None) -> DataFrame:
    """doc_id, src, dst, (dim,) sim for ordered positions src <> dst: a source segment alone against a target within the document.

    Documents with one position have no pairs.
    """
    s = standalone.select("seg_id", F.col("embedding").alias("seg_emb"))
    a = late.select("doc_id", F.col("pos").alias("src"), "seg_id").join(s, "seg_id").select("doc_id", "src", "seg_emb")
    b = late.select(F.col("doc_id").alias("_d"), F.col("pos").alias("dst"), F.col("embedding").alias("late_emb"))
    pairs = a.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("src") != F.col("dst"))).drop("_d")
    if dims is None:
        return pairs.select("doc_id", "src", "dst", cosine(F.col("seg_emb"), F.col("late_emb")).alias("sim"))
    pairs = pairs.withColumn("dim", F.explode(F.array(*map(F.lit, dims))))
    return pairs.select("doc_id", "src", "dst", "dim", cosine(truncate(F.col("seg_emb"), F.col("dim")), truncate(F.col("late_emb"), F.col("dim"))).alias("sim"))


def _when(cond: Column) -> Column:
    return F.when(cond, F.col("sim"))


def directional_leakage(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and means of forward (src before dst) and backward similarities; 0 where there are none."""
    ahead = F.col("src") < F.col("dst")
    agg = [
        F.count(_when(ahead)).alias("n_forward"), F.coalesce(F.avg(_when(ahead)), F.lit(0.0)).alias("forward"),
        F.count(_when(~ahead)).alias("n_backward"), F.coalesce(F.avg(_when(~ahead)), F.lit(0.0)).alias("backward"),
    ]
    return pairs.groupBy(*by).agg(*agg) if by else pairs.agg(*agg)


def leakage_test(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Student's t of forward against backward with equal variances, forward greater, for each group if there are some."""
    ahead = F.col("src") < F.col("dst")
    aggs = [f(_when(c)).alias(f"{k}{s}") for s, c in (("f", ahead), ("b", ~ahead)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    g = pairs.groupBy(*by).agg(*aggs) if by else pairs.agg(*aggs)
    df = F.col("nf") + F.col("nb") - 2
    pooled = ((F.col("nf") - 1) * F.col("vf") + (F.col("nb") - 1) * F.col("vb")) / df
    t = (F.col("mf") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("nf") + 1 / F.col("nb")))
    out = g.select(*(by or []), F.col("mf").alias("forward"), F.col("mb").alias("backward"), t.alias("t"), df.alias("df"))
    return out.withColumn("p_value", t_greater(F.col("t"), F.col("df"))).withColumn("significant", F.col("p_value") < 0.05)


def positional_leakage(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per source position: mean similarity to later and to earlier positions, 0 where there are none."""
    ahead = F.col("src") < F.col("dst")
    zero = F.lit(0.0)
    return pairs.groupBy(*(by or []), F.col("src").alias("pos")).agg(
        F.coalesce(F.avg(_when(ahead)), zero).alias("forward"), F.coalesce(F.avg(_when(~ahead)), zero).alias("backward"))


def leakage_map(pairs: DataFrame) -> DataFrame:
    """Mean similarity of each (source, target) pair of positions."""
    return pairs.groupBy("src", "dst").agg(F.avg("sim").alias("mean_sim"), F.count("sim").alias("n"))


def leakage_line(positional: DataFrame) -> DataFrame:
    """Means over positions without the last one's forward and the first one's backward, which are empty by construction."""
    ends = positional.agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))  # one row
    p = positional.join(F.broadcast(ends))
    return p.agg(F.avg(F.when(F.col("pos") < F.col("_hi"), F.col("forward"))).alias("forward"), F.avg(F.when(F.col("pos") > F.col("_lo"), F.col("backward"))).alias("backward"))


def similarity_limits(values: DataFrame, value: str, by: list[str] | None = None, margin: float = 0.01) -> DataFrame:
    """Least and greatest value with a margin, within [-1, 1]."""
    agg = [F.greatest(F.min(value) - margin, F.lit(-1.0)).alias("lo"), F.least(F.max(value) + margin, F.lit(1.0)).alias("hi")]
    return values.groupBy(*by).agg(*agg) if by else values.agg(*agg)


def histogram(values: DataFrame, value: str, bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """Counts in bins of equal width between the least and greatest value; the last bin holds the greatest."""
    by = by or []
    ends = values.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")) if by else values.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = values.filter(F.col(value).isNotNull()).join(F.broadcast(ends), by or None)  # a row per group
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return v.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def axis_limits(profile: DataFrame, margin: float = 0.05) -> DataFrame:
    """lo, hi: the ends of all intervals of a profile, and a margin of their distance on either side."""
    lo, hi = F.col("_a"), F.col("_b")
    return profile.agg(F.min("ci_low").alias("_a"), F.max("ci_high").alias("_b")).select((lo - margin * (hi - lo)).alias("lo"), (hi + margin * (hi - lo)).alias("hi"))


def later_and_earlier(pairs: DataFrame) -> DataFrame:
    """pos, later, earlier: how many positions each position (src) is compared with after and before it (dst)."""
    at = lambda c: F.countDistinct(F.when(c, F.col("dst")))
    return pairs.groupBy(F.col("src").alias("pos")).agg(at(F.col("dst") > F.col("src")).alias("later"), at(F.col("dst") < F.col("src")).alias("earlier"))
