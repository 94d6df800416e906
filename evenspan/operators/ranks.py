"""Numbers, ranks and order statistics, without ordering a whole table or a large group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import dropped, saved

#: Rows that one task orders, about.
BLOCK = 1_000_000
#: Bits that a pass settles after the first, which settles all but 3 * DIGIT of the 64.
DIGIT = 14
#: Values of a bucket that are put in order instead of being counted once more.
FEW = 1000
#: Targets of a pass are broadcast if, counted, they are at most so many; else the join shuffles.
MOST_SENT = 100_000


def ordered_bits(x: Column) -> Column:
    """The bits of a double as a whole number that rises with it: those of its size, negative below zero. Both zeros
    are 0, infinity is beyond all numbers; x is no NaN. As Spark has no function for the bits they are made of exponent and fraction."""
    every = F.abs(x)
    size = F.when(every == float("inf"), F.lit(1.0)).otherwise(every)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("int")
    two = F.lit(2.0)
    # the logarithm is rounded, so that next to a power of two it may name the neighbour
    exponent = F.when(F.pow(two, guess) > size, F.greatest(guess - 1, F.lit(-1022))).when((guess < 1023) & (F.pow(two, F.least(guess + 1, F.lit(1023))) <= size), guess + 1).otherwise(guess)
    lifted = (exponent + 1023).cast("long") * F.lit(1 << 52) + ((size / F.pow(two, exponent) - 1) * F.lit(float(1 << 52))).cast("long")
    tiny = (F.least(size, F.lit(2.0**-1022)) * F.lit(2.0**1000) * F.lit(2.0**74)).cast("long")  # below 2^-1022 the size is so many times 2^-1074
    bits = F.when(every == float("inf"), F.lit(0x7FF << 52)).when(size < 2.0**-1022, tiny).otherwise(lifted)
    return F.when(x < 0, -bits).otherwise(bits)


def block_of(rows: DataFrame, order: str, block: int = BLOCK) -> Column:
    """A number that rises with ``order`` (a number, null last) and takes about ``block`` rows: blocks lie between sampled quantiles."""
    parts = rows.count() // block + 1
    cuts = sorted(set(rows.approxQuantile(order, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order)))


def sum_before(rows: DataFrame, group: list[str], order: str, block: str, weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows of the group that come before, by ``order``. ``block`` is a
    number that rises with it: rows are ordered within blocks, and a block starts from the sums of those before."""
    sums = rows.groupBy(*group, block).agg(F.sum(weight).alias("_base"))
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))  # a row per block
    sums = sums.withColumn("_base", F.coalesce(F.sum("_base").over(over.orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = W.partitionBy(*group, block).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("_within", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    joined = out.alias("_rows").join(sums.alias("_sums"), [F.col(f"_rows.{c}").eqNullSafe(F.col(f"_sums.{c}")) for c in (*group, block)])
    return joined.select("_rows.*", "_sums._base").withColumn(name, F.col("_within") + F.col("_base")).drop("_within", "_base")


def dense_number(keys: DataFrame, order: str, name: str, group: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Rows with their number from 0 in order, within each group if there is one. ``order`` is a number."""
    group = group or []
    at = block_of(keys, order, block)
    return sum_before(keys.withColumn("_b", at), group, order, "_b", F.lit(1), name).withColumn(name, F.col(name).cast("long")).drop("_b")


def percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row for each group that has numbers: exact interpolated percentiles of the values, by name. Nulls and NaN are left
    out; infinite values are ordinary ones (between two that differ, one of them infinite, the percentile is not finite).

    Radix selection: values are counted by the first bits of their order, then, of the buckets that hold a wanted place, by
    further bits, until a bucket has one value, or FEW at most, which are put in order. No other values meet in a task.
    """
    x = F.col(value).cast("double")
    # one zero: the two that there are have one place, and they are told apart nowhere
    v = rows.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.when(x == 0, F.lit(0.0)).otherwise(x).alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    v = saved(v.withColumn("_bits", ordered_bits(F.col("_x"))), "values")
    g = [f"_g{i}" for i in range(len(group))]
    count = [F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    over = W.partitionBy(*g) if g else W.partitionBy(F.lit(0))  # a row for each bucket
    shift = 3 * DIGIT
    buckets = v.groupBy(*g, F.shiftright("_bits", shift).alias("_p")).agg(*count)
    buckets = buckets.withColumns({"_n": F.sum("_c").over(over), "_w": F.coalesce(F.sum("_c").over(over.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    place = {n: (F.col("_n") - 1) * F.lit(float(p)) for n, p in shares.items()}
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in place.values()])))
    held = F.filter(wanted, lambda at: (at >= F.col("_w")) & (at < F.col("_w") + F.col("_c")))
    targets = saved(buckets.select(*g, "_n", "_p", "_w", "_c", "_lo", "_hi", F.explode(held).alias("_at")), "targets")

    def with_values(some: DataFrame, fits: Column) -> DataFrame:
        """The values that lie in a target's bucket, with the target."""
        some = some.select(*[F.col(c).alias(f"_t{c}") for c in g], *[F.col(c).alias(f"_t{c}") for c in ("_n", "_p", "_w", "_at", "_lo", "_hi")])
        some = F.broadcast(some) if some.count() <= MOST_SENT else some
        on = fits
        for c in g:
            on = on & F.col(c).eqNullSafe(F.col(f"_t{c}"))
        return v.join(some, on)

    named = [*[F.col(f"_t{c}").alias(c) for c in g], F.col("_t_n").alias("_n"), F.col("_t_w").alias("_base"), F.col("_t_at").alias("_at")]
    spread = (F.col("_c") > FEW) & (F.col("_lo") < F.col("_hi"))
    while shift and not (more := targets.filter(spread)).isEmpty():
        near = with_values(more, F.shiftright("_bits", shift) == F.col("_t_p"))
        shift -= DIGIT
        split = near.groupBy(*named, F.shiftright("_bits", shift).alias("_p")).agg(*count)
        each = W.partitionBy(*g, "_at").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # at most 2^DIGIT buckets
        split = split.withColumn("_w", F.col("_base") + F.coalesce(F.sum("_c").over(each), F.lit(0))).filter("_at >= _w and _at < _w + _c")
        old, targets = targets, saved(targets.filter(~spread).unionByName(split.select(*targets.columns)), "targets")
        dropped(old)
    sure = targets.filter("_lo = _hi").select(*g, "_n", "_at", F.col("_lo").alias("_v"))
    # a bucket that few values share may have been settled by fewer bits than others, so its bounds tell what lies in it
    few = with_values(targets.filter("_lo < _hi"), (F.col("_x") >= F.col("_t_lo")) & (F.col("_x") <= F.col("_t_hi")))
    few = few.groupBy(*named).agg(F.sort_array(F.collect_list("_x")).alias("_l")).select(*g, "_n", "_at", F.get("_l", (F.col("_at") - F.col("_base")).cast("int")).alias("_v"))

    def at(p: Column) -> Column:
        lo, hi = (F.max(F.when(F.col("_at") == f(p).cast("long"), F.col("_v"))) for f in (F.floor, F.ceil))
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.max(p - F.floor(p)))

    out = sure.unionByName(few).groupBy(*g).agg(*[at(p).alias(n) for n, p in place.items()])
    out = saved(out.select(*[F.col(c).alias(group[i]) for i, c in enumerate(g)], *shares), "percentiles")
    dropped(v, targets)
    return out
