"""Sharding by sampled splitters: near-equal bytes, equal texts side by side.

The key of a record is a hash of its text, then a hash of its id. A sample of keys, each drawn with a
probability in proportion to the record's size, gives quantile boundaries of many fine ranges. The bytes of
every range are then counted over all records; a range with more than its part (a hot text, or chance) is
subdivided by more bits of the key, and where all texts are equal by the hash of the id. Ranges in key order
go to shards by their running bytes.

Equal texts are in one shard unless a shard's border falls into their range or, when they have more than a range's
part of all bytes, among their subdivisions: then they are in neighbouring shards, as sizes go first.

Defined results: a null text has no bytes (size 1) and the checksum of the empty text; a null doc_id is a
value like others; records that agree in id and text are numbered and told apart by that; an empty table gives an
empty result; columns named as those added are replaced.
"""

from __future__ import annotations

from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, stash

#: Fine ranges per shard, at least and at most, and rows for each more; keys drawn per range; parts of an overfull range
#: of several texts.
RANGES_PER_SHARD, MOST_RANGES, RANGE_ROWS, DRAWN_PER_RANGE, PARTS = 64, 1024, 20_000, 16, 64


def _range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key, found in two steps through literal arrays."""
    step = max(64, isqrt(len(splitters)))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    if not blocks:
        return F.lit(0)
    array = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    block = F.greatest(F.size(F.filter(array([b[0] for b in blocks]), lambda s: s <= key)) - 1, F.lit(0))
    inner = F.get(F.array(*[array(b) for b in blocks]), block)
    return block * step + F.size(F.filter(inner, lambda s: s <= key))


def shard(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with size, text_crc32, shard and slot.

    The driver holds the sampled keys (DRAWN_PER_RANGE for each range, of which a shard has MOST_RANGES at most) and a
    line for each subdivision.
    """
    added = ["size", "text_crc32", "shard", "slot"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stash(docs.select(
        F.struct(*carry).alias("_row"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(t), 2).alias("_t"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null")), t).alias("_g"), F.spark_partition_id().alias("_i")), "shard")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not total:
        return rows.select("_row.*", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows = numbered(rows, "_g", "_i", "_o").withColumn("_d", F.when(F.col("_o") == 0, F.col("_g")).otherwise(F.xxhash64("_g", "_o"))).drop("_g", "_i", "_o")
    # 1. keys drawn in proportion to size
    n_ranges = shards * min(MOST_RANGES, max(RANGES_PER_SHARD, count // (shards * RANGE_ROWS)))
    chance = F.col("size") * (n_ranges * DRAWN_PER_RANGE / total)
    drawn = (F.xxhash64(F.lit("draw"), "_d").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < chance
    keys = sorted(r[0] for r in rows.filter(drawn).select("_t").collect())
    splitters = sorted({keys[len(keys) * i // n_ranges] for i in range(1, n_ranges)}) if keys else []
    ranged = rows.withColumn("_r", _range_of(F.col("_t"), splitters))
    # 2. exact bytes of each range; overfull ones are subdivided
    full = {r["_r"]: (r["b"], r["lo"], r["hi"]) for r in ranged.groupBy("_r").agg(F.sum("size").alias("b"), F.min("_t").alias("lo"), F.max("_t").alias("hi")).collect()}
    part = total / n_ranges
    one = [k for k, (b, lo, hi) in full.items() if b > part and lo == hi]
    many = [k for k, (b, lo, hi) in full.items() if b > part and lo < hi]
    # of several texts, their places among the texts of the range; one heavy text among them is dealt by id within its place
    spans = {k: (full[k][1], (full[k][2] - full[k][1]) // PARTS + 1) for k in many}
    lo = F.create_map(*[F.lit(x) for k, (a, _) in spans.items() for x in (k, a)]) if spans else None
    width = F.create_map(*[F.lit(x) for k, (_, w) in spans.items() for x in (k, w)]) if spans else None
    place = F.when(F.col("_r").isin(one), F.lit(0)) if one else F.when(F.lit(False), F.lit(0))
    if spans:
        place = place.when(F.col("_r").isin(many), F.floor((F.col("_t") - F.element_at(lo, F.col("_r"))) / F.element_at(width, F.col("_r"))).cast("int"))
    cut = ranged.withColumn("_p", place.otherwise(F.lit(0)))
    heavy = [] if not many else [tuple(r) for r in cut.filter(F.col("_r").isin(many)).groupBy("_r", "_p").agg(F.sum("size").alias("b")).filter(F.col("b") > part).collect()]
    # heavy texts, in as many parts by the hash of the id as their bytes are of a range's
    parts = [(k, 0, int(full[k][0] / part) + 1) for k in one] + [(r, p, int(b / part) + 1) for r, p, b in heavy]
    hot = docs.sparkSession.createDataFrame(parts, "_r int, _p int, _parts long")
    cut = cut.join(F.broadcast(hot), ["_r", "_p"], "left")  # fewer than two lines a range
    cut = cut.withColumn("_q", F.coalesce(F.pmod(F.col("_d"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    # 3. subdivisions in key order to shards, by the bytes up to their middle
    units = sorted((r["_r"], r["_p"], r["_q"], r["b"], r["n"]) for r in cut.groupBy("_r", "_p", "_q").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect())
    ends = list(accumulate(u[3] for u in units))
    to = [min(shards - 1, int((e - u[3] / 2) * shards / total)) for u, e in zip(units, ends, strict=True)]
    seen: dict[int, int] = {}
    plan = []
    for (r, p, q, _, n), s in zip(units, to, strict=True):
        plan.append((r, p, q, s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    spark = docs.sparkSession
    dealt = spark.createDataFrame(plan, "_r int, _p int, _q int, shard int, _first long")
    # slots: places within a subdivision, after those of the subdivisions before it
    within = F.row_number().over(W.partitionBy("_r", "_p", "_q").orderBy("_t", "_d"))
    out = cut.withColumn("_n", within).join(F.broadcast(dealt), ["_r", "_p", "_q"])  # a line per subdivision, counted above
    # in two steps, so that no name of the caller's is taken for one of these
    added = F.struct("size", "text_crc32", "shard", (F.col("_first") + F.col("_n") - 1).alias("slot"))
    return out.select("_row", added.alias("_added")).select("_row.*", "_added.*")
