"""Experiment design: filters by length, samples of segments, permutations and switches."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .ranks import dense_number
from .sets import SequenceCounts, SetCounts, dealt, mixed


def length_range(segments: DataFrame, lo: int, hi: int, length: str = "token_length") -> DataFrame:
    return segments.filter(F.col(length).between(lo, hi))


def position_pools(segments: DataFrame, ranges: list[tuple[int, int]], length: str = "token_length") -> DataFrame:
    """pos and the segments whose length is in that position's range."""
    r = segments.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "pos int, lo int, hi int")
    return segments.join(F.broadcast(r), F.col(length).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")  # a row per position


def parallel_lengths(segments: DataFrame, source: str, targets: dict[str, float], length: str = "token_length") -> DataFrame:
    """dataset_idx of which every target language has a length within its tolerance of the source's, bounds included."""
    spark = segments.sparkSession
    tol = spark.createDataFrame(list(targets.items()), "lang string, tol double")
    s = segments.filter(F.col("lang") == source).select("dataset_idx", F.col(length).alias("_s"))
    t = segments.join(F.broadcast(tol), "lang").join(s, "dataset_idx")  # a row per language
    ok = t.filter(F.col(length).between(F.col("_s") * (1 - F.col("tol")), F.col("_s") * (1 + F.col("tol"))))
    return ok.groupBy("dataset_idx").agg(F.countDistinct("lang").alias("_n")).filter(F.col("_n") == len(targets)).select("dataset_idx")


def pair_length_similar(a: Column, b: Column, tolerance: float = 0.15) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(a, b)


def rounded_sample(n: int | Column, k: int) -> int | Column:
    """The next multiple of k! from n on: every set gives all its permutations."""
    if isinstance(n, Column):
        return F.ceil(n / factorial(k)) * factorial(k)
    return -(-n // factorial(k)) * factorial(k)


def draw(*columns: Column | str, seed: int = 0) -> Column:
    """A number that depends on the columns and the seed alone; md5, so that other engines draw the same."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


#: Sets that a task makes at once, and sets of a partition, about.
MADE, PER_TASK = 2_000, 50_000
#: Segments of a block, about, and sets of a partition, about, where all sets are made.
BLOCK, PER_MEETINGS = 1024, 5_000_000


def _lengths(pool: DataFrame, ident: str, length: str, max_total: int | None) -> DataFrame:
    """_id, _n: every segment once, with its length (null: 0; all 0 without a cap, as then lengths don't matter)."""
    n = F.lit(0).cast("long") if max_total is None else _length(length)
    return pool.filter(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_id")).agg(F.min(n).alias("_n"))


def _length(length: str) -> Column:
    return F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long")


def _counts(rows: DataFrame, k: int, max_total: int | None) -> SetCounts:
    """The table of the sets that fit: of each length up to the cap, how many segments have it (no more rows than the cap)."""
    cap = 0 if max_total is None else max(0, max_total)
    histogram = rows.filter(F.col("_n") <= cap).groupBy("_n").agg(F.count(F.lit(1)).alias("c")).collect()
    return SetCounts([(r["_n"], r["c"]) for r in histogram], k, cap)


def feasible_sets(pool: DataFrame, k: int, max_total: int | None = None, ident: str = "seg_id", length: str = "token_length") -> int | float:
    """How many sets of k different segments there are whose lengths sum to the cap at most (a double from 2^62 on)."""
    return _counts(_lengths(pool, ident, length, max_total), k, max_total).total


def sampled_sets(pool: DataFrame, k: int, n_sets: int, max_total: int | None = None, seed: int = 0, ident: str = "seg_id", length: str = "token_length") -> DataFrame:
    """set_no, segs: ``n_sets`` sets of k different segments, no two equal, whose lengths sum to the cap at most, every
    such set as likely as another; all there are, where there are no more. Members stand in a drawn order.

    Sets are made from their numbers (``operators.sets``), so that none is drawn in vain; segments are joined to them by
    length and place, and no task holds the pool. A pool of fewer than k segments gives sequences in which segments
    come more than once, and the same sequence may come again.
    """
    spark = pool.sparkSession
    rows = _lengths(pool, ident, length, max_total)
    short = [tuple(r) for r in rows.limit(k).collect()]
    none = pool.select(F.lit(0).cast("long").alias("set_no"), F.array(ident).alias("segs")).limit(0)
    if n_sets < 1 or not short or (max_total is not None and max_total < 0):
        return none
    if len(short) < k:
        return _sequences(spark, sorted(short), k, n_sets, max_total, seed, pool.schema[ident].dataType.simpleString())
    counts = _counts(rows, k, max_total)
    if counts.total < 1:
        return none
    sets = _numbered_sets(spark, counts, 0, min(n_sets, counts.total) if counts.exact else n_sets, seed)
    if not counts.exact:
        # numbers no longer tell sets apart: of equal ones the first stays, and draws go on for those that are missing
        first = lambda x: x.groupBy("set_no").agg(F.array_sort(F.collect_list(F.struct("_n", "_i"))).alias("_k")).groupBy("_k").agg(F.min("set_no").alias("set_no"))
        drawn = n_sets
        while (lacking := n_sets - first(sets).count()) > 0:
            sets = sets.unionByName(_numbered_sets(spark, counts, drawn, drawn + lacking, seed))
            drawn += lacking
        sets = sets.join(dense_number(first(sets).select("set_no"), "set_no", "_no"), "set_no").drop("set_no").withColumnRenamed("_no", "set_no")
    places = dense_number(rows.withColumn("_h", F.xxhash64("_id")), "_h", "_i", ["_n"])
    members = sets.join(places, ["_n", "_i"]).withColumn("_h", draw("set_no", "_id", seed=seed))
    return members.groupBy("set_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("_h", "_id"))), lambda x: x["_id"]).alias("segs"))


def all_sets(pool: DataFrame, k: int, max_total: int, ident: str = "seg_id", length: str = "token_length") -> DataFrame:
    """segs (ascending), total: every set of k different segments whose lengths sum to the cap at most. A segment that is
    given more than once gives its sets as often, as in a join of the rows.

    Segments of a length are packed into blocks; blocks that fit together, by length and number, meet k at a time, and each
    meeting gives its sets. What is shuffled is k blocks for BLOCK ** k sets; meetings are dealt to tasks by the number of sets.
    """
    given = pool.filter(F.col(ident).isNotNull()).select(F.col(ident).alias("_id"), _length(length).alias("_n"))
    rows = saved(given.filter(F.col("_n") <= max_total), "short")
    total = _counts(rows, k, max_total).total if max_total >= 0 else 0
    sizes = rows.groupBy("_n").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_many"))  # no more rows than the cap
    rows = rows.join(F.broadcast(sizes), "_n").select("_id", F.struct("_n", F.pmod(F.xxhash64("_id"), F.col("_many")).alias("_b")).alias("_t"))
    blocks, keys = rows.groupBy("_t").agg(F.sort_array(F.collect_list("_id")).alias("_ids")), rows.select("_t").distinct()
    met = keys.select(F.col("_t").alias("_t0"), F.col("_t._n").alias("total"))
    for j in range(1, k):
        more = keys.withColumnRenamed("_t", f"_t{j}")
        met = met.join(more, (F.col(f"_t{j}") >= F.col(f"_t{j - 1}")) & (F.col("total") + F.col(f"_t{j}._n") <= max_total)).withColumn("total", F.col("total") + F.col(f"_t{j}._n"))
    for j in range(k):
        met = met.join(blocks.withColumnsRenamed({"_t": f"_t{j}", "_ids": f"_ids{j}"}), f"_t{j}")
    met = met.repartition(max(1, int(total // PER_MEETINGS)))
    for j in range(k):
        met = met.withColumn(f"_s{j}", F.explode(f"_ids{j}")).drop(f"_ids{j}")
        if j:  # within a block each set comes once; one segment of two lengths lies in two blocks
            met = met.filter((F.col(f"_t{j}") != F.col(f"_t{j - 1}")) | (F.col(f"_s{j}") > F.col(f"_s{j - 1}")))
        for i in range(j):
            met = met.filter(F.col(f"_s{j}") != F.col(f"_s{i}"))
    return met.select(F.array_sort(F.array(*[f"_s{j}" for j in range(k)])).alias("segs"), "total")


def _numbered_sets(spark, counts: SetCounts, start: int, stop: int, seed: int) -> DataFrame:
    """set_no, _n, _i: the k members of each set from ``start`` up to ``stop``, as length and place."""
    table = spark.sparkContext.broadcast(counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = table.value
        for b in batches:
            every = b.column(0).to_numpy()
            for at in range(0, len(every), MADE):
                ids = every[at : at + MADE]
                n, i = c.sets(dealt(ids, c.total, seed) if c.exact else ids, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, c.k)), pa.array(n.ravel()), pa.array(i.ravel())], names=["set_no", "_n", "_i"])

    return spark.range(start, stop, 1, max(1, (stop - start) // PER_TASK)).mapInArrow(make, "set_no long, _n long, _i long")


def _sequences(spark, rows: list[tuple], k: int, n_sets: int, max_total: int | None, seed: int, kind: str) -> DataFrame:
    """Sequences of a pool of fewer than k segments."""
    counts = SequenceCounts([n for _, n in rows], k, 0 if max_total is None else max_total)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            high, low = mixed(ids, 2 * seed + 1).tolist(), mixed(ids, 2 * seed + 2).tolist()
            at = [counts.sequence(((h << 64) | x) % counts.total) for h, x in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32()))], names=["set_no", "at"])

    pool = F.array(*[F.lit(r[0]).cast(kind) for r in rows])
    return spark.range(n_sets if counts.total else 0).mapInArrow(make, "set_no long, at array<int>").select("set_no", F.transform("at", lambda i: F.get(pool, i)).alias("segs"))


def permutation_table(spark, k: int) -> DataFrame:
    """perm, pos, slot: all k! orders, in the order of the words that they spell."""
    return spark.range(factorial(k)).select(F.col("id").cast("int" if k < 13 else "long").alias("perm"), F.posexplode(_order(F.col("id"), k)).alias("pos", "slot"))


def _order(number: Column, k: int) -> Column:
    """The order of 0 to k - 1 that has this number: each digit of the number, in the base of the places left, picks one."""
    state = F.struct(F.array(*[F.lit(i) for i in range(k)]).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(s, f):
        at = F.pmod(F.floor(number / f), F.size(s["left"])).cast("int")
        pick = F.get(s["left"], at)
        return F.struct(F.filter(s["left"], lambda x: x != pick).alias("left"), F.array_append(s["out"], pick).alias("out"))

    digits = F.array(*[F.lit(factorial(k - 1 - i)).cast("long") for i in range(k)])
    return F.aggregate(digits, state, step, lambda s: s["out"])


def permuted(sets: DataFrame, k: int) -> DataFrame:
    """set_no, perm, segs: each set in all orders. The orders are made row by row, so that k sets no bound."""
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(factorial(k) - 1).cast("long"))
    each = sets.select("set_no", "segs", F.explode(numbers).alias("perm"))
    return each.select("set_no", F.col("perm").cast("int" if k < 13 else "long").alias("perm"), F.transform(_order(F.col("perm"), k), lambda s: F.get("segs", s)).alias("segs"))


def switched(sets: DataFrame) -> DataFrame:
    """set_no, form, segs: each set as it is and with its first and last segments exchanged."""
    n = F.size("segs")
    swap = F.transform("segs", lambda x, i: F.when(i == 0, F.get("segs", n - 1)).when(i == n - 1, F.get("segs", F.lit(0))).otherwise(x))
    return sets.select("set_no", F.posexplode(F.array("segs", swap)).alias("form", "segs"))


def independent_draws(pools: DataFrame, n: int, seed: int = 0, ident: str = "seg_id") -> DataFrame:
    """doc_no, segs: a draw from each position's pool for each document; a segment may come twice."""
    p = dense_number(pools, ident, "_i", ["pos"])
    size = p.groupBy("pos").agg(F.count(F.lit(1)).alias("_n"))
    spark = pools.sparkSession
    want = spark.range(n).withColumnRenamed("id", "doc_no").join(F.broadcast(size))  # a row per position
    want = want.withColumn("_i", F.pmod(F.conv(F.substring(draw("doc_no", "pos", seed=seed), 1, 12), 16, 10).cast("long"), F.col("_n")))
    got = want.join(p, ["pos", "_i"])
    return got.groupBy("doc_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", ident))), lambda s: s[ident]).alias("segs"))


def substituted(perms: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first segment of each order replaced by its translation (seg_id, pair_id), where it has one."""
    p = pairs.select(F.col("seg_id").alias("_s"), F.col("pair_id").alias("_p"))
    out = perms.join(p, F.get("segs", F.lit(0)) == F.col("_s"), "left")
    rest = F.slice("segs", 2, F.greatest(F.size("segs") - 1, F.lit(0)))
    return out.withColumn("segs", F.when(F.col("_p").isNotNull(), F.concat(F.array("_p"), rest)).otherwise(F.col("segs"))).drop("_s", "_p")


def mixed_language_ids(segs: Column, source: str, target: str | None = None) -> Column:
    """Segment numbers with a language: the first position in the target language, the others in the source's."""
    return F.transform(segs, lambda x, i: F.concat(x.cast("string"), F.when(i == 0, F.lit(target or source)).otherwise(F.lit(source))))


def used_segments(docs: DataFrame, segs: str = "segs") -> DataFrame:
    """The distinct segments that documents use."""
    return docs.select(F.explode(segs).alias("seg_id")).distinct()
