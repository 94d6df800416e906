"""Connected components of links between long ids, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, small, stash


#: Links that one task joins by itself: two numbers each, counted before.
FEW_LINKS = 100_000


def _by_one_task(links: DataFrame) -> DataFrame:
    """The same from few links, by union and find."""
    import pyarrow as pa

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        ids = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "root"])

    return stash(links.select("a", "b").filter("a <> b").coalesce(1).mapInArrow(run, "id long, root long"), "roots")


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b. One row per id that has a link: id, root (the smallest id of its component).

    A few links are joined in one task. Of more it alternates large-star and small-star steps until nothing would change; the number of rounds grows with the
    logarithm of the longest chain. What a round leaves is written to the shared folder.
    """
    if links.count() <= FEW_LINKS:
        return _by_one_task(links)
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        # pairs (a, b) with b smaller: a state is final when every a has one b and no b is an a
        ends = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
        both = edges.select(F.inline(ends))
        up = F.count_if(F.col("y") < F.col("x"))
        nodes = stash(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), up.alias("up"), (F.count(F.lit(1)) - up).alias("down")), "nodes")
        if nodes.filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        # large star: all larger neighbours of x are hung on the smallest of x and its neighbours, and x itself
        own = nodes.select(F.col("x").alias("a"), F.col("m").alias("b"))
        hung = both.filter("y > x").join(small(own.withColumnRenamed("b", "m")), F.col("x") == F.col("a")).select(F.col("y").alias("a"), F.col("m").alias("b"))
        large = hung.unionByName(own).filter("a <> b")
        # small star: all smaller neighbours of a, and a itself, on the smallest of them
        least = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))
        joined = large.join(least.hint("merge"), F.col("a") == F.col("_a"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        old, edges = edges, stash(joined.select(F.inline(pairs)).filter("a <> b").distinct(), "edges")
        drop(old, nodes)
    drop(nodes)
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stash(roots.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()), "roots")
