"""What the operators of this folder share: scratch tables, words, small joins."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A side of a join is broadcast only if it was counted and has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 48_000_000
#: Rows that a Python worker gets at once.
ARROW_ROWS = 1000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset a local master gets
    /tmp/checkpoints (tests); on a cluster that would be another folder on each machine, so there it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or "/tmp/checkpoints").rstrip("/")


#: Where the tables written now are noted, if anywhere: the list of a run that deletes them itself.
_noting: ContextVar[list[str] | None] = ContextVar("noting", default=None)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds the paths of the tables written within to ``paths``."""
    token = _noting.set(paths)
    try:
        yield
    finally:
        _noting.reset(token)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of what runs within as soon as it has run, and give Python fewer rows at once:
    ARROW_ROWS, as texts are long."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", rows: str(min(ARROW_ROWS, int(spark.conf.get(rows))))}
    old = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back: the lineage ends there, and
    the shuffles behind it are deleted."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/evenspan/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    if (paths := _noting.get()) is not None:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*frames: DataFrame) -> None:
    """Delete the tables behind stashed frames that nothing reads any more."""
    for f in frames:
        if path := getattr(f, "_stashed", None):
            delete(f.sparkSession, path)
            f._stashed = None


def drop_unread(spark: SparkSession, paths: list[str], docs: DataFrame) -> list[str]:
    """Delete those of the tables that ``docs`` doesn't read; the others are returned."""
    files = docs.inputFiles() if paths else []
    kept = [p for p in paths if any(p.rpartition("/")[2] in f for f in files)]
    for p in paths:
        if p not in kept:
            delete(spark, p)
    return kept


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null. Splitting at one blank is several times faster than at a
    class of characters, which only texts with white space other than blanks and line feeds need."""
    t = F.coalesce(text, F.lit(""))
    odd = F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\r")) | F.contains(t, F.lit("\x0b")) | F.contains(t, F.lit("\x0c"))
    plain = F.when(odd, F.regexp_replace(t, SPACE, " ")).otherwise(F.replace(t, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(plain, " "), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once and bound to ``v``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(8).cast("long"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(8))
        return 8 * F.greatest(F.size(value), F.lit(0)) + 8
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows are at most ``limit`` and its bytes at most ``most``, both measured
    here; else as it is, and the join shuffles, with skewed partitions split by adaptive execution."""
    with tidy(df.sparkSession):
        rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most else df


def numbered(rows: DataFrame, by: str, part: str, out: str) -> DataFrame:
    """Stashed ``rows`` with the number, from 0, of each among the rows that have the same ``by``. ``part`` is the task
    that wrote the row: within a task rows are numbered by a window, and tasks follow each other, so that
    however many rows agree no more of them meet than a task had."""
    twice = stash(rows.groupBy(F.col(by).alias("_same")).count().filter("count > 1").select("_same"), "twice")
    if twice.isEmpty():
        return rows.withColumn(out, F.lit(0).cast("long"))
    again = stash(rows.join(small(twice), F.col(by) == F.col("_same"), "left_semi"), "again")
    tasks = again.groupBy(F.col(by).alias("_same"), F.col(part).alias("_task")).agg(F.count(F.lit(1)).alias("_times"))
    before = F.coalesce(F.sum("_times").over(W.partitionBy("_same").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = stash(tasks.select("_same", "_task", before.alias("_before")), "tasks")
    mine = again.withColumn("_place", F.row_number().over(W.partitionBy(by, part).orderBy(F.lit(0))))
    mine = mine.join(small(tasks), (F.col(by) == F.col("_same")) & (F.col(part) == F.col("_task"))).withColumn(out, F.col("_before") + F.col("_place") - 1)
    once = rows.join(small(twice), F.col(by) == F.col("_same"), "left_anti").withColumn(out, F.lit(0).cast("long"))
    return once.unionByName(mine.select(*once.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
