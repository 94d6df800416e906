"""Lookups of keys in a remote service, in batches of bounded size."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.scratch import dropped, saved
from .ranks import dense_number

BATCH, ATTEMPTS = 50, 3


def asked(rows: DataFrame, key: str, connect: Callable[[], Callable[[list], dict]], kind: str = "string", batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = 0.0, tasks: int = 4) -> DataFrame:
    """key, value, error of every different key of ``rows`` that isn't null, as a table: each key is asked for once, in
    ceil(keys / batch) calls and those that are repeated.

    ``connect()``, called once in a task, gives a function from a list of keys to a dictionary; a key it doesn't have is null, found
    nowhere. A call that raises is made up to ``attempts`` times, each after ``wait`` seconds more than the last; then all of its
    keys have the error. ``tasks`` bounds how many ask at once.
    """
    keys = rows.select(F.col(key).alias("key")).filter(F.col("key").isNotNull()).distinct()
    numbered = dense_number(keys.withColumn("_h", F.xxhash64("key")), "_h", "_n")
    lists = numbered.groupBy(F.floor(F.col("_n") / batch).alias("_b")).agg(F.sort_array(F.collect_list("key")).alias("keys"))  # a batch each
    lists = saved(lists, "batches")  # so that a task that runs again asks for the same
    schema = StructType([StructField("key", keys.schema["key"].dataType), StructField("value", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for b in batches:
            of = b.schema.field(0).type.value_type
            for wanted in b.column(0).to_pylist():
                found, error = {}, None
                for turn in range(attempts):
                    time.sleep(wait * turn)
                    try:
                        ask = ask or connect()
                        found, error = ask(wanted), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                values = [None if error or found.get(k) is None else str(found[k]) for k in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, of), pa.array(values, pa.string()), pa.array([error] * len(wanted), pa.string())], names=["key", "value", "error"])

    # round robin, so that the batches are spread over as many tasks
    told = saved(lists.select("keys").repartition(tasks).mapInArrow(run, schema), "answers")
    dropped(lists)
    return told.withColumn("value", F.col("value").cast(kind))


def looked_up(rows: DataFrame, key: str, connect: Callable[[], Callable[[list], dict]], value: str = "value", error: str = "error", **how) -> DataFrame:
    """``rows`` with the value of their key, null where there is none, and the error of a key that could not be asked for."""
    told = asked(rows, key, connect, **how).select(F.col("key").alias("_key"), F.col("value").alias(value), F.col("error").alias(error))
    return rows.drop(*(c for c in (value, error) if c in rows.columns)).join(told, F.col(key) == F.col("_key"), "left").drop("_key")
