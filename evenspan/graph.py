"""Jobs as a graph: a job's table lies under a key of its settings and its inputs, so that a second run does what is missing only.

Each job writes one table, whole or not at all (Spark's own success mark tells), so that a run that was stopped goes on where it
stopped. A job that fails leaves its dependents undone, and no others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Job:
    """``make(spark, settings, tables of needs by name)`` gives the table. ``version`` changes the key where the code did."""

    make: Callable[[SparkSession, dict, dict[str, DataFrame]], DataFrame]
    settings: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    version: int = 1


@dataclass
class Outcome:
    """state: "done" (made now), "kept" (it was there), "failed" or "left" (something it needs failed)."""

    state: str
    path: str
    error: str | None = None


def keys_of(jobs: dict[str, Job]) -> dict[str, str]:
    """Of each job, in an order in which they can run, a key of all that its table depends on."""
    unknown = {n for j in jobs.values() for n in j.needs} - set(jobs)
    if unknown:
        raise ValueError(f"jobs that nobody makes: {sorted(unknown)}")
    keys: dict[str, str] = {}
    for name in TopologicalSorter({n: j.needs for n, j in jobs.items()}).static_order():  # raises on a cycle
        j = jobs[name]
        told = json.dumps([name, j.version, j.settings, [keys[n] for n in j.needs]], sort_keys=True, default=str)
        keys[name] = hashlib.sha256(told.encode()).hexdigest()[:16]
    return keys


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run_graph(spark: SparkSession, jobs: dict[str, Job], root: str, only: list[str] | None = None) -> dict[str, Outcome]:
    """Runs the jobs, or those that ``only`` needs, below the folder ``root``, and tells what became of each."""
    keys, wanted = keys_of(jobs), set(jobs if only is None else only)
    while more := {n for w in wanted for n in jobs[w].needs} - wanted:
        wanted |= more
    out: dict[str, Outcome] = {}
    for name, key in keys.items():
        if name not in wanted:
            continue
        job, path = jobs[name], f"{root.rstrip('/')}/{name}-{key}"
        broken = [n for n in job.needs if out[n].state in ("failed", "left")]
        if broken:
            out[name] = Outcome("left", path, f"needs {', '.join(broken)}")
        elif _finished(spark, path):
            out[name] = Outcome("kept", path)
        else:
            try:
                inputs = {n: spark.read.parquet(out[n].path) for n in job.needs}
                job.make(spark, job.settings, inputs).write.mode("overwrite").parquet(path)  # what a stopped run left goes
                out[name] = Outcome("done", path)
            except Exception as e:
                out[name] = Outcome("failed", path, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    return out
