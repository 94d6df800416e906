"""Tables for papers and the jobs of the command line as functions. Reports are made of aggregated rows only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latex_table(rows: DataFrame, columns: list[str], caption: str = "", decimals: int = 3) -> str:
    """A LaTeX tabular of a small frame, in its order."""
    def cell(x) -> str:
        if x is None:
            return "--"
        return f"{x:.{decimals}f}" if isinstance(x, float) else str(x).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")

    # rows come to the driver one partition at a time: a table is as long as its text
    body = "\n".join(" & ".join(cell(x) for x in r) + r" \\" for r in rows.select(*columns).toLocalIterator())
    head = " & ".join(c.replace("_", r"\_") for c in columns)
    lines = [r"\begin{table}", r"\centering", rf"\begin{{tabular}}{{{'l' + 'r' * (len(columns) - 1)}}}", r"\hline", head + r" \\", r"\hline", body, r"\hline", r"\end{tabular}"]
    return "\n".join([*lines, rf"\caption{{{caption}}}" if caption else "", r"\end{table}"])


def range_ids(rows: DataFrame, of: str, at: str, prefix: str = "SL") -> DataFrame:
    """``of`` and range_id: each distinct range with a number, from 1, in the order of its first row by ``at``."""
    first = rows.groupBy(of).agg(F.min(at).alias("_at"))
    # a row per distinct range
    return first.select(of, F.concat(F.lit(prefix), F.row_number().over(W.orderBy("_at", of))).alias("range_id"))


def result_groups(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Results that agree in the settings ``by``: how many values of the one that varies, and the greatest."""
    return rows.groupBy(*by).agg(F.countDistinct(value).alias("n_values"), F.max(value).alias("most"))


def configurations(languages: DataFrame) -> DataFrame:
    """source, target: every language alone, and every ordered pair of two. Languages are a handful."""
    a = languages.select(F.col("lang").alias("source"))
    b = F.broadcast(languages.select(F.col("lang").alias("target")))
    pairs = a.join(b, F.col("source") != F.col("target"))
    return a.select("source", F.lit(None).cast("string").alias("target")).unionByName(pairs.select("source", "target"))


@dataclass
class Run:
    """What a batch of jobs came to."""

    done: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def run_all(jobs: dict[str, Callable[[], object]]) -> Run:
    """Runs each job; one that fails is noted and the others go on."""
    run = Run()
    for name, job in jobs.items():
        try:
            job()
            run.done.append(name)
        except Exception as e:
            run.failed[name] = f"{type(e).__name__}: {e}"
    return run


def sweep(cases: DataFrame, sizes: DataFrame) -> DataFrame:
    """All settings of a sweep: every case with every size. Both are lists of settings, of which the sizes are fewer."""
    return cases.join(F.broadcast(sizes))
