"""The distribution functions as Arrow UDFs. They run on aggregated rows only.

The UDFs are made at each use, so that importing the module needs no session.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special


def _apply(f, *columns: Column) -> Column:
    """``f`` row by row over numbers; NULL where an argument is missing or the result is not a number."""
    fields = F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def over(frame: pd.DataFrame) -> pd.Series:
        rows = frame.itertuples(index=False)
        values = [math.nan if any(math.isnan(x) for x in r) else f(*r) for r in rows]
        return pd.Series(values, dtype="float64")

    over.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    got = F.pandas_udf(over, "double")(fields)
    return F.when(~F.isnan(got), got)


def _wilcoxon(n: float, w: float, ties: float) -> float:
    if n < 1:
        return math.nan
    return special.wilcoxon_exact(int(n), w) if n <= 50 and ties == 0 else special.wilcoxon_normal(int(n), w, ties)


def t_crit(df: Column) -> Column:
    """Quantile .975 of Student's t."""
    return _apply(lambda d: special.t_ppf(0.975, d) if d > 0 else math.nan, df)


def t_two_sided(t: Column, df: Column) -> Column:
    return _apply(lambda a, d: special.t_two_sided(a, d) if d > 0 else math.nan, t, df)


def t_greater(t: Column, df: Column) -> Column:
    return _apply(lambda a, d: special.t_sf(a, d) if d > 0 else math.nan, t, df)


def f_greater(f: Column, d1: Column, d2: Column) -> Column:
    return _apply(lambda a, b, c: special.f_sf(a, b, c) if b > 0 and c > 0 else math.nan, f, d1, d2)


def wilcoxon_p(n: Column, w: Column, ties: Column) -> Column:
    return _apply(_wilcoxon, n, w, ties)
