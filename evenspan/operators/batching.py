"""Batches by token budget: rows of like length together, so that little is padding and no batch is above its budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import dense_number


def budget_batches(rows: DataFrame, length: str, ident: str, budget: int, multiple: int = 8, batch: str = "batch", padded: str = "padded") -> DataFrame:
    """``rows`` with padded (their length up to the next multiple) and batch: rows of one padded length, in the order of ``ident`` (a
    number), as many as the budget of padded tokens takes, one at least. Null lengths count as 0, which takes one multiple.

    Rows are numbered within a length in blocks, so that a length that most rows have isn't put in order by one task.
    """
    full = (F.greatest(F.ceil(F.coalesce(F.col(length), F.lit(0)) / multiple), F.lit(1)) * multiple).cast("long")
    out = dense_number(rows.withColumn(padded, full), ident, "_n", [padded])
    per = F.greatest(F.floor(F.lit(budget) / F.col(padded)), F.lit(1))
    return out.withColumn(batch, F.concat_ws("_", F.col(padded), F.floor(F.col("_n") / per))).drop("_n")


def padding_share(rows: DataFrame, length: str, batch: str = "batch", padded: str = "padded") -> DataFrame:
    """n_batches, most_tokens (padded, of a batch) and padding: the share of all padded tokens that is padding."""
    each = rows.groupBy(batch).agg(F.sum(padded).alias("full"), F.sum(F.coalesce(F.col(length), F.lit(0))).alias("used"))
    return each.agg(F.count(F.lit(1)).alias("n_batches"), F.max("full").alias("most_tokens"), (1 - F.sum("used") / F.sum("full")).alias("padding"))
