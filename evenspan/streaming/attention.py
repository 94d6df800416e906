"""Attention baskets over a stream. The batch operators are merges of sums and counts, so the same
aggregation runs on a stream in update or complete mode; this goes beyond what a batch engine needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_baskets(incoming: DataFrame, size: int) -> DataFrame:
    """layer, bin, mass, n_tokens of a stream of (layer, k, w): running sums that each batch is merged into."""
    b = F.floor(F.col("k") / size).cast("int").alias("bin")
    return incoming.groupBy("layer", b).agg(F.sum("w").alias("mass"), F.count(F.lit(1)).alias("n_tokens"))


def streaming_position_profile(sims: DataFrame) -> DataFrame:
    """pos, n, mean_sim, std_pop of a stream of similarities."""
    return sims.groupBy("pos").agg(F.count("sim").alias("n"), F.avg("sim").alias("mean_sim"), F.stddev_pop("sim").alias("std_pop"))
