"""Queries and operators read all they are given."""

from evenspan.registry import QUERIES
from evenspan import plans  # noqa: F401


def test_ranges_of_all_orders(spark, tmp_path):
    rows = [(1, 1, 5.0), (2000, 1, 15.0), (70_000, 2, 25.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["lo"]: r["range_id"] for r in QUERIES["a35_range_ids"](spark, str(tmp_path)).collect()}
    assert got == {0: "SL1", 1: "SL2", 2: "SL3"}
