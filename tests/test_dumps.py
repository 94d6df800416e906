"""Dumps read by splits against the tuples that were written."""

import random

import pytest

from evenspan.sources import dumps as D
from evenspan.sources import files as S


def quoted(t):
    return t.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")


def written(path, rows, statements, header=""):
    each = [rows[i::statements] for i in range(statements)]
    made = [f"INSERT INTO `page` VALUES {','.join(f"({i},{ns},'{quoted(t)}',0,'',0.5)" for i, ns, t in part)};\n" for part in each if part]
    path.write_text(header + "".join(made))
    return path.stat().st_size


@pytest.mark.parametrize("statements", [1, 7])
def test_one_line_is_read_by_many_tasks(spark, tmp_path, statements):
    rnd = random.Random(statements)
    odd = ["),(", "'", "\\", "'),(", "\\'),('", "(1,0,'x'", "é", "),(),(", "),(12,0,", "a_b", ");", "INSERT INTO `page` VALUES (", "long " * 900, "),(" * 700]
    rows = [(i, rnd.choice((0, 0, 14)), "".join(rnd.choices(odd, k=rnd.randrange(1, 5)))) for i in range(1500)]
    size = written(tmp_path / "page.sql", rows, statements, "-- it's a dump\n/*!40101 SET NAMES utf8 */;\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "20000")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        lines = D.dump_tuples(spark, str(tmp_path / "page.sql"))
        got = {(r["page_id"], r["title"]) for r in S.dump_pages(lines).collect()}
        tasks = D._pieces(spark, str(tmp_path / "page.sql")).rdd.getNumPartitions()
    finally:
        for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{k}")
    assert tasks > size // 40_000 > 10
    one = spark.createDataFrame([((tmp_path / "page.sql").read_text(),)], "value string")  # as one task reads it
    assert got == {(r["page_id"], r["title"]) for r in S.dump_pages(one).collect()}
    assert {i for i, _ in got} == {i for i, ns, _ in rows if ns == 0}


def test_files_of_a_folder_stand_apart(spark, tmp_path):
    for k in range(3):
        written(tmp_path / f"{k}.sql", [(10 * k + i, 0, f"t),({i}'") for i in range(4)], 2)
    (tmp_path / "open.sql").write_text("INSERT INTO `page` VALUES (99,0,'never closed),(")
    got = sorted(r["page_id"] for r in S.dump_pages(D.dump_tuples(spark, str(tmp_path))).collect())
    assert got == [10 * k + i for k in range(3) for i in range(4)]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.sql").write_text("")
    assert D.dump_tuples(spark, str(tmp_path / "empty")).count() == 0
