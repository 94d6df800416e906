"""Lookups, batches, stores and job graphs: what happens when things go wrong, and how often things are done."""

import os

import pytest
from pyspark.sql import functions as F

from evenspan.graph import Job, keys_of, run_graph
from evenspan.operators import batching as B
from evenspan.operators import lookup as L
from evenspan.sources import stores as S


def counting(folder, refuse=lambda keys, turn: False):
    """A service that notes each call in a file of its own."""

    def connect():
        def ask(keys):
            turn = sum(f.startswith(f"{keys[0]}-") for f in os.listdir(folder))
            open(f"{folder}/{keys[0]}-{turn}-{len(keys)}", "w").close()
            if refuse(keys, turn):
                raise ConnectionError("refused")
            return {k: k.upper() for k in keys if not k.startswith("x")}

        return ask

    return connect


def test_as_many_calls_as_batches(spark, tmp_path):
    d = spark.createDataFrame([(f"{'xk'[i % 10 > 0]}{i % 130}", i) for i in range(400)] + [(None, 1)] * 5, "k string, value int").repartition(6)
    got = L.looked_up(d, "k", counting(str(tmp_path)))
    rows = got.collect()
    assert len(rows) == 405 and len(os.listdir(tmp_path)) == 3 and sorted(int(f.split("-")[2]) for f in os.listdir(tmp_path)) == [30, 50, 50]
    assert all(r["value"] == (None if r["k"] is None or r["k"].startswith("x") else r["k"].upper()) and r["error"] is None for r in rows)


def test_refused_calls_are_repeated_and_then_told(spark, tmp_path):
    d = spark.createDataFrame([(f"k{i}",) for i in range(40)], "k string")
    once = L.asked(d, "k", counting(str(tmp_path), lambda keys, turn: turn == 0), batch=7)
    assert once.filter("error is null and value = upper(key)").count() == 40 and len(os.listdir(tmp_path)) == 12
    (tmp_path / "b").mkdir()
    never = L.asked(d, "k", counting(str(tmp_path / "b"), lambda keys, turn: "k3" in keys), batch=7, attempts=2)
    bad = never.filter("error is not null").collect()
    assert len(bad) in (5, 7) and all(r["error"] == "ConnectionError: refused" and r["value"] is None for r in bad) and len(os.listdir(tmp_path / "b")) == 7
    assert L.asked(d.limit(0), "k", counting(str(tmp_path))).count() == 0


def test_batches_keep_to_their_budget(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate([3] * 50 + [9, 16, 17, 500, None, 0] * 5)], "i long, n int")
    got = B.budget_batches(d, "n", "i", 64).collect()
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r)
        assert r["padded"] % 8 == 0 and r["padded"] >= (r["n"] or 0) and r["padded"] - (r["n"] or 0) <= 8
    assert len(got) == 80 and all(len({r["padded"] for r in b}) == 1 and (sum(r["padded"] for r in b) <= 64 or len(b) == 1) for b in batches.values())
    assert max(len(b) for b in batches.values()) == 8
    share = B.padding_share(B.budget_batches(d, "n", "i", 64), "n").first()
    full, used = sum(r["padded"] for r in got), sum(r["n"] or 0 for r in got)
    assert (share["n_batches"], share["most_tokens"]) == (len(batches), 504) and share["padding"] == pytest.approx(1 - used / full)


def test_each_rule_of_resolution(spark, tmp_path):
    files = spark.createDataFrame([("f", n) for n in ("standalone_mean_b.parquet", "standalone_mean_a.parquet", "zz_standalone__mean.parquet", "cls_latechunking.parquet", "standalone__cls.txt", "latechunking_x.parquet")] + [("g", "other.parquet")], "folder string, file string")
    texts = spark.createDataFrame([("f", '{"embedding_paths": {"latechunking_mean": "/p/m", "standalone_cls": null}}'), ("g", "no json"), ("h", '{"embedding_paths": {"standalone_mean": "/p/h"}}')], "folder string, value string")
    asks = [("f", "standalone", "mean"), ("f", "standalone", "cls"), ("f", "standalone", None), ("f", "latechunking", "cls"), ("f", "latechunking", "mean"), ("f", "latechunking", None), ("g", "standalone", None), ("h", "standalone", "mean"), ("h", "standalone", None)]
    wanted = spark.createDataFrame(asks, "folder string, kind string, choice string")
    got = {(r["folder"], r["kind"], r["choice"]): (r["rule"], r["path"]) for r in S.resolved(wanted, S.manifest(files), S.settings_paths(texts)).collect()}
    want = [
        ("name", "f/zz_standalone__mean.parquet"), ("missing", None), ("name", "f/zz_standalone__mean.parquet"), ("name", "f/cls_latechunking.parquet"),
        ("settings", "/p/m"), ("name", "f/latechunking_x.parquet"), ("missing", None), ("settings", "/p/h"), ("missing", None),
    ]
    assert got == dict(zip(asks, want, strict=True))
    path = str(tmp_path / S.store_name("standalone", "mean", "org/model"))
    spark.range(3).write.parquet(f"{path}.parquet")
    here = S.manifest(spark.createDataFrame([(str(tmp_path), f) for f in os.listdir(tmp_path)], "folder string, file string"))
    assert S.read_store(here, S.settings_paths(texts), str(tmp_path), "standalone").count() == 3
    with pytest.raises(FileNotFoundError):
        S.read_store(here, S.settings_paths(texts), str(tmp_path), "latechunking", "cls")


def test_a_graph_goes_on_where_it_stopped(spark, tmp_path):
    made, broken = [], [True]

    def job(name, needs=(), **settings):
        def make(s, settings, tables):
            made.append(name)
            if name == "b" and broken[0]:
                raise RuntimeError("b")
            n = sum(t.count() for t in tables.values())
            return s.range(n + settings.get("n", 1))

        return Job(make, settings, needs)

    jobs = {"d": job("d", ("b", "c")), "c": job("c", ("a",)), "b": job("b", ("a",)), "a": job("a", n=4), "e": job("e")}
    states = lambda out: {n: o.state for n, o in out.items()}
    assert states(run_graph(spark, jobs, str(tmp_path))) == {"a": "done", "b": "failed", "c": "done", "d": "left", "e": "done"}
    broken[0], made[:] = False, []
    out = run_graph(spark, jobs, str(tmp_path))
    assert states(out) == {"a": "kept", "b": "done", "c": "kept", "d": "done", "e": "kept"} and made == ["b", "d"]
    assert spark.read.parquet(out["d"].path).count() == 5 + 5 + 1
    made[:] = []
    assert set(states(run_graph(spark, jobs, str(tmp_path))).values()) == {"kept"} and not made
    # other settings are another table, for all that need it too
    assert states(run_graph(spark, jobs | {"a": job("a", n=2)}, str(tmp_path))) == {"a": "done", "b": "done", "c": "done", "d": "done", "e": "kept"}
    # what a stopped run left without its mark is made again
    os.remove(out["c"].path + "/_SUCCESS")
    assert states(run_graph(spark, jobs, str(tmp_path), only=["c"])) == {"a": "kept", "c": "done"}
    with pytest.raises(ValueError):
        keys_of({"x": job("x", ("y",))})
