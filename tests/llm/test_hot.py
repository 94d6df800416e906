"""Hot groups, repeated rows, names that clash, and joins with nothing broadcast."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenspan.llm import common, linedup, mixing, ngram_join, quality, sharding, url_rules


def test_shared_passage_makes_few_candidates(spark, monkeypatch):
    """Two thousand texts that share one passage, and as many that don't: pairs grow with the texts, not their square."""
    seen = []
    old = ngram_join._verified

    def counted(sides, pairs):
        seen.append(pairs.count())
        return old(sides, pairs)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"q{i}_{k}" for k in range(20)) + " " + passage) for i in range(2000)]
    rows += [(5000, passage), (5001, passage + " more")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_documents(d).collect()}
    # 56 of 76 shingles in common with the passage itself, 56 of 96 with each other
    assert got == {i: 5000 if i == 5001 else i for i, _ in rows}
    assert sum(seen) <= 4 * len(rows)


def test_large_family_is_one_component(spark, monkeypatch):
    seen = []
    old = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda sides, pairs: (seen.append(pairs.count()), old(sides, pairs))[1])
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        w[(i * 13) % 200] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and sum(seen) <= 8 * len(rows)


def test_string_ids(spark):
    t = " ".join(f"w{k}" for k in range(40))
    d = spark.createDataFrame([("b", t), ("a", t + " x"), ("c", "other"), (None, t)], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_documents(d).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", None: None}


@pytest.fixture
def shuffled(monkeypatch):
    """No side of a join is marked for broadcast."""
    for m in (common, linedup, mixing, ngram_join, quality, url_rules):
        monkeypatch.setattr(m, "small", lambda df, *a: df)


def test_joins_that_shuffle(spark, shuffled):
    rng = random.Random(3)
    base = [[f"{x}{k}" for k in range(50)] for x in "abcd"]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        w[rng.randrange(50)] = f"n{rng.randrange(4)}"
        rows.append((i, " ".join(w), rng.choice("st")))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(46)} for _, t, _ in rows]
    near = [[10 * len(a & b) >= 8 * len(a | b) for b in sets] for a in sets]
    removed = {r["doc_id"]: r["removed_lines"] for r in linedup.dedup_lines(d).collect()}
    assert removed == {i: [0] if any(near[i][:i]) else [] for i in range(60)}
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if near[i][j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_documents(d).collect()} == dict(enumerate(root))
    assert quality.quality_rules(d).count() == 60 and mixing.mix(d).count() == 60


def test_repeated_rows_meet_the_target(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h", "s")] * 300 + [(k, "x y", "t") for k in range(100)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    taken = sum(r["copies"] * r["size"] for r in got if r["source"] == "s")
    assert abs(taken - next(r["target"] for r in got if r["source"] == "s")) <= 8


def test_picks_are_those_of_a_plain_sort(spark):
    d = spark.createDataFrame([(i, " ".join(["w1" if i % 3 else "#9#9"] * (1 + i % 17)), "ab"[i % 5 == 0]) for i in range(900)], "doc_id long, text string, source string")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), "text"), 11) + F.lit(0.5)) / float(1 << 53)
    keys = {r["doc_id"]: r["k"] for r in d.select("doc_id", (-F.log(u) / mixing.quality_weight(F.col("text"))).alias("k")).collect()}
    by = defaultdict(list)
    for r in mixing.mix(d).collect():
        by[r["source"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: keys[r["doc_id"]])
        epochs = int(rows[0]["target"] // rows[0]["source_size"])
        budget, at = rows[0]["target"] - epochs * rows[0]["source_size"], 0
        for r in rows:
            at += r["size"]
            assert r["copies"] == epochs + (at - r["size"] / 2 <= budget)


def test_equal_rows_shard_evenly(spark):
    d = spark.createDataFrame([(7, "same text " * 20)] * 2000 + [(10 + i, f"text {i} " * 20) for i in range(2000)], "doc_id long, text string")
    got = sharding.shard(d).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(size) == 16 and max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in size)


def test_repeated_rows_lose_their_lines(spark):
    d = spark.createDataFrame([(1, "one two\nthree")] * 3 + [(2, "fresh")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["removed_lines"], r["text"]) for r in linedup.dedup_lines(d).collect())
    assert got == [(1, [], "one two\nthree"), (1, [0, 1], ""), (1, [0, 1], ""), (2, [], "fresh")]


def test_thousands_of_rules(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("shop", "news", "blog", "spam", "win", "x") for b in range(40)]
    rules = [url_rules.site_rule(rng.choice(["allow", "block"]), f"{rng.choice(words)}.{rng.choice(['com', 'net'])}/{rng.choice(words)}{rng.choice(['/', ''])}") for _ in range(1500)]
    rules += [url_rules.word_rule("block", *rng.sample(words, rng.choice([1, 2]))) for _ in range(490)]
    rules += [url_rules.Rule(f"re{i}", "block", p, 5) for i, p in enumerate([r"[0-9]{3}x", r"shop\d+/?$", r"(?i)NEWS1[.]", r"a|win3", r"blog(1|2)0", r"/(?:q/)?spam7/", r"^x1\d?\.net/", r"wi", r"[^a-z]x5[^a-z]", r"b{2}"])]
    rules = tuple({r.name: r for r in rules}.values())
    urls = [f"http://{rng.choice(['www.', '', 'a.b.'])}{rng.choice(words)}.{rng.choice(['com', 'net'])}/{'/'.join(rng.choice(words) for _ in range(rng.randrange(4)))}" for _ in range(600)]
    got = {r["page_id"]: (r["pattern"], r["verdict"]) for r in url_rules.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for i, u in enumerate(urls):
        site = u.partition("://")[2]
        hit = min(((-r.weight, r.name, r.verdict) for r in rules if re.search(r.pattern, site)), default=(0, None, "allow"))
        assert got[i] == hit[1:]


CLASH = ["_host", "_rate", "_h", "_p", "b", "removed", "_t", "_x", "_id", "epochs", "budget", "_b", "_r", "_s", "_k", "_row", "_text", "token", "site", "w", "_d", "_o"]


def test_columns_of_any_name_come_back(spark):
    d = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("line one\nline "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("http://a.com/x").alias("url"), *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in CLASH])
    for out in (quality.quality_rules(d), linedup.dedup_lines(d), url_rules.url_filter(d), sharding.shard(d), mixing.mix(d)):
        rows = out.collect()
        assert len(rows) == 40 and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASH)


def test_results_survive_a_pipeline_run(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.quality_rules(docs)
    first = P.quality_stage(spark, docs, sf)
    again = P.STAGES[0][1](spark, docs, sf)
    n = again.count()
    P.STAGES[1][1](spark, spark.createDataFrame(again.collect(), docs.schema), sf)
    assert out.count() == docs.count() and first.count() == n


def test_levels_and_bitmaps():
    from evenspan.llm import holders

    n = np.arange(1, 3000)
    assert (np.diff(holders.level(n).astype(int)) >= 0).all() and holders.level(n)[0] == 0 < holders.level(n)[1]
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, y = (rng.integers(0, 2000, rng.integers(1, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in "ab")
        x, y = np.unique(x), np.unique(y)
        assert ngram_join.most_common(ngram_join.bitmap(x), ngram_join.bitmap(y), len(x), len(y)) >= len(np.intersect1d(x, y))


def test_bands_hold_linked_sizes():
    ends = ngram_join.bands(3000)
    for n in range(1, 500):
        for m in range(-(-n * 80 // 100), n + 1):
            assert np.searchsorted(ends, n, "right") - np.searchsorted(ends, m, "right") in (0, 1)


def test_line_dedup_splits_once(spark, monkeypatch):
    """A text is split once for all its lines: neither again to see that it has some, nor for each line that is looked up."""
    plans = {}

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.stash(df, name)

    monkeypatch.setattr(linedup, "stash", spied)
    line = " ".join(f"w{k}" for k in range(60))
    d = spark.createDataFrame([(1, f"{line}\n{line} end"), (2, f"other words\n{line} more")], "doc_id long, text string")
    removed = {r["doc_id"]: r["removed_lines"] for r in linedup.dedup_lines(d).collect()}
    assert removed == {1: [1], 2: [1]}
    assert plans["lines"].count("split(text") == 1
    assert plans["shown"].count("split(text") == 1 and plans["shown"].count("split(CASE") == 1
    assert "transform(array(split(text" in plans["tokens"]


def test_shown_tokens_of_similar_lines(spark):
    """Any two lines of a similarity of 0.8 share as many of the tokens shown as either asks for, at repeated words too."""

    draw, lines = random.Random(3), []
    for _ in range(60):
        base = [f"w{draw.randrange(draw.choice([4, 30, 1000]))}" for _ in range(draw.randrange(1, 160))]
        edges = base[draw.randrange(0, 1 + len(base) // 12) :] + [f"x{draw.random()}" for _ in range(draw.randrange(0, 1 + len(base) // 12))]
        lines += [base, edges, base + base[: len(base) // 3]]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "c long, line string")
    shown = {}
    for r in linedup.shown(d.selectExpr("c * 256 as c", "line")).collect():
        shown.setdefault(r["k"] >> 8, (r["k"] & 255, set()))[1].add(r["h"])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in lines]
    near = [(a, b) for a in range(len(lines)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert len(near) > 40
    for a, b in near:
        assert len(shown[a][1] & shown[b][1]) >= max(shown[a][0], shown[b][0])
