"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from evenspan.llm import bpe, langid, linedup, mixing, ngram_join, quality, queries, sharding, spotsigs, toxicity, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, kept int, n_words string, node string, fingerprint int, n_tokens string, shard string, copies string, removed_lines string, lang_pred string, host_rate string"
LONG = " ".join(f"word{k % 977}" for k in range(60_000)) + "\n" + "x" * 200_000


def row(i, t, s="a"):
    return (i, t, "en", s, None, 1, "x", 2, "y", "z", 3, "t", "s", "c", "r", "l", "h")


ROWS = [
    row(1, "the cat and dog sat on a mat by the house of the king"), row(1, "the cat and dog sat on a mat by the house of the king"), row(2, None), row(3, ""), row(4, " \t\n\r\x0b\x0c "),
    row(None, "no id here but words of the text"), row(None, None, None), row(5, LONG, None), row(6, "one"), row(7, "one"), row(8, "\n\n\n"), row(9, "#$% *** |||", "b"), row(10, "naïve ÀÉ 漢字 😀 <|endoftext|> 'S", "b"),
    row(11, "same id"), row(11, "other text of one id"),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(messy, none):
    out = quality.quality_rules(messy).collect()
    assert len(out) == len(ROWS) and out[0].asDict().keys() >= {"kept", "host_rate", "n_words"}
    by = [r for r in out if r["text"] is None]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in by)
    assert next(r for r in out if r["doc_id"] == 5)["n_words"] == 60_001
    assert quality.quality_rules(none).count() == 0


def test_repeated_windows(spark):
    texts = ["a a a a", "a b c x a b c", "a b c d", "a b", "a b c a b c a"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measured(d).collect()}
    assert got == {0: 4, 1: 6, 2: 0, 3: 0, 4: 7}


def test_hosts_are_shrunk(spark):
    d = spark.createDataFrame([(i, "bad" if i % 50 == 0 else "ok", i % 50 == 0 or i % 10 == 0) for i in range(1000)], "doc_id long, source string, failed boolean")
    r = {x["host"]: x for x in quality.host_verdicts(d).collect()}
    assert r["bad"]["host_rejected"] and not r["ok"]["host_rejected"] and 0.08 < r["ok"]["host_rate"] < r["bad"]["host_rate"] <= 1


def test_urls(spark):
    urls = ["http://a.com/x", "HTTP://Sub.Example.COM/en/1?q#f", "https://example.com/en", "http://www.example.com/en/", "http://x.net/es/1", "http://x.net/ES/1", "http://com/", "http://acom/", "http://a.com", "nothing", "", None,
            "http://spam-farm.org/x", "http://spamfarm.org/x", "http://a.com:80/x", "http://u@example.com/en/x", "http://a.net/fr/", "ftp://é.com/en/", "http://com/"]
    d = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, host int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.url_filter(d).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("sub.example.com", "/en/1", "example.com/en/", "block")
    assert got[2][2:] == ("com/", "allow") and got[3][2:] == ("www.example.com/en/", "allow") and got[4][2:] == ("net/es/", "block") and got[5][2:] == (None, "allow")
    assert got[6][2] == "com/" and got[7][2] is None and got[8] == ("a.com", "", None, "allow")
    assert all(got[k] == ("", "", None, "allow") for k in (9, 10, 11))
    assert got[12][2:] == (None, "block") and got[13][3] == "allow" and got[14][2] is None and got[15][2] == "com/" and got[16][2] == "net/fr/" and got[17][2] == "com/" and got[18] == got[6]
    assert url_rules.url_filter(d.limit(0)).count() == 0 and url_rules.url_filter(d, ()).count() == len(urls)


def test_bpe(messy, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    out = bpe.bpe_encode(messy, queries.vocabulary()).collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, t.decode(ids, skip_special_tokens=False), len(ids))
    assert bpe.bpe_encode(none, queries.vocabulary()).count() == 0


def test_bpe_speculates():
    coder = bpe.WordBpe(queries.vocabulary())
    coder.words(["the", "house", "king"])
    assert coder.runs[1] < coder.runs[0]


def test_fingerprints(messy, none):
    out = spotsigs.edited_fingerprints(messy).collect()
    assert len(out) == len(ROWS)
    same = {r["fingerprint"] for r in out if r["doc_id"] in (6, 7)}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert {r["fingerprint"] for r in out if r["doc_id"] in (2, 3, 4)} == {next(r["fingerprint"] for r in out if r["doc_id"] == 8)}
    assert spotsigs.edited_fingerprints(none).count() == 0
    assert spotsigs.edited_fingerprints(messy.filter("doc_id = 5")).first()["near_next"] == 1.0


def test_neighbours_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 5)
    d = spark.createDataFrame([(i * 3 % 101, f"t{i * 3 % 101}") for i in range(101)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(d).collect()}
    assert got == {i: f"t{(i + 1) % 101}" for i in range(101)}


def test_languages(messy, none, spark):
    model = langid.learn(messy.filter("doc_id is not null"))
    out = langid.identify(messy, model).collect()
    assert len(out) == len(ROWS) and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in out if not any(c.isalpha() for c in r["text"] or ""))
    empty = langid.learn(none)
    assert {r["lang_pred"] for r in langid.identify(messy, empty).collect()} == {"und"} and langid.identify(none, model).count() == 0


def test_lines(messy, none, spark):
    out = linedup.dedup_lines(messy).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out if r["doc_id"] not in (1, None, 11)}
    assert by[6]["removed_lines"] == [] and by[7]["removed_lines"] == [0] and by[7]["text"] == "" and by[8]["removed_lines"] == []
    assert by[2]["text"] is None and by[2]["n_lines"] == 0 and sorted(r["removed_lines"] for r in out if r["doc_id"] == 1) == [[], [0]]
    assert linedup.dedup_lines(none).count() == 0
    line = " ".join(f"w{k}" for k in range(60))
    near = line.replace("w59", "other")
    d = spark.createDataFrame([(2, near), (1, f"new\n{line}\n\n{line}"), (3, "fresh line\n" + near)], "doc_id long, text string")
    got = {r["doc_id"]: (r["removed_lines"], r["text"]) for r in linedup.dedup_lines(d).collect()}
    assert got == {1: ([3], f"new\n{line}\n"), 2: ([0], ""), 3: ([1], "fresh line")}


def test_near(messy, none):
    out = ngram_join.near_documents(messy).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out}
    assert by[7]["component_id"] == 6 and by[2]["component_id"] == 2 and by[3]["n_shingles"] == 0 and all(r["component_id"] is None for r in out if r["doc_id"] is None)
    assert ngram_join.near_documents(none).count() == 0
    assert ngram_join.near_documents(messy.filter("doc_id = 2")).first()["component_id"] == 2


def test_shards(messy, none, spark):
    out = sharding.shard(messy).collect()
    assert len(out) == len(ROWS) and sharding.shard(none).count() == 0
    hot = spark.createDataFrame([(i, "hot" * 50 if i % 3 else f"cold {i} " * 10) for i in range(3000)], "doc_id long, text string")
    rows = sharding.shard(hot).collect()
    size = {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert len(rows) == 3000 and max(size.values()) < 1.15 * min(size.values())


def test_mix(messy, none, spark):
    out = mixing.mix(messy).collect()
    assert len(out) == len(ROWS) and all(r["copies"] == 0 for r in out if r["size"] == 0) and mixing.mix(none).count() == 0
    assert {(r["source"], r["source_size"]) for r in out if r["source"] == "b"} == {("b", 9)}
    nothing = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert mixing.mix(nothing).first()["target"] == 0 and mixing.mixed_rows(messy).columns == messy.columns


def test_toxicity(messy, none, spark):
    labels = spark.createDataFrame([(1, 0), (5, 0), (9, 1), (10, 0), (11, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(messy, labels)
    out = toxicity.score_toxicity(messy, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out) and len({r["score"] for r in out if r["doc_id"] in (2, 3, 4)}) == 1
    assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.learn(messy, labels.filter("toxic = 0")) is None and toxicity.score_toxicity(messy, None).first()["predicted"] == 0


def test_pipeline_on_messy_rows(spark, messy, none):
    import corpus_pipeline as P

    for d in (messy, none):
        at = d
        for _, stage in P.STAGES:
            rows = (out := stage(spark, at, "")).collect()
            at = spark.createDataFrame(rows, out.schema)
