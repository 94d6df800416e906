"""Each operator against SQL, a library, a brute-force version or held-out labels, on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from evenspan.llm import oracles, queries, spotsigs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(name, spark, sf, duck):
    got, want = same_rows(queries.queries()[name](spark, sf), duck, oracles.oracle_sql()[name])
    assert got == want


def test_bpe_is_the_library(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    got = {r["doc_id"]: r for r in queries.op3_bpe(spark, sf).collect()}
    for i, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def spots(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate(LOW)) if x]
    content = [x for x in w if x not in spotsigs.ANCHORS]
    out, before = set(), 0
    for x in w:
        if x in spotsigs.ANCHORS:
            if before + spotsigs.CHAIN <= len(content):
                out.add((x, *content[before : before + spotsigs.CHAIN]))
        else:
            before += 1
    return out or ({tuple(w)} if w else set())


def test_spotsigs(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op4_spotsigs(spark, sf).collect()}
    seen = defaultdict(set)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(spots, (text, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
        seen[frozenset(a)].add(r["fingerprint"])
        seen[frozenset(b)].add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_spot_pairs(spark, sf, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, members = spotsigs.spot_pairs(d, 0.6)
    sets = {i: frozenset(spots(t)) for i, t in docs}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {i: first[s] for i, s in sets.items()}
    reps = sorted(first.values())
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {tuple(sorted((r["id_a"], r["id_b"]))) for r in pairs.collect()} == want


def shingles(words):
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_line_dedup(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op6_line_dedup(spark, sf).collect()}
    sets, index = [], defaultdict(list)
    for i, text in docs:
        lines, gone = text.split("\n"), []
        for k, line in enumerate(lines):
            if not (s := shingles(line.encode().split())):
                continue
            hits = Counter(j for x in s for j in index[x])
            if any(100 * n >= 80 * (len(s) + len(sets[j]) - n) for j, n in hits.items()):
                gone.append(k)
            sets.append(s)
            for x in s:
                index[x].append(len(sets) - 1)
        assert got[i]["removed_lines"] == gone and got[i]["n_lines"] == len(lines)
        assert got[i]["text_sha256"] == sha("\n".join(x for k, x in enumerate(lines) if k not in set(gone)))


def components(docs):
    sets = {i: shingles((t or "").translate(LOW).encode().split()) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_documents(spark, sf, docs):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_ngram_jaccard(spark, sf).collect()} == components(docs)


def test_near_families(spark):
    """A chain of copies, each a word from the last, and texts that share a passage only."""
    from evenspan.llm.ngram_join import near_documents

    base = [f"w{k}" for k in range(120)]
    rows, words = [], list(base)
    for i in range(40):
        words[(i * 7) % 120] = f"x{i}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(100 + i, " ".join(f"q{i}_{k}" for k in range(90)) + " " + passage) for i in range(60)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_documents(d).collect()} == components(rows)


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_long_chains(spark, monkeypatch, few):
    from evenspan.llm import components as C
    from evenspan.llm.components import components as connected

    monkeypatch.setattr(C, "FEW_LINKS", few)

    links = [(k, k + 1) for k in range(60)] + [(100, 105), (105, 103)] + [(200, k) for k in range(201, 230)]
    got = {r["id"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 103: 100, 105: 100, **{k: 200 for k in range(200, 230)}}


def test_shards(spark, docs):
    rows = queries.op8_sharding(spark, BIG).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    shards = defaultdict(list)
    where = defaultdict(set)
    for r in rows:
        b = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        shards[r["shard"]].append(r)
        where[b].add(r["shard"])
    sizes = [sum(r["size"] for r in v) for v in shards.values()]
    assert len(rows) == len(text) and sorted(shards) == list(range(16)) and max(sizes) < 1.05 * min(sizes) * 1.02
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in shards.values())
    assert all(len(v) == 1 for v in where.values())


def test_mixing(spark):
    rows = queries.op9_mixing(spark, BIG).collect()
    again = {r["doc_id"]: r["taken"] for r in queries.op9_mixing(spark, BIG).collect()}
    src = {r["doc_id"]: (r["source"], len(r["text"].encode().split())) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    size = Counter()
    for s, n in src.values():
        size[s] += n
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    left, target = dict(weight), {}
    budget = 1.5 * sum(size.values())
    while True:
        rate = (budget - sum(target.values())) / sum(left.values())
        over = [s for s in left if rate * left[s] > 2 * size[s]]
        if not over:
            target |= {s: rate * w for s, w in left.items()}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            del left[s]
    taken = Counter()
    for r in rows:
        s, n = src[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, size[s]) and r["target"] == pytest.approx(target[s])
        assert again[r["doc_id"]] == r["taken"] <= 2 * n and (not n or r["taken"] % n == 0)
        taken[s] += r["taken"]
    most = defaultdict(int)
    for s, n in src.values():
        most[s] = max(most[s], n)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)


def test_mixing_prefers_clean_text(spark):
    from evenspan.llm.mixing import mix

    d = spark.createDataFrame([(i, ("good words here " if i % 2 else "#$% 123 #$% ") * 4, "a" if i < 2000 else "b") for i in range(2100)], "doc_id long, text string, source string")
    got = mix(d).filter("source = 'a'").groupBy((F.col("doc_id") % 2).alias("clean")).agg(F.avg("copies").alias("c")).collect()
    c = {r["clean"]: r["c"] for r in got}
    assert c[1] > c[0]


def test_languages_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = [r for r in queries.op5_language_id(spark, BIG).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) > 0.98 * len(rows)


def test_language_mixtures(spark):
    from evenspan.llm import langid

    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = langid.learn(docs)
    by = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg(F.max_by("text", "n_chars").alias("t")).collect()}
    halves = " ".join(by["de"].split()[:300] + by["fr"].split()[:300])
    one = spark.createDataFrame([(1, halves)], "doc_id long, text string")
    assert set(langid.identify(one, model).first()["langs"]) == {"de", "fr"}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op10_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in y]
    hit = sum(r["predicted"] for r in rows if y[r["doc_id"]])
    assert hit > 0.8 * sum(y[r["doc_id"]] for r in rows)
    assert sum(r["predicted"] for r in rows if not y[r["doc_id"]]) < 0.03 * len(rows)


def test_toxicity_tolerates_inserted_characters(spark):
    from evenspan.llm import toxicity

    sf = "/root/testdata/sf0.1"
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    plain, gapped, clean = model[0].score(["disgusting", "disg*usting", "thering"])
    assert plain > 0 and gapped > 0 > clean


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    seen = [docs.count()]
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, at, sf)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            if k == 2:
                assert all(i == c for i, (_, c) in components([(r["doc_id"], r["text"]) for r in rows]).items())
            at = spark.createDataFrame(rows, docs.schema)
        seen.append(len(rows))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    text = {r["doc_id"]: r["text"] for r in at.collect()}
    assert all(r["ids"] == t.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in rows)
    assert seen[0] > seen[1] >= seen[2] >= seen[3] > 0
    assert Counter(r["doc_id"] for r in P.run(spark, sf).collect()) == Counter(r["doc_id"] for r in rows)
