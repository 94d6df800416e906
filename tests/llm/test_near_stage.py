"""The pipeline's near duplicates where ids repeat."""

import corpus_pipeline as P


def test_rows_of_one_id_are_judged_each(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (4, c + " more"), (None, a), (None, a), (5, ""), (5, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in P.near_stage(spark, d, "").collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (3, c), (5, ""), (5, "")], key=repr)


def test_rows_against_brute_force(spark):
    """Ids that repeat or are null, texts that repeat, near copies and rows without words, by plain search."""
    import random

    rng = random.Random(5)
    bases = [[f"{x}{k}" for k in range(60)] for x in "abcdef"]
    rows = []
    for i in range(70):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(60)] = f"n{rng.randrange(9)}"
        rows.append((rng.choice([None, *range(12)]), " ".join(w) if i % 9 else rng.choice(["", " ", None])))
    rows += rows[:10]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} if t and t.strip() else set() for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in P.near_stage(spark, d, "").collect()]
    groups = {}
    for k, (r, s) in enumerate(zip(root, sets, strict=True)):
        groups.setdefault(r if s else (k,), []).append(rows[k])
    assert len(got) == len(groups)
    for members in groups.values():
        least = min((i for i, _ in members if i is not None), default=None)
        assert sum((i, t) in set(members) and i == least for i, t in got) >= 1


def test_bpe_stage_makes_ids_alone():
    """The stage has no use for decoded texts and keeps ids of words packed; they are those of the full way."""
    import numpy as np

    from evenspan.llm import bpe
    from evenspan.llm.queries import vocabulary

    coder = bpe.WordBpe(vocabulary())
    texts = ["", "Some words, and some words again.", "naïve ÇA — 123 <|endoftext|> x", "a" * 300]
    full = [[int(x) for ids, _, _ in g for x in ids.split()] for g in coder.batch(texts)]
    assert [np.frombuffer(x, np.int32).tolist() for x in coder.ids(texts)] == full
    assert bpe.CACHE_WORDS <= 100_000 and not coder.normalizer.normalize_str("ABC") == "ABC"


def test_bpe_without_decoding(spark):
    from evenspan.llm import bpe
    from evenspan.llm.queries import vocabulary

    d = spark.createDataFrame([(1, "Two words"), (2, None), (3, "")], "doc_id long, text string")
    whole = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in bpe.bpe_encode(d, vocabulary(), carry=["doc_id"]).collect()}
    alone = bpe.bpe_encode(d, vocabulary(), carry=["doc_id"], decode=False)
    assert alone.columns == ["doc_id", "n_tokens", "ids"]
    assert {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in alone.collect()} == whole and whole[2] == (0, [])
