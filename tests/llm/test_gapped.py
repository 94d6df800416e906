"""Insults with separators between their letters."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from evenspan.llm import toxicity


@pytest.mark.parametrize("spelling, word", [("i.d.i.o.t", "idiot"), ("s*t*u*p*i*d", "stupid"), ("id..io..t", "idiot"), ("ixdxixoxt", "idiot"), ("idxxioxxt", "idiot")])
def test_kernel_over_gaps(spelling, word):
    near, far = toxicity._kernel([spelling], [word, "garden"])[0]
    assert near > 0.1 and near > 3 * far


def test_letters_that_stand_apart():
    assert "idiot" in toxicity.tokens("You, i d i o t!") and "idiot" in toxicity.tokens("i. d. i.\no. t.")
    assert toxicity.tokens("a cat i saw b 12 c") == "a cat i saw b 12 c".split()


def test_scores_of_gapped_insults(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer, _ = toxicity.learn(docs, labels)
    words = sorted({w.strip(toxicity.EDGE) for r in docs.join(labels.filter("toxic = 1"), "doc_id").collect() for w in toxicity.tokens(r["text"])})
    words = [w for w in words if w.isalpha() and len(w) > 4]
    found = [w for w, s in zip(words, scorer.score(words), strict=True) if s > toxicity.CLEAR]
    assert found
    for how in ("{}".format, ".".join, "*".join, lambda w: "..".join([w[:2], w[2:4], w[4:]])):
        assert (scorer.score([how(w) for w in found]) > toxicity.CLEAR).all()
    parts = scorer.document([" ".join(w) for w in found])
    assert (parts[:, 3] >= 1).all()  # the word that the letters make is clearly toxic


def naive(a, b):
    """The kernel of two words by all their subsequences, one by one."""
    def found(w):
        w, out = f"\x02{w}\x03", {}
        for n in (3, 4):
            for places in combinations(range(len(w)), n):
                if places[-1] - places[0] < toxicity.SPAN:
                    out.setdefault("".join(w[i] for i in places), []).append(toxicity.DECAY ** (places[-1] - places[0] + 1 - n))
        out["whole", w] = [toxicity.WHOLE]
        return out

    x, y = found(a), found(b)
    # a subsequence that comes several times counts each time, and adds to the norm each time
    dot = sum(sum(x[s]) * sum(y[s]) for s in x if s in y)
    return dot / math.sqrt(sum(v * v for vs in x.values() for v in vs) * sum(v * v for vs in y.values() for v in vs))


def test_kernel_against_all_subsequences():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdé", k=rnd.randrange(1, 11))) for _ in range(40)] + ["idiot", "ixdxixoxt"]
    got = toxicity._kernel(words, words[:12])
    want = [[naive(a, b) for b in words[:12]] for a in words]
    assert np.allclose(got, want, atol=0.02)  # hashes of 18 bits meet now and then


def test_sentences():
    assert list(toxicity.sentences("One, two. Three\nfour! i d i o t")) == [["one,", "two."], ["three"], ["four!"], ["i", "d", "i", "o", "t"], ["idiot"]]
    assert list(toxicity.sentences("")) == []


def test_freest_level_that_no_clean_word_needs():
    class Plain:
        weights, bias = np.zeros(1 << toxicity.BITS, np.float32), 0.0

    clean = ["sxcum", "garden", "loqsqer"]
    taken = toxicity.spelled_by(clean, ["scum", "loser", "idiot"])
    assert taken == {("scum", 1), ("scum", 2), ("scum", 3), ("loser", 2), ("loser", 3)}
    scorer = toxicity.with_gaps(Plain, ["scum", "loser", "idiot"], taken)
    assert scorer.spelled == [("loser", 1), ("idiot", 3)]
    scorer.own = np.array([2.0, 3.0], np.float32)
    assert scorer.score(["loxser", "lxoxser", "ixxdiot", "ixxxdiot", "scxum"]).tolist() == [2.0, 0.0, 3.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def held(spark):
    """The model of the larger tables, learned as the query does, and its scores of the rows that it hasn't seen."""
    from evenspan.llm import queries as Q

    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{d}/labels.parquet").filter(Q._remainder(5) != 0))
    labels = spark.read.parquet(f"{d}/labels.parquet").filter(Q._remainder(5) == 0)
    scored = toxicity.score_toxicity(docs.join(labels, "doc_id"), model, carry=["text", "toxic"]).collect()
    return model, scored


def test_held_out_rows(held):
    _, rows = held
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert np.mean(np.array(toxic) >= 0.5) >= 0.9 and np.mean(np.array(clean) >= 0.5) < 0.02


def test_insults_with_letters_put_in(spark, held):
    (scorer, fold), rows = held
    clean = [r["text"] for r in rows if not r["toxic"] and 300 < len(r["text"]) < 900 and r["score"] < 0.1][:20]
    assert len(clean) == 20
    for word in ("idxiot", "ixdxixoxt", "idxxioxxt", "stxupid", "clxowxn", "disgxusting", "i.d.i.o.t", "idiot"):
        df = spark.createDataFrame([(f"{t} You {word}.",) for t in clean], "text string")
        assert np.mean([r["score"] >= 0.5 for r in toxicity.score_toxicity(df, (scorer, fold)).collect()]) >= 0.9, word
