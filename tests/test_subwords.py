"""Subword tokens against a longest match that tries every length."""

import random

import pytest
from pyspark.sql import functions as F

from evenspan import jobs as J
from evenspan.operators import subwords as W


def plainly(word, pieces):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            p = word[at:end] if at == 0 else "##" + word[at:end]
            if p in pieces and not (at == 0 and p.startswith("##")) and len(word) <= 100:
                out.append((pieces[p], at, end))
                at = end
                break
        else:
            return [(pieces["[UNK]"], 0, len(word))]
    return out


def by_hand(text, pieces):
    out, at = [], 0
    for w in text.replace("\t", " ").replace("\n", " ").split(" "):
        out += [(i, at + a, at + b) for i, a, b in plainly(w, pieces)]
        at += len(w) + 1
    return out


def made(seed):
    rnd = random.Random(seed)
    letters = "abcé\U0001f600"
    pieces = {"[UNK]", "a", "b", "##a", "##b", "##c", "##", "#", "##é\U0001f600"}
    pieces |= {rnd.choice(("", "##")) + "".join(rnd.choices(letters, k=rnd.randrange(1, 5))) for _ in range(60)}
    texts = [" ".join("".join(rnd.choices(letters + "#", k=rnd.randrange(0, 9))) for _ in range(rnd.randrange(12))) for _ in range(150)]
    return ["[UNK]", *sorted(pieces - {"[UNK]"})], texts


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words(spark, seed):
    pieces, texts = made(seed)
    number = {p: i for i, p in enumerate(pieces)}
    texts += ["a" * 100, "a" * 101, "", " \t\n", None, "b" * 400_000 + " a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit(1))
    got = {r["doc_id"]: r["tokens"] for r in W.subword_tokens(df.repartition(3), pieces).collect()}
    for i, t in enumerate(texts):
        assert (None if got[i] is None else [tuple(x) for x in got[i]]) == (None if t is None else by_hand(t, number)), t


def test_cuts_that_are_not_kept_are_made_again(monkeypatch):
    pieces, texts = made(3)
    monkeypatch.setattr(W, "KEPT", 2)
    number = {p: i for i, p in enumerate(pieces)}
    cutter = W.Subwords(pieces)
    assert [cutter.spans(t) for t in texts] == [by_hand(t, number) for t in texts]


def test_patterns_marks_and_unknown_of_the_caller():
    cutter = W.Subwords(["<unk>", "un", "@able", "@do", ","], unknown="<unk>", mark="@", pattern=r"\w+|[^\w\s]")
    assert cutter.spans("undoable, no") == [(1, 0, 2), (3, 2, 4), (2, 4, 8), (4, 8, 9), (0, 10, 12)]
    for bad in (["a", "a", "[UNK]"], ["a"]):
        with pytest.raises(ValueError):
            W.Subwords(bad)


def test_tables_and_files_of_pieces(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("[UNK]",), ("##é",)], "piece string")
    assert W.vocabulary(df) == ["[UNK]", "##é", "a", "b"]
    (tmp_path / "v.txt").write_text("[PAD]\n[UNK]\n##x\n \n")
    assert W.vocabulary_file(spark, str(tmp_path / "v.txt")) == ["[PAD]", "[UNK]", "##x", " "]
    monkeypatch.setattr(W, "MOST_PIECES", 2)
    with pytest.raises(ValueError):
        W.vocabulary(df)


def test_the_tokenize_job_counts_subwords(spark, tmp_path):
    spark.createDataFrame([(1, "unwell"), (2, None), (3, "x un"), (4, "un " * 50)], "id long, text string").write.parquet(str(tmp_path / "d"))
    (tmp_path / "v.txt").write_text("[UNK]\nun\n##well\n##we\n[CLS]\n[SEP]\n")
    cfg = {"dataset_path": str(tmp_path / "d"), "vocabulary_path": str(tmp_path / "v.txt"), "begin_token": "[CLS]", "end_token": "[SEP]", "max_length": 8}
    got = {r["id"]: (r["input_ids"], r["length"]) for r in J.tokenize(spark, cfg).collect()}
    assert got == {"1": ([4, 1, 2, 5], 4), "2": ([4, 5], 2), "3": ([4, 0, 1, 5], 4), "4": ([4, 1, 1, 1, 1, 1, 1, 5], 8)}


def test_tokens_are_the_spans(spark):
    """Tokens made a text at a time are those of word after word, also with a caller's pattern."""
    pieces = ["[UNK]", "a", "ab", "##b", "##c", "\U0001f600"]
    for pattern in (W.WORDS, r"[ab]+|c", r"(a|b)+", r"[a-c]*"):
        cutter = W.Subwords(pieces, pattern=pattern)
        for text in ("", " ", "abc  abx\né \U0001f600 ab", "  a", "abcb ", "a b " * 3):
            assert [tuple(x) for x in cutter.tokens(text).tolist()] == cutter.spans(text)
