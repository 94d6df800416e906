"""Words of a batch are proposed for and merged on arrays; the results are those of one merge after another."""

import json
import random

import pytest

from evenspan.llm import bpe
from evenspan.llm.queries import vocabulary


def words():
    draw = random.Random(3)
    parts = ["the", "tion", "ing", "qu", "ß", "é", "ñ", "x", "zz", "of", "an", "ä"]
    out = {"".join(draw.choice(parts) for _ in range(draw.randint(1, 9))) for _ in range(2500)}
    out |= {"".join(draw.choice("abcdefgh") for _ in range(k)) for k in (1, 2, 64, 127, 128, 129, 130, 700)}
    return sorted(out | {"a" * 128, "a" * 129, "a" * 5000, "!" * 37, "日本語", "ⱥⱦ", "한국어" * 30, "²½", "🙂🙂"})


def test_words_are_merged_many_at_once(monkeypatch):
    coder = bpe.WordBpe(vocabulary())
    new, alone, single = words(), [], coder.merge
    want = [single(coder._symbols(w)) for w in new]
    monkeypatch.setattr(coder, "merge", lambda s: alone.append(len(s)) or single(s))
    assert coder.words(new) == want and coder.words([]) == []
    assert coder.runs[1] > 100 and len(alone) < 20 and min(alone) > 128


def test_texts_as_the_library():
    from tokenizers import Tokenizer

    coder, t = bpe.WordBpe(vocabulary()), Tokenizer.from_file(vocabulary())
    draw, new = random.Random(4), words()
    marks = [" ", "\n", "\t", " ", " 's ", "'ll", ".", "!?", "7", "ÀÉ", "Ⱥ", "\x85", "\x1c", "<|endoftext|>", "ªº¼", "Ω"]
    for _ in range(300):
        text = "".join(draw.choice(new[:2000] if draw.random() < 0.6 else marks) for _ in range(40))
        assert coder.encode(text) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("suffix", ["", "</w>"])
def test_other_vocabularies(tmp_path, suffix):
    """With and without a suffix, with letters that are missing, with merges in an order that makes greedy matches wrong."""
    with open(vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    merges = [("b", "c"), ("a", "b"), ("ab", "c"), ("a", "a"), ("aa", "aa"), ("bc", "a")] + ([("c", "a" + suffix), ("a", "b" + suffix)] if suffix else [("c", "a")])
    tokens = list("abc") + ([x + suffix for x in "abc"] if suffix else []) + [x + y for x, y in merges]
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(dict.fromkeys(tokens))}, "merges": [list(p) for p in merges], "end_of_word_suffix": suffix, "unk_token": None}
    spec["added_tokens"], spec["post_processor"] = [], None
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    coder = bpe.WordBpe(str(path))
    draw = random.Random(5)
    new = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 12))) for _ in range(400)})
    assert coder.words(new) == [coder.merge(coder._symbols(w)) for w in new]
    assert 0 < coder.runs[1] < coder.runs[0]
    with pytest.raises(KeyError):
        coder.words(["abd"])
