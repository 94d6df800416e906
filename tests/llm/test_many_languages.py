"""Documents of more than three languages."""

import numpy as np
import pytest

from evenspan.llm import langid

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst", "ee": "uvwxyz"}


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(3)
    return {la: ["".join(rng.choice(list(x), 6)) for _ in range(400)] for la, x in LETTERS.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_all_languages_of_a_mix(spark, words, n):
    rows = [(i, " ".join(words[la]), la) for i, la in enumerate(LETTERS)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [" ".join(w for la in list(LETTERS)[:n] for w in words[la][:200]), " ".join(words["ee"])]
    label, score, sets = model.predict(mixed)
    assert sorted(sets[0]) == list(LETTERS)[:n] and score[0] == pytest.approx(1 / n, abs=0.02)
    assert (label[1], sets[1]) == ("ee", ["ee"])
