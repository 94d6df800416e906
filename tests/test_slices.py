"""Python gets rows in slices: memory is that of a slice, not of an Arrow batch."""

import numpy as np
import pytest

from evenspan.operators import encode as E


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, [(i * k) % 50 for k in range(i % 90)] if i % 50 else None) for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, input_ids array<int>").repartition(1)


def test_encoder_gets_slices(docs):
    def make():
        def encode(batch):
            if len(batch) > E.SLICE_ROWS or (len(batch) > 1 and sum(map(len, batch)) > E.SLICE_TOKENS):
                raise MemoryError(f"{len(batch)} rows at once")
            return E.fixture_encoder(3)()(batch)

        return encode

    got = {r["doc_id"]: r for r in E.encode_with(docs, make).collect()}
    assert len(got) == 2000
    for i in (0, 1, 89, 1234):
        ids = got[i]["input_ids"] or []
        assert np.allclose(np.array(got[i]["hidden"] or np.zeros((0, 3))).reshape(-1, 3), E.fixture_encoder(3)()([ids])[0])


def test_tokenizer_gets_slices(spark):
    d = spark.createDataFrame([(i, "a b " * (i % 7) if i % 3 else None) for i in range(3000)], "doc_id long, text string").repartition(1)

    def make():
        def cut(texts):
            if len(texts) > E.SLICE_ROWS:
                raise MemoryError(f"{len(texts)} rows at once")
            return [[len(w) for w in t.split()] for t in texts]

        return cut

    got = {r["doc_id"]: (r["input_ids"], r["length"]) for r in E.tokenize_with(d, make, most=5).collect()}
    assert len(got) == 3000 and got[0] == ([], 0) and got[1] == ([1, 1], 2) and got[5] == ([1] * 5, 5)


def test_generated_rows_of_long_and_null_values(spark):
    d = spark.createDataFrame([(i, None if i == 3 else f"x{i}\ny") for i in range(120)], "doc_id long, text string").repartition(1)
    got = E.generated_rows(d, lambda r: ({"doc_id": r["doc_id"], "line": x} for x in (r["text"] or "").split("\n")), "doc_id long, line string")
    assert got.count() == 239 and got.filter("doc_id = 7").count() == 2
