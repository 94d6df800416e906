"""Calibrated encoding against a plain loop over documents, layers, heads and rows."""

import numpy as np
import pytest

from evenspan import jobs as J
from evenspan.operators import calibrated as K

RNG = np.random.default_rng(1)
MATRICES = [tuple(RNG.normal(size=(6, 6)) for _ in range(3)) for _ in range(3)]
MADE = K.layered_fixture(dim=6, heads=2, layers=3, sharp=0.7, matrices=MATRICES)


def evened(row, c):
    """One row by baskets, in words of the definition."""
    n = len(row)
    inside = list(range(int(c.isolate_first), n - int(c.isolate_last)))
    baskets = [inside[i : i + c.size] for i in range(0, len(inside), c.size)]
    alone = ([(0, c.first_share)] if c.isolate_first else []) + ([(n - 1, c.last_share)] if c.isolate_last else [])
    out = [0.0] * n
    for at, share in alone:
        out[at] = row[at] if share == "original" else 1 / (len(baskets) + len(alone)) if share == "equal" else share
    left = max(0.0, 1 - sum(out))
    filled = [b for b in baskets if sum(row[k] for k in b) > 0]
    for b in filled:
        for k in b:
            out[k] = left / len(filled) * row[k] / sum(row[j] for j in b)
    return [c.strength * x / sum(out) + (1 - c.strength) * w for x, w in zip(out, row, strict=True)]


def plainly(ids, c):
    x = np.array([[np.cos(i * (j + 1)) / np.sqrt(1 + p) for j in range(6)] for p, i in enumerate(ids)])
    n = len(ids)
    for layer, (wq, wk, wv) in enumerate(MATRICES):
        y = np.zeros_like(x)
        for h in (slice(0, 3), slice(3, 6)):
            q, k, v = (x @ wq)[:, h], (x @ wk)[:, h], (x @ wv)[:, h]
            for i in range(n):
                e = np.exp(0.7 * (k @ q[i]))
                w = (e / e.sum()).tolist()
                if c and n - c.apart >= c.size and layer >= 3 - c.layers and i in {"cls": [0], "last": [n - 1], "all": range(n)}[c.rows]:
                    w = evened(w, c)
                y[i, h] = np.array(w) @ v
        x = (x + y) / 2
    return x


DOCS = [(i, RNG.integers(1, 50, n).tolist(), "x") for i, n in enumerate((1, 2, 3, 7, 8, 9, 20, 33, 5))] + [(50, [], None), (51, None, "y")]
CASES = [
    K.Calibration(4, 1, 1.0), K.Calibration(4, 2, 0.5, "all", False, False), K.Calibration(3, 3, 0.7, "last", True, True, 0.2, 0.1),
    K.Calibration(5, 2, 0.9, "all", True, True, "equal", "original"), K.Calibration(4, 1, 0.0), K.Calibration(1, 2, 0.5, "cls", False, True),
]


@pytest.mark.parametrize("c", CASES)
@pytest.mark.parametrize("left", [False, True])
def test_against_loops(spark, c, left):
    df = spark.createDataFrame(DOCS, "doc_id long, input_ids array<int>, embedding string")
    got = {r["doc_id"]: r for r in K.encode_layers(df, MADE, c, left=left).collect()}
    for i, ids, _ in DOCS:
        if not ids:
            assert got[i]["hidden"] is None and got[i]["calibrated"] is None
            continue
        assert got[i]["calibrated"] == (len(ids) - c.apart >= c.size)
        assert np.allclose(got[i]["hidden"], plainly(ids, c))


def test_tiles_and_padding_change_nothing():
    rows = [r for _, r, _ in DOCS if r]
    for left in (False, True):
        ids, mask = K.padded(rows, left)
        for c in (None, CASES[1], CASES[2]):
            whole = K.forward(MADE(), ids, mask, c)
            assert all(np.allclose(K.forward(MADE(), ids, mask, c, tile)[mask], whole[mask]) for tile in (1, 5, 7))


def test_embeddings_by_pooling(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, input_ids array<int>, embedding string")
    for how, at in (("cls", lambda h: h[0]), ("last", lambda h: h[-1]), ("mean", lambda h: h.mean(axis=0))):
        c = K.Calibration(4, 2, 0.5, {"mean": "all"}.get(how, how), how != "mean", how == "last")
        got = {r["doc_id"]: r["embedding"] for r in K.encode_calibrated(df, MADE, c, how).collect()}
        for i, ids, _ in DOCS:
            if ids:
                v = at(plainly(ids, c))
                assert np.allclose(got[i], v / np.linalg.norm(v))
            else:
                assert got[i] is None
    assert K.encode_calibrated(df.limit(0), MADE).count() == 0


def test_attention_that_was_used(spark):
    c = CASES[1]
    df = spark.createDataFrame([d[:2] for d in DOCS], "doc_id long, input_ids array<int>")
    rows = K.attention_rows(df, MADE, c).collect()
    assert len(rows) == sum(3 * 2 * len(i) ** 2 for _, i, _ in DOCS if i)
    for r in rows:
        assert r["layer"] >= 1 or r["w"] == r["w_cal"]
    first = [r for r in rows if (r["doc_id"], r["layer"], r["head"], r["q"]) == (7, 2, 1, 5)]
    first.sort(key=lambda r: r["k"])
    assert np.allclose([r["w_cal"] for r in first], evened([r["w"] for r in first], c))
    assert {r["q"] for r in K.attention_rows(df, MADE, c, first_row_only=True, layers=[2]).collect()} == {0}


def test_wrong_settings_are_told():
    for bad in ({"size": 0}, {"strength": 2.0}, {"rows": "some"}, {"layers": 0}, {"first_share": "half"}, {"first_share": 0.6, "last_share": 0.5, "isolate_last": True}):
        with pytest.raises(ValueError):
            K.Calibration(**bad)
    with pytest.raises(ValueError):
        K.Calibration(layers=4).from_layer(3)


def test_job_with_settings_for_each_embedder(spark):
    cfg = {"apply_attn_calibration": True, "calib_layers": "last_half", "calib_basket_size": 4, "latechunk_calib_layers": "last", "standalone_apply_attn_calibration": False, "pooling": "mean", "latechunk_calib_strength": 0.25}
    own, late = J.embedder_settings(cfg, "standalone"), J.embedder_settings(cfg, "latechunk")
    assert J.calibration_of(own, 6) is None
    assert J.calibration_of(late, 6) == K.Calibration(4, 1, 0.25, "all", False, False)
    assert J.calibration_of(J.embedder_settings(cfg | {"latechunk_calib_layers": "last_half"}, "latechunk"), 6).layers == 3
    seg = spark.createDataFrame([(i, "en", "t", [101, *range(i + 1, i + 9), 102]) for i in range(4)], "dataset_idx int, lang string, text string, input_ids array<int>")
    idx = spark.createDataFrame([(0, [0, 1, 2]), (1, [3, 2, 0])], "doc_no long, segs array<int>")
    base = {"source_lang": "en", "pooling": "mean"}
    plain = J.compute_embeddings(spark, base, seg, idx, MADE)
    evened_ = J.compute_embeddings(spark, base | cfg, seg, idx, MADE)
    ids = [101, *range(1, 9), *range(2, 10), *range(3, 11), 102]
    for (_, doc, late_rows), c in ((plain, None), (evened_, K.Calibration(4, 1, 0.25, "all", False, False))):
        h = plainly(ids, c)
        v = h.mean(axis=0)
        assert np.allclose(doc.filter("doc_id = 0").first()["embedding"], v / np.linalg.norm(v))
        v = h[9:17].mean(axis=0)
        assert np.allclose(late_rows.filter("doc_id = 0 and pos = 1").first()["embedding"], v / np.linalg.norm(v))
    same = lambda x: sorted((r["seg_id"], tuple(r["embedding"])) for r in x.collect())
    assert same(plain[0]) == same(evened_[0])
    with pytest.raises(ValueError):
        J.compute_embeddings(spark, base | cfg, seg, idx)


def test_weights_of_a_batch_are_bounded():
    """However many places a batch has, about WEIGHTS weights of a head are made at once."""

    class Watched(K.LayeredFixture):
        most = 0

        def attention(self, x, layer, mask, a, b):
            w = super().attention(x, layer, mask, a, b)
            Watched.most = max(Watched.most, w[:, 0].size)
            return w

    for n, length in ((40, 300), (4, 5000)):
        ids, mask = K.padded([list(range(1, length + 1))] * n)
        K.forward(Watched(dim=2, heads=1, layers=1), ids, mask, K.Calibration(size=32, layers=1))
    assert 0 < Watched.most <= K.WEIGHTS
