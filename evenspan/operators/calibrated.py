"""Calibrated encoding end to end: an encoder gives its attention layer by layer, rows of it are put back with equal
mass in every basket before the layer's sum is taken, and documents too short for a basket go plainly.

An encoder here is an object with ``n_layers`` and three steps on padded batches (B documents, L places):

* ``start(ids, mask)``: the vectors before the first layer, (B, L, D);
* ``attention(x, layer, mask, a, b)``: weights of the query places a to b over all places, (B, heads, b - a, L), rows
  summing to 1 over the places that ``mask`` has;
* ``step(x, layer, w, a, b)``: the vectors of these places after the layer, (B, b - a, D).

As queries come in tiles, a batch holds about WEIGHTS weights for a head, not B x L x L, however long its documents are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

#: Query places whose weights are made at once at most, weights of a head among them, about, and padded places of a batch (a longer
#: document is alone).
TILE, WEIGHTS, PLACES = 256, 1 << 20, 65_536

Share = float | str | None


@dataclass(frozen=True)
class Calibration:
    """How rows are evened out. Tokens that stand apart get a share of the row: a number, "equal" (that of a basket) or
    "original" (what they had); the baskets of the others divide the rest equally, in proportion within each."""

    size: int = 128
    #: So many of the last layers; half of them if None.
    layers: int | None = None
    strength: float = 0.5
    #: Which rows: "cls" (the first token's), "last" or "all".
    rows: str = "cls"
    isolate_first: bool = True
    isolate_last: bool = False
    first_share: Share = "original"
    last_share: Share = "equal"

    def __post_init__(self):
        if self.size < 1 or not 0 <= self.strength <= 1 or self.rows not in ("cls", "last", "all"):
            raise ValueError("size is 1 at least, strength from 0 to 1, rows one of cls, last, all")
        if self.layers is not None and self.layers < 1:
            raise ValueError("at least one layer is calibrated")
        shares = [s for s, apart in ((self.first_share, self.isolate_first), (self.last_share, self.isolate_last)) if apart]
        if any(s not in ("equal", "original") if isinstance(s, str) else not 0 <= s <= 1 for s in shares) or sum(s for s in shares if not isinstance(s, str)) >= 1:
            raise ValueError("a share is 'equal', 'original' or a number from 0 to 1, and numbers leave something for the content")

    @property
    def apart(self) -> int:
        return int(self.isolate_first) + int(self.isolate_last)

    def from_layer(self, n_layers: int) -> int:
        """The first layer that is calibrated."""
        many = max(1, n_layers // 2) if self.layers is None else self.layers
        if many > n_layers:
            raise ValueError(f"{many} layers to calibrate, but the encoder has {n_layers}")
        return n_layers - many

    def takes(self, length: int) -> bool:
        """Whether a document of so many tokens has a basket's worth of content."""
        return length - self.apart >= self.size

    def evened(self, w: np.ndarray) -> np.ndarray:
        """Rows over the tokens of one document, (..., tokens), evened out and blended with what they were."""
        n = w.shape[-1]
        content = w[..., int(self.isolate_first) : n - int(self.isolate_last)]
        starts = np.arange(0, content.shape[-1], self.size)
        baskets = len(starts) + self.apart
        out = np.zeros_like(w)
        left = np.ones(w.shape[:-1])
        for share, apart, at in ((self.first_share, self.isolate_first, 0), (self.last_share, self.isolate_last, n - 1)):
            if apart:
                out[..., at] = w[..., at] if share == "original" else 1 / baskets if share == "equal" else share
                left = left - out[..., at]
        if len(starts):
            mass = np.add.reduceat(content, starts, axis=-1)
            part = np.divide(content, np.repeat(mass, np.diff([*starts, content.shape[-1]]), axis=-1), out=np.zeros_like(content), where=content > 0)
            filled = (mass > 0).sum(axis=-1)  # each filled basket sums to 1
            scale = np.divide(np.maximum(left, 0), filled, out=np.zeros_like(left), where=filled > 0)
            out[..., int(self.isolate_first) : n - int(self.isolate_last)] = part * scale[..., None]
        total = out.sum(axis=-1, keepdims=True)
        out = np.divide(out, total, out=np.zeros_like(out), where=total > 0)
        return self.strength * out + (1 - self.strength) * w


def padded(rows: list, left: bool = False, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of a batch, filled up to its longest row on the right or the left."""
    longest = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), longest), pad, np.int64), np.zeros((len(rows), longest), bool)
    for i, r in enumerate(rows):
        at = slice(longest - len(r), longest) if left else slice(0, len(r))
        ids[i, at], mask[i, at] = r, True
    return ids, mask


def forward(encoder, ids: np.ndarray, mask: np.ndarray, calibration: Calibration | None = None, tile: int | None = None, seen: Callable | None = None) -> np.ndarray:
    """Hidden vectors of a padded batch; with ``calibration`` the rows it names are evened out in each of its layers before
    the layer goes on. ``seen(layer, document, first query, before, after)`` is told of the weights, padding cut off."""
    starts, ends = mask.argmax(axis=1), mask.shape[1] - mask[:, ::-1].argmax(axis=1)
    x = encoder.start(ids, mask)
    tile = tile or min(TILE, max(1, WEIGHTS // max(1, mask.size)))
    first = encoder.n_layers if calibration is None else calibration.from_layer(encoder.n_layers)
    for layer in range(encoder.n_layers):
        made = []
        for a in range(0, ids.shape[1], tile):
            b = min(a + tile, ids.shape[1])
            w = encoder.attention(x, layer, mask, a, b)
            for d in np.flatnonzero(mask[:, a:b].any(axis=1)).tolist():
                lo, hi = max(a, starts[d]), min(b, ends[d])
                rows = w[d, :, lo - a : hi - a, starts[d] : ends[d]]
                before = rows.copy() if seen else rows
                if layer >= first:
                    p, q = {"cls": (starts[d], starts[d] + 1), "last": (ends[d] - 1, ends[d]), "all": (lo, hi)}[calibration.rows]
                    if p < hi and q > lo:
                        chosen = slice(max(p, lo) - lo, min(q, hi) - lo)
                        rows[:, chosen] = calibration.evened(rows[:, chosen])
                if seen:
                    seen(layer, d, lo - starts[d], before, rows)
            made.append(encoder.step(x, layer, w, a, b))
        x = np.concatenate(made, axis=1) if made else x
    return x


class LayeredFixture:
    """A small transformer that stands where a model would: vectors from id and place alone, dot-product attention by
    heads, the mean of a token and what it attends to. Matrices for queries, keys and values may be given for each layer."""

    def __init__(self, dim: int = 8, heads: int = 2, layers: int = 2, sharp: float = 1.0, matrices: list[tuple] | None = None):
        self.dim, self.heads, self.n_layers, self.sharp, self.matrices = dim, heads, layers, sharp, matrices

    def _split(self, x: np.ndarray, layer: int, which: int) -> np.ndarray:
        y = x if self.matrices is None else x @ self.matrices[layer][which]
        return y.reshape(*x.shape[:2], self.heads, self.dim // self.heads).transpose(0, 2, 1, 3)

    def start(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        place = np.cumsum(mask, axis=1) - 1
        return np.cos(ids[..., None] * np.arange(1.0, self.dim + 1)) / np.sqrt(1.0 + np.maximum(place, 0))[..., None]

    def attention(self, x: np.ndarray, layer: int, mask: np.ndarray, a: int, b: int) -> np.ndarray:
        s = self.sharp * self._split(x[:, a:b], layer, 0) @ self._split(x, layer, 1).transpose(0, 1, 3, 2)
        s = np.where(mask[:, None, None, :], s, -np.inf)
        top = s.max(axis=-1, keepdims=True)
        e = np.exp(s - np.where(np.isfinite(top), top, 0.0))
        total = e.sum(axis=-1, keepdims=True)
        return np.divide(e, total, out=np.zeros_like(e), where=total > 0)

    def step(self, x: np.ndarray, layer: int, w: np.ndarray, a: int, b: int) -> np.ndarray:
        y = (w @ self._split(x, layer, 2)).transpose(0, 2, 1, 3).reshape(x.shape[0], b - a, self.dim)
        return (x[:, a:b] + y) / 2


def layered_fixture(**how) -> Callable[[], LayeredFixture]:
    return lambda: LayeredFixture(**how)


def batches_of(lengths: list[int], places: int = PLACES) -> list[list[int]]:
    """Rows of like length together, so many that they take about ``places`` padded places."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if not out or (len(out[-1]) + 1) * lengths[i] > places:
            out.append([])
        out[-1].append(i)
    return out


def pool(hidden: np.ndarray, how: str) -> np.ndarray:
    """One vector of the hidden vectors of a document's tokens."""
    return hidden[0] if how == "cls" else hidden[-1] if how == "last" else hidden.mean(axis=0)


def _encoded(docs: DataFrame, fields: list[StructField], make: Callable, ids: str, calibration: Calibration | None, left: bool, result: Callable) -> DataFrame:
    """``docs`` with ``fields``: result(hidden, calibrated) of each document with tokens, nulls of one without."""
    out = StructType([f for f in docs.schema.fields if f.name not in {x.name for x in fields}] + fields)
    arrow = to_arrow_schema(out, prefers_large_types=False)
    own = [f.name for f in out.fields[: len(out.fields) - len(fields)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            rows = [np.asarray(x.values) if x.is_valid else () for x in batch.column(batch.schema.get_field_index(ids))]  # views of the batch
            made: list[tuple] = [(None,) * len(fields)] * len(rows)
            evened = [calibration is not None and calibration.takes(len(r)) for r in rows]
            for kind in (False, True):
                chosen = [i for i, r in enumerate(rows) if len(r) and evened[i] == kind]
                for group in batches_of([len(rows[i]) for i in chosen]):
                    group = [chosen[g] for g in group]
                    a, mask = padded([rows[i] for i in group], left)
                    hidden = forward(encoder, a, mask, calibration if kind else None)
                    for h, m, i in zip(hidden, mask, group, strict=True):
                        made[i] = result(h[m], kind)
            cols = [batch.column(batch.schema.get_field_index(c)).cast(arrow.field(c).type) for c in own]
            cols += [pa.array([m[k] for m in made], type=arrow.field(f.name).type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.mapInArrow(run, out)


_VECTOR, _VECTORS = ArrayType(DoubleType()), ArrayType(ArrayType(DoubleType()))


def encode_layers(docs: DataFrame, make: Callable, calibration: Calibration | None = None, ids: str = "input_ids", left: bool = False) -> DataFrame:
    """``docs`` with hidden (a vector for each token) and calibrated. Empty documents have nulls."""
    fields = [StructField("hidden", _VECTORS), StructField("calibrated", BooleanType())]
    return _encoded(docs, fields, make, ids, calibration, left, lambda h, kind: (h.tolist(), kind))


def encode_calibrated(docs: DataFrame, make: Callable, calibration: Calibration | None = None, pooling: str = "cls", normalize: bool = True, ids: str = "input_ids", left: bool = False) -> DataFrame:
    """``docs`` with embedding and calibrated, in one narrow pass: documents with a basket's worth of content are encoded
    with calibrated rows, the others plainly. Without ``calibration`` its defaults follow the pooling: with "cls" the first token
    stands apart, with "last" both ends do, with "mean" none does and all rows are calibrated."""
    if pooling not in ("cls", "last", "mean"):
        raise ValueError("pooling is one of cls, last, mean")
    how = calibration or Calibration(rows={"mean": "all"}.get(pooling, pooling), isolate_first=pooling != "mean", isolate_last=pooling == "last")

    def result(h: np.ndarray, kind: bool) -> tuple:
        v = pool(h, pooling)
        return (v / max(float(np.linalg.norm(v)), 1e-12) if normalize else v).tolist(), kind

    return _encoded(docs, [StructField("embedding", _VECTOR), StructField("calibrated", BooleanType())], make, ids, how, left, result)


def attention_rows(docs: DataFrame, make: Callable, calibration: Calibration | None = None, key: str = "doc_id", ids: str = "input_ids", layers: list[int] | None = None, first_row_only: bool = False, left: bool = False) -> DataFrame:
    """Attention in long form as the encoder used it: the key, layer, head, q, k, w and w_cal (w where a row isn't calibrated),
    of all layers or those named. What the analyses of ``operators.attention`` take."""
    out = StructType([docs.schema[key], *(StructField(c, IntegerType()) for c in ("layer", "head", "q", "k")), StructField("w", DoubleType()), StructField("w_cal", DoubleType())])
    arrow = to_arrow_schema(out, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            for name, row in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if not row:
                    continue
                told: list[pa.RecordBatch] = []

                def seen(layer, _, first, before, after, name=name, told=told):
                    if (layers is not None and layer not in layers) or (first_row_only and first):
                        return
                    if first_row_only:
                        before, after = before[:, :1], after[:, :1]
                    h, q, k = (x.ravel().astype(np.int32) for x in np.indices(before.shape))
                    cols = [pa.repeat(name, before.size).cast(arrow.field(0).type), np.full(before.size, layer, np.int32), h, q + np.int32(first), k, before.ravel(), after.ravel()]
                    told.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=arrow))

                a, mask = padded([row], left)
                forward(encoder, a, mask, calibration if calibration is not None and calibration.takes(len(row)) else None, seen=seen)
                yield from told

    return docs.select(key, ids).mapInArrow(run, out)
