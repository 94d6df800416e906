"""Hard negatives by distributed radix selection.

A window is an anchor with a range of integer scores: all scores, for its positives; from a share of a positive's score up
to that score, for the negatives of anchor and positive. The kth best row of a window is located without sorting or
gathering scores: each pass over the rows counts, in every window, how many scores fall into each bucket of a digit
of their distance from the window's top; the bucket with the kth becomes the next window's range, and the next pass
counts the next digit. When the kth distance is known a last pass gathers the rows within it. A task sends of each window only
the buckets, or rows, down to its own kth, as the kth of all can't lie beyond that: ties, hot labels and copies of one
vector cost no more than a few lines for each window and task.

Anchors are the stated query set and are taken in slabs of bounded size, which the tasks hold; all rows pass by each
slab, in blocks, and scores are made anew in each pass as a matrix product, never stored.

Scores are exact: products go through floats only where no sum can leave the integers that the float holds, else through
Python's integers, and are held within 2^60 on either side.

Defined results: rows with a null id, label or vector, or with a component that is null or not finite (also after scaling),
take no part; of vectors of different lengths the shorter counts as filled up with zeros; a row that repeats is another row,
so it is a positive of its copy, and an anchor for each time it comes; no anchor, or an empty table, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, stash, tidy

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is at least this share of its positive's, and not above it.
LEAST_PERCENT = 80
#: Anchors that pass the rows at once, and bytes of their vectors at most.
SLAB, SLAB_BYTES = 4096, 16_000_000
#: Bits of a digit: so many are settled in one pass.
DIGIT = 10
#: Rows that are scored at once.
BLOCK = 512
FAR = 1 << 60
_NO = np.zeros(0, np.int64)


def prepared(rows: DataFrame, anchors: Column) -> DataFrame:
    """``rows``: vec_id, label, embedding. Rows that take part: uid, id, label, anchor, norm, wide, q (components times SCALE,
    floored: 16-bit integers, or doubles where ``wide``)."""
    picked = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), "embedding")
    picked = picked.filter("id is not null and label is not null and embedding is not null")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            lists = b.column(3)
            flat = lists.flatten()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(SCALE * flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
            good, wide, norms, packed = [], [], [], []
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                v = q[start:end]
                top = np.abs(v).max(initial=0.0)
                good.append(bool(np.isfinite(top)))
                if good[-1]:
                    wide.append(bool(top > 32767))
                    norms.append(float(np.linalg.norm(v / top) * top) if top else 0.0)
                    packed.append((v if wide[-1] else v.astype(np.int16)).tobytes())
            kept = b.filter(pa.array(good, pa.bool_()))
            n = kept.num_rows
            cols = [pa.array(np.arange(uid, uid + n), pa.int64()), *kept.columns[:3], pa.array(norms, pa.float64()), pa.array(wide, pa.bool_()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "id", "label", "anchor", "norm", "wide", "q"])
            uid += n

    return picked.mapInArrow(make, "uid long, id long, label long, anchor boolean, norm double, wide boolean, q binary")


def _matrix(packed: list[bytes], wide: np.ndarray, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` doubles, filled up with zeros or cut (what the other side lacks counts nothing)."""
    if not wide.any() and all(len(x) == 2 * dims for x in packed):
        return np.frombuffer(b"".join(packed), np.int16).reshape(len(packed), dims).astype(np.float64)
    out = np.zeros((len(packed), dims))
    for i, x in enumerate(packed):
        v = np.frombuffer(x, np.float64 if wide[i] else np.int16)[:dims]
        out[i, : len(v)] = v
    return out


def _scores(rows: np.ndarray, norms: np.ndarray, slab: dict) -> np.ndarray:
    """Integer products of rows and anchors. No partial sum is larger than the product of the norms."""
    far = slab["norms"].max(initial=0.0) * (1 + 1e-9)
    if norms.max(initial=0.0) * far < 2**24:
        return (rows.astype(np.float32) @ slab["q"].astype(np.float32).T).astype(np.int64)
    exact = norms * far < 2**53
    out = np.empty((len(rows), len(slab["q"])), np.int64)
    out[exact] = (rows[exact] @ slab["q"].T).astype(np.int64)
    if not exact.all():
        theirs = [[int(x) for x in v] for v in slab["q"]]
        for i in np.flatnonzero(~exact).tolist():
            mine = [int(x) for x in rows[i]]
            out[i] = [max(-FAR, min(FAR, sum(x * y for x, y in zip(mine, v, strict=True)))) for v in theirs]
    return out


def _within(batch: pa.RecordBatch, slab: dict, windows: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Window, distance of the score from the window's top, and id, of all rows that lie in a window, by blocks."""
    uids, ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "id", "label"))
    norms, wide = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "wide"))
    packed, per = batch.column("q").to_pylist(), windows["hi"].shape[1]
    lowest, highest = windows["lo"].min(axis=1, initial=FAR), windows["hi"].max(axis=1, initial=-FAR)
    for at in range(0, len(ids), BLOCK):
        part = slice(at, at + BLOCK)
        s = _scores(_matrix(packed[part], wide[part], slab["q"].shape[1]), norms[part], slab)
        fits = (labels[part, None] == slab["label"]) == windows["same"]
        fits &= (s >= lowest) & (s <= highest)
        own = np.searchsorted(slab["uid"], uids[part]).clip(0, len(slab["uid"]) - 1)
        itself = slab["uid"][own] == uids[part]
        fits[np.flatnonzero(itself), own[itself]] = False
        row, anchor = np.nonzero(fits)
        score, id_ = s[row, anchor], ids[part][row]
        for j in range(per):
            ok = (score >= windows["lo"][anchor, j]) & (score <= windows["hi"][anchor, j])
            a = anchor[ok]
            yield a * per + j, windows["hi"][a, j] - score[ok], id_[ok]


def _counted(blocks: DataFrame, slab, windows, state, shift: int) -> DataFrame:
    """w, digit, n, left: how many rows of a window have the digit, of those that agree with the digits settled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, win, st = slab.value, windows.value, state.value
        codes, counts = _NO, _NO
        for b in batches:
            for w, d, _ in _within(b, s, win):
                ok = st["open"][w] & (d >> (shift + DIGIT) == st["prefix"][w])
                new, n = np.unique((w[ok] << DIGIT) | (d[ok] >> shift & ((1 << DIGIT) - 1)), return_counts=True)
                codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
                # of a window, the buckets down to the one that has this task's kth
                w = codes >> DIGIT
                before = np.cumsum(counts) - counts
                first = np.searchsorted(w, w)
                keep = before - before[first] < st["left"][w] if len(w) else np.zeros(0, bool)
                codes, counts = codes[keep], counts[keep]
        w = codes >> DIGIT
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(codes & ((1 << DIGIT) - 1)), pa.array(counts), pa.array(st["left"][w])], names=["w", "digit", "n", "left"])

    told = blocks.mapInArrow(count, "w long, digit long, n long, left long")
    return told.groupBy("w", "digit", "left").agg(F.sum("n").alias("n"))


def _gathered(blocks: DataFrame, slab, windows, state, k: int) -> DataFrame:
    """w, d, id of the rows within the kth distance: of each window the first k of every task."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, win, st = slab.value, windows.value, state.value
        held = [_NO, _NO, _NO]
        for b in batches:
            for found in _within(b, s, win):
                ok = found[1] <= st["reach"][found[0]]
                held = [np.concatenate([x, y[ok]]) for x, y in zip(held, found, strict=True)]
                order = np.lexsort((held[2], held[1], held[0]))
                held = [x[order] for x in held]
                keep = np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) < k
                held = [x[keep] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["w", "d", "id"])

    told = blocks.mapInArrow(gather, "w long, d long, id long")
    rank = F.row_number().over(W.partitionBy("w").orderBy("d", "id"))
    return told.withColumn("rank", rank).filter(F.col("rank") <= k)


def select_first(blocks: DataFrame, slab, windows: dict, k: int) -> DataFrame:
    """The first k rows of each window, by falling score and then rising id: w, d (distance from the top), id, rank.
    ``windows``: hi and lo, a line for each anchor of the slab and a column for each of its windows, and same:
    whether rows have the anchor's label."""
    sc = blocks.sparkSession.sparkContext
    hi, lo = windows["hi"].ravel(), windows["lo"].ravel()
    span = np.maximum(hi - lo, -1)
    passes = max(1, -(-int(span.max(initial=0)).bit_length() // DIGIT))
    given = sc.broadcast(windows)
    reach, state = span.copy(), {"prefix": np.zeros(len(hi), np.int64), "left": np.full(len(hi), k, np.int64), "open": span >= 0}
    for p in reversed(range(passes)):
        sent = sc.broadcast(state)
        run = F.sum("n").over(W.partitionBy("w").orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
        kth = _counted(blocks, slab, given, sent, p * DIGIT).withColumn("run", run).filter("run >= left and run - n < left")
        got = kth.select("w", "digit", (F.col("run") - F.col("n")).alias("before")).toArrow()  # a line for each window of the slab at most
        sent.destroy()
        w, digit, before = (got.column(c).to_numpy() for c in ("w", "digit", "before"))
        found = np.zeros(len(hi), bool)
        found[w] = True
        state = {"prefix": state["prefix"].copy(), "left": state["left"].copy(), "open": found}  # windows with fewer than k rows are all within reach
        state["prefix"][w] = state["prefix"][w] << DIGIT | digit
        state["left"][w] -= before
    reach[state["open"]] = state["prefix"][state["open"]]
    return _gathered(blocks, slab, given, sc.broadcast({"reach": reach}), k)


def _slab(anchors: list) -> dict:
    anchors = sorted(anchors, key=lambda r: r.uid)
    wide = np.array([r.wide for r in anchors])
    dims = max((len(r.q) // (8 if r.wide else 2) for r in anchors), default=0)
    return {
        "uid": np.array([r.uid for r in anchors], np.int64), "id": np.array([r.id for r in anchors], np.int64), "label": np.array([r.label for r in anchors], np.int64),
        "norms": np.array([r.norm for r in anchors]), "q": _matrix([bytes(r.q) for r in anchors], wide, dims),
    }


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """``rows``: vec_id, label, embedding; ``anchors``: which of them are. For each anchor and each of its first
    ``positives`` other rows of its label the first ``negatives`` rows of other labels whose score lies from
    ``least_percent`` of the positive's up to it: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    with tidy(spark):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")  # rows are short
        blocks = stash(prepared(rows, anchors), "vectors")
        queries = stash(blocks.filter("anchor"), "anchors")
        n, longest = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("q") * F.when(F.col("wide"), 1).otherwise(4)), F.lit(1))).first()
        top = blocks.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0]
        slabs = -(-n // max(1, min(SLAB, SLAB_BYTES // max(1, longest))))
        made = [_mined(blocks, queries.filter(F.pmod(F.xxhash64("uid"), F.lit(slabs)) == i).collect(), top, positives, negatives, least_percent) for i in range(slabs)]
        drop(blocks, queries)
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    paths = [x._stashed for x in made if x is not None]
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def _mined(blocks: DataFrame, anchors: list, top: float, positives: int, negatives: int, least_percent: int) -> DataFrame | None:
    """The rows of one slab of anchors."""
    spark = blocks.sparkSession
    if not anchors:
        return None
    slab = _slab(anchors)
    sent = spark.sparkContext.broadcast(slab)
    reach = np.array([min(FAR, int(x * top * (1 + 1e-9)) + 1) for x in slab["norms"].tolist()], np.int64)[:, None]
    best = select_first(blocks, sent, {"hi": reach, "lo": -reach, "same": True}, positives).toArrow()  # so many lines for each anchor of the slab at most
    a, rank = best.column("w").to_numpy(), best.column("rank").to_numpy() - 1
    ids, hi = np.zeros((len(anchors), positives), np.int64), np.full((len(anchors), positives), -1, np.int64)
    lo = np.zeros_like(hi)  # an empty window where there is no such positive
    ids[a, rank] = best.column("id").to_numpy()
    hi[a, rank] = score = reach[a, 0] - best.column("d").to_numpy()
    lo[a, rank] = [-(-least_percent * x // 100) for x in score.tolist()]
    found = select_first(blocks, sent, {"hi": hi, "lo": lo, "same": False}, negatives)
    named = spark.sparkContext.broadcast({"anchor": np.repeat(slab["id"], positives), "positive": ids.ravel(), "hi": hi.ravel()})

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = named.value
        for b in batches:
            w, d, id_, rank = (b.column(c).to_numpy() for c in ("w", "d", "id", "rank"))
            cols = [x["anchor"][w], x["positive"][w], rank.astype(np.int32), id_, x["hi"][w], x["hi"][w] - d]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    out = stash(found.mapInArrow(name, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "negatives")
    sent.destroy()
    named.destroy()
    return out
