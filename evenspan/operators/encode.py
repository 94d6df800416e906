"""Encoders: the hook for a model, a fixture encoder, pooling, and the split of short and calibrated inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import cls_pool, l2_normalize, last_pool, mean_rows, span_pool


#: Rows, and characters or tokens, that Python has as objects at once (a longer row is alone); vectors are given on at that pace too.
SLICE_ROWS, SLICE_CHARS, SLICE_TOKENS = 200, 500_000, 20_000


def slices(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so much size and SLICE_ROWS rows at most."""
    start = 0
    while start < len(sizes):
        stop, held = start + 1, sizes[start]
        while stop < len(sizes) and stop - start < SLICE_ROWS and held + sizes[stop] <= most:
            held += sizes[stop]
            stop += 1
        yield batch.slice(start, stop - start)
        start = stop


def _beside(part: pa.RecordBatch, arrow: pa.Schema, made: list[pa.Array]) -> pa.RecordBatch:
    """Columns of ``part`` and behind them those that were made, in the types of ``arrow``."""
    own = [c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)]
    return pa.RecordBatch.from_arrays([*own, *(c.cast(f.type) for c, f in zip(made, list(arrow)[len(own) :], strict=True))], schema=arrow)


def tokenize_with(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[list[int]]]], text: str = "text", most: int | None = None) -> DataFrame:
    """``docs`` with input_ids and length from a tokenizer that ``make`` builds once in each task, cut at ``most`` tokens."""
    schema = StructType([*docs.schema.fields, StructField("input_ids", ArrayType(IntegerType())), StructField("length", IntegerType())])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for b in batches:
            at = b.schema.get_field_index(text)
            for part in slices(b, pc.utf8_length(b.column(at)).fill_null(0).to_pylist(), SLICE_CHARS):
                ids = [x[:most] for x in tokenizer([t or "" for t in part.column(at).to_pylist()])]
                yield _beside(part, arrow, [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int32())])

    return docs.mapInArrow(run, schema)


def encode_with(docs: DataFrame, make: Callable[[], Callable[[list[list[int]]], list[np.ndarray]]], ids: str = "input_ids") -> DataFrame:
    """``docs`` with hidden, one vector for each token, from an encoder that ``make`` builds once in each task. Vectors stay
    arrays of numbers all the way."""
    schema = StructType([*docs.schema.fields, StructField("hidden", ArrayType(ArrayType(DoubleType())))])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for b in batches:
            at = b.schema.get_field_index(ids)
            for part in slices(b, pc.list_value_length(b.column(at)).fill_null(0).to_pylist(), SLICE_TOKENS):
                made = [np.asarray(h, dtype=np.float64) for h in encoder([x or [] for x in part.column(at).to_pylist()])]
                yield _beside(part, arrow, [vectors_of(made)])

    return docs.mapInArrow(run, schema)


def vectors_of(made: list[np.ndarray]) -> pa.Array:
    """A list of vectors for each matrix; of no vectors an empty one."""
    rows = [len(h) for h in made]
    widths = np.repeat([h.shape[1] if h.ndim > 1 else 0 for h in made], rows)
    values = pa.array(np.concatenate([h.ravel() for h in made]) if made else np.zeros(0))
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *widths.tolist()]), pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *rows]), pa.int32()), inner)


def fixture_encoder(dim: int = 8) -> Callable[[], Callable[[list[list[int]]], list[np.ndarray]]]:
    """Stands where a model would: a token's vector depends on its id and place alone, and sums and cosines are exact to repeat."""

    def make():
        def encode(batch: list[list[int]]) -> list[np.ndarray]:
            axis = np.arange(1, dim + 1)
            return [np.cos(np.outer(np.array(ids, dtype=float), axis)) / np.sqrt(1 + np.arange(len(ids)))[:, None] for ids in batch]

        return encode

    return make


def pooled(hidden: Column, how: str, normalize: bool = True) -> Column:
    """'cls', 'last' or 'mean' pooling of token vectors."""
    choose = {"cls": cls_pool, "last": last_pool, "mean": mean_rows}
    if how not in choose:
        raise ValueError(f"pooling is one of {sorted(choose)}")
    v = choose[how](hidden)
    return l2_normalize(v) if normalize else v


def pooling_of(override: str | None, model: str | None, default: str = "mean") -> str:
    """A caller's choice goes before the model's own, and that before the default."""
    return override or model or default


def segment_vectors(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """doc_id, pos, seg_id, embedding of each non-empty span of a document: segments (seg_id, start, end) over hidden."""
    s = docs.select("doc_id", "hidden", F.posexplode("segments").alias("pos", "s")).filter("s.end > s.start")
    v = span_pool(F.col("hidden"), F.col("s.start"), F.col("s.end"))
    return s.select("doc_id", "pos", "s.seg_id", (l2_normalize(v) if normalize else v).alias("embedding"))


def geometry(docs: DataFrame, valid: str = "valid_len", padded: str = "padded_len", left: bool = False, isolated: int = 1, basket: int = 128) -> DataFrame:
    """start_idx, content_len, n_baskets and whether the content is long enough to be calibrated."""
    content = F.greatest(F.col(valid) - isolated, F.lit(0))
    start = F.col(padded) - F.col(valid) if left else F.lit(0)
    out = docs.withColumn("start_idx", start).withColumn("content_len", content)
    return out.withColumn("n_baskets", F.ceil(content / basket).cast("int")).withColumn("calibrated", content >= basket)


def split_route(short: DataFrame, plain: Callable[[DataFrame], DataFrame], calibrated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows too short for calibration go through ``plain``, the others through ``calibrated``; both give the same columns."""
    return plain(short.filter(~F.col("calibrated"))).unionByName(calibrated(short.filter("calibrated")))


#: What a model is given of a row; all else stands beside it.
MODEL_KEYS = ("input_ids", "attention_mask", "token_type_ids")
CHOICES = {"pooling": ("cls", "mean", "last"), "padding_side": ("left", "right"), "calibrated_tokens": ("cls", "all", "last")}


def overrides(pooling: str | None = None, padding_side: str | None = None, calibrated_tokens: str | None = None, isolate_first: bool | None = None,
              isolate_last: bool | None = None, *, model_pooling: str | None = None, decoder: bool = False) -> dict[str, object]:
    """The settings that take effect: a caller's choice goes before what the model says, and that before the default.

    A model without a pooling of its own is pooled by its first token; decoders are padded on the left. Without a
    choice the calibrated tokens are those that are pooled, and the first and last tokens stand apart as that asks.
    """
    for name, value in (("pooling", pooling), ("padding_side", padding_side), ("calibrated_tokens", calibrated_tokens)):
        if value is not None and value not in CHOICES[name]:
            raise ValueError(f"{name} is one of {CHOICES[name]}")
    how = pooling_of(pooling, model_pooling, "cls")
    first, last = {"mean": (False, False), "cls": (True, False)}.get(how, (True, True))
    return {
        "pooling": how, "padding_side": padding_side or ("left" if decoder else "right"), "calibrated_tokens": calibrated_tokens or {"cls": "cls", "mean": "all", "last": "last"}[how],
        "isolate_first": first if isolate_first is None else isolate_first, "isolate_last": last if isolate_last is None else isolate_last,
    }


def override_columns(pooling: Column, padding_side: Column, calibrated_tokens: Column, isolate_first: Column, isolate_last: Column, *, model_pooling: Column, decoder: Column) -> dict[str, Column]:
    """The same for rows of settings, null where nothing is chosen; a choice that there isn't fails the row's task."""
    def known(name: str, value: Column) -> Column:
        return F.when(value.isNull() | value.isin(*CHOICES[name]), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} is one of {CHOICES[name]}, not "), value)))

    how = F.coalesce(known("pooling", pooling), model_pooling, F.lit("cls"))
    return {
        "pooling": how, "padding_side": F.coalesce(known("padding_side", padding_side), F.when(decoder, "left").otherwise("right")),
        "calibrated_tokens": F.coalesce(known("calibrated_tokens", calibrated_tokens), F.when(how == "mean", "all").otherwise(how)),
        "isolate_first": F.coalesce(isolate_first, how != "mean"), "isolate_last": F.coalesce(isolate_last, how == "last"),
    }


def model_inputs(rows: DataFrame, keep: tuple[str, ...] = MODEL_KEYS) -> DataFrame:
    """Only the columns that a model takes, as far as there are any."""
    return rows.select(*[c for c in keep if c in rows.columns])


def generated_rows(of: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """A frame of the rows that ``make(row)`` yields for each row of ``of``; nothing is held but a batch."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # some rows at once as objects
            rows = (x for at in range(0, b.num_rows, 50) for r in b.slice(at, 50).to_pylist() for x in make(r))
            while batch := list(islice(rows, 1000)):
                yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in batch], type=f.type) for f in arrow], schema=arrow)

    return of.mapInArrow(run, out)


def collated(rows: DataFrame, batch: str, pad_id: int = 0, left: bool = False, multiple: int = 1, ids: str = "input_ids") -> DataFrame:
    """``rows`` with the ids padded to the longest of their batch, or the next multiple, and an attention_mask."""
    longest = rows.groupBy(F.col(batch).alias("_b")).agg((F.ceil(F.max(F.size(ids)) / multiple) * multiple).cast("int").alias("_l"))
    out = rows.join(longest, F.col(batch).eqNullSafe(F.col("_b")))
    room = F.array_repeat(F.lit(pad_id), F.col("_l") - F.size(ids))
    ones, none = F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_l") - F.size(ids))
    sides = (lambda a, b: F.concat(b, a)) if left else F.concat
    return out.withColumns({"attention_mask": sides(ones, none), ids: sides(F.col(ids), room)}).drop("_b", "_l")
