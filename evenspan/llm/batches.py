"""Arrow batches of texts in groups of bounded size, for the operators that run Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .holders import release

#: Texts are handled in groups of about so many characters (a longer text is a group of its own).
GROUP_CHARS = 2_000_000


def with_columns(source: DataFrame, text: str, carry: list[str], fields: list[StructField], make: Callable[[], Callable[[list], list]], group_chars: int = GROUP_CHARS) -> DataFrame:
    """``carry`` of ``source`` and ``fields``, which come from texts: ``make()``, called once in a task, gives a
    function from a group of texts (or None) to one list or Arrow array per field. A narrow pass without shuffle."""
    carry = [c for c in carry if c not in {f.name for f in fields}]
    picked = source.select(*carry, source[text].alias("_text"))
    out = StructType([picked.schema[c] for c in carry] + fields)
    arrow = to_arrow_schema(out, prefers_large_types=False)
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts, start = batch.column(n), 0
            lengths = [x or 0 for x in pc.utf8_length(texts).to_pylist()]
            while start < len(lengths):
                stop, chars = start, 0
                while stop < len(lengths) and (stop == start or chars + lengths[stop] <= group_chars):
                    chars += lengths[stop]
                    stop += 1
                made = work(texts.slice(start, stop - start).to_pylist())
                cols = [batch.column(c).slice(start, stop - start).cast(arrow.field(c).type) for c in range(n)]
                cols += [x.cast(arrow.field(n + k).type) if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(n + k).type) for k, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
                start, made, cols = stop, None, None
        batch = texts = None
        release()

    return picked.mapInArrow(run, out)


#: Longer words are looked at in pieces of this length that overlap by half.
PIECE = 40
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def pieces(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The words between marks of start and end, long ones in pieces; and the word each piece belongs to."""
    out, owner = [], []
    for i, w in enumerate(words):
        w = f"\x02{w}\x03"
        for at in range(0, max(1, len(w) - PIECE // 2), PIECE // 2) if len(w) > PIECE else (0,):
            out.append(w[at : at + PIECE])
            owner.append(i)
    return out, np.array(owner, dtype=np.int64)


def hashed_subsequences(parts: list[str], patterns: tuple[tuple[int, ...], ...], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each pattern of offsets: its number, a matrix of hashed subsequences (part, place), and which of them exist."""
    codes = np.array(parts, dtype=f"U{PIECE}").view(np.uint32).reshape(len(parts), PIECE).astype(np.uint64)
    longest = max(map(len, parts), default=0)
    for k, p in enumerate(patterns):
        width = longest - p[-1]
        if width <= 0:
            continue
        h = np.full((len(parts), width), np.uint64(len(p)), dtype=np.uint64)
        for o, odd in zip(p, _ODD, strict=False):
            h = (h ^ codes[:, o : o + width]) * odd
            h ^= h >> np.uint64(29)
        h = (h * _ODD[0]) >> np.uint64(64 - bits)
        yield k, h.astype(np.int64), codes[:, p[-1] : p[-1] + width] != 0
