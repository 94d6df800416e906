"""How many documents hold a token, told back to the documents, without a row for each token.

Documents are taken in blocks, as many as a task reads. A block sends each token it has once, as a packed array
for each part of the hash space; a part adds up what all blocks sent and answers every block with one byte a
token, the level of its count. Hot tokens cost no more than one entry a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType

#: Tokens of a block at most (but for a longer document), and about so many sent to a part.
BLOCK_TOKENS, PART_TOKENS = 400_000, 400_000


def scattered(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits one to one to others, evenly spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Gives the memory that arrays took back to the system: a Python worker lives on, and the next stage has workers
    of its own kind beside it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def parts_for(tokens: int) -> int:
    """How many parts so many tokens are dealt to: a power of two."""
    return 1 << max(4, (max(1, tokens // PART_TOKENS) - 1).bit_length())


def level(count: np.ndarray) -> np.ndarray:
    """0 for a count of one, else by eighths of doublings; rises with the count."""
    return np.where(count > 1, 1 + np.floor(8 * np.log2(np.maximum(count, 1))), 0).clip(0, 255).astype(np.uint8)


def count_of(levels: np.ndarray) -> np.ndarray:
    """About the count that a level stands for."""
    return np.where(levels > 0, np.exp2((levels.astype(np.float32) - 1) / 8), 1)


def send(df: DataFrame, parts: int, facts: dict[str, str], work: Callable[[list], Iterator[tuple[list, np.ndarray]]]) -> DataFrame:
    """Blocks of the rows of ``df``, whose first column is the key. ``work`` makes of the columns of a batch, as
    lists, for each row its facts (of the named types) and its distinct tokens, hashes that are scattered here. A block has a head (part -1:
    keys, facts, which document has which token) and a row for each part with the tokens, sorted, and their
    counts within the block."""
    import pyarrow as pa

    key = df.schema.fields[0]
    kind = to_arrow_type(DataType.fromDDL(key.dataType.simpleString()))  # parts of it may be null
    names, kinds = ["key", *facts], [kind, *({"long": pa.int64()}[t] for t in facts.values())]
    bits = parts.bit_length() - 1
    edges = np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)

    def packed(block: int, rows: list, tokens: list) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(t) for t in tokens])
        # another order than that of the hashes, by which prefixes are taken
        every = scattered(np.concatenate(tokens) ^ np.uint64(0x5BD1E995)) if tokens else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(tokens), dtype=np.uint32), lengths)
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        first = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        distinct, counts = every[at], np.diff(np.append(at, len(every))).clip(0, 65535).astype(np.uint16)
        cuts = [0, *np.searchsorted(distinct, edges).tolist(), len(distinct)]
        full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        n = 1 + len(full)
        cols = [
            pa.array([block] * n, pa.int64()), pa.array([-1, *full], pa.int32()),
            pa.array([b"", *(distinct[cuts[p] : cuts[p + 1]].tobytes() for p in full)], pa.binary()),
            pa.array([b"", *(zlib.compress(counts[cuts[p] : cuts[p + 1]].tobytes(), 1) for p in full)], pa.binary()),
            pa.array([owner.astype(np.uint16 if len(tokens) < 65536 else np.uint32).tobytes(), *[None] * len(full)], pa.binary()),
            pa.array([np.packbits(first).tobytes(), *[None] * len(full)], pa.binary()),
        ]
        cols += [pa.array([[r[i] for r in rows], *[None] * len(full)], pa.list_(k)) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "part", "tokens", "counts", "owners", "first", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, tokens, size = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys = part.column(0).to_pylist()
                for k, (fact, t) in zip(keys, work([c.to_pylist() for c in part.columns]), strict=True):
                    if fact is None:
                        continue
                    rows.append([k, *fact])
                    tokens.append(t)
                    size += len(t)
                    if size >= BLOCK_TOKENS:
                        yield from packed(block, rows, tokens)
                        block, rows, tokens, size = block + 1, [], [], 0
        if rows:
            yield from packed(block, rows, tokens)
        rows, tokens = [], []
        release()

    columns = ", ".join(f"{n} {ArrayType(key.dataType).simpleString() if i == 0 else f'array<{facts[n]}>'}" for i, n in enumerate(names))
    return df.mapInArrow(run, f"block long, part int, tokens binary, counts binary, owners binary, first binary, {columns}")


def answers(blocks: DataFrame) -> DataFrame:
    """block, part and the levels of the tokens that the block sent there, in their order."""
    import pyarrow as pa

    def add(key, table):
        sent = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint16) for x in table.column("counts").to_pylist()])
        order = np.argsort(every := np.concatenate(sent))
        every = every[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        out = np.empty(len(every), np.uint8)
        out[order] = level(total)[np.cumsum(new) - 1]
        ends = np.cumsum([len(s) for s in sent])
        packed = [zlib.compress(out[e - len(s) : e].tobytes(), 1) for s, e in zip(sent, ends.tolist(), strict=True)]
        del sent, every, counts, order, new, total, out
        release()
        return pa.table({"block": table.column("block"), "part": table.column("part"), "levels": pa.array(packed, pa.binary())})

    return blocks.filter("part >= 0").select("block", "part", "tokens", "counts").groupBy("part").applyInArrow(add, "block long, part int, levels binary")


def told(blocks: DataFrame, said: DataFrame, schema: str, work, whole: bool) -> DataFrame:
    """``work(facts, owners, levels, tokens)`` for each block: the columns of its head, and for each of its tokens
    in order of hash the document (its place in the block), the level and, if ``whole``, the token itself."""
    import pyarrow.compute as pc

    def run(key, left, right):
        head = left.filter(pc.equal(left.column("part"), -1)).to_pylist()[0]
        said = sorted(zip(right.column("part").to_pylist(), right.column("levels").to_pylist(), strict=True))
        levels = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for _, x in said]) if said else np.zeros(0, np.uint8)
        kept = {k: v for k, v in head.items() if k not in ("block", "part", "tokens", "counts", "owners", "first")}
        owners = np.frombuffer(head["owners"], np.uint16 if len(kept["key"]) < 65536 else np.uint32).astype(np.int64)
        place = np.cumsum(np.unpackbits(np.frombuffer(head["first"], np.uint8), count=len(owners))) - 1
        tokens = None
        if whole:
            rows = sorted((p, t) for p, t in zip(left.column("part").to_pylist(), left.column("tokens").to_pylist(), strict=True) if p >= 0)
            tokens = (np.concatenate([np.frombuffer(t, np.uint64) for _, t in rows]) if rows else np.zeros(0, np.uint64))[place]
        made = work(kept, owners, levels[place], tokens)
        del head, said, levels, kept, owners, place, tokens
        release()
        return made

    mine = blocks.drop("counts") if whole else blocks.filter("part < 0").drop("counts", "tokens")
    return mine.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(run, schema)
