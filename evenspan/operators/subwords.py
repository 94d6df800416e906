"""Subword tokens by greedy longest match over a trie, with continuation pieces, unknown words and offsets.

A vocabulary is a list of pieces. Pieces that go on a word are written with MARK before them. A word is cut from the
left: at each place the longest piece that fits is taken; a word of which some place fits no piece, or which is longer
than LONGEST, is one unknown token. Words are what white space leaves (U+0020, U+0009 to U+000D) or a pattern of the caller's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

MARK, UNKNOWN = "##", "[UNK]"
#: Characters of a word that is still cut, and words whose cuts a task keeps.
LONGEST, KEPT = 100, 200_000
#: Pieces that a vocabulary may have: all tasks hold it.
MOST_PIECES = 1_000_000
WORDS = r"[^\x20\x09-\x0D]+"


class Trie:
    """Pieces by characters; ``longest(word, at)`` is the end and the number of the longest piece that begins there."""

    def __init__(self, pieces: dict[str, int]):
        self.root: dict = {}
        for piece, number in pieces.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = number

    def longest(self, word: str, at: int) -> tuple[int, int] | None:
        node, best = self.root, None
        for end in range(at, len(word)):
            node = node.get(word[end])
            if node is None:
                break
            if "" in node:
                best = (end + 1, node[""])
        return best


class Subwords:
    """Cuts texts by a vocabulary: pieces in the order of their numbers."""

    def __init__(self, pieces: list[str], unknown: str = UNKNOWN, mark: str = MARK, pattern: str = WORDS, longest: int = LONGEST):
        number = {p: i for i, p in enumerate(pieces)}
        if len(number) != len(pieces) or unknown not in number:
            raise ValueError("pieces are all different and hold the unknown one")
        self.unknown, self.longest, self.words = number[unknown], longest, re.compile(pattern)
        self.first = Trie({p: i for p, i in number.items() if p and p != unknown and not p.startswith(mark)})
        self.next = Trie({p[len(mark) :]: i for p, i in number.items() if p.startswith(mark) and len(p) > len(mark)})
        self.known: dict[str, list[tuple[int, int]]] = {}
        self.packed: dict[str, bytes] = {}
        # words and what is between them in turn; a pattern with groups of its own would add those
        self.parts = re.compile(f"({pattern})") if not self.words.groups else None

    def cut(self, word: str) -> list[tuple[int, int]]:
        """Number and end of each piece of a word."""
        if (got := self.known.get(word)) is not None:
            return got
        out: list[tuple[int, int]] = []
        at, trie = 0, self.first
        while at < len(word) <= self.longest and (hit := trie.longest(word, at)):
            at, trie = hit[0], self.next
            out.append((hit[1], at))
        if at < len(word):
            out = [(self.unknown, len(word))]
        if len(self.known) >= KEPT:
            self.known.clear()
        self.known[word] = out
        return out

    def ids(self, text: str) -> list[int]:
        return [i for w in self.words.findall(text) for i, _ in self.cut(w)]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Number, start and end (characters of the text, end excluded) of each token."""
        out = []
        for m in self.words.finditer(text):
            at = m.start()
            for i, end in self.cut(m.group()):
                out.append((i, at, m.start() + end))
                at = m.start() + end
        return out


    def _cuts(self, word: str) -> bytes:
        """Number, start and end of each piece of a word, as numbers of 32 bits."""
        if (got := self.packed.get(word)) is None:
            at, out = 0, []
            for i, end in self.cut(word):
                out += (i, at, end)
                at = end
            if len(self.packed) >= KEPT:
                self.packed.clear()
            got = self.packed[word] = np.array(out, np.int32).tobytes()
        return got

    def tokens(self, text: str) -> np.ndarray:
        """``spans`` as an array of three columns."""
        if self.parts is None:
            return np.array(self.spans(text), np.int32).reshape(-1, 3)
        parts = self.parts.split(text)
        cuts = [*map(self._cuts, parts[1::2])]
        out = np.frombuffer(b"".join(cuts), np.int32).reshape(-1, 3).copy()
        starts = np.cumsum(np.fromiter(map(len, parts), np.int32, len(parts)), dtype=np.int32)[:-1:2]
        out[:, 1:] += np.repeat(starts, np.fromiter(map(len, cuts), np.int32, len(cuts)) // 12)[:, None]
        return out


def vocabulary(pieces: DataFrame, piece: str = "piece", unknown: str = UNKNOWN) -> list[str]:
    """The vocabulary of a table of pieces: the unknown piece is number 0, the others follow in code-point order. It is
    as large as a vocabulary is; more than MOST_PIECES are refused."""
    rows = pieces.select(piece).filter(F.col(piece).isNotNull() & (F.col(piece) != unknown)).distinct().limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"a vocabulary has at most {MOST_PIECES} pieces")
    return [unknown, *sorted(r[0] for r in rows)]


def vocabulary_file(spark: SparkSession, path: str, unknown: str = UNKNOWN) -> list[str]:
    """A vocabulary as such files have it: a piece in each line, numbered by its line from 0."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a vocabulary is one file")
    pieces = rows[0][0].split("\n")
    pieces = [p.rstrip("\r") for p in (pieces[:-1] if pieces[-1] == "" else pieces)]
    if unknown not in pieces:
        raise ValueError(f"the vocabulary lacks {unknown}")
    return pieces


def tokenizer(pieces: list[str], begin: int | None = None, end: int | None = None, most: int | None = None, **how) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """For ``encode.tokenize_with``: makes a function from texts to ids, between ``begin`` and ``end`` where they are given;
    with ``most`` the text's own ids are cut so that all together are so many at most, as truncation does."""
    before, after = [] if begin is None else [begin], [] if end is None else [end]
    room = None if most is None else max(0, most - len(before) - len(after))

    def make():
        cutter = Subwords(pieces, **how)
        return lambda texts: [before + cutter.ids(t)[:room] + after for t in texts]

    return make


_TOKEN = StructType([StructField(c, IntegerType()) for c in ("id", "start", "end")])


def subword_tokens(docs: DataFrame, pieces: list[str], text: str = "text", name: str = "tokens", **how) -> DataFrame:
    """``docs`` with ``name``: id, start, end of each token of the text, in order; null for a null text. One narrow pass; the
    vocabulary goes to each task with the function."""
    out = StructType([f for f in docs.schema.fields if f.name != name] + [StructField(name, ArrayType(_TOKEN))])
    arrow = to_arrow_schema(out, prefers_large_types=False)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Subwords(shared.value, **how)
        for b in batches:
            at = b.schema.get_field_index(text)
            for start in range(0, b.num_rows, 200):  # a text's tokens take many times its room
                part = b.slice(start, 200)
                spans = [None if t is None else cutter.tokens(t) for t in part.column(at).to_pylist()]
                flat = np.concatenate([np.empty((0, 3), np.int32), *[x for x in spans if x is not None]])
                tokens = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(arrow.field(name).type.value_type))
                ends = [0]
                for s in spans:
                    ends.append(ends[-1] + (0 if s is None else len(s)))
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens, type=arrow.field(name).type, mask=pa.array([s is None for s in spans]))
                cols = [part.column(part.schema.get_field_index(f.name)).cast(arrow.field(f.name).type) for f in out.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, made], schema=arrow)

    return docs.mapInArrow(run, out)
