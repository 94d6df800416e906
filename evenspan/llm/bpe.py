"""BPE encoding and decoding: speculate, verify, and merge only what fails.

Every distinct word of a batch gets a proposal by greedy longest match. A sequence of tokens is what merging
would give exactly if each token stands for itself and each adjacent pair is compatible, that is, no merge
across their border comes before the merges that make them. The words of a whole batch are proposed for and
their pairs tested at once on arrays; words with a failing pair go through exact merging, many in step too.

The vocabulary is a ``tokenizers`` JSON file whose path the caller gives: BPE with a word-end suffix, the
normaliser and the split pattern of the file, byte-level symbols, special tokens cut out first.

Defined results: a null text is an empty one, which has no tokens and decodes to the empty string; rows that
repeat are encoded each; long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from .batches import with_columns

#: Characters that normalising may change otherwise than by lower-casing.
ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\u0130]|[^\x00-\u024f]")
#: Distinct words whose results a task keeps; beyond, it starts afresh.
CACHE_WORDS = 100_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 500_000
#: Words are merged in step, so many of about equal length at once; those of more symbols than WIDE one by one.
STEP_WORDS, WIDE = 2048, 128
#: A rank beyond all others.
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is a visible Latin-1 character, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Lookup:
    """Numbers by keys that are not negative, on arrays. A key lies in its slot of the first table in which no other had it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        self.absent, self.tables = absent, []
        odd, keys = 0x9E3779B97F4A7C15, keys.astype(np.int64)
        while len(keys) or not self.tables:
            bits = len(keys).bit_length() + 2
            slot = self._slot(keys, odd, bits)
            held, value = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, absent, dtype=np.int32)
            _, first = np.unique(slot, return_index=True)
            held[slot[first]], value[slot[first]] = keys[first], values[first]
            self.tables.append((odd, bits, held, value))
            keys, values = np.delete(keys, first), np.delete(values, first)
            odd = (odd * 0xBF58476D1CE4E5B9 + 2) % (1 << 64)

    @staticmethod
    def _slot(keys: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, at = np.full(len(keys), self.absent, dtype=np.int32), None
        for odd, bits, held, value in self.tables:
            slot = self._slot(keys, odd, bits)
            there = held[slot]
            hit = there == keys
            if at is None:
                out = np.where(hit, value[slot], out)
            else:
                out[at[hit]] = value[slot[hit]]
            # an empty slot: the key is in no further table
            more = np.flatnonzero(~hit & (there >= 0))
            if not len(more):
                break
            keys, at = keys[more], more if at is None else at[more]
        return out


class WordBpe:
    """Encodes words. ``runs`` counts the words proposed and those that needed exact merging."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("only a plain BPE vocabulary without a decoder is understood")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # the same pattern for lower-cased ASCII, and for other text that isn't ODD
        self.ascii = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        latin = "".join(sorted({x for c in range(0x250) if c != 0x130 for x in chr(c).lower()}))
        letters, digits = ("".join(regex.findall(x, latin)) for x in (r"\p{L}", r"\p{N}"))
        self.latin = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", letters).replace(r"\p{N}", digits))
        self.plain = [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        # the library's own copy of the vocabulary is of no use here
        self.normalizer = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})).normalizer
        self.symbols = byte_symbols()
        size = max(self.names) + 1
        # what each token was merged from, and when
        self.left, self.right, self.rank = (np.full(size, -1, dtype=np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        doubtful: set[int] = set()
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[x, y] = (r, z)
            if self.rank[z] >= 0 or max(self.rank[x], self.rank[y]) >= r:
                doubtful.add(z)
            else:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        pairs = np.array([*self.merges], dtype=np.int64).reshape(-1, 2)
        ranks, results = np.array([*self.merges.values()], dtype=np.int64).reshape(-1, 2).T
        self.size, self.ranks = size, Lookup(pairs[:, 0] * size + pairs[:, 1], ranks, NONE)
        # what the merge of each rank gives
        self.result = np.full(len(model["merges"]) + 1, -1, dtype=np.int32)
        self.result[ranks] = results
        self.runs = [0, 0]
        # tokens that merging never gives for their own string aren't proposed
        self.good = np.ones(size, dtype=bool)
        self.good[list(doubtful)] = False
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        fits = self._fits(self.left[made], self.right[made], self.rank[made])
        for z, ok in zip(made.tolist(), fits.tolist(), strict=True):
            self.good[z] &= ok and self.good[self.left[z]] and self.good[self.right[z]]
        # symbols as numbers: the byte, and 256 more at the end of a word
        names = self.symbols + [x + self.suffix for x in self.symbols]
        self.base = np.array([self.vocab.get(x, -1) for x in names], dtype=np.int32)
        spelled: dict[int, tuple[int, ...]] = {}
        for k in range(511, -1, -1):  # without a suffix both are the same token, which stands for the first
            spelled[int(self.base[k])] = (k,)
        for z in made.tolist():
            if (x := int(self.left[z])) in spelled and (y := int(self.right[z])) in spelled:
                spelled[z] = spelled[x] + spelled[y]
        self._offer({t: s for t, s in spelled.items() if t >= 0 and self.good[t]})
        self.shown = pa.array([str(i) for i in range(size)], pa.large_string())
        self.named = pa.array([self.names.get(i, "") for i in range(size)], pa.large_string())
        self.packed: dict[str | int, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _offer(self, spelled: dict[int, tuple[int, ...]]) -> None:
        """Files tokens by their symbols, as a tree whose branches are looked up by node and symbol."""
        branches: dict[int, int] = {}
        ends = [-1]
        # without a suffix a token may stand at the end of a word too
        spellings = [*spelled.items(), *(() if self.suffix else ((t, (*s[:-1], s[-1] + 256)) for t, s in spelled.items()))]
        for t, symbols in spellings:
            node = 0
            for k in symbols:
                if (after := branches.get(node * 512 + k)) is None:
                    after = branches[node * 512 + k] = len(ends)
                    ends.append(-1)
                node = after
            ends[node] = t
        self.ends = np.array(ends, dtype=np.int32)
        self.branches = Lookup(np.array([*branches], dtype=np.int64), np.array([*branches.values()], dtype=np.int32), -1)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NONE where there is none."""
        return self.ranks(a.astype(np.int64) * self.size + b)

    def _fits(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int | None = None) -> np.ndarray:
        """Whether no merge across the border of a and b comes before the merges that make them (and before ``before``).

        Both tokens are taken apart along the border, the part that was merged last first. The parts that
        stand at the border together could have merged if their merge comes before either is used up; of two
        equal merges the one to the left comes first.
        """
        top = NONE - 1
        fits = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        end = np.full(len(a), top) if before is None else np.broadcast_to(before, len(a)).astype(np.int64)
        x_end, y_end = end.copy(), end.copy()
        if before is not None:
            y_end = y_end - 1  # the pair's own merge doesn't count against it
        while len(live):
            r = self._rank_of(x[live], y[live])
            bad = (r < x_end[live]) & (r <= y_end[live])
            fits[live[bad]] = False
            live = live[~bad]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            go = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[go], rx[go], ry[go]
            of_x = rx > ry
            i, j = live[of_x], live[~of_x]
            x_end[i], x[i] = rx[of_x], self.right[x[i]]
            y_end[j], y[j] = ry[~of_x], self.left[y[j]]
        return fits

    def _longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each symbol, -1 if none does, and its length. No token passes the end of a
        word, as nothing follows a symbol of an end."""
        token, length = np.full(len(symbols), -1, dtype=np.int32), np.zeros(len(symbols), dtype=np.int64)
        at, node, k = np.arange(len(symbols)), np.zeros(len(symbols), dtype=np.int64), 0
        while len(at):
            node = self.branches(node * 512 + symbols[at + k]).astype(np.int64)
            k += 1
            at, node = at[node >= 0], node[node >= 0]
            end = self.ends[node]
            token[at[end >= 0]], length[at[end >= 0]] = end[end >= 0], k
            go = at + k < len(symbols)
            at, node = at[go], node[go]
        return token, length

    def _propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over the symbols of each word: the tokens of all words, how many each has, and whether
        there is a place where none fits."""
        token, length = self._longest(symbols)
        stuck, count = np.zeros(len(starts), dtype=bool), np.zeros(len(starts), dtype=np.int64)
        live, at, steps = np.arange(len(starts)), starts, []
        while len(live):
            t = token[at]
            if (t < 0).any():
                stuck[live[t < 0]] = True
                live, at, t = live[t >= 0], at[t >= 0], t[t >= 0]
            steps.append((live, t))
            count[live] += 1
            at = at + length[at]
            go = at < ends[live]
            live, at = live[go], at[go]
        flat, first = np.zeros(int(count.sum()), dtype=np.int64), np.cumsum(count) - count
        for k, (who, t) in enumerate(steps):
            flat[first[who] + k] = t
        return flat, count, stuck

    def _in_step(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """Exact merging of many words, one merge of each at a time: always the pair of lowest rank, the leftmost of equals."""
        width = int(sizes.max())
        cols, n = np.arange(width), len(starts)
        inside = cols < sizes[:, None]
        ids = np.where(inside, self.base[symbols[np.minimum(starts[:, None] + cols, len(symbols) - 1)]], -1)
        if (ids < 0).sum() != (~inside).sum():
            raise KeyError("a symbol is not in the vocabulary")
        ranks = np.full((n, width), NONE, dtype=np.int32)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self._rank_of(ids[:, :-1][pair], ids[:, 1:][pair])
        out, left, live = np.full((n, width), -1, dtype=np.int32), sizes.copy(), np.arange(n)
        while len(live):
            row = np.arange(len(live))
            j = ranks.argmin(axis=1)
            low = ranks[row, j]
            go = low < NONE
            if not go.all():
                out[live[~go], : ids.shape[1]] = ids[~go]
                ids, ranks, live, j, low = ids[go], ranks[go], live[go], j[go], low[go]
                row = row[: len(live)]
                if not len(live):
                    break
            left[live] -= 1
            # the pair becomes one token, what is to the right of it moves up
            width = ids.shape[1]
            kept = cols[: width - 1] <= j[:, None]
            ids[row, j] = self.result[low]
            ids, ranks = np.where(kept, ids[:, :-1], ids[:, 1:]), np.where(kept, ranks[:, :-1], ranks[:, 1:])
            for i in (j - 1, j):
                some = np.flatnonzero((i >= 0) & (i + 1 < left[live]))
                i_ = i[some]
                ranks[some, i_] = self._rank_of(ids[some, i_], ids[some, i_ + 1])
            last = np.flatnonzero(j + 1 >= left[live])
            ranks[last, j[last]] = NONE
        return [x[:k] for x, k in zip(out.tolist(), left.tolist(), strict=True)]

    def merge(self, s: list[str]) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equals."""
        ids = [self.vocab[x] for x in s]
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= len(ids) or (ids[i], ids[j]) != p:
                continue
            ids[i], alive[j], after[i] = self.merges[p][1], False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (q := (ids[i], ids[after[i]])) in self.merges:
                    heapq.heappush(heap, (self.merges[q][0], i, q))
            if (h := before[i]) >= 0 and (q := (ids[h], ids[i])) in self.merges:
                heapq.heappush(heap, (self.merges[q][0], h, q))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def _symbols(self, word: str) -> list[str]:
        s = [self.symbols[b] for b in word.encode("utf-8")]
        s[-1] += self.suffix
        return s

    def words(self, new: list[str]) -> list[list[int]]:
        """The tokens of each word."""
        if not new:
            return []
        raw = [w.encode("utf-8") for w in new]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        symbols[ends - 1] += 256
        flat, lengths, failed = self._propose(symbols, starts, ends)
        owner = np.repeat(np.arange(len(new)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self._fits(pairs // self.size, pairs % self.size)
        failed[owner[inner[~fits[back]]]] = True
        self.runs[0] += len(new)
        self.runs[1] += int(failed.sum())
        tokens, to = flat.tolist(), np.cumsum(lengths).tolist()
        out = [tokens[i:j] for i, j in zip([0, *to], to, strict=False)]
        again = np.flatnonzero(failed)
        again = again[np.argsort(sizes[again], kind="stable")]
        wide = int(np.searchsorted(sizes[again], WIDE, side="right"))
        for k in range(0, wide, STEP_WORDS):
            some = again[k : min(wide, k + STEP_WORDS)]
            for i, p in zip(some.tolist(), self._in_step(symbols, starts[some], sizes[some]), strict=True):
                out[i] = p
        for i in again[wide:].tolist():
            out[i] = self.merge(self._symbols(new[i]))
        return out

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of special tokens that stand in it."""
        if self.cut is None or not any(x in text for x in self.specials):
            return self._split(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                out += self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        """Words of the normalised text. Latin text without control characters is only lower-cased by the
        normaliser (its white space splits words either way), which needs no call of the library."""
        if self.plain and text.isascii() and (text.replace("\n", " ").isprintable() or not ODD.search(text)):
            return self.ascii.findall(text.lower())
        if self.plain and not ODD.search(text):
            return self.latin.findall(text.lower())
        return self.pattern.findall(self.normalizer.normalize_str(text))

    def batch(self, texts: list[str]) -> list[list[tuple[str, int, str]]]:
        """For each piece of each text: its ids as text, how many they are, its tokens as text."""
        split = [self.pieces(t) for t in texts]
        self._learn(split)
        ids = [[np.frombuffer(self.packed[w], np.int32).tolist() for w in ws] for ws in split]
        return [[(" ".join(map(str, i)), len(i), self.decode(i)) for i in ws] for ws in ids]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as numbers of 32 bits."""
        split = [self.pieces(t) for t in texts]
        self._learn(split)
        get = self.packed.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def _learn(self, split: list[list[str | int]]) -> None:
        """Has the pieces of all texts in ``packed``, each with its ids."""
        if len(self.packed) > CACHE_WORDS:
            self.packed.clear()
        new = set().union(*split).difference(self.packed)
        names = [w for w in new if isinstance(w, str)]
        for w, found in zip(names, self.words(names), strict=True):
            self.packed[w] = array("i", found).tobytes()
        for w in new.difference(names):
            self.packed[w] = array("i", [w]).tobytes()

    def joined(self, ids: pa.ListArray, names: bool) -> pa.Array:
        """The ids of each text, or the tokens they stand for, as one text with a space between."""
        values = pc.take(self.named if names else self.shown, ids.values)
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, values), pa.scalar(" ", values.type))

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _, _ in self.batch([text])[0] for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """What the vocabulary without a decoder gives: the tokens joined by a space."""
        return " ".join(self.names[i] for i in ids)


_loaded: dict[str, WordBpe] = {}


def _coder(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, digest: bool = False, decode: bool = True) -> DataFrame:
    """``carry`` (all columns by default) with n_tokens and, as ``digest`` says, the ids and decoded text or their SHA-256;
    without ``decode`` the ids alone.

    One narrow pass over Arrow batches, no shuffle; a task holds one group of texts and about CACHE_WORDS words.
    """
    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"] if decode else ["ids"]
    kinds = [StringType(), StringType()] if digest else [ArrayType(IntegerType()), StringType()]
    fields = [StructField("n_tokens", LongType()), *map(StructField, names, kinds)]

    def make():
        coder = _coder(path)
        sha = lambda texts: [hashlib.sha256(x.as_buffer()).hexdigest() for x in texts]

        def work(texts: list[str | None]) -> list:
            got = coder.ids([x or "" for x in texts])
            n = [len(g) // 4 for g in got]
            values = pa.array(np.frombuffer(b"".join(got), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), values, type=pa.list_(pa.field("element", pa.int32())))
            if digest:
                return [n, sha(coder.joined(ids, False)), sha(coder.joined(ids, True))]
            return [n, ids, *([coder.joined(ids, True)] if decode else [])]

        return work

    return with_columns(docs, text, docs.columns if carry is None else carry, fields, make, GROUP_CHARS)
