"""Language identification by multilingual mixtures.

A language is a distribution over hashed character n-grams, counted over a bounded sample of labelled rows.
Each distinct word of a document has a likelihood under each language; expectation-maximisation estimates the
proportions in which the languages make up the document. Sets of languages, nested by proportion, are fitted
again, up to all languages or as long as one more could raise the best likelihood less a penalty for each
language; the set with the best is the document's, its largest member the prediction, and that member's
proportion the score.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if
nothing could be learned; rows that repeat get equal results; rows with a null doc_id are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField

from .batches import hashed_subsequences, pieces, with_columns

#: About so many labelled rows of each language are learned from, drawn by a hash of the id.
TRAIN_ROWS = 2000
BITS = 14
GRAMS = ((0, 1), (0, 1, 2))
#: Weight of a word's evidence, as its n-grams overlap; words kept by a task; rounds of estimation.
DAMP, CACHE_WORDS, ROUNDS, REFIT = 0.5, 400_000, 8, 4
#: Penalty for each language beyond the first: this times the log of the number of words.
PENALTY = 4.0
LETTER = re.compile(r"[^\W\d_]")


def _bags(texts: list[str | None]) -> list[Counter]:
    return [Counter(t.lower().split()) if t else Counter() for t in texts]


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: a row of n-gram counts for each language."""
        self.languages = languages
        p = counts + 0.5
        self.logp = np.log(p / p.sum(axis=1, keepdims=True)).T.astype(np.float32) if len(languages) else np.zeros((1 << BITS, 0), np.float32)
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)), np.float32)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        parts, owner = pieces(words)
        got = np.zeros((len(parts), len(self.languages)), np.float32)
        for _, h, there in hashed_subsequences(parts, GRAMS, BITS):
            for i in range(h.shape[1]):
                got += np.where(there[:, i, None], self.logp[h[:, i]], 0)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        np.add.at(out, owner, got)
        return out * np.float32(DAMP)

    def rows(self, words: set[str]) -> None:
        if len(self.index) > CACHE_WORDS:
            self.index, self.table = {}, self.table[:0]
        new = [w for w in words if w not in self.index]
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            base = len(self.table)
            self.table = np.concatenate([self.table, self.likelihoods(part)])
            self.index.update(zip(part, range(base, base + len(part)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]]]:
        n, k = len(texts), len(self.languages)
        label, score, sets = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
        bags = _bags([t if t and LETTER.search(t) else None for t in texts])
        live = [i for i in range(n) if bags[i]]
        if not live or not k:
            return label, score, sets
        self.rows(set().union(*(bags[i].keys() for i in live)))
        at = np.fromiter((self.index[w] for i in live for w in bags[i]), np.int64)
        c = np.fromiter((x for i in live for x in bags[i].values()), np.float32)
        sizes = np.array([len(bags[i]) for i in live])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(live)), sizes)
        ll = self.table[at]
        top = ll.max(axis=1, keepdims=True)
        p = np.exp(ll - top)
        total = np.add.reduceat(c, starts)[:, None]
        rest = np.add.reduceat(c * top[:, 0], starts)

        def fit(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for step in range(rounds + 1):
                joint = pi[doc] * p
                den = np.maximum(joint.sum(axis=1), 1e-30)
                if step == rounds:
                    return pi, np.add.reduceat(c * np.log(den), starts) + rest
                pi = np.add.reduceat(joint * (c / den)[:, None], starts) / total
            raise AssertionError

        ids = np.arange(len(live))

        pi, _ = fit(np.full((len(live), k), 1 / k, np.float32), ROUNDS)
        order = np.argsort(-pi, axis=1, kind="stable")
        best = np.full(len(live), -np.inf)
        chosen = np.zeros((len(live), k), np.float32)
        for size in range(1, k + 1):
            # no set's likelihood is above that of every word in its best language; larger sets have larger penalties
            go = rest - PENALTY * (size - 1) * np.log(total[:, 0] + 1) > best[ids]
            if not go.any():
                break
            if not go.all():
                stay = go[doc]
                p, c, ids, total, rest, pi = p[stay], c[stay], ids[go], total[go], rest[go], pi[go]
                lengths = np.bincount(doc[stay], minlength=len(go))[go]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                doc = np.repeat(np.arange(len(ids)), lengths)
            mask = np.zeros_like(pi)
            np.put_along_axis(mask, order[ids, :size], 1, axis=1)
            start = np.maximum(pi, 1e-4) * mask
            fitted, like = fit(start / start.sum(axis=1, keepdims=True), REFIT if size > 1 else 0)
            worth = like - PENALTY * (size - 1) * np.log(total[:, 0] + 1)
            better = worth > best[ids]
            best[ids[better]], chosen[ids[better]] = worth[better], fitted[better]
        first = chosen.argmax(axis=1)
        for j, i in enumerate(live):
            label[i], score[i] = self.languages[first[j]], float(min(1.0, chosen[j, first[j]]))
            sets[i] = [self.languages[x] for x in order[j] if chosen[j, x] > 0]
        return label, score, sets


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Counts n-grams of about ``rows`` rows of each language, whole texts. The driver gets one line per language and n-gram hash."""
    from pyspark.sql.types import LongType, StructType

    have = {r[0]: r[1] for r in docs.groupBy(lang).count().collect()}
    if not have:
        return LanguageModel([], np.zeros((0, 1 << BITS)))
    chance = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, min(1.0, rows / n))])
    draw = F.pmod(F.xxhash64(F.lit("learn"), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    drawn = docs.filter(draw < F.element_at(chance, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for la, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bag = Counter(t.lower().split()) if t else None
                if not bag:
                    continue
                mine = sums.setdefault(la, np.zeros(1 << BITS))
                parts, owner = pieces(list(bag))
                weight = np.array(list(bag.values()), dtype=float)[owner]
                for _, h, there in hashed_subsequences(parts, GRAMS, BITS):
                    mine += np.bincount(h[there], np.broadcast_to(weight[:, None], h.shape)[there], 1 << BITS)
        for la, m in sums.items():
            at = np.flatnonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array([la] * len(at)), pa.array(at), pa.array(m[at].astype(np.int64))], names=["lang", "gram", "n"])

    schema = StructType([StructField("lang", StringType()), StructField("gram", LongType()), StructField("n", LongType())])
    got = drawn.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(names), 1 << BITS))
    place = {x: i for i, x in enumerate(names)}
    counts[[place[x] for x in got["lang"].to_pylist()], got["gram"].to_numpy()] = got["n"].to_numpy()
    return LanguageModel(names, counts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with lang_pred, score and langs (the chosen set). No shuffle."""
    state = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp))  # languages x 2**BITS numbers

    def make():
        mine = LanguageModel([], np.zeros((0, 1 << BITS)))
        mine.languages, mine.logp = state.value
        mine.table = np.zeros((0, len(mine.languages)), np.float32)
        return lambda texts: list(mine.predict(texts))

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("langs", ArrayType(StringType()))]
    return with_columns(docs, text, docs.columns if carry is None else carry, fields, make)
