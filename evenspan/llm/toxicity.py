"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words is the cosine of their weighted subsequences of three and four characters within a span
of SPAN, so that gapped and inserted-character spellings stay close. A word with other characters between its
letters is looked at without them too, and letters that stand apart in a row as the word they make; a word that spells a
landmark of several toxic documents with characters put in between its letters, at most as many as no clean word that was learned from
needs to spell it, is read as that landmark. The reading that scores highest counts. Words become vectors of
kernel values with landmark words, whitened by the landmarks' own kernel (Nyström); a linear machine is
trained on them. Labels hold for documents, not words, so training alternates: each toxic document's
strongest words stand for it, the words of clean sentences stand against them. As kernel and machine are
linear in the subsequences, both fold into one weight per hashed subsequence for scoring.

A sentence's score is the sum of its words' over the root of their number, as of a set kernel; a document's is a logistic function
of those of its strongest sentences, of the share of words that are toxic and of the number that clearly are, fitted on the
labelled rows that are learned from.

Defined results: a null or empty text has the score of a text without toxic words; with no label of one kind
all scores are 0; a doc_id with several labels is toxic if any says so; rows with a null doc_id are not
learned from; rows that repeat get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .batches import hashed_subsequences, pieces, with_columns
from .common import stash

#: About so many labelled rows of each kind are learned from, drawn by a hash of the id.
TRAIN_TOXIC, TRAIN_CLEAN = 1000, 2500
#: Words of clean sentences that stand against the toxic ones, drawn by a hash of the word.
TRAIN_WORDS = 40_000
BITS = 18
#: Offsets of the subsequences, all of three and four characters within a span, and what each skipped character costs.
SPAN = 8
PATTERNS = tuple((0, *c) for n in (2, 3) for c in combinations(range(1, SPAN), n))
DECAY = 0.6
#: Weight of a word as a whole beside its subsequences.
WHOLE = 1.5
#: Score from which a word is clearly toxic, and the most that a word adds to its sentence.
CLEAR, MOST = 0.8, 1.5
WEIGHT = tuple(DECAY ** (p[-1] + 1 - len(p)) for p in PATTERNS)
LANDMARKS, STRONGEST, ROUNDS = 256, 3, 6
CACHE_WORDS = 500_000
#: Landmarks that are looked for with characters put in: so many, of so many toxic documents and letters at least; and the
#: freest level.
SPELLED, SEVERAL, SHORTEST, WIDEST = 64, 3, 4, 3
#: A toxic document missed weighs as much as so many clean ones taken for toxic, so that one clear insult may do.
MISSED = 3.0
EDGE = ".,;:!?\"'()[]|*#$%&<>-_"
_EDGES = f"[{re.escape(EDGE)}]*"
#: Three or more letters in a row that stand apart.
APART = re.compile(rf"(?<!\S){_EDGES}[^\W\d_]{_EDGES}(?:\s+{_EDGES}[^\W\d_]{_EDGES}(?!\S)){{2,}}")
BETWEEN = re.compile(r"[\W_]+")


def tokens(text: str | None) -> list[str]:
    """The words, and the words that letters standing apart make."""
    if not text:
        return []
    low = text.lower()
    return low.split() + [BETWEEN.sub("", m) for m in APART.findall(low)]


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each sentence: of what stands between line feeds, up to a word that ends with a mark of a sentence. A word that
    letters standing apart make is one by itself."""
    low = text.lower()
    for line in low.split("\n"):
        words = line.split()
        start = 0
        for i, w in enumerate(words):
            if w[-1] in ".!?":
                yield words[start : i + 1]
                start = i + 1
        if start < len(words):
            yield words[start:]
    for m in APART.findall(low):
        yield [BETWEEN.sub("", m)]


def _readings(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Pieces of the words and their owners; then those of words with other characters between letters, without them."""
    bare = [w.strip(EDGE) or w for w in words]
    parts, owner = pieces(bare)
    odd = [i for i, w in enumerate(bare) if not w.isalnum()]
    plain = [(i, p) for i in odd if len(p := BETWEEN.sub("", bare[i])) > 2]
    if not plain:
        return parts, owner
    more, of = pieces([p for _, p in plain])
    return parts + more, np.concatenate([owner, np.array([i for i, _ in plain], dtype=np.int64)[of]])


def _whole(parts: list[str]) -> np.ndarray:
    """The pieces as wholes, so that a word can differ from its neighbours."""
    return np.array([zlib.crc32(p.encode("utf-8", "replace")) >> (32 - BITS) for p in parts], dtype=np.int64)


def _features(words: list[str], readings=_readings):
    """Pieces' owners, hashed subsequences in columns with their weights (0 where there is none), and norms."""
    parts, owner = readings(words)
    hs, ws = [], []
    for k, h, there in hashed_subsequences(parts, PATTERNS, BITS):
        hs.append(h)
        ws.append(np.where(there, np.float32(WEIGHT[k]), np.float32(0)))
    if not hs:
        return owner, np.zeros((len(parts), 0), np.int64), np.zeros((len(parts), 0), np.float32), np.ones(len(parts), np.float32)
    hs.append(_whole(parts)[:, None])
    ws.append(np.full((len(parts), 1), WHOLE, np.float32))
    h, w = np.concatenate(hs, axis=1), np.concatenate(ws, axis=1)
    return owner, h, w, np.maximum(np.sqrt((w * w).sum(axis=1)), 1e-6)


def spelled_out(word: str, level: int) -> str:
    """A pattern of a word with characters put in: at level 1 one at one place, at level 2 one between any two letters, at level 3 two."""
    letters = [re.escape(c) for c in word]
    if level == 1:
        return "|".join("".join(letters[:i]) + "[^\\n]" + "".join(letters[i:]) for i in range(1, len(word)))
    return f"[^\\n]{{0,{level - 1}}}".join(letters)


class WordScorer:
    """Scores of words from folded weights. ``spelled``: landmarks that a word may spell with characters put in, and how freely
    (``spelled_out``); such a word has the landmark's score too, if that is higher."""

    def __init__(self, weights: np.ndarray, bias: float, spelled: list[tuple[str, int]] = ()):
        self.weights, self.bias, self.spelled, self.cache = weights, bias, list(spelled), {}
        # without groups, so that the matcher looks at a branch only where its first letter stands
        self.pattern = re.compile("|".join(spelled_out(w, g) for w, g in self.spelled)) if self.spelled else None
        self.each = [re.compile(spelled_out(w, g)) for w, g in self.spelled]
        self.own = self.by_kernel([w for w, _ in self.spelled]) if self.spelled else np.zeros(0, np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        out = self.by_kernel(words)
        if self.pattern is not None:
            # all words in one text; no pattern takes a line feed, and a word has none
            low = np.flatnonzero(out < CLEAR).tolist()
            ends = np.cumsum([len(words[i]) + 1 for i in low])
            for at in {int(np.searchsorted(ends, m.start(), "right")) for m in self.pattern.finditer("\n".join(words[i] for i in low))}:
                i = low[at]
                out[i] = max(out[i], max(x for x, p in zip(self.own.tolist(), self.each, strict=True) if p.search(words[i])))
        return out

    def by_kernel(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -np.inf, np.float32)
        every, owners = _readings(words)
        # pieces of like length together, as all of a batch take the room of its longest
        order = np.argsort([len(p) for p in every], kind="stable")
        for at in range(0, len(order), 4000):
            mine = order[at : at + 4000]
            parts = [every[i] for i in mine]
            total = self.weights[_whole(parts)] * np.float32(WHOLE)
            square = np.full(len(parts), WHOLE**2, np.float32)
            for k, h, there in hashed_subsequences(parts, PATTERNS, BITS):
                total += np.where(there, self.weights[h], np.float32(0)).sum(axis=1) * np.float32(WEIGHT[k])
                square += there.sum(axis=1) * np.float32(WEIGHT[k] ** 2)
            np.maximum.at(out, owners[mine], total / np.maximum(np.sqrt(square), 1e-6) + np.float32(self.bias))
        return out

    def document(self, texts: list[str | None]) -> np.ndarray:
        """For each text: of its two strongest sentences the summed scores of the words above 0 over the root of their number, the root
        of the share of different words above 0, and how many are clearly above, up to four."""
        split = [list(set(tokens(t))) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list({w for ws in split for w in ws if w not in self.cache})
        self.cache.update(zip(new, self.score(new).tolist(), strict=True))
        out = np.zeros((len(texts), 4))
        get = self.cache.__getitem__
        for i, (t, ws) in enumerate(zip(texts, split, strict=True)):
            if not ws:
                continue
            s = np.array([get(w) for w in ws])
            if (above := s > 0).any():
                out[i, 2], out[i, 3] = np.sqrt(above.mean()), min(4, (s > CLEAR).sum())
                marked = {w: min(x, MOST) for w, x in zip(ws, s.tolist(), strict=True) if x > 0}
                sums = sorted((sum(map(marked.get, hit)) / len(words) ** 0.5 for words in sentences(t) if (hit := [w for w in words if w in marked])), reverse=True)
                out[i, : len(sums[:2])] = sums[:2]
        return out


def _kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Kernel values of words with landmarks; only subsequences that a landmark has take room."""
    _, mh, mw, mn = _features(marks, pieces)
    seen = np.unique(mh)
    where = np.zeros(1 << BITS, np.int32)  # 0: no landmark has it
    where[seen] = np.arange(1, len(seen) + 1)
    from_marks = np.zeros((len(seen) + 1, len(marks)), np.float32)
    for j in range(len(marks)):
        np.add.at(from_marks[:, j], where[mh[j]], mw[j] / mn[j])
    out = np.zeros((len(words), len(marks)), np.float32)
    for at in range(0, len(words), 2000):
        owner, h, w, norm = _features(words[at : at + 2000])
        at_h = where[h]
        w = np.where(at_h > 0, w, np.float32(0))
        part = np.zeros((len(owner), len(marks)), np.float32)
        for c in range(h.shape[1]):
            if (rows := np.flatnonzero(w[:, c])).size:
                part[rows] += from_marks[at_h[rows, c]] * w[rows, c, None]
        np.maximum.at(out, owner + at, part / norm[:, None])
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(25):
        inside = y * (x1 @ w) < 1
        a, c = x1[inside], cost[inside]
        new = np.linalg.solve(ridge + a.T @ (a * c[:, None]), a.T @ (c * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def fit_words(bags: list[list[str]], clean: dict[str, int], n_clean: int) -> WordScorer:
    """``bags``: the distinct words of each toxic document; ``clean``: words of clean sentences with their documents."""
    seen = Counter(w for b in bags for w in b)
    gain = {w: np.log((n + 0.5) / (len(bags) + 1)) - np.log((clean.get(w, 0) + 0.5) / (n_clean + 1)) for w, n in seen.items()}
    # at first every word of a toxic document that no clean one has, those that many have first
    ranked = sorted((w for w in seen if not clean.get(w)), key=lambda w: (-gain[w], w))
    against = sorted(clean)
    rng = np.random.default_rng(7)
    mine = [[w for w in b if not clean.get(w)] or b for b in bags]
    pool = sorted({w for b in mine for w in b})
    place = {w: i for i, w in enumerate(pool)}
    own = [np.array([place[w] for w in b]) for b in mine if b]
    worth = np.array([gain[w] for w in pool])
    picked = [o[np.argsort(-worth[o], kind="stable")[:STRONGEST]] for o in own]
    lead, hard = ranked[: LANDMARKS // 2], []
    rest = [w for w in against if w not in seen] or against
    for _ in range(2):
        # in the second pass the clean words that the first took for toxic are landmarks and stand against
        marks = list(dict.fromkeys([*lead, *hard[: LANDMARKS // 4]]))
        marks += [rest[i] for i in rng.choice(len(rest), min(len(rest), LANDMARKS - len(marks)), replace=False)]
        marks = list(dict.fromkeys(marks))
        gram = _kernel(marks, marks).astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-3
        white = vectors[:, keep] / np.sqrt(values[keep])
        neg = against if len(against) <= 15_000 else [against[i] for i in rng.choice(len(against), 15_000, replace=False)]
        neg = list(dict.fromkeys([*neg, *hard]))
        thin = white.astype(np.float32)
        x_neg, x_pool = _kernel(neg, marks) @ thin, _kernel(pool, marks) @ thin
        beta, bias = np.zeros(white.shape[1]), 0.0
        for _ in range(ROUNDS):
            at = np.concatenate(picked)
            weight = np.concatenate([np.full(len(p), 1 / len(p)) for p in picked])
            x, y = np.concatenate([x_pool[at], x_neg]), np.concatenate([np.ones(len(at)), -np.ones(len(neg))])
            cost = np.concatenate([weight * (len(neg) / max(1, len(picked))), np.ones(len(neg))]) * 0.5
            beta, bias = _svm(x, y, cost)
            f = x_pool @ beta.astype(np.float32) + 0.02 * worth
            picked = [o[np.argsort(-f[o], kind="stable")[:STRONGEST]] for o in own]
        taken = WordScorer(_fold(marks, white @ beta), bias).score(against)
        hard = [against[i] for i in np.argsort(-taken, kind="stable")[:3000]]
    return WordScorer(_fold(marks, white @ beta), bias)


def candidates(scorer: WordScorer, bags: list[list[str]]) -> list[str]:
    """Words that several toxic documents have and that are clearly toxic, those of most documents first."""
    seen = Counter(w for b in bags for w in b)
    often = sorted(w for w, n in seen.items() if n >= SEVERAL and len(w) >= SHORTEST and w.isalpha())
    sure = [w for w, x in zip(often, scorer.score(often), strict=True) if x >= CLEAR] if often else []
    return sorted(sure, key=lambda w: (-seen[w], w))[:SPELLED]


def spelled_by(words: list[str], sure: list[str]) -> set[tuple[str, int]]:
    """Which of the candidates a word spells, and at which levels."""
    joined = "\n".join(words)
    return {(w, g) for w in sure for g in range(1, WIDEST + 1) if re.search(spelled_out(w, g), joined)}


def with_gaps(scorer: WordScorer, sure: list[str], taken: set[tuple[str, int]]) -> WordScorer:
    """The scorer with those candidates that no clean word spells, each at the freest level for which that holds."""
    widest = {w: next((g for g in range(WIDEST, 0, -1) if (w, g) not in taken), 0) for w in sure}
    return WordScorer(scorer.weights, scorer.bias, [(w, g) for w, g in widest.items() if g])


def _fold(marks: list[str], alpha: np.ndarray) -> np.ndarray:
    """One weight per hashed subsequence: landmark values are linear in a word's subsequences."""
    folded = np.zeros(1 << BITS)
    _, h, w, norm = _features(marks, pieces)
    for j in range(len(marks)):
        np.add.at(folded, h[j], w[j] / norm[j] * alpha[j])
    return folded.astype(np.float32)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1, cost = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.where(y > 0, MISSED, 1.0)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w)) * 0.05
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(ridge + x1.T @ (x1 * (cost * p * (1 - p))[:, None]), x1.T @ (cost * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN):
    """(word scorer, logistic weights), or None without labels of both kinds.

    The drawn ids are about ``toxic + clean`` however large the input is, so they are broadcast; the driver gets
    the distinct words of the toxic ones, TRAIN_WORDS words of the clean ones and four numbers a document.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    n = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    draw = F.pmod(F.xxhash64(F.lit("toxic"), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    ids = marked.filter(draw < F.when(F.col("y") == 1, min(1.0, toxic / n[1])).otherwise(min(1.0, clean / n[0])))
    rows = stash(docs.select(key, F.col(text).alias("text")).join(F.broadcast(ids), key), "toxic")

    def bag(batches):
        import pyarrow as pa

        for b in batches:
            for i, (t, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                found = sorted(set(tokens(t)))
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int64()), pa.array([found], pa.list_(pa.string()))], names=["y", "words"])

    schema = StructType([StructField("y", LongType()), StructField("words", ArrayType(StringType()))])
    bags = stash(rows.select("text", F.col("y").cast("long").alias("y")).mapInArrow(bag, schema), "bags")
    toxic_bags = [r["words"] for r in bags.filter("y = 1").select("words").collect()]
    mine = bags.filter("y = 0").select(F.explode("words").alias("w")).groupBy("w").count()
    # words that toxic documents have too are needed to tell which of them are not toxic; of the others a draw will do
    wanted = bags.filter("y = 1").select(F.explode("words").alias("w")).distinct().withColumn("both", F.lit(True))
    counted = stash(mine.join(wanted, "w", "left"), "words")
    some = counted.filter("both is null").count()
    drawn = counted.filter(F.col("both").isNotNull() | (F.pmod(F.xxhash64("w"), F.lit(1 << 20)) / float(1 << 20) < F.lit(min(1.0, TRAIN_WORDS / max(1, some)))))
    got = drawn.select("w", "count").toArrow()
    clean_words = dict(zip(got["w"].to_pylist(), got["count"].to_pylist(), strict=True))
    n_clean = bags.filter("y = 0").count()
    if not toxic_bags or not clean_words:
        return None
    scorer = fit_words(toxic_bags, clean_words, n_clean)
    sure = candidates(scorer, toxic_bags)

    def spelled(batches):
        import pyarrow as pa

        for b in batches:
            found = sorted(spelled_by(b.column(0).to_pylist(), sure))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([g for _, g in found], pa.int32())], names=["w", "g"])

    # all words of the clean documents that are learned from; no more pairs than candidates and gaps
    taken = counted.filter("w is not null").select("w").mapInArrow(spelled, "w string, g int").distinct().collect() if sure else []
    scorer = with_gaps(scorer, sure, {(r["w"], r["g"]) for r in taken})
    seen = apply_scorer(rows.select("text", "y"), scorer, None, "text", ["y"]).select("y", "parts").toArrow()
    x, y = np.array(seen["parts"].to_pylist()), np.array(seen["y"].to_pylist(), dtype=float)
    return scorer, _logistic(x, y)


def apply_scorer(docs: DataFrame, scorer: WordScorer, logistic: np.ndarray | None, text: str, carry: list[str]) -> DataFrame:
    state = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias, scorer.spelled, logistic))  # 2**BITS numbers

    def make():
        weights, bias, spelled, fold = state.value
        mine = WordScorer(weights, bias, spelled)

        def work(texts):
            parts = mine.document(texts)
            if fold is None:
                return [parts.tolist()]
            return [(1 / (1 + np.exp(-np.clip(parts @ fold[:-1] + fold[-1], -30, 30)))).tolist()]

        return work

    fields = [StructField("parts", ArrayType(DoubleType()))] if logistic is None else [StructField("score", DoubleType())]
    return with_columns(docs, text, carry, fields, make)


def score_toxicity(docs: DataFrame, model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with score and predicted. A narrow pass without shuffle."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    out = docs.select(*carry, F.lit(0.0).alias("score")) if model is None else apply_scorer(docs, model[0], model[1], text, carry)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
