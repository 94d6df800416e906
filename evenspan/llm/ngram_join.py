"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct shingles of five words. First the documents go that can have no partner: a
document shows the tokens of a plain prefix by hash and SLACK-th of its size more, and a linked one must see
enough of them in others (``holders`` counts, with one entry for each token and block of documents). For what
is left the exact number of holders of every token is found the same way. A token that no other set has can't
be common, so it only shortens a set's prefix; the others are ordered by their number of holders, rare ones
first. Of a set with c such tokens of n, any partner of m tokens must share o = 80 (n + m) / 180 of them, so the
two share a token within the first c - o + 1, and k tokens within k - 1 more: a set whose tokens promise many
candidates gets a longer prefix, and its pairs must share correspondingly more of it (the lesser k of the two)
before they are verified. The smaller set of a pair needs a shorter prefix than the larger, and they meet by
token and band of sizes.

Equal sets are one node. In each round the nodes of a token are paired with one of them, the pivot; what links
joins the pivot's component. A pair within a component needs no test, so a large family of near copies costs
about as many pairs as it has members. After a first round they end when the pairs across components are few for each row, or when
a round no longer makes them much fewer; then all pairs that are left across components are formed, so that no
link between components is lost. Pairs are held against bitmaps of their common tokens, then against the sets.

Defined results: a null or empty text has the empty set and no links; a null doc_id has component null and
links nothing else; rows that repeat are one node; several rows of one doc_id keep sets of their own and
count as that id; ids may be of any type that has an order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import drop, small, stash, tidy
from .components import components
from .holders import answers, count_of, parts_for, scattered, send, told

WORDS, PERCENT = 5, 80
#: Of n tokens n // SLACK more than the plain prefix are shown to others at first.
SLACK = 10
#: A set of n tokens may be asked for 1 + n // SPARE matches at most; each so many candidates ask for one more.
SPARE, CANDIDATES_PER_MATCH = 16, 4
#: Pairs across components for each row that need no further round; the share of them that a round must leave at most.
PAIRS_PER_ROW, WORTH = 16, 0.7
#: Rows of one or two numbers that may be broadcast, counted first.
BROADCAST_KEYS = 300_000
#: Texts are hashed in groups of about so many bytes, whose numbers stay in a core's cache.
GROUP_BYTES = 200_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


#: A number for each byte; powers of the base and of its inverse, as far as they were needed.
_LETTERS = scattered(np.arange(1, 257, dtype=np.uint64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: What the words of a shingle are multiplied by.
_PLACES = scattered(np.arange(301, 301 + WORDS, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(max(n, 2 * GROUP_BYTES), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of lower-cased bytes, all words at once: differences of running sums of
    letter * base**place, brought to the place 0."""
    word = (data != 32) & (data - np.uint8(9) > 4)
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
    return starts, scattered((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; few words are one shingle, none are none."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    at = 0
    while at < len(raw):
        stop, total = at, 0
        while stop < len(raw) and (stop == at or total + len(raw[stop]) <= GROUP_BYTES):
            total += len(raw[stop]) + 1
            stop += 1
        part = raw[at:stop]
        data = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
        starts, h = _word_hashes(data)
        bounds = np.cumsum([0] + [len(x) + 1 for x in part])
        cuts = np.searchsorted(starts, bounds)
        n = len(h)
        s = np.zeros(n, dtype=np.uint64)
        for k in range(min(WORDS, n)):
            s[: n - k] += h[k:] * _PLACES[k]
        s = scattered(s)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(s[a : b - WORDS + 1])
            elif b > a:
                v = np.full(1, b - a, dtype=np.uint64)
                for x in h[a:b]:
                    v = scattered(v * np.uint64(5) + x)
                yield v
            else:
                yield np.zeros(0, dtype=np.uint64)
        at = stop


def _node(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, whose members are hashes already."""
    return int(np.add.reduce(s).view(np.int64)), int(np.bitwise_xor.reduce(s * _BASE).view(np.int64)) if len(s) else 0


def needed(n, m):
    """Common tokens of two sets of likeness PERCENT, of sizes n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def plain_length(n):
    """Tokens of which two sets of likeness PERCENT share one, whatever their order."""
    return n - -(-n * PERCENT // 100) + 1


def shown(s: np.ndarray) -> np.ndarray:
    """The tokens that a document shows at first: more than a plain prefix by hash."""
    n = len(s)
    return s[: plain_length(n) - 1 + max(1, n // SLACK)] if n else s


def must_see(n: np.ndarray) -> np.ndarray:
    """Of the tokens shown, those that a linked document has in common with another one at least."""
    return np.maximum(1, -(-n * PERCENT // 100) // SLACK)


def bitmap(tokens: np.ndarray) -> bytes:
    """Tokens thrown into a power of two of bits, two or more for each token."""
    bits = max(512, 1 << int(2 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def most_common(a: bytes, b: bytes, na: int, nb: int) -> int:
    """A bound on the common tokens of two sets of so many tokens, from their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    # the larger one is folded: its bits are numbered by the low bits of the tokens
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def bands(most: int) -> np.ndarray:
    """Lower ends of bands of sizes, so wide that the sizes of a linked pair are in one or two neighbouring ones."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * 100 // PERCENT)))
    return np.array(ends)


def near_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    with tidy(docs.sparkSession):
        size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rows = _seen(texts, kind, size)
    # of equal sets the smallest id, and a number, which is written so that it stays
    alive = rows.filter("alive").select("doc_id", "n", "node", "chk")
    reps = alive.groupBy("node", "chk").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    reps = stash(reps.withColumn("no", F.monotonically_increasing_id()), "reps")
    if reps.isEmpty():
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nodes = _nodes(texts, alive, reps)
    comp = _linked(nodes)
    drop(nodes)
    return _labelled(rows, reps, comp)


def _seen(texts: DataFrame, kind: str, size: int) -> DataFrame:
    """doc_id, n, node, chk and alive (whether it may have a partner) of every row."""
    import pyarrow as pa

    def work(cols):
        for i, s in zip(cols[0], shingle_sets(cols[1]), strict=True):
            yield [len(s), *_node(s)], (shown(s) if i is not None else s[:0])

    blocks = stash(send(texts, parts_for(size // 18), {"n": "long", "node": "long", "chk": "long"}, work), "shown")

    key = to_arrow_type(DataType.fromDDL(kind))  # parts of it may be null

    def apply(facts, owners, levels, _):
        n = np.array(facts["n"], np.int64)
        seen = np.bincount(owners, weights=levels > 0, minlength=len(n))
        alive = (n > 0) & (seen >= must_see(n)) & np.array([k is not None for k in facts["key"]])
        return pa.table({"doc_id": pa.array(facts["key"], key), "n": n, "node": pa.array(facts["node"], pa.int64()), "chk": pa.array(facts["chk"], pa.int64()), "alive": alive})

    rows = stash(told(blocks, answers(blocks), f"doc_id {kind}, n long, node long, chk long, alive boolean", apply, False), "sets")
    drop(blocks)
    return rows


def _nodes(texts: DataFrame, alive: DataFrame, reps: DataFrame) -> DataFrame:
    """One row for each node that may have a partner: no, n (tokens), c (those that others have), k (matches asked
    for), few (length of the prefix as the smaller of a pair), p (prefix as the larger one), band of its size,
    bits (bitmap) and s (the c tokens)."""
    import pyarrow as pa

    mine = reps.select(F.col("rep").alias("_id"), "no", "node", "chk")
    chosen = texts.join(small(mine, BROADCAST_KEYS), F.col("doc_id") == F.col("_id")).select("no", "node", "chk", "text")
    if not alive.groupBy("doc_id", "node", "chk").count().filter("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["no", "text"])  # rows that repeat

    def work(cols):
        for node, chk, s in zip(cols[1], cols[2], shingle_sets(cols[3]), strict=True):
            # another text of the same id is not the one looked for
            yield ([len(s)], s) if _node(s) == (node, chk) else (None, s)

    tokens = reps.agg(F.sum("n")).first()[0]
    blocks = stash(send(chosen, parts_for(tokens), {"n": "long"}, work), "whole")

    def apply(facts, owners, levels, every):
        n = np.array(facts["n"], np.int64)
        common = levels > 0
        owners, levels, every = owners[common], levels[common], every[common]
        order = np.lexsort((levels, owners))  # stable: then by hash
        owners, levels, every = owners[order], levels[order], every[order]
        c = np.bincount(owners, minlength=len(n)).astype(np.int64)
        ends = np.cumsum(c)
        large = c - needed(n, -(-n * PERCENT // 100)) + 1  # plain prefix if the partner is as small as it may be
        few = c - needed(n, n) + 1
        width = bands(int(n.max(initial=1)))
        out = []
        for i in np.flatnonzero(large > 0).tolist():
            a, b = int(ends[i] - c[i]), int(ends[i])
            length = int(large[i])
            cost = float((count_of(levels[a : a + length]) - 1).sum())
            k = 1 + min(int(n[i]) // SPARE, int(c[i]) - length, int(cost / CANDIDATES_PER_MATCH))
            s = np.sort(every[a:b])
            out.append((facts["key"][i], int(n[i]), int(c[i]), k, int(few[i]) + k - 1 if few[i] > 0 else 0, every[a : a + length + k - 1].view(np.int64),
                        int(np.searchsorted(width, n[i], "right")), bitmap(s), s.tobytes()))
        names = ["no", "n", "c", "k", "few", "p", "band", "bits", "s"]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({x: pa.array([o[i] for o in out], t) for i, (x, t) in enumerate(zip(names, kinds, strict=True))})

    nodes = stash(told(blocks, answers(blocks), "no long, n long, c long, k long, few long, p array<long>, band long, bits binary, s binary", apply, True), "nodes")
    drop(blocks)
    return nodes


def _linked(nodes: DataFrame) -> DataFrame | None:
    """id and root of the nodes (by their no) that have a link."""
    row = nodes.select("no", "n", "c", "k", "few", "band", F.posexplode("p").alias("at", "h"))
    # tokens of two nodes and more, one of which may be the smaller of a pair
    several = row.groupBy("h").agg(F.min("no").alias("lo"), F.max("no").alias("hi"), F.min(F.col("at") - F.col("few")).alias("s"))
    several = several.filter("lo <> hi and s < 0").select(F.col("h").alias("_h"))
    # joins by token have one plan at every size: both sides are shuffled, skewed tokens are split
    rest = stash(row.join(several.hint("merge"), F.col("h") == F.col("_h")).drop("_h").withColumns({"root": F.col("no"), "was": F.lit(False)}), "shared")
    comp, before = None, None
    sides = {what: small(nodes.select("no", "n", "c", what)) for what in ("bits", "s")}
    while True:
        # pairs that testing all across components would take, from the counts of each token's components
        is_small = F.count_if(F.col("at") < F.col("few"))
        each = rest.groupBy("h", "band", "root").agg(F.count(F.lit(1)).alias("l"), is_small.alias("s"))
        each = each.groupBy("h", "band").agg(F.sum("l").alias("l"), F.sum("s").alias("s"), F.sum(F.col("l") * F.col("s")).alias("own"))
        with tidy(nodes.sparkSession):
            rows_left, pairs_left = each.agg(F.coalesce(F.sum("l"), F.lit(0)), F.coalesce(F.sum(F.col("l") * F.col("s") - F.col("own")), F.lit(0))).first()
        # the first round pays at any size: families of near copies, of which each has as many pairs as the square of its nodes,
        # are small where the input is, but they are there
        if not pairs_left or (before is not None and (pairs_left <= PAIRS_PER_ROW * rows_left or pairs_left > WORTH * before)):
            break
        before = pairs_left
        # the nodes of a token with one of them that was no pivot yet: one whose tokens others have too stands in the
        # middle of a family
        best = F.max(F.struct((F.col("c") / F.col("n")).alias("score"), "no", "n", "c", "root")).alias("p")
        piv = stash(rest.filter(~F.col("was")).groupBy("h", "band").agg(best).select(F.col("h").alias("_h"), F.col("band").alias("_band"), F.col("p.no").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.c").alias("pc"), F.col("p.root").alias("proot")), "pivots")
        star = rest.join(piv.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("band") == F.col("_band")))
        star = star.filter((F.col("root") != F.col("proot")) & _alike("n", "c", "pn", "pc")).select(F.col("pivot").alias("a"), F.col("no").alias("b")).distinct()
        comp = _joined(comp, _verified(sides, star))
        old, rest = rest, _unsettled(rest, comp, piv.select(F.col("pivot").alias("_u")).distinct())
        drop(old, piv)
    # the remaining pairs across components: the smaller one of a pair by its short prefix
    a = rest.filter("at < few").select("h", "band", *[F.col(c).alias("a" + c) for c in ("no", "n", "c", "k", "at", "root")])
    b = rest.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).select("h", "band", *[F.col(c).alias("b" + c) for c in ("no", "n", "c", "k", "at", "root")])
    o, k = F.expr(f"({PERCENT} * (an + bn) + {99 + PERCENT}) div {100 + PERCENT}"), F.least("ak", "bk")
    smaller = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("ano") < F.col("bno")))
    early = (F.col("aat") < F.col("ac") - o + k) & (F.col("bat") < F.col("bc") - o + k)
    # of two nodes that share as many tokens as they must, the kth of these has k - 1 before it on either side, and enough after it
    kth = (F.least("aat", "bat") >= k - 1) & (F.least("aat", "bat") + 1 + F.least(F.col("ac") - F.col("aat"), F.col("bc") - F.col("bat")) - 1 >= o)
    pairs = a.join(b.hint("merge"), ["h", "band"]).filter(smaller & (F.col("aroot") != F.col("broot")) & _alike("an", "ac", "bn", "bc") & early & kth)
    pairs = stash(pairs.select("ano", "bno").distinct(), "meetings")
    side = lambda x: nodes.select(*[F.col(c).alias(x + c) for c in ("no", "n", "c", "k", "few", "p")])
    both = pairs.join(small(side("a")), "ano").join(small(side("b")), "bno")
    first = lambda x, most: F.slice(x, F.lit(1), F.greatest(most, F.lit(0)).cast("int"))
    shared = F.size(F.array_intersect(first("ap", F.least(F.col("few"), F.col("ac") - o + k)), first("bp", F.col("bc") - o + k)))
    pairs = both.withColumnRenamed("afew", "few").filter(shared >= k)
    comp = _joined(comp, _verified(sides, pairs.select(F.col("ano").alias("a"), F.col("bno").alias("b"))))
    drop(rest)
    return comp


def _joined(comp: DataFrame | None, links: DataFrame | None) -> DataFrame | None:
    """The components after further links."""
    if links is None or links.isEmpty():
        return comp
    if comp is not None:
        links = links.unionByName(comp.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    return components(links)


def _unsettled(rest: DataFrame, comp: DataFrame | None, used: DataFrame) -> DataFrame:
    """The rows of tokens whose nodes are still of several components, with the components as they are now."""
    if comp is not None:
        rest = rest.join(small(comp.withColumnRenamed("root", "_root"), BROADCAST_KEYS), F.col("no") == F.col("id"), "left").withColumn("root", F.coalesce("_root", "no")).drop("_root", "id")
    rest = rest.join(small(used, BROADCAST_KEYS), F.col("no") == F.col("_u"), "left").withColumn("was", F.col("was") | F.col("_u").isNotNull()).drop("_u")
    mixed = rest.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select(F.col("h").alias("_h"))
    return stash(rest.join(mixed.hint("merge"), F.col("h") == F.col("_h"), "left_semi"), "rest")


def _alike(n: str, c: str, m: str, d: str) -> Column:
    """Whether sets of sizes n and m can be alike enough, that have c and d tokens which others have too."""
    n, m = F.col(n), F.col(m)
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT) & (PERCENT * (n + m) <= (100 + PERCENT) * F.least(c, d))


def _labelled(rows: DataFrame, reps: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Components of nodes to ids: the smallest id of a component's nodes."""
    named = reps.select("no", F.col("node").alias("_node"), F.col("chk").alias("_chk"), F.col("rep").alias("component"))
    if comp is not None:
        named = named.join(comp, F.col("no") == F.col("id"), "left").withColumn("root", F.coalesce("root", "no"))
        least = named.groupBy(F.col("root").alias("_root")).agg(F.min("component").alias("least"))
        named = named.join(least, F.col("root") == F.col("_root")).withColumn("component", F.col("least"))
    named = stash(named.select("_node", "_chk", "component"), "named")
    out = rows.filter("alive").join(small(named, BROADCAST_KEYS), (F.col("node") == F.col("_node")) & (F.col("chk") == F.col("_chk")))
    out = out.select("doc_id", "n", "component").unionByName(rows.filter("not alive").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _verified(sides: dict[str, DataFrame], pairs: DataFrame) -> DataFrame | None:
    """Those of the pairs (a, b) of nodes that link, by their bitmaps and then by their sets; None if there are no pairs."""
    import pyarrow as pa

    left = stash(pairs, "candidates")
    if left.isEmpty():
        return None

    def checked(test):
        """a, n, c and a binary column of either side: the pairs that pass."""
        def run(batches):
            for b in batches:
                keep = [test(*r) for r in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return run

    def possible(n, c, x, m, d, y):
        return most_common(x, y, c, d) >= needed(n, m)

    def like(n, c, x, m, d, y):
        common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return 100 * common >= PERCENT * (n + m - common)

    def beside(p: DataFrame, what: str) -> DataFrame:
        side = lambda x: sides[what].select(F.col("no").alias(x), *[F.col(c).alias(x + c) for c in ("n", "c", what)])
        # the pivots' side first, which may be few nodes with many pairs each, so that little is moved with it
        both = p.join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", *[x + c for x in "ab" for c in ("n", "c", what)])

    maybe = stash(beside(left, "bits").mapInArrow(checked(possible), "a long, b long"), "maybe")
    links = stash(beside(maybe, "s").mapInArrow(checked(like), "a long, b long"), "links")
    drop(left, maybe)
    return links
