"""Line dedup by an exact set-similarity join.

A line is the set of its five-word shingles (fewer words are one shingle). A line is removed if a line before
it, by doc_id and then place, has a Jaccard similarity of 0.8 or more to it, be it in the same document or in
another. Lines without words are no lines here and stay.

Two similar lines share one of the first n - ceil(0.8 n) + 1 tokens of either, in any order of all tokens. At
first the order is that of the first words' hashes, so that only a quarter of a line's shingles have to be made;
lines of which other lines have too few go out of the join. Of the others, those of equal text are one class, whose
first occurrence stands for it. Their tokens are ordered by rarity, counted over them in hashed counters, and
classes that share a prefix token are candidates if their sizes and the token's places allow the overlap; they
are verified on the whole sets. Each class is held against the first class of its tokens, then the second, as
long as that leaves clearly fewer pairs; only what is still unmatched is held against all before it.

Defined results: a null text is null again, with no lines; null ids come first in order; of rows with the same
doc_id and text one keeps its lines as they are judged, and the others, which repeat them, lose all lines with
words; an empty table gives an empty result; columns named n_lines or removed_lines are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, drop, let, small, stash, tidy, words

SHINGLE = 5
#: Counters of the rarity estimate; each counts the tokens of one hash.
COUNTERS = 1 << 15
#: Rows of one or two numbers that may be broadcast, counted first.
BROADCAST_KEYS = 600_000
#: Of n tokens n // SLACK more than a fifth are shown to other lines at first.
SLACK = 20
#: Pairs for each row that need no further round of first classes; the share of them that a round must leave at most.
PAIRS_PER_ROW, WORTH = 12, 0.7


def _whole(w: Column) -> Column:
    """The one token of a line of few words."""
    return F.array(F.xxhash64(F.array_join(w, " ")))


def _at(w: Column, i: Column) -> Column:
    """The shingle of the words from place i."""
    return F.xxhash64(F.get(w, i), *[F.get(w, i + k) for k in range(1, SHINGLE)])


def _every(w: Column) -> Column:
    # the last SHINGLE - 1 places have no whole shingle
    return F.array_distinct(F.transform(F.slice(w, F.lit(1), F.size(w) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)])))


def shingles(w: Column) -> Column:
    """Distinct 64-bit shingle hashes of a line's words, unsorted; empty without words."""
    return F.when(F.size(w) >= SHINGLE, _every(w)).when(F.size(w) > 0, _whole(w)).otherwise(F.array().cast("array<long>"))


def shown(lines: DataFrame) -> DataFrame:
    """Of ``lines`` (c, line) the rows k, h: tokens of each line, of which a similar line has as many as t says, the lower byte
    of k, whose other bytes are those of c. The tokens are those whose first words' hashes come first: so many different first words
    as a fifth of the places and a SLACK-th more, each at all its places. Where a line has fewer, all its tokens. A line has at least
    as many shingles as different first words, so that t is what lines of four fifths of that number show beyond a fifth of
    their own. Each step is a column of its own, so that compiled code does all but the lambda's hash of a word."""
    w, f, d, n = F.col("w"), F.col("f"), F.col("d"), F.size("f")
    need = F.floor(n / 5).cast("int") + F.greatest(F.lit(1), F.floor(n / SLACK).cast("int"))
    least = F.floor(F.ceil(F.size(d) * 0.8 - 1e-9) / SLACK).cast("int").cast("long")
    rows = lines.select("c", words(F.col("line")).alias("w"))
    rows = rows.select("c", "w", F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))), lambda x: F.xxhash64(x)).alias("f"))
    rows = rows.select("c", "w", "f", F.sort_array(F.array_distinct(f)).alias("d"))
    # bound before the places are rows, so as not to be made for each of them; never null, as Spark would test that on the line
    last = F.coalesce(let(F.when(F.size(d) >= need, F.get(d, need - 1)), lambda v: v), F.lit(2**63 - 1))
    key = let(F.col("c").bitwiseAND(F.lit(~255).cast("long")).bitwiseOR(F.greatest(F.lit(1).cast("long"), F.least(F.lit(255).cast("long"), least))), lambda v: v)
    rows = rows.select("w", F.when(F.size(w) < SHINGLE, F.array(F.lit(0).cast("long"))).otherwise(f).alias("f"), key.alias("k"), last.alias("last"))
    rows = rows.select("k", "w", "last", F.posexplode_outer("f").alias("i", "v")).filter("v <= last")
    return rows.select("k", F.when(F.size(w) < SHINGLE, F.xxhash64(F.array_join(w, " "))).otherwise(_at(w, F.col("i"))).alias("h"))


def rarity_levels(sets: DataFrame) -> Column:
    """A constant array: for each counter the doublings by which it is above the usual one, 31 at most."""
    counted = sets.select(F.explode("s").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(COUNTERS - 1)).alias("c")).count()
    with tidy(sets.sparkSession):
        got = dict(counted.collect())  # no more lines than counters
    usual = sorted(got.get(i, 0) for i in range(COUNTERS))[COUNTERS // 2]
    over = [max(0.0, got.get(i, 0) - usual - 4 * usual**0.5) for i in range(COUNTERS)]
    return F.split(F.lit(",".join(str(min(31, int(x).bit_length())) for x in over)), ",").cast("array<long>")


def by_rarity(tokens: Column, levels: Column) -> Column:
    """The tokens in order: rarity in the upper five bits of a number, the token without its lowest bits in the others."""
    level = lambda h: F.get(levels, h.bitwiseAND(F.lit(COUNTERS - 1)))
    return F.sort_array(F.transform(tokens, lambda h: F.shiftleft(level(h), 58).bitwiseOR(F.shiftrightunsigned(h, 6))))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _t (hash of the text) and removed (the sorted numbers, from 0, of the lines that go) of each different row
    that loses some."""
    base = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    # outer, as for the other kind Spark splits every text once more to see that it has lines
    at = base.select("_id", "_t", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.col("line").rlike(NOT_SPACE))
    at, texts = at.select("_id", "_t", "line_no", F.xxhash64("line").alias("c"), F.xxhash64(F.lit(1), "line").alias("c2")), at.select(F.xxhash64("line").alias("c"), "line")
    at = stash(at, "lines")
    # classes of equal lines: first occurrence, and whether there are more
    first, last = (f(F.struct("_id", "_t", "line_no")) for f in (F.min, F.max))
    classes = stash(at.groupBy("c", "c2").agg(first.alias("first"), last.alias("last")), "classes")
    hit = _matched(base, classes, _sharing(texts))
    gone = classes.join(small(hit.select(F.col("c").alias("_c"), F.col("c2").alias("_c2"), F.lit(True).alias("_hit")), BROADCAST_KEYS), (F.col("c") == F.col("_c")) & (F.col("c2") == F.col("_c2")), "left")
    gone = gone.filter(~F.col("first").eqNullSafe(F.col("last")) | F.col("_hit")).select(F.col("c").alias("_c"), F.col("c2").alias("_c2"), F.when(F.col("_hit").isNull(), F.col("first")).alias("kept"))
    out = at.select("_id", "_t", "line_no", "c", "c2").join(small(stash(gone, "gone"), BROADCAST_KEYS), (F.col("c") == F.col("_c")) & (F.col("c2") == F.col("_c2")))
    out = out.filter(~F.struct("_id", "_t", "line_no").eqNullSafe(F.col("kept")))
    out = stash(out.groupBy("_id", "_t").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "removed")
    drop(at, classes, hit)
    return out


def _sharing(texts: DataFrame) -> DataFrame:
    """_p, the upper seven bytes of c of the lines of which others have so many tokens as a similar one must."""
    token = stash(shown(texts), "shown")
    held = token.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    held = stash(held, "held")
    # of two lines both are known; more are looked up, a line that comes several times as often
    more = held.filter("n > 2").select(F.col("h").alias("_h"))
    others = token.join(small(more, BROADCAST_KEYS), F.col("h") == F.col("_h"), "left_semi").select("k")
    two = held.filter("n = 2").select(F.explode(F.array("lo", "hi")).alias("k"))
    seen = two.unionByName(others).groupBy("k").agg(F.count(F.lit(1)).alias("seen"))
    out = stash(seen.filter("seen >= (k & 255)").select(F.shiftright("k", 8).alias("_p")), "sharing")
    drop(held, token)
    return out


def _sets(base: DataFrame, who: DataFrame) -> DataFrame:
    """no, n and s (the tokens) of the lines ``who``: no, first."""
    need = who.groupBy(F.col("first._id").alias("_nid"), F.col("first._t").alias("_nt")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "no")).alias("q"))
    need = stash(need, "need")
    docs = base.join(small(need), F.col("_id").eqNullSafe(F.col("_nid")) & (F.col("_t") == F.col("_nt")))
    # bound before the lines are rows, or Spark splits the text for each line
    made = docs.select(let(F.split("text", "\n", -1), lambda v: v).alias("ls"), "q").select("ls", F.explode("q").alias("q"))
    made = made.select(F.col("q.no").alias("no"), words(F.get("ls", F.col("q.line_no"))).alias("w")).select("no", shingles(F.col("w")).alias("s"))
    sets = stash(made.select("no", F.size("s").alias("n"), "s"), "tokens")
    if sets.count() > who.count():  # rows that repeat
        sets, old = stash(sets.dropDuplicates(["no"]), "tokens"), sets
        drop(old)
    drop(need)
    return sets


def _matched(base: DataFrame, classes: DataFrame, sharing: DataFrame) -> DataFrame:
    """c and c2 of the classes that a class before them matches."""
    def allowed(n: Column, m: Column, i: Column, j: Column) -> Column:
        return (10 * F.least(n, m) >= 8 * F.greatest(n, m)) & (9 * F.least(n - i, m - j) >= 4 * (n + m))

    who = classes.join(small(sharing, BROADCAST_KEYS), F.shiftright("c", 8) == F.col("_p"), "left_semi").select("c", "c2", "first")
    # numbers in the order of the lines
    who = stash(who.orderBy("first").withColumn("no", F.monotonically_increasing_id()), "who")
    sets = _sets(base, who)
    n = F.col("n")
    lead = F.slice(by_rarity(F.col("s"), rarity_levels(sets)), F.lit(1), n - F.ceil(n * 0.8 - 1e-9).cast("int") + 1)
    leads = stash(sets.select("no", "n", lead.alias("p")), "leads")
    token = leads.select("no", "n", F.posexplode("p").alias("i", "h"))
    several = token.groupBy("h").agg(F.min("no").alias("lo"), F.max("no").alias("hi")).filter("lo <> hi").select(F.col("h").alias("_h"))
    # one plan at every size: both sides are shuffled by token, skewed tokens are split
    rest = stash(token.join(several.hint("merge"), F.col("h") == F.col("_h")).select("h", "no", "n", "i", F.lit(False).alias("hit")), "shared")

    def verified(pairs: DataFrame) -> DataFrame:
        """b of the pairs (a, b) that match."""
        members = small(pairs.select(F.explode(F.array("a", "b")).alias("_m")).distinct(), BROADCAST_KEYS)
        some = sets.join(members, F.col("no") == F.col("_m"), "left_semi")
        side = lambda x: some.select(F.col("no").alias(x), F.col("s").alias("s" + x))
        both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        return both.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("b").distinct()

    hits, last, before = [], None, None
    while True:
        counts = rest.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("hit")).alias("u"))
        with tidy(base.sparkSession):
            rows_left, pairs_left = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("u") * F.col("n")), F.lit(0))).first()
        if pairs_left <= PAIRS_PER_ROW * rows_left or (before is not None and pairs_left > WORTH * before):
            break
        before = pairs_left
        # the first class of each token that was none yet, and those after it that nothing has matched
        after = rest if last is None else rest.join(last.hint("merge"), F.col("h") == F.col("_l"), "left").filter("_no is null or no > _no")
        head = stash(after.groupBy("h").agg(F.min(F.struct("no", "n", "i")).alias("p")).select(F.col("h").alias("_h"), F.col("p.no").alias("_a"), F.col("p.n").alias("_n"), F.col("p.i").alias("_i")), "heads")
        led = rest.filter(~F.col("hit")).join(head.hint("merge"), F.col("h") == F.col("_h")).filter((F.col("no") > F.col("_a")) & allowed(F.col("n"), F.col("_n"), F.col("i"), F.col("_i")))
        hit = stash(verified(stash(led.select(F.col("_a").alias("a"), F.col("no").alias("b")).distinct(), "pairs")), "hit")
        hits.append(hit)
        last = head.select(F.col("_h").alias("_l"), F.col("_a").alias("_no"))
        marked = rest.join(small(hit.withColumnRenamed("b", "_b"), BROADCAST_KEYS), F.col("no") == F.col("_b"), "left")
        marked = stash(marked.select("h", "no", "n", "i", (F.col("hit") | F.col("_b").isNotNull()).alias("hit")), "marked")
        open_ = marked.filter("not hit").select(F.col("h").alias("_h")).distinct()
        old, rest = rest, stash(marked.join(open_.hint("merge"), F.col("h") == F.col("_h"), "left_semi"), "rest")
        drop(old, marked)
    x, y = rest.alias("x"), rest.filter("not hit").alias("y")
    may = allowed(F.col("x.n"), F.col("y.n"), F.col("x.i"), F.col("y.i"))
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.no") < F.col("y.no")) & may)
    hit = verified(stash(pairs.select(F.col("x.no").alias("a"), F.col("y.no").alias("b")).distinct(), "pairs"))
    for h in hits:
        hit = hit.unionByName(h)
    out = stash(who.join(small(stash(hit.distinct(), "hits"), BROADCAST_KEYS), F.col("no") == F.col("b"), "left_semi").select("c", "c2"), "matched")
    drop(rest, sets, leads, who, sharing, *hits)
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text cleaned, n_lines (before) and removed_lines."""
    gone = removed_lines(docs, key, text)
    keep = [c for c in docs.columns if c not in ("n_lines", "removed_lines", text)]
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_x"), F.col(text).alias("_text"))
    named = lambda df, *names: df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)])
    same = F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_t"))
    lines = F.split(F.col("_text"), "\n", -1)
    wordy = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(NOT_SPACE), i)), lambda i: i.isNotNull())
    # rows that repeat: all but one lose their lines
    twice = stash(rows.filter("_text is not null").groupBy("_k", "_x").count().filter("count > 1").select("_k", "_x"), "twice")
    if twice.isEmpty():
        rows = rows.withColumn("_again", F.lit(False))
    else:
        twice = named(twice, "_id", "_t")
        some = stash(rows.join(small(twice), same, "left_semi").withColumn("_m", F.monotonically_increasing_id()), "again")
        one = named(some.groupBy("_k", "_x").agg(F.min("_m").alias("_m")), "_id", "_t", "_one")
        some = some.join(small(one), same).withColumn("_again", F.col("_m") != F.col("_one")).drop("_m", "_one", "_id", "_t")
        rows = rows.join(small(twice), same, "left_anti").withColumn("_again", F.lit(False)).unionByName(some)
    out = rows.join(small(gone), same, "left")
    none = F.array().cast("array<int>")
    out = out.withColumn("removed", F.when(F.col("_again"), wordy).otherwise(F.coalesce("removed", none)))
    cleaned = F.when(F.size("removed") == 0, F.col("_text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed", i)), "\n"))
    # in two steps, so that no name of the caller's is taken for one of these
    added = F.struct(cleaned.alias(text), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.col("removed").alias("removed_lines"))
    return out.select("_row", added.alias("_added")).select("_row.*", "_added.*")
