"""Host-level quality rules.

Each document is measured; the failures of its host (``source``) are counted, the host's failure rate is
shrunk towards the mean of all hosts by an empirical beta prior, and the verdict on the host is joined
back to the document, which it decides together with the document's own base rules.

Defined results: a null or empty text has no words and fails the base rules; a null source is a host of its
own; rows that repeat, or share a doc_id, are judged one by one; columns of the input named as the added ones
are replaced, and other names are the caller's; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, let, small, stash, words

SYMBOLS = "[#*$%&|<>]"
#: Base rules of a document.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document also counts as a failure of its host with more symbols than this share of its word characters,
#: or more repeated lines than this share of its lines with words.
MAX_SYMBOL_SHARE, MAX_DUP_LINE_SHARE = 0.05, 0.5
#: A host whose shrunk failure rate is above the first is rejected as a whole. Under a host of at most the
#: second rate a document that fails only the extra rules is kept.
REJECT_RATE, TRUST_RATE = 0.6, 0.02
#: Bits of a packed window that hold its place; the other bits hold a hash.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _covered(places: Column) -> Column:
    """Words under windows of three that start at the sorted ``places``."""
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x))


def repeat_words(w: Column) -> Column:
    """Words within windows of three words that occur twice or more, the first included.

    Windows are sorted as 64-bit numbers of hash and place; equal hashes are checked word by word, and a
    text in which two different windows share a hash is counted by sorting the windows themselves.
    """
    low, place = F.lit(PLACE).cast("long"), F.lit(PLACE_BITS)

    def fast(w):
        packed = F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~PLACE).cast("long")).bitwiseOR(i.cast("long"))))
        same = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), PLACE_BITS) == 0

        def counted(s):
            hit = F.filter(s, lambda v, k: F.coalesce(same(v, F.get(s, k + 1)), F.lit(False)) | F.coalesce((k > 0) & same(v, F.get(s, k - 1)), F.lit(False)))

            def exact(h):
                at = lambda v: v.bitwiseAND(low).cast("int")
                differ = lambda v, u: ~((F.get(w, at(v)) == F.get(w, at(u))) & (F.get(w, at(v) + 1) == F.get(w, at(u) + 1)) & (F.get(w, at(v) + 2) == F.get(w, at(u) + 2)))
                clash = F.exists(F.transform(h, lambda v, k: F.struct(v.alias("v"), F.get(h, k + 1).alias("u"))),
                                 lambda x: x["u"].isNotNull() & same(x["v"], x["u"]) & differ(x["v"], x["u"]))
                return F.when(clash, slow(w)).otherwise(_covered(F.sort_array(F.transform(h, lambda v: v.bitwiseAND(low)))))

            return let(hit, exact)

        return let(packed, counted)

    def slow(w):
        grams = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.slice(w, i + 1, 3).alias("g"), i.cast("long").alias("i"))))
        return let(grams, lambda s: _covered(F.sort_array(F.transform(
            F.filter(s, lambda v, k: F.coalesce(v["g"] == F.get(s, k + 1)["g"], F.lit(False)) | F.coalesce((k > 0) & (v["g"] == F.get(s, k - 1)["g"]), F.lit(False))),
            lambda v: v["i"]))))

    return let(w, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) > PLACE, slow(w)).otherwise(fast(w)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES, base_failed and failed (base or extra rules)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    out = docs.withColumns({
        "_m": let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))),
        "_l": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
    })
    out = out.withColumns({"n_words": F.col("_m.n_words"), "n_repeat_words": F.col("_m.n_repeat_words"), "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines")}).drop("_m", "_l")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    extra = (F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars")) | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))
    return out.withColumns({"base_failed": base, "failed": base | extra})


def host_verdicts(rows: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: host, host_docs, host_failures, host_rate (shrunk), host_rejected.

    The beta prior is fitted to all hosts by moments; with one host, or rates that vary no more than
    chance makes them, it is so strong that every host gets the mean rate.
    """
    hosts = stash(rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failures")), "hosts")
    n, f = F.col("host_docs"), F.col("host_failures")
    got = hosts.agg(F.sum(f) / F.sum(n), F.var_samp(f / n), F.avg(1 / n)).first()
    mean, var, inverse = (float(x or 0) for x in got)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    between = var - mean * (1 - mean) * inverse  # variance of the rates beyond binomial noise
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    rate = (f + mean * strength) / (n + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > REJECT_RATE)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with the measures, base_failed, host_rate, host_rejected and kept.

    The measured rows are written once; hosts are counted from there, so that no text is read twice.
    """
    names = [*MEASURES, "base_failed", "failed"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*names, "host_rate", "host_rejected", "kept")]
    rows = measured(docs.select(F.struct(*carry).alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_host")), "_text")
    rows = stash(rows.select("_row", "_host", *names), "quality")
    hosts = host_verdicts(rows, "_host").select("host", "host_rate", "host_rejected")
    out = rows.join(small(hosts), F.col("_host").eqNullSafe(F.col("host")))
    kept = ~F.col("base_failed") & ~F.col("host_rejected") & (~F.col("failed") | (F.col("host_rate") <= TRUST_RATE))
    # in two steps, so that no name of the caller's is taken for one of these
    return out.select("_row", F.struct(*names, "host_rate", "host_rejected", kept.alias("kept")).alias("_added")).select("_row.*", "_added.*")
