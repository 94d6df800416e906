"""Document fingerprints by SpotSigs.

A spot signature is an anchor, which is one of the common words below, with the chain of the CHAIN content
words that follow it, further anchors skipped. A document's fingerprint is the set of its signatures; sets are
compared by Jaccard, which pruning by set length saves where the lengths alone rule a likeness out.

Defined results: a text without a signature (no anchor with CHAIN content words after it) is its own
signature as a whole sequence of words, and a text without words, or null, has the empty fingerprint; two
empty fingerprints have the likeness 1. Documents of equal id stand in the order of their texts, null ids
first. An empty table gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, lower_ascii, stash, words

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "avec", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "con", "del", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)
CHAIN = 2
#: Documents of a bucket in which neighbours are found, the most buckets, and ids drawn for each.
BUCKET_ROWS, MOST_BUCKETS, DRAWN = 4000, 16384, 12


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct 64-bit hashes of a text's spot signatures.

    The content words before the j-th anchor (from 0) at place q are q - j many, so an anchor's chain starts
    there in the list of content words, and no running count is needed.
    """
    def build(w):
        content = F.filter(w, lambda x: ~x.isin(*ANCHORS))
        spots = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*ANCHORS), i)), lambda i: i.isNotNull())

        def chains(s):
            full = F.filter(F.transform(s["q"], lambda q, j: F.struct(q.alias("q"), (q - j).alias("k"))), lambda p: p["k"] + chain <= F.size(s["c"]))
            return F.transform(full, lambda p: F.xxhash64(F.get(w, p["q"]), *[F.get(s["c"], p["k"] + i) for i in range(chain)]))

        found = let(F.struct(content.alias("c"), spots.alias("q")), chains)
        return let(F.array_distinct(found), lambda s: F.when(F.size(s) > 0, F.sort_array(s)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>")))

    return let(words(lower_ascii(text)), build)


def fingerprint(sigs: Column) -> Column:
    """The set as a string: its length and a digest of its sorted members."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.substring(F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256), 1, 32))


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 where the lengths alone keep it under ``least``."""
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return (F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0))
            .when(F.least(n, m) < least * F.greatest(n, m), F.lit(0.0)).otherwise(common / (n + m - common)))


def _splitters(docs: DataFrame, key: str) -> list:
    """Quantiles of ids drawn by hash, one for each bucket but the first; the driver gets about DRAWN for each. Ids may be
    of any type that Python orders as Spark does: numbers, texts, dates."""
    n = docs.filter(F.col(key).isNotNull()).count()
    buckets = min(MOST_BUCKETS, n // BUCKET_ROWS + 1)
    if buckets < 2:
        return []
    chance = min(1.0, DRAWN * buckets / n)
    draw = F.pmod(F.xxhash64(F.lit("next"), F.col(key)), F.lit(1 << 30)) < int(chance * (1 << 30))
    ids = sorted(r[0] for r in docs.filter(F.col(key).isNotNull() & draw).select(key).collect())
    return sorted({ids[len(ids) * i // buckets] for i in range(1, buckets)}) if ids else []


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` and next_text: the text of the next document by id, after the last one the first's.

    Documents are dealt by id into buckets; the first document of each bucket is dealt to the bucket before
    as well, so that one shuffle of the texts and a window within each bucket suffice.
    """
    splits = _splitters(docs, key)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bucket = F.lit(0)
    if splits:
        step = max(64, isqrt(len(splits)))
        blocks = [splits[i : i + step] for i in range(0, len(splits), step)]
        array = lambda v: F.array(*[F.lit(x).cast(docs.schema[key].dataType) for x in v])
        at = F.greatest(F.size(F.filter(array([b[0] for b in blocks]), lambda s: s <= F.col(key))) - 1, F.lit(0))
        bucket = F.when(F.col(key).isNull(), F.lit(0)).otherwise(at * step + F.size(F.filter(F.get(F.array(*[array(b) for b in blocks]), at), lambda s: s <= F.col(key))))
    rows = rows.withColumn("_b", bucket)
    none = F.max(F.col(key).isNull()).alias("none")
    heads = [(r["_b"], None if r["none"] else r["k"]) for r in rows.groupBy("_b").agg(F.min(key).alias("k"), none).collect()]  # a line per bucket
    if not heads:
        return rows.select(key, "text", F.lit(None).cast("string").alias("next_text"))
    order = sorted(b for b, _ in heads)
    to = {b: order[i - 1] for i, b in enumerate(order)}  # the first bucket's head follows the last document
    first = docs.sparkSession.createDataFrame([(b, k, to[b]) for b, k in heads], f"_fb int, _k {docs.schema[key].dataType.simpleString()}, _to int")
    hit = rows.join(F.broadcast(first), (F.col("_b") == F.col("_fb")) & F.col(key).eqNullSafe(F.col("_k")))
    ends = hit.groupBy("_to").agg(F.min("text").alias("text")).select(F.lit(None).cast(docs.schema[key].dataType).alias(key), "text", F.col("_to").alias("_b"), F.lit(True).alias("_end"))
    both = rows.withColumn("_end", F.lit(False)).unionByName(ends)
    w = W.partitionBy("_b").orderBy("_end", F.col(key).asc_nulls_first(), "text")
    return both.withColumn("next_text", F.lead("text").over(w)).filter(~F.col("_end")).select(key, "text", "next_text")


def spot_pairs(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pairs of different fingerprints with a likeness of ``least`` or more, as pairs of class ids, and
    each document's class: two frames, (id_a, id_b, likeness) and (key, class_id, n_signatures).

    Documents of equal fingerprints are one class. Classes are partitioned by set length into bands whose
    lengths grow by 1/least, so partners lie in the same or the next band; within a band they meet by the
    signatures of a prefix in order of rarity, long enough that none is lost.
    """
    sig = docs.select(F.col(key), signatures(F.col(text)).alias("s")).withColumn("f", fingerprint(F.col("s")))
    sig = stash(sig, "signatures")
    classes = stash(sig.groupBy("f").agg(F.min(key).alias("class_id"), F.first("s").alias("s")), "classes")
    members = sig.join(classes.select("f", "class_id"), "f").select(key, "class_id", F.size("s").alias("n_signatures"))
    n = F.size("s")
    band = F.floor(F.log(n) / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    # signatures that few classes have come first
    every = classes.filter(n > 0).select(F.col("class_id").alias("id"), "f", n.alias("n"), band.alias("band"), F.explode("s").alias("g"))
    held = every.groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    placed = every.join(held.hint("merge"), F.col("g") == F.col("_g")).groupBy("id", "f", "n", "band").agg(F.array_sort(F.collect_list(F.struct("held", "g"))).alias("o"))  # a class's own signatures
    # those that no other class has come before all others: they only take places in the prefix
    lead = F.slice("o", F.lit(1), F.greatest(F.size("o") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1, F.lit(0)))
    keyed = stash(placed.select("id", "f", "n", "band", F.explode(lead).alias("x")).select("id", "f", "n", "band", F.col("x.g").alias("g")), "keyed")
    meet = keyed.alias("a").join(keyed.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).alias("b"),
                                 (F.col("a.g") == F.col("b.g")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.f") != F.col("b.f"))
                                 & (F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n")))
    pairs = meet.select(F.least("a.f", "b.f").alias("fa"), F.greatest("a.f", "b.f").alias("fb")).distinct()
    one = classes.select(F.col("f").alias("fa"), F.col("class_id").alias("id_a"), F.col("s").alias("sa"))
    two = classes.select(F.col("f").alias("fb"), F.col("class_id").alias("id_b"), F.col("s").alias("sb"))
    like = pairs.join(one, "fa").join(two, "fb").withColumn("likeness", pruned_jaccard(F.col("sa"), F.col("sb"), least))
    return like.filter(F.col("likeness") >= least).select("id_a", "id_b", "likeness"), members


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text (its second half replaced by the start of the next document) and
    beside the next document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    rows = with_next(docs, key, text)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 2).cast("int")))
    rows = rows.select(key, n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("_e"))
    rows = rows.select(key, "n_chars", F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"),
                       signatures(F.col("text")).alias("_a"), signatures(F.col("_e")).alias("_b"), signatures(F.col("next_text")).alias("_c"))
    return rows.select(key, "n_chars", "edited_sha256", fingerprint(F.col("_a")).alias("fingerprint"), fingerprint(F.col("_b")).alias("edited_fingerprint"),
                       pruned_jaccard(F.col("_a"), F.col("_b")).alias("near_edited"), pruned_jaccard(F.col("_a"), F.col("_c")).alias("near_next"))
