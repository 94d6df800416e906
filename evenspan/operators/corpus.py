"""Corpus construction: cleaning of title pairs, joins across languages, alignment, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import dense_number, percentiles

#: Fixed patterns: pages outside the article namespace, and templates or categories in the second column.
NAMESPACE = r"(?i)wikipedia:|image:|talk:|file:|user:|help:|mediawiki:|\.(?:jpg|jpeg|png|gif|svg)|#"
TEMPLATE = r"(?i)template:|category:"
CYRILLIC, PERSO_ARABIC = "[\\u0400-\\u04ff]", "[\\u0600-\\u06ff]"


def unambiguous(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Pairs whose source has one target and whose target has one source.

    Minimum and maximum tell one value from several, so both sides aggregate before the shuffle.
    """
    p = pairs.select(src, tgt).distinct()
    one = p.groupBy(src).agg(F.min(tgt).alias("_a"), F.max(tgt).alias("_z")).filter("_a = _z").select(src, F.col("_a").alias(tgt))
    back = p.groupBy(tgt).agg(F.min(src).alias("_a"), F.max(src).alias("_z")).filter("_a = _z").select(tgt)
    return one.join(back, tgt, "left_semi").select(src, tgt)


def articles_only(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    ok = ~F.col(src).rlike(NAMESPACE) & ~F.col(tgt).rlike(NAMESPACE) & ~F.col(tgt).rlike(TEMPLATE)
    return pairs.filter(ok & (F.trim(src) != "") & (F.trim(tgt) != ""))


def without_script(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.filter(~F.col(column).rlike(pattern))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return _pick(rows, keys, order, F.min)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _pick(rows, keys, order, F.max)


def _pick(rows: DataFrame, keys: list[str], order: str, f) -> DataFrame:
    # an aggregate with partial sums in place of a window: no key's rows meet in one task
    rest = [c for c in rows.columns if c not in (*keys, order)]
    g = rows.groupBy(*keys).agg(f(F.struct(order, *rest)).alias("_r"))
    return g.select(*keys, "_r.*").select(*rows.columns)


def in_all_languages(titles: DataFrame, key: str, lang: str, value: str, n_langs: int) -> DataFrame:
    """key and a map from language to value, for keys that have a value in each of the languages."""
    g = titles.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(lang, value)))).alias("by_lang"))
    return g.filter(F.size("by_lang") == n_langs)


def linked_titles(pages: DataFrame, links: DataFrame) -> DataFrame:
    """src, tgt: a page's title and its title in the other language; links without a page go."""
    return pages.select("page_id", F.col("title").alias("src")).join(links.select("page_id", F.col("title").alias("tgt")), "page_id").select("src", "tgt")


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left lookup; a miss gives the default."""
    out = rows.join(lookup.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def chained(rows: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left lookups one after the other: (table, key, value) each; a miss stays NULL to the end."""
    for lookup, key, value in steps:
        rows = rows.join(lookup.select(key, value), key, "left")
    return rows


def aligned(parallel: DataFrame, articles: DataFrame, n_langs: int) -> DataFrame:
    """Articles of the parallel ids that every language has: aligned_id, lang, wiki_pageid, title, text, id.

    ``articles``: lang, wiki_pageid, src (which file), title, text; of a page in several files the last wins.
    ``id`` is the dense number of the aligned row, from 0, with the language after it.
    """
    art = last_wins(articles, ["lang", "wiki_pageid"], "src")
    hit = parallel.join(art, ["lang", "wiki_pageid"])
    full = hit.groupBy("aligned_id").agg(F.countDistinct("lang").alias("_n")).filter(F.col("_n") == n_langs).select("aligned_id")
    number = dense_number(full, "aligned_id", "row_no")
    out = hit.join(number, "aligned_id")
    return out.withColumn("id", F.concat(F.col("row_no").cast("string"), "lang")).select("row_no", "aligned_id", "lang", "wiki_pageid", "title", "text", "id")


def alignment_check(corpus: DataFrame, n_rows: int = 100) -> DataFrame:
    """One row: whether all languages have equally many rows, and whether the first rows agree in aligned_id."""
    sizes = corpus.groupBy("lang").count().agg((F.min("count") == F.max("count")).alias("same_length"))
    head = corpus.filter(F.col("row_no") < n_rows).groupBy("row_no").agg(F.countDistinct("aligned_id").alias("n"))
    return sizes.join(F.broadcast(head.agg((F.coalesce(F.max("n"), F.lit(1)) == 1).alias("same_ids"))))  # one row each


def metadata(docs: DataFrame, language: Column | None = None, topic: Column | None = None, pair_id: Column | None = None) -> DataFrame:
    """doc_id, dataset_idx, token_length, language, topic, pair_id. ``docs``: id, dataset_idx, length, with the two special tokens."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("id").cast("string").alias("doc_id"), "dataset_idx", (F.col("length") - 2).alias("token_length"), F.coalesce(language if language is not None else none, F.lit("en")).alias("language"),
        F.coalesce(topic if topic is not None else none, F.lit("_NA")).alias("topic"), F.coalesce(pair_id if pair_id is not None else none, F.lit("_NA")).alias("pair_id"))


def length_summary(meta: DataFrame, by: str = "language", length: str = "token_length") -> DataFrame:
    """Number, mean, median, sample deviation, least and greatest length of each group; the median by selection."""
    x = F.col(length).cast("double")
    g = meta.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_len"), F.stddev_samp(x).alias("std_len"), F.min(x).alias("min_len"), F.max(x).alias("max_len"))
    middle = percentiles(meta, [by], length, {"median_len": 0.5}).withColumnRenamed(by, "_by")
    return g.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean_len", "median_len", "std_len", "min_len", "max_len")


def length_deviation(meta: DataFrame, idx: str = "dataset_idx", length: str = "token_length") -> DataFrame:
    """Mean absolute deviation of an instance's lengths across languages."""
    mean = F.avg(length).over(W.partitionBy(idx))
    return meta.withColumn("_d", F.abs(F.col(length) - mean)).groupBy(idx).agg(F.avg("_d").alias("mad"), F.count(F.lit(1)).alias("n_langs"))


def wide(meta: DataFrame, languages: list[str], idx: str = "dataset_idx", length: str = "token_length", lang: str = "language") -> DataFrame:
    return meta.groupBy(idx).pivot(lang, languages).agg(F.first(length))


def wide_filter(wide_rows: DataFrame, ranges: dict[str, tuple[int | None, int | None]], reference: str | None = None, tolerance: float | None = None, languages: list[str] = ()) -> DataFrame:
    """Rows within absolute bounds per language (None is open) and within a share of a reference language; all must hold."""
    ok = F.lit(True)
    for lang, (lo, hi) in ranges.items():
        ok = ok & (F.col(lang) >= lo if lo is not None else F.lit(True)) & (F.col(lang) <= hi if hi is not None else F.lit(True))
    for lang in languages if reference and tolerance is not None else ():
        if lang != reference:
            ok = ok & F.col(lang).between(F.col(reference) * (1 - tolerance), F.col(reference) * (1 + tolerance))
    return wide_rows.filter(ok)


def length_by_position(docs: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """Per position of documents of k segments: n, mean and population std of token lengths, 0 where there are none."""
    parts = docs.filter(F.size("segs") == k).select(F.posexplode("segs").alias("pos", "seg_id"))
    spine = docs.sparkSession.range(k).select(F.col("id").cast("int").alias("pos"))
    g = parts.join(meta.select("seg_id", "token_length"), "seg_id").groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.avg("token_length").alias("mean_len"), F.stddev_pop("token_length").alias("std_len"))
    return spine.join(g, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_len", F.lit(0.0)).alias("mean_len"), F.coalesce("std_len", F.lit(0.0)).alias("std_len"))
