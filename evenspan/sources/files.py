"""Scans and sinks: text folders, delimited files, title files, SQL dumps, metadata, embeddings, indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.titles import unescape_sql

SEP = "|||"


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """id (file name without ending), text (stripped) and folder of each ``*.txt``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return files.select(F.url_decode(name).alias("id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"), folder.alias("folder"))


def csv_documents(spark: SparkSession, path: str, id_column: str = "id", text_column: str = "text", nulls: str | None = None) -> DataFrame:
    """id and text as strings; missing values stay NULL, or become ``nulls``."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := {id_column, text_column} - set(rows.columns):
        raise ValueError(f"no column {sorted(missing)}")
    out = rows.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    return out if nulls is None else out.fillna(nulls)


def json_lines(spark: SparkSession, path: str, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """id, text, ok of each line that isn't blank; ``ok`` is false for a malformed line or a missing column."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = lines.select("value", F.from_json("value", "map<string,string>").alias("m"))
    # a map keeps other columns from mattering; numbers become text
    got = row.select(F.element_at("m", id_column).alias("id"), F.element_at("m", text_column).alias("text"))
    return got.withColumn("ok", F.col("id").isNotNull() & F.col("text").isNotNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0) and line of one file, without gathering it in one task.

    Lines are numbered within each split; the splits' first numbers come from their counts.
    """
    raw = spark.read.text(path).select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    first = {r["part"]: r["n"] for r in raw.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per split
    starts, total = [], 0
    for part in sorted(first):
        starts.append((part, total))
        total += first[part]
    if not starts:
        return raw.select(F.lit(0).cast("long").alias("line_no"), F.col("value").alias("line"))
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, first long"))
    return raw.join(offsets, "part").select((F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("line_no"), F.col("value").alias("line"))


def title_pairs(lines: DataFrame, strict: bool = False) -> DataFrame:
    """line_no, src, tgt of ``src ||| tgt`` lines. Split at the first separator, or (strict) only lines with exactly one."""
    parts = F.split("line", r"\|\|\|", -1) if strict else F.split("line", r"\|\|\|", 2)
    p = lines.withColumn("p", parts).filter(F.size("p") == 2)
    return p.select("line_no", F.trim(F.get("p", F.lit(0))).alias("src"), F.trim(F.get("p", F.lit(1))).alias("tgt"))


def language_table(lines: DataFrame, wanted: list[str] | None = None, strict: bool = True) -> DataFrame:
    """line_no (data lines from 1), lang, value of a file whose first line names the languages.

    A row needs as many cells as there are languages; with ``wanted`` only those languages, which must not be empty.
    """
    head = lines.filter("line_no = 0").select(F.transform(F.split("line", r"\|\|\|", -1), lambda x: F.trim(x)).alias("langs"))
    p = lines.filter("line_no > 0").select("line_no", F.transform(F.split("line", r"\|\|\|", -1), lambda x: F.trim(x)).alias("cells")).join(F.broadcast(head))  # one row
    if strict:
        p = p.filter(F.size("cells") == F.size("langs"))
    out = p.select("line_no", F.inline(F.arrays_zip(F.col("langs").alias("lang"), F.col("cells").alias("value"))))
    if wanted is None:
        return out
    w = W.partitionBy("line_no")
    out = out.filter(F.col("lang").isin(wanted) & (F.coalesce("value", F.lit("")) != ""))
    return out.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == len(wanted)).drop("_n")


def ids_with_titles(ids: DataFrame, titles: DataFrame) -> DataFrame:
    """line_no, lang, article_id, title of lines on which every id is a number and every title is there.

    Columns are matched by language, whatever order the two files have them in.
    """
    both = ids.select("line_no", "lang", F.col("value").alias("_id")).join(titles.select("line_no", "lang", F.col("value").alias("title")), ["line_no", "lang"], "full")
    both = both.withColumn("article_id", F.expr("try_cast(nullif(trim(_id), '') as bigint)"))
    bad = F.max((F.col("article_id").isNull() | (F.coalesce("title", F.lit("")) == "")).cast("int")).over(W.partitionBy("line_no"))
    return both.withColumn("_bad", bad).filter("_bad = 0").select("line_no", "lang", "article_id", "title")


def parallel_ids(table: DataFrame) -> DataFrame:
    """aligned_id (data line from 1), lang, wiki_pageid of lines all of whose cells are numbers."""
    t = table.withColumn("wiki_pageid", F.expr("try_cast(nullif(trim(value), '') as bigint)"))
    bad = F.max(F.col("wiki_pageid").isNull().cast("int")).over(W.partitionBy("line_no"))
    return t.withColumn("_bad", bad).filter("_bad = 0").select(F.col("line_no").alias("aligned_id"), "lang", "wiki_pageid")


#: What stands in quotes; runs without a backslash are taken at once, as the matcher keeps a frame for each turn.
_QUOTED = r"'([^'\\]*+(?:\\.[^'\\]*+)*)'"
PAGE = rf"\((\d+),(-?\d+),{_QUOTED}"
LINK = rf"\((\d+),{_QUOTED},{_QUOTED}\)"


def dump_pages(lines: DataFrame, column: str = "value") -> DataFrame:
    """page_id, title of the tuples in a page dump (namespace 0)."""
    t = lines.select(F.explode(F.regexp_extract_all(column, F.lit(f"({PAGE})"), F.lit(1))).alias("t"))
    got = t.select(F.regexp_extract("t", PAGE, 1).cast("long").alias("page_id"), F.regexp_extract("t", PAGE, 2).alias("ns"), unescape_sql(F.regexp_extract("t", PAGE, 3)).alias("title"))
    return got.filter("ns = '0'").select("page_id", "title")


def dump_langlinks(lines: DataFrame, lang: str, column: str = "value") -> DataFrame:
    """page_id, title of the links to one language; links without a title go."""
    t = lines.select(F.explode(F.regexp_extract_all(column, F.lit(f"({LINK})"), F.lit(1))).alias("t"))
    got = t.select(F.regexp_extract("t", LINK, 1).cast("long").alias("page_id"), F.regexp_extract("t", LINK, 2).alias("lang"), unescape_sql(F.regexp_extract("t", LINK, 3)).alias("title"))
    return got.filter((F.col("lang") == lang) & (F.col("title") != "")).select("page_id", "title")


def metadata_map(texts: DataFrame, column: str = "value") -> DataFrame:
    """doc_id, dataset_idx, token_length, language, topic, pair_id of JSON maps from id to metadata."""
    kind = "map<string,struct<dataset_idx:int,token_length:int,language:string,topic:string,pair_id:string>>"
    return texts.select(F.explode(F.from_json(column, kind)).alias("doc_id", "m")).select("doc_id", "m.*")


def indices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_no, segs) and (idx) of an indices file."""
    row = spark.read.schema("concat_indices array<array<int>>, standalone_indices array<int>").json(path, multiLine=True)
    return row.select(F.posexplode("concat_indices").alias("doc_no", "segs")), row.select(F.explode("standalone_indices").alias("idx"))


def article_text(paragraphs: DataFrame) -> DataFrame:
    """wiki_id, text: the paragraphs of an article in order, joined by line breaks."""
    return paragraphs.groupBy("wiki_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))), lambda x: x["text"]), "\n").alias("text"))


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """The table as Parquet in folders by the given columns, one file per folder and task."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def delimited(df: DataFrame, columns: list[str], sep: str = f" {SEP} ") -> DataFrame:
    """One text column of the given ones, NULL as nothing."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


def write_lines(df: DataFrame, path: str, columns: list[str], header: bool = False) -> None:
    lines = delimited(df, columns)
    if header:
        lines = df.sparkSession.createDataFrame([(f" {SEP} ".join(columns),)], "value string").unionByName(lines)
    lines.write.text(path)


def metadata_json(meta: DataFrame) -> DataFrame:
    """One JSON object per row from the id to its metadata, to be written as lines."""
    rest = [c for c in meta.columns if c != "doc_id"]
    return meta.select(F.to_json(F.create_map("doc_id", F.struct(*rest))).alias("value"))


def sampled(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in an order that the key and the seed alone give."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def run_catalog(names: DataFrame, root: str, languages: list[str]) -> DataFrame:
    """name, model, languages, concat_size, kind, place of run folders (a ``name`` column) under a prefix.

    Runs of one language come in the order of the given list, then others by name; pairs in the order of the
    list for the first, then for the second language.
    """
    pattern = r"^(.+?)__([a-z]{2}(?:_[a-z]{2})?)__concat-size_(\d+)"
    r = names.filter(F.col("name").startswith(root) & F.col("name").contains("__concat-size"))
    r = r.select("name", F.regexp_extract("name", pattern, 1).alias("model"), F.regexp_extract("name", pattern, 2).alias("lang_key"), F.regexp_extract("name", pattern, 3).cast("int").alias("concat_size"))
    order = F.array(*map(F.lit, languages))
    place = lambda c: F.when(F.array_contains(order, c), F.array_position(order, c).cast("int")).otherwise(len(languages) + 1)
    a, b = F.get(F.split("lang_key", "_"), F.lit(0)), F.get(F.split("lang_key", "_"), F.lit(1))
    return r.withColumn("kind", F.when(F.col("lang_key").contains("_"), "multi").otherwise("mono")).withColumn("place_a", place(a)).withColumn("place_b", F.when(b.isNotNull(), place(b)).otherwise(0))


def embeddings_where(store: DataFrame, run: str, pooling: str, kind: str) -> DataFrame:
    """Rows of an embedding store; on a table partitioned by these columns only their folders are read."""
    return store.filter((F.col("run") == run) & (F.col("pooling") == pooling) & (F.col("kind") == kind))


def unioned(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)

