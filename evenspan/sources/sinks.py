"""Sinks beyond plain tables: settings of a run, aligned corpora behind a check, attention results, lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import alignment_check


def write_settings(spark: SparkSession, path: str, given: dict[str, object], effective: dict[str, object]) -> DataFrame:
    """One row of JSON: the settings given, over which go those that took effect; what was written, read again."""
    row = given | effective
    schema = ", ".join(f"`{k}` {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items())
    spark.createDataFrame([tuple(row.values())], schema).write.json(path)
    return spark.read.schema(schema).json(path)


def write_settings_of(rows: DataFrame, path: str, key: str) -> DataFrame:
    """The same for many runs: rows of a key and two structs, given and effective. What took effect goes over what was given where it
    isn't null; a line of JSON for each run, read again."""
    given, effective = (rows.schema[c].dataType for c in ("given", "effective"))
    names = list(dict.fromkeys([*given.names, *effective.names]))
    sides = {n: [F.col(f"{c}.`{n}`") for c, kind in (("effective", effective), ("given", given)) if n in kind.names] for n in names}
    merged = rows.select(key, *[F.coalesce(*cols).alias(n) for n, cols in sides.items()])
    merged.write.json(path)
    return rows.sparkSession.read.schema(merged.schema).json(path)


def write_aligned(corpus: DataFrame, path: str) -> bool:
    """A corpus (row_no, aligned_id, lang, ...) as a folder for each language, if the languages have equally many rows
    and agree in their first ones. Whether it was written."""
    ok = bool(corpus.limit(1).count()) and all(alignment_check(corpus).first())
    if ok:
        corpus.write.partitionBy("lang").parquet(path)
    return ok


def attention_name(model: Column, basket: Column, bins: Column, first_row_only: Column, layers: Column) -> Column:
    """The name of an attention result, which tells its options."""
    return F.concat_ws("__", F.regexp_replace(model, "[^A-Za-z0-9.-]+", "_"), F.concat(F.lit("basket-"), basket), F.concat(F.lit("bins-"), bins),
                       F.when(first_row_only, F.lit("cls-row")).otherwise(F.lit("all-rows")), F.concat(F.lit("layers-"), layers))


def write_attention(parts: dict[str, DataFrame], path: str, name: str) -> None:
    """Results of one analysis as JSON, a folder for each part under the name."""
    for part, frame in parts.items():
        frame.write.json(f"{path}/{name}/part={part}")


def read_attention(spark: SparkSession, path: str, name: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{name}/part={part}")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
