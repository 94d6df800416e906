"""Which table a reader of embeddings gets: a manifest of stores, resolved by settings first and by name patterns then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of stores and what may be asked of them beside; a name has kind and choice, in this or the other order.
KINDS = {"standalone": ("mean", "cls"), "latechunking": ("segments", "cls", "mean")}


def store_name(kind: str, choice: str, model: str | None = None) -> str:
    """The name under which a store is written."""
    return "__".join([kind, choice, *([model.replace("/", "_")] if model else [])])


def settings_paths(settings: DataFrame, column: str = "value") -> DataFrame:
    """folder, entry, path of settings files (folder and their JSON text): the paths under ``embedding_paths``. A file that is no
    JSON, or has no such part, names none."""
    paths = F.from_json(column, "embedding_paths map<string,string>")["embedding_paths"]
    return settings.select("folder", F.explode(paths).alias("entry", "path")).filter("path is not null")


def manifest(files: DataFrame, suffix: str = ".parquet") -> DataFrame:
    """folder, name of the stores among files and folders (folder, file)."""
    return files.filter(F.col("file").endswith(suffix)).select("folder", F.expr(f"left(file, length(file) - {len(suffix)})").alias("name"))


def resolved(wanted: DataFrame, stores: DataFrame, named: DataFrame, suffix: str = ".parquet") -> DataFrame:
    """``wanted`` (folder, kind, choice; a null choice takes any) with path and rule: the path that the folder's settings name for
    ``kind_choice`` ("settings"), else that of the first store (folder, name) whose name fits the first pattern that any fits ("name"),
    the first in code-point order among several; null where there is none ("missing")."""
    entry = named.select(F.col("folder").alias("_f"), F.col("entry").alias("_e"), F.col("path").alias("_path"))
    asks = wanted.join(entry, (F.col("folder") == F.col("_f")) & (F.col("_e") == F.concat_ws("_", "kind", "choice")) & F.col("choice").isNotNull(), "left").drop("_f", "_e")
    kind, choice = F.col("kind"), F.col("choice")
    fits = F.when(choice.isNull(), F.array(F.concat(kind, F.lit("__")), F.concat(kind, F.lit("_"))))
    fits = fits.otherwise(F.array(F.concat(kind, F.lit("__"), choice), F.concat(kind, F.lit("_"), choice), F.concat(choice, F.lit("_"), kind)))
    place: Column = F.array_position(F.transform(fits, lambda p: F.contains(F.col("_name"), p)), True)
    # of a folder's stores the first that fits is a minimum, however many there are
    having = stores.select(F.col("folder").alias("_g"), F.col("name").alias("_name"))
    keys = ["folder", "kind", "choice"]
    best = wanted.select(*keys).distinct().join(having, F.col("folder") == F.col("_g")).withColumn("_p", place).filter("_p > 0")
    best = best.groupBy(*keys).agg(F.min(F.struct("_p", "_name")).alias("_best")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_best._name").alias("_found"))
    on = (F.col("folder") == F.col("_folder")) & (F.col("kind") == F.col("_kind")) & choice.eqNullSafe(F.col("_choice"))
    out = asks.join(best, on, "left").drop("_folder", "_kind", "_choice")
    by_name = F.concat(F.col("folder"), F.lit("/"), F.col("_found"), F.lit(suffix))
    rule = F.when(F.col("_path").isNotNull(), "settings").when(F.col("_found").isNotNull(), "name").otherwise("missing")
    return out.withColumns({"path": F.coalesce("_path", by_name), "rule": rule}).drop("_path", "_found")


def read_store(stores: DataFrame, named: DataFrame, folder: str, kind: str, choice: str | None = None) -> DataFrame:
    """The one store that is asked for; FileNotFoundError where there is none."""
    spark = stores.sparkSession
    row = resolved(spark.createDataFrame([(folder, kind, choice)], "folder string, kind string, choice string"), stores, named).first()
    if row["path"] is None:
        raise FileNotFoundError(f"no {kind} store{f' of {choice}' if choice else ''} in {folder}")
    return spark.read.parquet(row["path"])
