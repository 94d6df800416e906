"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset a local master gets /tmp/checkpoints (tests); on a
    cluster that would be another folder on each machine, so there it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/evenspan/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table of its own and read again: what made it isn't run a second time."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables behind saved frames that nothing reads any more."""
    for f in frames:
        if path := getattr(f, "_saved", None):
            spark = f.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            f._saved = None
