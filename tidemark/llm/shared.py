"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    # Python workers import this package; a driver that only put it on its own path has not told them.
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one of its own only where none is set and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Files of these tables have no second file with checksums where the folder is a local one (Parquet's pages have their own):
#: Hadoop starts a process, a child of the executor, to set the mode of each file and folder that it makes there.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no more than what reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes what ``written`` wrote; ``df`` must not be read any more."""
    if df is not None and (path := getattr(df, "_shared_path", None)):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
