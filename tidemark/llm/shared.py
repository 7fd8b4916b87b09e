"""Small helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import cut, shared_folder

__all__ = ["LOWER", "UPPER", "WHITE", "cut", "drop", "shared_folder", "table", "utf8"]

#: What `[\x20\x09-\x0D]` matches: the white space of every contract here.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def drop(spark: SparkSession, folder: str) -> None:
    """Remove a folder of ours and all in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col) -> F.Column:
    """A text as bytes, null as empty: what byte-level Python code in tasks takes."""
    return F.coalesce(col.cast("binary"), F.lit(b""))
