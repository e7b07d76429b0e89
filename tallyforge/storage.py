"""Tables in the cluster's shared folder, for steps whose result is read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of this machine's only where the setting is absent and all runs here (tests).

    On a cluster executors would each write to their own disk and results would lack rows, so that's an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[(\d+|\*)(,\s*\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path there)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; it goes when the application ends.

    Whoever reads it again needn't plan and run what led to it, and a lost executor costs no more than reading.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
