"""Written tables that end a lineage: they outlive executors, unlike cached blocks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir (a temporary one only under a local master), which goes with the application."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/table-{uuid.uuid4().hex}"


def goes_at_exit(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of a new folder."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    goes_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
