"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share; a new local one only where none is set and there is one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
        where = tempfile.mkdtemp(prefix="graphlode-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/graphlode/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table under spark.checkpoint.dir: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application stored. Results that aren't saved yet can't be read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
