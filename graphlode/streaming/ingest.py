"""Streaming ingest: new Markdown files become items as they arrive. Corpus statistics stay a batch job over the items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlode.operators import ingest
from graphlode.sources import markdown
from graphlode.sources.files import wanted


def stream_items(spark: SparkSession, root: str, products: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Items of files that arrive below root, by level; each micro-batch replaces its own folder, so a retried batch writes no row twice."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).schema("value string").load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    named = raw.select(F.substring_index(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*(?=/)", ""), base, -1).alias("path"), F.col("value").alias("content"))

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.where(wanted(F.col("path"))).withColumn("seq", F.xxhash64("path"))
        docs = ingest.classify(markdown.parsed(rows), products)
        ingest.items(docs).write.mode("overwrite").partitionBy("lvl").parquet(f"{out.rstrip('/')}/batch={epoch}")

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
