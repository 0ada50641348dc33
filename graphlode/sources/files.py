"""Sources and sinks: Markdown trees, the product dimension, and the tables' own formats."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode import schemas
from graphlode.config import SKIP_DIRS, SKIP_FILES


def wanted(path: Column) -> Column:
    """Whether a relative path is a Markdown file outside the skipped folders and not a skipped file."""
    parts = F.split(path, r"[\\/]")
    outside = ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIP_DIRS)))
    return path.rlike(r"(?i)\.(md|mdx)\z") & outside & ~F.element_at(parts, -1).isin(*SKIP_FILES)


def markdown_tree(spark: SparkSession, root: str, products: list[str] | None = None, limit: int = 0) -> DataFrame:
    """path (relative), parts, content, seq of the Markdown files below root, in order of path; skipped folders and unreadable files left out."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    full = F.regexp_replace(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), r"^file:/*(?=/)", "")
    files = raw.select(F.substring_index(full, base, -1).alias("path"), F.col("value").alias("content"))
    parts = F.split("path", r"[\\/]")
    files = files.where(wanted(F.col("path"))).withColumn("parts", parts)
    if products:
        top = F.lower(F.when(F.col("parts")[0] == "kb", F.get("parts", F.lit(1))).otherwise(F.col("parts")[0]))
        files = files.where(F.coalesce(top, F.lit("")).isin(*[p.lower() for p in products]))
    if limit:
        files = files.orderBy("path").limit(limit)
    return files.select("path", "parts", "content", F.xxhash64("path").alias("seq"))


def products(spark: SparkSession, path: str) -> DataFrame:
    """The product dimension with its defaults, from JSON (an array or one object a line)."""
    p = spark.read.schema(schemas.PRODUCTS_JSON).option("multiLine", True).json(path)
    return with_defaults(p)


def with_defaults(p: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<version:string,label:string,isLatest:boolean,kbSource:string>>")
    v = F.coalesce("versions", none)
    latest = F.coalesce(F.get(F.filter(v, lambda x: x["isLatest"]), F.lit(0)), F.get(F.filter(v, lambda x: x["version"] == F.col("defaultVersion")), F.lit(0)), F.get(v, F.lit(0)))
    full = F.transform(v, lambda x: F.struct(x["version"].alias("version"), F.coalesce(F.nullif(x["label"], F.lit("")), x["version"]).alias("label"), F.coalesce(x["isLatest"], F.lit(False)).alias("is_latest"), x["kbSource"].alias("kb_source")))
    return p.select(
        "id", "name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce(F.nullif("path", F.lit("")), F.concat(F.lit("docs/"), "id")).alias("path"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.coalesce(F.nullif("defaultVersion", F.lit("")), latest["version"], F.lit("current")).alias("default_version"),
        F.coalesce(latest["version"], F.lit("current")).alias("latest_version"), full.alias("versions"),
    )


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, attrs, seq) and edges of one JSON document {nodes, edges: [[from, to, rel]]}."""
    raw = spark.read.schema("nodes array<map<string,string>>, edges array<array<string>>").option("multiLine", True).json(path)
    n = raw.select(F.posexplode("nodes").alias("seq", "n"))
    nodes = n.select(F.col("n")["id"].alias("id"), F.col("n")["type"].alias("type"), F.map_filter("n", lambda k, v: ~k.isin("id", "type")).alias("attrs"), F.col("seq").cast("bigint"))
    e = raw.select(F.posexplode("edges").alias("seq", "e"))
    return nodes, e.select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"), F.col("e")[2].alias("rel"), F.col("seq").cast("bigint"))


def items_jsonl(spark: SparkSession, path: str, lvl: str) -> DataFrame:
    """An item corpus of one record a line; row_idx is the order of lines within a file."""
    raw = spark.read.schema("id string, type string, docId string, tier string, product string, version string, label string, title string, ref string, url string, headingPath array<string>, text string").json(path)
    cols = [F.lit(lvl).alias("lvl"), "id", "type", F.col("docId").alias("doc_id"), "tier", "product", "version", "label", "title", "ref", "url", F.col("headingPath").alias("heading_path"), "text"]
    return raw.withColumn("row_idx", F.monotonically_increasing_id()).select(*cols, "row_idx")


def packed_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """row_idx, embedding of a file of packed little-endian floats; its length must be a multiple of a vector's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                v = np.frombuffer(content, "<f4")
                if len(v) % dim:
                    raise ValueError(f"{len(v)} floats aren't vectors of {dim}")
                yield pd.DataFrame({"row_idx": range(len(v) // dim), "embedding": list(v.reshape(-1, dim))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_idx bigint, embedding array<float>")


def labels_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("qid string, query string, field string, golds array<string>, group string, product string, targetTier string").json(path)
    out = raw.select("qid", "query", "field", "golds", F.col("group").alias("grp"), "product", F.col("targetTier").alias("target_tier"), F.monotonically_increasing_id().alias("seq"))
    twice = out.groupBy("qid").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"qid {twice[0]['qid']!r} occurs more than once")
    return out


def save_labels(labels: DataFrame, path: str) -> None:
    labels.select("qid", "query", "field", "golds", F.col("grp").alias("group"), "product", F.col("target_tier").alias("targetTier")).write.mode("overwrite").json(path)


def save(df: DataFrame, base: str, name: str, by_level: bool = False) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy("lvl") if by_level else w).parquet(f"{base.rstrip('/')}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    path = f"{base.rstrip('/')}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: build it first")
    return spark.read.parquet(path)


def save_text(spark: SparkSession, base: str, name: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base.rstrip('/')}/{name}")


def load_text(spark: SparkSession, base: str, name: str) -> dict:
    path = f"{base.rstrip('/')}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: build it first")
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
