"""Exact vector search: score, top k on narrow rows, then the attributes of the winners."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlode.functions.vector import dot
from graphlode.operators import blocks
from graphlode.operators.bm25 import BROADCAST_BYTES, len_and_mb

#: Up to so many queries are broadcast. MB of a block of vectors, as rows of the JVM.
FEW, BLOCK_MB = 16, 16


def search(vectors: DataFrame, query: Column, k: int, where: Column | None = None, digits: int | None = 6) -> DataFrame:
    """id, row_idx, score of the k nearest rows; predicates come first, ties go to the earlier row. Scores are rounded after they are ranked."""
    rows = vectors if where is None else vectors.where(where)
    best = rows.select("id", "row_idx", dot(F.col("embedding"), query).alias("score")).orderBy(F.desc("score"), "row_idx").limit(k)
    return best if digits is None else best.withColumn("score", F.round("score", digits))


def search_many(vectors: DataFrame, queries: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """qid, id, row_idx, score, rank of the k nearest rows of each query(qid, qvec). A few queries are broadcast; of more both sides are parted in blocks, each pair of which gives its k best."""
    rows, asked = vectors.select("id", "row_idx", "embedding"), queries.select("qid", "qvec")
    n_asked, asked_mb = len_and_mb(asked)
    if n_asked <= FEW and asked_mb * 1e6 <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(asked), F.lit(True))
        scored = met.select("qid", "id", "row_idx", dot(F.col("embedding"), F.col("qvec")).alias("score"))
    else:
        n_rows, rows_mb = len_and_mb(rows)
        n = blocks.grid(n_rows, n_asked, rows_mb, asked_mb, n_asked * k * 40 / 1e6, (BLOCK_MB, BLOCK_MB), blocks.parallel(vectors.sparkSession))
        kinds = {f.name: f.dataType for f in [*rows.schema.fields, *asked.schema.fields]}
        schema = T.StructType([*(T.StructField(c, kinds[c]) for c in ("qid", "id", "row_idx")), T.StructField("score", T.DoubleType())])
        scored = blocks.met(rows, asked, ("row_idx", "qid"), n).mapInArrow(lambda batches: blocks.nearest(batches, k), schema)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "row_idx")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best if digits is None else best.withColumn("score", F.round("score", digits))


def similar(vectors: DataFrame, items: DataFrame, node: str, k: int = 8, cross_tier: bool = False, product: str | None = None) -> DataFrame:
    """The k nearest items of a node (not itself), of its tier unless cross_tier; ValueError if it has no vector."""
    own = vectors.join(items.select("id", "tier", "product"), "id")
    one = own.where(F.col("id") == node).select(F.col("embedding").alias("qvec"), F.col("tier").alias("qtier")).limit(1)
    if one.isEmpty():
        raise ValueError(f"no vector for {node!r}")
    rows = own.where(F.col("id") != node)
    if product:
        rows = rows.where(F.col("product") == product)
    rows = rows.crossJoin(F.broadcast(one))  # one row
    if not cross_tier:
        rows = rows.where(F.col("qtier").isNull() | (F.col("qtier") == "") | F.col("tier").eqNullSafe(F.col("qtier")))
    best = rows.select("id", "row_idx", dot(F.col("embedding"), F.col("qvec")).alias("score")).orderBy(F.desc("score"), "row_idx").limit(k)
    return best.withColumn("score", F.round("score", 6))


def similar_pairs(vectors: DataFrame, threshold: float, blocks: int | None = None, digits: int | None = 6) -> DataFrame:
    """a, b, score for all pairs a < b (by row_idx) with score at the threshold or above.

    Rows fall into blocks; each pair of blocks is one task, so the work is spread evenly, no side is broadcast, and a row is
    copied as often as there are blocks (by default as many as keep a block small and give every partition of a shuffle some pairs)."""
    near = paired(vectors, threshold, blocks, False)
    return near if digits is None else near.withColumn("score", F.round("score", digits))


def similar_forest(vectors: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """a, b of as many of similar_pairs() as keep connected what they connect: of each pair of blocks less than a pair a row."""
    return paired(vectors, threshold, blocks, True)


def paired(vectors: DataFrame, threshold: float, n: int | None, forest: bool) -> DataFrame:
    v = vectors.select("row_idx", "embedding")
    if n is None:
        n_rows, mb = len_and_mb(v)
        n = max(math.ceil(mb / BLOCK_MB), min(math.isqrt(2 * blocks.parallel(vectors.sparkSession)), n_rows // 64), 1)
    # of the blocks i <= j the pair is one task
    v = v.withColumn("blk", blocks.block("row_idx", n)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i, j = F.least("blk", "other"), F.greatest("blk", "other")
    placed = v.withColumn("at_", (i * n - F.floor(i * (i - 1) / 2) + j - i).cast("int")).drop("other").repartitionById(n * (n + 1) // 2, F.col("at_")).drop("at_")
    kind = v.schema["row_idx"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *([] if forest else [T.StructField("score", T.DoubleType())])])
    return placed.mapInArrow(lambda batches: blocks.pairs(batches, threshold, forest), schema)
