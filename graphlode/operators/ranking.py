"""Candidates of two signals, fused and pooled to nodes, for all queries and all configurations at once."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlode.functions import text as tx
from graphlode.operators.bm25 import fixed_sum

CONFIG = "config_key string, lvl string, signal string, alpha double, rrf_k int, pool string, place int"


def candidates(vec: DataFrame, bm: DataFrame, lvl: str, cand_n: int = 200) -> DataFrame:
    """Full outer join of the two signals' candidates: qid, lvl, id, v_score, v_rank, b_score, b_rank, arrival (order of first appearance)."""
    v = vec.select("qid", "id", F.col("score").alias("v_score"), F.col("rank").alias("v_rank"))
    b = bm.select("qid", "id", F.col("score").alias("b_score"), F.col("rank").alias("b_rank"))
    both = v.join(b, ["qid", "id"], "full")
    return both.select("qid", F.lit(lvl).alias("lvl"), "id", "v_score", "v_rank", "b_score", "b_rank", F.coalesce("v_rank", F.lit(cand_n) + F.col("b_rank")).alias("arrival"))


def minmax(value: Column, over: Window) -> Column:
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.coalesce((value - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def expand_grid(levels=("doc",), signals=("vector", "bm25", "rrf"), pools=("max",), alphas=(0.5,), rrf_k: int = 60) -> list[tuple]:
    """Distinct configurations in grid order: documents need no pooling, only linear has an alpha."""
    out: dict[str, tuple] = {}
    for lvl, signal, pool in product(levels, signals, pools):
        pool = "max" if lvl == "doc" else pool
        for alpha in alphas if signal == "linear" else (0.5,):
            key = f"{lvl}/{signal}" + (f"@{alpha:g}" if signal == "linear" else "") + ("" if lvl == "doc" else f"/{pool}")
            out.setdefault(key, (key, lvl, signal, float(alpha), rrf_k, pool, len(out)))
    return list(out.values())


def rank(cand: DataFrame, configs: DataFrame, top_k: int = 100, digits: int = 6, node: Column | None = None) -> DataFrame:
    """qid, config_key, node, score, rank. configs is a grid: a few rows from the driver, broadcast. Scores are rounded after they are ranked."""
    w = Window.partitionBy("qid", "lvl")
    c = cand.withColumn("nv", minmax(F.col("v_score"), w)).withColumn("nb", minmax(F.col("b_score"), w))
    c = c.withColumn("node", tx.node_of_item(F.col("lvl"), F.col("id")) if node is None else node)
    c = c.join(F.broadcast(configs), "lvl")
    rrf = F.coalesce(1.0 / (F.col("rrf_k") + F.col("v_rank")), F.lit(0.0)) + F.coalesce(1.0 / (F.col("rrf_k") + F.col("b_rank")), F.lit(0.0))
    score = F.when(F.col("signal") == "vector", F.col("v_score")).when(F.col("signal") == "bm25", F.col("b_score")).when(F.col("signal") == "linear", F.col("alpha") * F.col("nv") + (1 - F.col("alpha")) * F.col("nb")).otherwise(rrf)
    scored = c.withColumn("score", score).where("score IS NOT NULL")
    total = fixed_sum(F.col("score"))
    pooled = scored.groupBy("qid", "config_key", "pool", "node").agg(F.max("score").alias("mx"), total.alias("sm"), F.count("*").alias("n"), F.min("arrival").alias("arrival"))
    value = F.when(F.col("pool") == "mean", F.col("sm") / F.col("n")).when(F.col("pool") == "sum", F.col("sm")).otherwise(F.col("mx"))
    order = Window.partitionBy("qid", "config_key").orderBy(F.desc("score"), "arrival", "node")
    best = pooled.withColumn("score", value).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return best.select("qid", "config_key", "node", F.round("score", digits).alias("score"), "rank")
