"""Retrieval metrics of ranked nodes against golds, their means, and group-resampled intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlode.config import METRICS
from graphlode.functions import rng


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def per_query(ranked: DataFrame, labels: DataFrame, configs: DataFrame, digits: int = 6, golds: DataFrame | None = None) -> DataFrame:
    """qid, config_key, grp, product, field and the metrics; a query without any hit has zeros.

    Labels have their own golds, or, where many queries share them, a gold_key and n_gold, and golds(gold_key, node) has them once."""
    if golds is None:
        met = ranked.join(labels.select("qid", F.explode(F.array_distinct("golds")).alias("node")), ["qid", "node"])
        n_gold = F.size(F.array_distinct("golds"))
    else:
        met = ranked.join(labels.select("qid", "gold_key"), "qid").join(golds, ["gold_key", "node"])
        n_gold = F.col("n_gold")
    hits = met.groupBy("qid", "config_key").agg(
        F.min("rank").alias("first"), F.sum((F.col("rank") <= 10).cast("int")).alias("in10"), F.sum(F.when(F.col("rank") <= 10, _discount(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    every = labels.select("qid", "grp", "product", "field", n_gold.alias("n_gold"), "seq").join(F.broadcast(configs.select("config_key")), F.lit(True))
    m = every.join(hits, ["qid", "config_key"], "left")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least("n_gold", F.lit(10)), F.lit(1))), lambda i: _discount(i)), F.lit(0.0), lambda s, x: s + x)

    def hit(k: int) -> Column:
        return F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"hit{k}")

    some = F.greatest(F.col("n_gold"), F.lit(1))
    return m.select("qid", "config_key", "grp", "product", "field", "seq", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), digits).alias("mrr"), hit(1), hit(5), hit(10),
                    F.round(F.coalesce(F.col("in10") / some, F.lit(0.0)), digits).alias("recall10"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), digits).alias("ndcg10"))


def means(rows: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in METRICS])


def macro(rows: DataFrame, digits: int = 6) -> DataFrame:
    """config_key and the unweighted mean over products of each metric's mean."""
    per = rows.groupBy("config_key", "product").agg(*[F.avg(m).alias(m) for m in METRICS])
    return per.groupBy("config_key").agg(*[F.round(F.avg(m), digits).alias(m) for m in METRICS])


def bootstrap(rows: DataFrame, metric: str, n: int = 500, seed: int = 7, ci: float = 0.95, digits: int = 6) -> DataFrame:
    """config_key, mean, lo, hi, n of a metric, whole groups being drawn with replacement.

    Draw b * G + s + 1 of the generator picks the s-th group of resample b, so all draws are rows of a range: no order, no loop."""
    return bootstraps(rows, [metric], n, seed, ci, digits).drop("metric")


def bootstraps(rows: DataFrame, names: list[str], n: int = 500, seed: int = 7, ci: float = 0.95, digits: int = 6) -> DataFrame:
    """config_key, metric, mean, lo, hi, n of all named metrics: the same draws serve them all, in one pass."""
    whole = rows.groupBy("config_key").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in names])
    groups = rows.groupBy("config_key", "grp").agg(F.count("*").alias("cnt"), F.min("seq").alias("first"), *[F.sum(m).alias(m) for m in names])
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("config_key").orderBy("first", "grp")) - 1)
    sizes = groups.groupBy("config_key").agg(F.count("*").alias("g"))
    spots = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("s", F.explode(F.sequence(F.lit(0), (F.col("g") - 1).cast("int"))))
    drawn = spots.withColumn("at", F.floor(rng.draw(F.lit(seed), F.col("b") * F.col("g") + F.col("s") + 1) * F.col("g")).cast("int"))
    share = [(F.sum(m) / F.greatest(F.sum("cnt"), F.lit(1))).alias(m) for m in names]
    resampled = drawn.join(groups, ["config_key", "at"]).groupBy("config_key", "b").agg(*share)
    ordered = resampled.groupBy("config_key").agg(*[F.array_sort(F.collect_list(m)).alias(f"all_{m}") for m in names])  # n values for each configuration
    lo, hi = int((1 - ci) / 2 * n + 1e-9), min(n - 1, int((1 + ci) / 2 * n + 1e-9))
    each = [F.struct(F.lit(m).alias("metric"), F.round(m, digits).alias("mean"), F.round(F.col(f"all_{m}")[lo], digits).alias("lo"), F.round(F.col(f"all_{m}")[hi], digits).alias("hi")) for m in names]
    return whole.join(ordered, "config_key").select("config_key", F.explode(F.array(*each)).alias("e"), "n").select("config_key", "e.*", "n")
