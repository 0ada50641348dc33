"""Evaluation of one configuration and tuning over a grid: one plan for all configurations, queries and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlode.config import METRICS
from graphlode.operators import metrics, ranking, splits
from graphlode.operators.tables import stored


def evaluate(cand: DataFrame, labels: DataFrame, configs: DataFrame, node=None, golds: DataFrame | None = None) -> dict[str, DataFrame]:
    """overall (each metric with its interval), macro, by_product and by_field (best or most first). golds as in metrics.per_query()."""
    rows = stored(metrics.per_query(ranking.rank(cand, configs, node=node), labels, configs, digits=12, golds=golds), "measured")
    return {"overall": metrics.bootstraps(rows, list(METRICS)), "macro": metrics.macro(rows), "by_product": metrics.means(rows, "config_key", "product").orderBy("config_key", F.desc("mrr"), "product"),
            "by_field": metrics.means(rows, "config_key", "field").orderBy("config_key", F.desc("n"), "field"), "rows": rows}


def leaderboard(rows: DataFrame, folds: DataFrame, configs: DataFrame, metric: str = "mrr", digits: int = 6) -> DataFrame:
    """config_key, metric (unweighted mean over folds), std (sample, 0 below two), rank; ties in grid order. An empty fold counts as 0."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: one of {METRICS}")
    names = folds.select("fold").distinct()
    every = names.join(F.broadcast(configs.select("config_key", "place")), F.lit(True))  # a grid of a few rows
    got = rows.join(folds.select("qid", "fold").where("qid IS NOT NULL"), "qid").groupBy("config_key", "fold").agg(F.avg(metric).alias("v"))
    m = every.join(got, ["config_key", "fold"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    out = m.groupBy("config_key", "place").agg(F.round(F.avg("v"), digits).alias("metric"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), digits).alias("std"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("metric"), "place"))).drop("place")  # a row for each configuration


def tune(cand: DataFrame, labels: DataFrame, configs: DataFrame, metric: str = "mrr", cv: int = 5, holdout: float = 0, lopo: bool = False, final_holdout: float = 0, stratify: str = "product", seed: int = 1, golds: DataFrame | None = None) -> dict:
    """The leaderboard over folds (leave one product out, else a holdout, else k-fold), and the winner on a final holdout that took no part."""
    pool, final = labels, None
    if final_holdout > 0:
        parts = splits.holdout(labels, final_holdout, stratify, seed)
        final = labels.join(parts.where("is_test").select("grp"), "grp", "left_semi")
        pool = labels.join(parts.where("NOT is_test").select("grp"), "grp", "left_semi")
    if lopo:
        folds, scheme = pool.select("qid", F.col(stratify).alias("fold")), f"leave one {stratify} out"
    elif holdout > 0:
        folds, scheme = pool.join(splits.holdout(pool, holdout, stratify, seed).where("is_test").select("grp"), "grp", "left_semi").select("qid", F.lit("holdout").alias("fold")), f"grouped holdout of {holdout:g}"
    else:
        every = pool.sparkSession.range(cv).select(F.lit(None).cast(pool.schema["qid"].dataType).alias("qid"), F.col("id").cast("string").alias("fold"))
        folds, scheme = pool.join(splits.kfold(pool, cv, stratify, seed), "grp").select("qid", F.col("fold").cast("string").alias("fold")).unionByName(every), f"{cv}-fold grouped"
    rows = stored(metrics.per_query(ranking.rank(cand, configs), pool, configs, digits=12, golds=golds), "measured")
    board = leaderboard(rows, folds, configs, metric)
    report = None
    if final is not None:
        best = board.orderBy("rank").first()["config_key"]
        report = {"key": best} | evaluate(cand, final, configs.where(F.col("config_key") == best), golds=golds)
    return {"leaderboard": board, "scheme": scheme, "final": report}
