"""Grouped, stratified splits of labels. A group never crosses a split; its stratum is that of its first row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlode.functions import rng


def shuffled_groups(labels: DataFrame, stratify: Column | str | None = "product", seed: int = 1) -> DataFrame:
    """grp, stratum, pos (place in its stratum's shuffled order), n (groups in it). A stratum's distinct groups meet in one task, as the shuffle is sequential."""
    stratum = F.lit("_") if stratify is None else F.coalesce(F.col(stratify) if isinstance(stratify, str) else stratify, F.lit(""))
    groups = labels.groupBy("grp").agg(F.min_by(stratum, "seq").alias("stratum"), F.min("seq").alias("first"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "grp"], ignore_index=True)
        order = rng.shuffled(len(pdf), seed ^ rng.fnv1a_py(pdf["stratum"][0]))
        out = pdf.iloc[order].reset_index(drop=True)
        return pd.DataFrame({"grp": out["grp"], "stratum": out["stratum"], "pos": range(len(out)), "n": len(out)})

    return groups.groupBy("stratum").applyInPandas(one, "grp string, stratum string, pos int, n int")


def kfold(labels: DataFrame, k: int = 5, stratify: str | None = "product", seed: int = 1) -> DataFrame:
    """grp, fold (0 to k - 1): round robin in each stratum."""
    return shuffled_groups(labels, stratify, seed).select("grp", "stratum", (F.col("pos") % k).alias("fold"))


def holdout(labels: DataFrame, frac: float = 0.3, stratify: str | None = "product", seed: int = 1) -> DataFrame:
    """grp, is_test: of each stratum at least one group, else the rounded share."""
    most = F.greatest(F.lit(1), F.floor(F.col("n") * frac + 0.5))
    return shuffled_groups(labels, stratify, seed).select("grp", "stratum", (F.col("pos") < most).alias("is_test"))


def leave_one_out(labels: DataFrame, by: str = "product") -> DataFrame:
    """name, qid, is_test: a fold for each value, in order; the rest of the labels trains."""
    names = labels.select(F.col(by).alias("name")).distinct()
    # the result has a row for each label and name: names are few, or the result is too large in any way
    return labels.select("qid", F.col(by).alias("of")).join(F.broadcast(names), F.lit(True)).select("name", "qid", (F.col("of") == F.col("name")).alias("is_test"))
