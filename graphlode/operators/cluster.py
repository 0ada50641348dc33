"""Clusters of items: connected components of the pairs at a cosine threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlode.operators.graph import components
from graphlode.operators.vectors import similar_forest


def clusters(vectors: DataFrame, threshold: float = 0.55, where: Column | None = None, cap: int | None = 2500, top: int = 25, label: str = "label") -> tuple[int, DataFrame, int]:
    """Rows compared, the top largest clusters (root, size, label of the first member, first ten members) and how many rows are alone. More rows than cap (None: any number) are an error."""
    rows = vectors if where is None else vectors.where(where)
    n = rows.count()
    if cap is not None and n > cap:
        raise ValueError(f"{n} rows are more than the cap of {cap}")
    found = components(similar_forest(rows, threshold))
    members = found.join(rows.select(F.col("row_idx").alias("id"), F.col(label).cast("string").alias("label")), "id")
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "root").limit(top)
    best = members.join(F.broadcast(sizes), "root")  # top rows
    place = F.row_number().over(Window.partitionBy("root").orderBy("id"))
    # ten members at most of each cluster meet in its list
    ten = best.withColumn("place", place).where("place <= 10").groupBy("root", "size").agg(F.min_by("label", "id").alias("label"), F.array_sort(F.collect_list("id")).alias("members"))
    return n, ten.select("root", "size", "label", "members").orderBy(F.desc("size"), "root"), n - found.count()
