"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources weigh 3, 1, 2, repeating in order of code point (null last), and share SHARE times all words; a target stops at twice its source's
size and the excess is shared again by weight. A source's mix is as many complete epochs as its target holds, then
a weighted sample without replacement for the rest: each document has the key -ln(u) / quality, u a hash of its id, and the documents of least key are
taken while that brings the sum nearer to the target. Quality is 1 less the share of symbols, at least 0.05.

No source is ever sorted: keys fall into buckets, sums of buckets find the one in which a source's budget ends, and only that one is sorted. A
document is then compared with its source's cut.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its own, the last; very long texts are counted whole; null ids share one
hash; rows of equal key, id and size are taken together or not at all; extra columns stay in mixed() and are ignored by plan(); with no words at all every
target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlode.llm import common

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rows of one source in a bucket, about.
PER_BUCKET = 5000
#: Per-source tables of more rows than this aren't broadcast.
MAX_BROADCAST = 10_000


def size_of(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.size(words).cast("bigint")


def key_of(doc_id: Column, text: Column) -> Column:
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>", ""))
    quality = F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - symbols.cast("double") / F.greatest(n, F.lit(1)).cast("double")), F.lit(1.0))
    hashed = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((hashed + 1) / F.lit(2.0**48)) / quality


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key of each row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for source, source_size. A row for each source; all sources meet in one task, their documents don't."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    # water filling: sources reach their limit in order of limit / weight; the level is that of the first one that doesn't
    full = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy()
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    level = (SHARE * F.sum("source_size").over(total) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest)
    w = w.withColumn("level", level)
    w = w.withColumn("place", F.row_number().over(full))
    first = F.min(F.when(F.col("level") * F.col("w") <= MOST * F.col("source_size"), F.struct("place", "level"))).over(total)
    w = w.withColumn("level", first["level"])
    return w.select("source", "source_size", F.least(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w"), (MOST * F.col("source_size")).cast("double")).alias("target"))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.least(F.lit(buckets - 1), F.floor(F.lit(float(buckets)) * (F.lit(1.0) - F.exp(-key)))).cast("bigint")


def cuts(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """source, source_size, target, epochs and the cut (bucket, then key, id, size) up to which documents are taken once more; how many buckets."""
    buckets = max(1, n // PER_BUCKET)
    place = F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "size")
    rows = rows.select("source", "size", bucket_of(F.col("key"), buckets).alias("b"), place.alias("place"))
    sums = common.written(rows.groupBy("source", "b").agg(F.sum("size").alias("s")), "bucket-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = common.written(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    by_bucket = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("before", F.coalesce(F.sum("s").over(by_bucket), F.lit(0))).withColumnRenamed("source", "src")
    same = F.col("src").eqNullSafe(F.col("source"))
    # the bucket in which the budget ends: the last that begins within it
    edge = known.join(goal.select("source", "rest"), same).where(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max_by(F.struct(F.col("b").alias("cut_b"), F.col("before").alias("before"), "rest"), "b").alias("e")).select("source", "e.*")
    small = edge.select(F.col("source").alias("src"), "cut_b", "before", "rest")
    inside = rows.join(small, F.col("source").eqNullSafe(F.col("src")) & (F.col("b") == F.col("cut_b"))).groupBy("source", "cut_b", "before", "rest", "place").agg(F.sum("size").alias("s"))
    up_to = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("s").over(up_to), F.lit(0))).where(2 * F.col("at") + F.col("s") <= 2 * F.col("rest"))
    ends = inside.groupBy("source").agg(F.max("place").alias("cut")).withColumnRenamed("source", "src")
    out = goal.join(edge.select(F.col("source").alias("src"), "cut_b"), same, "left").drop("src").join(ends, same, "left").drop("src")
    return common.written(out.select("source", "source_size", "target", "epochs", "cut_b", "cut"), "cuts"), buckets


def with_copies(rows: DataFrame, at: DataFrame, buckets: int, source: str, key: Column, doc_id: Column, size: Column) -> DataFrame:
    """rows with source_size, target and how often each is taken, as columns mix_source_size, mix_target, mix_copies."""
    at = at.select(*[F.col(c).alias(f"mix_{c}") for c in at.columns])
    if at.count() <= MAX_BROADCAST:
        at = F.broadcast(at)
    place = F.struct(key.alias("key"), F.coalesce(doc_id, F.lit(-(2**63))).alias("id"), size.alias("size"))
    b = bucket_of(key, buckets)
    more = (b < F.col("mix_cut_b")) | ((b == F.col("mix_cut_b")) & (place <= F.col("mix_cut")))
    joined = rows.join(at, rows[source].cast("string").eqNullSafe(F.col("mix_source")))
    return joined.withColumn("mix_copies", F.col("mix_epochs") + F.coalesce(more, F.lit(False)).cast("int")).drop("mix_source", "mix_epochs", "mix_cut_b", "mix_cut")


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row."""
    rows = common.written(keyed(docs), "keyed")
    at, buckets = cuts(rows, rows.count())
    out = with_copies(rows, at, buckets, "source", F.col("key"), F.col("doc_id"), F.col("size"))
    return out.select("doc_id", "source", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"), (F.col("mix_copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """Each row of docs as often as the mix takes it; all columns, whatever their names, stay."""
    rows = common.written(keyed(docs), "keyed")
    at, buckets = cuts(rows, rows.count())
    names = docs.columns
    mine = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    named = mine.select("*", key_of(doc_id, text).alias("mix_key"), size_of(text).alias("mix_size"))
    out = with_copies(named, at, buckets, f"c{names.index('source')}", F.col("mix_key"), doc_id.cast("bigint"), F.col("mix_size"))
    out = out.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH k AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 1) / 281474976710656.0::DOUBLE)
      / coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS DOUBLE) / CAST(greatest(length(text), 1) AS DOUBLE)), 1.0::DOUBLE) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (ARRAY[3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM k GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - CAST(2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level,
    row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS place
  FROM s),
t AS (SELECT source, source_size, least(coalesce((SELECT arg_min(level, place) FROM l WHERE level * w <= 2 * source_size), 0.0::DOUBLE) * w, CAST(2 * source_size AS DOUBLE)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
    CAST(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS through,
    CAST(sum(size) OVER (PARTITION BY k.source, key, doc_id, size) AS BIGINT) AS own
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN 2 * (through - own) + own <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
