"""BM25 over a postings table. Terms of queries meet postings in blocks; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlode.functions import text as tx
from graphlode.operators import blocks
from graphlode.operators.tables import stored

K1, B = 1.5, 0.75
#: Most bytes (as rows of the JVM) of a side that is broadcast; they are counted where they aren't bounded by construction.
BROADCAST_BYTES = 32 << 20
#: Scores are summed as whole multiples of this, so that sums don't depend on the order of rows.
UNIT = 1e-12
#: MB of a block of postings or terms, as rows of the JVM.
BLOCK_MB = 96


def postings(items: DataFrame, id_col: str = "id", order_col: str = "row_idx", text: Column | None = None) -> DataFrame:
    """id, row_idx, term, tf, doc_len. Terms are counted with map-side combination; no text is shuffled."""
    t = items.select(F.col(id_col).alias("id"), F.col(order_col).cast("bigint").alias("row_idx"), tx.tokens(F.col("text") if text is None else text).alias("tokens"))
    rows = t.select("id", "row_idx", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return rows.groupBy("id", "row_idx", "term", "doc_len").agg(F.count("*").cast("int").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(items: DataFrame, text: Column | None = None) -> DataFrame:
    """One row: n, avgdl. Empty documents count."""
    n = F.size(tx.tokens(F.col("text") if text is None else text))
    return items.agg(F.count("*").alias("n"), (F.coalesce(F.sum(n), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, pos: the distinct terms of each query, at their first places."""
    return queries.select("qid", F.posexplode(F.array_distinct(tx.tokens(F.col("query")))).alias("pos", "term"))


def width(kind: T.DataType) -> int | None:
    """Bytes of a value that don't depend on it; None for strings and arrays."""
    return None if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 8


def bytes_of(df: DataFrame) -> int:
    """About the bytes of df's rows in the JVM: one aggregate."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def len_and_mb(df: DataFrame) -> tuple[int, float]:
    """Rows of df and about the MB they take in the JVM: one aggregate."""
    n, size = df.agg(F.count("*"), F.sum(row_bytes(df))).first()
    return n, (size or 0) / 1e6


def row_bytes(df: DataFrame) -> Column:
    each = 16 + sum(width(f.dataType) or 16 for f in df.schema.fields)
    parts = [F.lit(each)]
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            parts.append(F.greatest(F.size(f.name), F.lit(0)) * 8)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("bigint")


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows take at most BROADCAST_BYTES; df should be cheap to read twice."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df


def fixed_sum(value: Column) -> Column:
    """A sum that is the same in any order."""
    return F.sum(F.round(value / UNIT).cast("bigint")) * UNIT


def search(queries: DataFrame, post: DataFrame, corpus: DataFrame, k: int, digits: int | None = 6, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, row_idx, score, first_pos, rank of the best k items of each query; ties by first query term, then row. Scores are rounded after they are ranked.

    The corpus is read once: postings of the queries' terms are stored. What a posting adds to a score doesn't depend on the query, so it is worked out once; postings
    and terms of queries are parted in blocks, and each pair of blocks adds up its items' scores, a query at a time, and gives the k best. No pair of a query and an item is a row before that."""
    terms = stored(query_terms(queries), "query-terms")
    vocabulary = stored(terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    known = small(vocabulary)
    asked = post.join(small(vocabulary.select("term")), "term", "left_semi").join(known, "term").select("id", "row_idx", "doc_len", "tid", "tf")
    asked = stored(asked, "asked")
    df = asked.groupBy("tid").agg(F.count("*").alias("df"))
    rated = asked.join(small(df), "tid").crossJoin(F.broadcast(corpus))  # corpus: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    rated = rated.select("id", "row_idx", "tid", F.round(part / UNIT).cast("bigint").alias("weight"))
    wanted = terms.join(known, "term").select("qid", "pos", "tid")
    (n_post, post_mb), (n_terms, terms_mb) = len_and_mb(asked.select("id", "row_idx", "tid")), len_and_mb(wanted)
    n_asked = terms.select("qid").distinct().count()
    n = blocks.grid(n_post // 100, n_asked, post_mb, terms_mb, n_asked * k * 48 / 1e6, (BLOCK_MB, BLOCK_MB), blocks.parallel(post.sparkSession))
    kinds = {f.name: f.dataType for f in [*rated.schema.fields, *wanted.schema.fields]}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in ("qid", "id", "row_idx")), T.StructField("total", T.LongType()), T.StructField("first_pos", T.IntegerType())])
    scored = blocks.met(rated, wanted, ("row_idx", "qid"), n).mapInArrow(lambda batches: blocks.overlaps(batches, k, UNIT), schema)
    scored = scored.select("qid", "id", "row_idx", (F.col("total") * UNIT).alias("score"), "first_pos")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "first_pos", "row_idx")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best if digits is None else best.withColumn("score", F.round("score", digits))
