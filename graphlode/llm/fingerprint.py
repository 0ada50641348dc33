"""Document fingerprints: MinHash over word shingles, in vectorised numpy.

A fingerprint is PERMUTATIONS universal hash minima, 16 bits of each, as base64. Likeness is the share of equal
minima, an estimate of the Jaccard similarity of the shingle sets (standard error at most 0.5 / sqrt(PERMUTATIONS)). pairs() joins bands of
the minima in Spark and verifies the Jaccard similarity on the whole shingle sets.

Defined results: null and empty texts have the fingerprint of the empty set (likeness 1 to each other, about 0 to others); texts of
fewer words than a shingle are one shingle; ids that are null come last; among equal ids the order is that of a
hash of the text; equal rows are neighbours; very long texts are read whole; extra columns are dropped; in a table of one row
the next document is the row itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.llm import common, minhash, neardup

PERMUTATIONS = 128
#: Rows whose keys set the borders of the ranges, about: a sample by hash, of bounded size.
SAMPLE = 20_000
#: Texts are fingerprinted so many at a time.
STEP = 2000
#: Least chance that a pair at pairs()' threshold shares a band, and most hash functions there.
RECALL, MAX_HASHES = 0.95, 200
#: The texts of a band's bucket are dealt to blocks of about so many; each pair of blocks is a task's key.
BLOCK = 200


def minima(texts: pa.Array) -> np.ndarray:
    off, sh = minhash.shingle_sets(texts)
    return minhash.signatures(off, sh, PERMUTATIONS).astype("<u2")


def as_text(sig: np.ndarray) -> list[str]:
    return [base64.b64encode(s.tobytes()).decode() for s in sig]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1) if len(a) else np.zeros(0)


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def columns(keys: list[tuple[int, int, int]]) -> list[np.ndarray]:
    return [np.array([k[i] for k in keys], np.int64) for i in range(3)]


def sortable(z, k, h) -> np.ndarray:
    """Keys of three integers as byte strings in the order of the keys; a last byte keeps zeros before it."""
    out = np.ones((len(z), 25), np.uint8)
    for i, x in enumerate((z, k, h)):
        u = np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, 8 * i : 8 * i + 8] = u.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out).view("S25").ravel()


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """part, doc_id, text, last of each row, in ranges of (id, hash of text): each part sorted, and ended by the row that follows it (last = true)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").isNull().cast("int").alias("z"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("k"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    keys = keyed.select("z", "k", "h")
    n = keys.count()
    some = keys.where(F.pmod(F.xxhash64("k", "h"), F.lit(max(1, n // SAMPLE))) == 0).limit(4 * SAMPLE).collect()
    sample = sorted(set(map(tuple, some)))
    borders = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    shared = spark.sparkContext.broadcast(sortable(*columns(borders)))

    @F.pandas_udf("int")
    def part_of(z: pd.Series, k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, sortable(z, k, h), "right").astype(np.int32))

    firsts = sorted((r["part"], tuple(r["first"])) for r in keys.select(part_of("z", "k", "h").alias("part"), F.struct("z", "k", "h").alias("key")).groupBy("part").agg(F.min("key").alias("first")).collect())
    # the first key of each part that has rows closes the part before it, the first of all the last
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    order = sorted(before)
    closing = spark.sparkContext.broadcast((sortable(*columns(order)), np.array([before[x] for x in order], np.int32)))

    @F.pandas_udf("array<int>")
    def to(z: pd.Series, k: pd.Series, h: pd.Series) -> pd.Series:
        key, (first, part) = sortable(z, k, h), closing.value
        own = np.searchsorted(shared.value, key, "right").astype(np.int32)
        at = np.minimum(np.searchsorted(first, key), max(len(first) - 1, 0))
        closes = first[at] == key if len(first) else np.zeros(len(key), bool)
        return pd.Series([[a, b] if c else [a] for a, b, c in zip(own.tolist(), part[at].tolist() if len(part) else own.tolist(), closes.tolist())])

    sent = keyed.select("*", F.posexplode(to("z", "k", "h")).alias("copy", "part"))
    last = (F.col("copy") == 1).alias("last")
    return sent.select("part", last, "z", "k", "h", "text").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "last", "z", "k", "h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """The rows but the last, each with its next; a closing row has no output of its own."""
            for a in range(0, len(rows) - 1, STEP):
                part = rows[a : a + STEP + 1]
                own = [i for i in range(len(part) - 1) if not part[i][1] and part[i + 1][0] == part[i][0]]
                edited = [edit(part[i][4], part[i + 1][4]) for i in range(len(part) - 1)]
                sig, sig_edited = minima(pa.array([r[4] for r in part], pa.string())), minima(pa.array(edited, pa.string()))
                if own:
                    fp, fe, at = as_text(sig), as_text(sig_edited), np.array(own)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if part[i][2] else part[i][3] for i in own], pa.int64()), pa.array([len(part[i][4]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in own]), pa.array([fp[i] for i in own]), pa.array([fe[i] for i in own]),
                        pa.array(likeness(sig[at], sig_edited[at])), pa.array(likeness(sig[at], sig[at + 1])),
                    ], names)

        size = 0
        for b in batches:
            for part in common.slices(b):  # rows are held up to a number of bytes, and one row more
                held += zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 3, 5)))
                size += part.nbytes
                if len(held) > STEP or size > common.SLICE_BYTES:
                    yield from done(held)
                    held, size = held[-1:], 0
        yield from done(held)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_order(docs, parts).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): most rows a band that keep RECALL at the threshold; one row where MAX_HASHES don't reach it."""
    best = (MAX_HASHES, 1)
    for rows in range(1, 13):
        need = 1 if threshold >= 1 else math.ceil(math.log(1 - RECALL) / math.log1p(-(threshold**rows)))
        if need * rows <= MAX_HASHES:
            best = (need, rows)
    return best


def pairs(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """a, b, jaccard: ids (the least of each distinct text) of different texts that share a band and whose Jaccard similarity reaches the threshold.

    Every pair that shares a band is checked; a pair right at the threshold shares one with a chance of RECALL at least, for thresholds of 0.0149
    and more. A group of n near copies has n (n - 1) / 2 pairs, and all are in the result."""
    bands, rows = banding(threshold)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        off, sh = minhash.shingle_sets(b.column(2))
        sig, sizes = minhash.signatures(off, sh, bands * rows).astype(np.uint64).reshape(-1, bands, rows), np.diff(off)
        h = np.zeros(sig.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * common.GOLDEN
        for r in range(rows):
            h = common.mix(h ^ sig[:, :, r])
        keys = [row.view(np.int64) if s else np.zeros(0, np.int64) for row, s in zip(h, sizes)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "keys"])

    text = F.coalesce("text", F.lit(""))
    keyed = common.map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("th"), text.alias("text")), batch, "doc_id bigint, th binary, keys array<bigint>")
    reps = common.written(keyed.groupBy("th").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "reps")
    multi = common.written(neardup.buckets(reps).select("key", "th"), "buckets")
    sets = common.written(neardup.shingle_table(docs, common.written(reps.join(multi.select("th").distinct(), "th", "left_semi").select("th", "rep"), "wanted")), "sets")
    # each text goes to its block's pairs with all blocks of the bucket: a bucket of any size is spread over tasks
    blocks = multi.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = multi.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "th", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    x = dealt.select("key", F.col("own").alias("i"), F.col("other").alias("j"), F.col("th").alias("a"))
    y = dealt.select("key", F.col("other").alias("i"), F.col("own").alias("j"), F.col("th").alias("b"))
    met = common.written(x.join(y, ["key", "i", "j"]).where(F.col("a") > F.col("b")).select("a", "b").distinct(), "met")
    left, right = sets.select(F.col("th").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("th").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = met.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    ids = reps.select("th", "rep")
    return found.join(ids.select(F.col("th").alias("a"), F.col("rep").alias("ra")), "a").join(ids.select(F.col("th").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "jaccard")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
