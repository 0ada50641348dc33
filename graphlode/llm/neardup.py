"""MinHash near-duplicates by a containment ensemble.

Two texts are linked if the smaller shingle set is contained in the larger one by at least THRESHOLD, whatever their sizes. A link is
mutual if the larger is by as much in the smaller; mutual links merge their texts into one core. Other links don't merge: a core with a text
that stands in a longer one joins the class of one container (of several, that whose core has the largest text), so a short text
inside many long ones doesn't chain these together. A core never joins one whose largest text isn't larger than its own.

Mutual links: texts are partitioned by the size of their shingle set; in each partition the containment threshold becomes the least Jaccard
similarity that sizes in it allow, and bands and rows are tuned for that. A text also queries the partition below where a partner may lie.
Links of any sizes: the Jaccard threshold of a text against a partition of much larger ones falls until bands have one row, that is, single
shingles. Each text then asks which texts have its probes. These are all shingles of a set of up to WHOLE, whose links are exact, and the
PROBES least of a larger set, of which at least PROBES_HIT are in a container with a chance of 0.98. A text that hasn't so many probes in other
cores asks no further, so that texts that share a boilerplate line and are not contained cost no pairs. A probe that only the text's own core has is a miss, and so many of the
other ones, rarest first, are followed that a container of PROBES_HIT has one of them. Lists of a shingle name cores, not texts: a group of n near
copies is one entry. Cores that have enough of all probes are met text by text; the text with the most probes is checked first, and if it
is linked the link stands for the core.
Candidates are checked exactly on their sets of shingles (44-bit hashes). Those of larger sets are checked in groups by the rarest probe they share, to which each
set is sent once, so that texts that share a passage cost a look at their pairs, not an exchange of two sets for each.

Equal texts are one class from the start and take part once. In a band's bucket every text is compared with the bucket's
first one, and those that aren't linked to it with the first of these: the work in a bucket of n texts grows as n. Pairs of a mixed bucket that
meet nowhere this way are found by their probes, as are all links between different cores.

Defined results: null and empty texts are equal (one class, no links); texts of fewer words than a shingle are one shingle;
texts of symbols count their words as they are; repeated rows and ids are copies of one class; a class is named by its least
id that isn't null (null if it has none), and the row kept is that of the least id in the core that contains the others; extra columns are ignored by classes() and kept by keep_one(); empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlode.llm import common, minhash

THRESHOLD = 0.75
#: Least chance that a pair at its partition's Jaccard threshold shares a bucket, and most bands and hash functions.
RECALL, MAX_BANDS, MAX_HASHES = 0.95, 40, 100
#: Partition p holds sizes from RATIO**p up to RATIO**(p+1).
RATIO = 4
#: Bits of the bitmap that thins candidates of one pass, and least and most bits of those that thin shingles (16 for each, if that is between).
BITS = 1 << 25
LEAST_BITS, MOST_BITS = 25, 28
#: Sets of up to WHOLE shingles ask with all of them, larger ones with PROBES, of which a container has at least PROBES_HIT: P(binomial(32, 0.75) >= 19) = 0.985.
WHOLE, PROBES, PROBES_HIT = 96, 32, 19
#: Probes (of at most 16 bytes with their text) that are broadcast at once, and ids (of at most 40 bytes): 30 MB and 10 MB.
MOST_ASKED, MOST_IDS = 2_000_000, 250_000
#: Shingles whose sets lie in one task's memory at once when pairs are checked in groups (8 bytes each, a few times that while they are numbered).
MOST_SHINGLES = 1 << 19


def jaccard_floor(low: int, high: int, t: float) -> float:
    """Least Jaccard similarity of two linked sets whose larger size is in [low, high)."""
    sizes = range(low, min(high, low + 64))
    return min([math.ceil(t * n - 1e-9) / (2 * n - math.ceil(t * n - 1e-9)) for n in sizes] + ([t / (2 - t)] if high > low + 64 else []))


@lru_cache(maxsize=256)
def banding(p: int, t: float = THRESHOLD) -> tuple[int, int]:
    """(bands, rows) of partition p: most rows a band that keep RECALL at its Jaccard threshold."""
    j = jaccard_floor(RATIO**p, math.ceil(RATIO ** (p + 1) / t), t)  # larger texts query it up to there
    best = (MAX_BANDS, 1)
    for rows in range(1, 13):
        need = 1 if j >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - j**rows))
        if need <= MAX_BANDS and need * rows <= MAX_HASHES:
            best = (need, rows)
    return best


def partition_of(size: int) -> int:
    p = 0
    while RATIO ** (p + 1) <= size:
        p += 1
    return p


def band_keys(sig: np.ndarray, sizes: np.ndarray, t: float = THRESHOLD) -> list[np.ndarray]:
    """Bucket keys of each text: of its own partition, and of the one below if that may hold a partner. Empty sets have none."""
    out: list[list[np.ndarray]] = [[] for _ in sizes]
    part = np.array([partition_of(int(s)) for s in sizes])
    for p in sorted(set(part) | {x - 1 for x in set(part) if x}):
        own = (part == p) | ((part == p + 1) & (t * sizes < RATIO ** (p + 1)))
        at = np.flatnonzero(own & (sizes > 0))
        if not len(at):
            continue
        bands, rows = banding(int(p), t)
        block = sig[at, : bands * rows].astype(np.uint64).reshape(len(at), bands, rows)
        with np.errstate(over="ignore"):
            h = np.zeros((len(at), bands), np.uint64) + (np.arange(bands, dtype=np.uint64) + np.uint64(p * 1000 + 1)) * common.GOLDEN
            for r in range(rows):
                h = common.mix(h ^ (block[:, :, r] + np.uint64(r + 1) * common.GOLDEN))
        for i, row in zip(at, h.view(np.int64)):
            out[i].append(row)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def n_probes(size: np.ndarray) -> np.ndarray:
    """How many of its least shingles a set of that size asks with."""
    return np.where(size <= WHOLE, size, PROBES)


def signed(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """doc_id, th (digest of the text), size of the shingle set, bucket keys, probes; of equal texts in a batch only the first has keys."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        th = b.column(1)
        first = np.zeros(b.num_rows, bool)
        first[np.unique(common.encode(th)[0], return_index=True)[1]] = True
        at = np.flatnonzero(first)
        off, sh = minhash.shingle_sets(b.column(2).take(pa.array(at)))
        sizes = np.diff(off)
        keys = band_keys(minhash.signatures(off, sh, MAX_HASHES), sizes, t)
        size, lists, probes = np.full(b.num_rows, -1), [None] * b.num_rows, [None] * b.num_rows
        size[at] = sizes
        for i, k, o in zip(at, keys, off):
            lists[i] = k
            probes[i] = sh[o : o + n_probes(size[i])].view(np.int64)  # sorted hashes: a random sample
        return pa.RecordBatch.from_arrays([b.column(0), th, pa.array(size, pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array(probes, pa.list_(pa.int64()))], ["doc_id", "th", "size", "keys", "probes"])

    text = F.coalesce("text", F.lit(""))
    return common.map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("th"), text.alias("text")), batch, "doc_id bigint, th binary, size int, keys array<bigint>, probes array<bigint>")


def buckets(reps: DataFrame) -> DataFrame:
    """key, th, pivot of each text in a bucket of two or more; the pivot is the bucket's least digest. Streams through sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, alone = None, b"", False
        for b in batches:
            k, out = b.column(0).to_numpy(), []
            th = b.column(1)
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            stops = np.append(starts[1:], len(k))
            for s, e in zip(starts.tolist(), stops.tolist()):
                first = k[s] != key
                if first:
                    if e - s == 1 and e < len(k):
                        continue  # a bucket of one
                    key, pivot, alone = k[s], th[s].as_py(), True
                for i in range(s + first, e):
                    x = th[i].as_py()
                    if x != pivot:
                        if alone:
                            out.append((int(key), pivot, pivot))
                            alone = False
                        out.append((int(key), x, pivot))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[i] for o in out], pa.binary()) for i in (1, 2))], ["key", "th", "pivot"])

    rows = reps.select(F.explode("keys").alias("key"), "th").repartition("key").sortWithinPartitions("key", "th")
    return rows.mapInArrow(run, "key bigint, th binary, pivot binary")


def bitmap(values: DataFrame, column: str, bits: int = BITS) -> bytes:
    """One bit for each value mod bits: of fixed size (4 MB), whatever the number of values, unless other bits are asked for."""
    v = F.pmod(F.col(column), F.lit(bits)) + 1  # these functions count from 1
    rows = values.select(F.bitmap_bucket_number(v).alias("n"), F.bitmap_bit_position(v).alias("p")).groupBy("n").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = bytearray(bits // 8 + 4096)
    for r in rows:
        at = (r["n"] - 1) * 4096
        out[at : at + 4096] = r["bits"]
    return bytes(out)


def shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """th, shingles of the texts in wanted (th, rep), and of few others, which a bitmap lets through; rows equal in id and text come more than once."""
    h = F.xxhash64("th", "rep")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(h.alias("h")), "h"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.frombuffer(shared.value, np.uint8)
        v = np.mod(b.column(0).to_numpy(), BITS)
        at = np.flatnonzero(bits[v // 8] >> (v % 8).astype(np.uint8) & 1)
        off, sh = minhash.shingle_sets(b.column(2).take(pa.array(at)))
        return pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(sh.view(np.int64)))], ["th", "shingles"])

    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.unhex(F.md5(text)).alias("th"), text.alias("text"))
    return common.map_batches(keyed.select(h.alias("h"), "th", "text"), batch, "th binary, shingles array<bigint>")


def with_sets(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """pairs with sa, sb: the shingles of a and b. Both joins read one exchange of sets (key, shingles)."""
    left = pairs.join(sets, F.col("a") == F.col(key)).withColumnRenamed("shingles", "sa").drop(key)
    return left.join(sets, F.col("b") == F.col(key)).withColumnRenamed("shingles", "sb").drop(key)


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """a, b, linked: the containment of each pair, checked on the whole sets."""
    both = with_sets(pairs, sets, "th")
    most = F.greatest(F.size("sa"), F.size("sb"))
    enough = F.least(F.size("sa"), F.size("sb")) >= most * t - 1e-9
    return both.select("a", "b", F.when(enough, F.size(F.array_intersect("sa", "sb")) >= most * t - 1e-9).otherwise(False).alias("linked")).distinct()


def shared_counts(group: tuple, pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """a, b, hits: how many shingles each of a group's pairs shares; texts (u, shingles) has both sides of all of them."""
    u = texts["u"].to_numpy()
    order = np.argsort(u)
    lists = common.plain(texts["shingles"])
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    flat = flat[off[0] : off[-1]]
    known = np.unique(flat)
    ids, off, mark = np.searchsorted(known, flat).astype(np.int32), off - off[0], np.zeros(len(known), bool)
    by_b = pairs.sort_by("b")
    a, b = (order[np.searchsorted(u, by_b[c].to_numpy(), sorter=order)] for c in "ab")
    hits, ends = np.zeros(len(a), np.int32), np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        whole = ids[off[b[lo]] : off[b[lo] + 1]]
        mark[whole] = True
        for i in range(lo, hi):  # a is the smaller one
            hits[i] = np.count_nonzero(mark[ids[off[a[i]] : off[a[i] + 1]]])
        mark[whole] = False
    common.give_back()
    return pa.table({"a": by_b["a"], "b": by_b["b"], "hits": pa.array(hits)})


def counted_in_groups(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, hits: how many shingles the pairs (a, b, na, nb, key) share, on whole sets (u, shingles).

    Pairs of one key meet in one group, to which each of their sets is sent once: n texts that share a passage are n sets there, though they have
    pairs in number as n squared. A key whose sets don't fit in memory is parted in blocks; small keys share a group."""
    spark = pairs.sparkSession
    sides = [F.struct(F.col(x).alias("u"), F.col(f"n{x}").alias("size")) for x in "ab"]
    sizes = pairs.select("key", F.explode(F.array(*sides)).alias("m")).select("key", "m.*").distinct().groupBy("key").agg(F.sum("size").alias("size"))
    sizes = common.written(sizes.withColumn("m", F.when(F.col("size") > MOST_SHINGLES, F.ceil(2 * F.col("size") / MOST_SHINGLES)).otherwise(1)), "sizes")
    room = sizes.select(F.sum(F.when(F.col("m") > 1, F.col("m") * F.col("m")).otherwise(4 * F.col("size") / MOST_SHINGLES))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(room))
    placed = pairs.join(few(sizes.where("m > 1").select("key", "m"), MOST_IDS), "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    block = F.xxhash64("key", *(F.pmod(F.xxhash64(x), "m") for x in "ab"))
    placed = common.written(placed.select(F.pmod(block, F.lit(groups)).alias("cell"), "a", "b").distinct(), "cells")
    texts = common.written(placed.select("cell", F.explode(F.array("a", "b")).alias("u")).distinct(), "sent").join(sets, "u").select(F.col("cell").alias("at"), "u", "shingles")
    return placed.groupBy("cell").cogroup(texts.groupBy("at")).applyInArrow(shared_counts, "a bigint, b bigint, hits int")


def few(rows: DataFrame, most: int) -> DataFrame:
    """rows, to be broadcast if they are at most so many; the count stops there. rows should be cheap to count."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its connected component) for links a, b. Least labels spread and jump; each round is a written table."""
    edges = common.written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = common.written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), "labels")
    while True:
        known = few(labels, MOST_IDS)
        near = edges.join(known, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        step = near.join(known, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        to = step.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = common.written(step.join(to, step["root"] == to["at"]).select("node", "old", F.least("root", "next").alias("root")), "labels")
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def links_of(docs: DataFrame, reps: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """a, b: the links found between different texts, as digests."""
    multi = common.written(buckets(reps), "buckets")
    wanted = common.written(reps.select("th", "rep").join(few(multi.select("th").distinct(), MOST_IDS), "th", "left_semi"), "wanted")
    sets = common.written(shingle_table(docs, wanted), "sets")
    first = common.written(verified(multi.where("th <> pivot").select(F.col("th").alias("a"), F.col("pivot").alias("b")).distinct(), sets, t), "first")
    failed = first.where(~F.col("linked")).select(F.col("a").alias("th"), F.col("b").alias("pivot"))
    odd = multi.join(failed, ["th", "pivot"], "left_semi").select("key", "th")
    again = odd.join(odd.groupBy("key").agg(F.min("th").alias("pivot")), "key").where(F.col("th") != F.col("pivot"))
    second = verified(again.select(F.col("th").alias("a"), F.col("pivot").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"), sets, t)
    links = common.written(first.where("linked").select("a", "b").unionByName(second.where("linked").select("a", "b")), "links")
    common.dropped(multi, wanted, sets, first)
    return links


def holders(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """s, u: the texts (xxhash64 of the digest) that have a shingle of probes (s) which isn't a probe of their own, and few other shingles: two bitmaps keep these low, a join leaves them out."""
    n = probes.count()
    width = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    bits, shift = 1 << width, 44 - width
    # by the low bits, and by the high ones: large texts ask with low shingles only, so the upper part of the second is sparse
    shared = docs.sparkSession.sparkContext.broadcast((bitmap(probes, "s", bits), bitmap(probes.select(F.shiftrightunsigned("s", shift).alias("s")), "s", bits)))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.sort(np.unique(b.column(0).to_numpy(), return_index=True)[1])
        off, sh = minhash.shingle_sets(b.column(1).take(pa.array(at)))
        size = np.diff(off)
        keep = np.arange(len(sh)) - np.repeat(off[:-1], size) >= np.repeat(n_probes(size), size)
        sh, owner = sh[keep], np.repeat(at, size)[keep]
        for raw, right in zip(shared.value, (0, shift)):
            v = (sh >> np.uint64(right)) & np.uint64(bits - 1)
            keep = (np.frombuffer(raw, np.uint8)[v >> np.uint64(3)] >> (v & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
            sh, owner = sh[keep], owner[keep]
        return pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), b.column(0).take(pa.array(owner))], ["s", "u"])

    text = F.coalesce("text", F.lit(""))
    return common.map_batches(docs.select(F.xxhash64(F.unhex(F.md5(text))).alias("u"), text.alias("text")), batch, "s bigint, u bigint")


def in_parts(asks: DataFrame) -> list[DataFrame]:
    """asks in parts whose probes may be broadcast: a probe that very many texts have is met part by part, not in one task."""
    n = -(-(asks.select(F.sum(F.size("s"))).first()[0] or 0) // MOST_ASKED)
    return [F.broadcast(asks.where(F.pmod(F.xxhash64("a"), F.lit(n)) == i) if n > 1 else asks) for i in range(max(1, n))]


def contained(docs: DataFrame, reps: DataFrame, cores: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """a, b, ra, rb, mutual: links of a text a (core ra) and one b (core rb) that isn't smaller, of different cores (node, root).

    Texts and cores go by xxhash64 of their digests; texts of one hash would be checked one by one."""
    nodes = reps.select("th", "rep", "size", "probes").join(cores.select(F.col("node").alias("th"), "root"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    nodes = common.written(nodes.select(F.xxhash64("th").alias("u"), F.xxhash64("root").alias("c"), "th", "rep", "size", "probes"), "nodes")
    mine = nodes.select(F.explode("probes").alias("s"), "u", "c", "size")
    other = holders(docs, mine.select("s")).join(nodes.select("u", "c", "size"), "u")
    other = common.written(other.select("s", "u", "c", "size"), "holders")
    every = mine.withColumn("own", F.lit(True)).unionByName(other.withColumn("own", F.lit(False)))
    # shingles that are a probe and that texts of two cores or more have; equal texts of different batches count as often as they come
    often = every.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("df"), F.max("own").alias("asked")).where("low <> high AND asked").select("s", "df")
    known = mine.join(often, "s").groupBy("u", "c", "size").agg(F.sort_array(F.collect_list(F.struct("df", "s")))["s"].alias("s"))
    need = F.when(F.col("size") <= WHOLE, F.ceil(F.col("size") * t - 1e-9)).otherwise(PROBES_HIT).cast("int")
    asks = known.withColumn("need", need).where(F.size("s") >= F.col("need"))
    asks = common.written(asks.select(F.col("u").alias("a"), F.col("c").alias("ra"), F.col("size").alias("na"), "need", "s"), "asks")
    # few texts have probes enough in other cores: these are broadcast, and only their probes' lists are followed
    parts = in_parts(asks)
    asked = few(asks.select(F.explode("s").alias("s")).distinct(), MOST_ASKED // 2)
    followed = common.written(every.join(asked, "s", "left_semi").select("s", "u", "c", "size"), "followed")

    def united(of) -> DataFrame:
        out = of(parts[0])
        for part in parts[1:]:
            out = out.unionByName(of(part))
        return out

    def meets(part: DataFrame) -> DataFrame:
        follow = F.broadcast(part.select("a", "ra", "na", F.explode(F.slice("s", F.lit(1), F.size("s") - F.col("need") + 1)).alias("s")))
        return followed.join(follow, "s").where((F.col("ra") != F.col("c")) & (F.col("size") >= F.col("na"))).select("a", F.col("c").alias("rb")).distinct()

    met = common.written(united(meets), "met")
    # how many probes each core that was met has
    has = followed.groupBy(F.col("c").alias("rb")).agg(F.collect_set("s").alias("sb"))
    hits = F.size(F.array_intersect("s", "sb"))
    enough = common.written(united(lambda part: met.join(has, "rb").join(part.select("a", "need", "s"), "a").where(hits >= F.col("need")).select("a", "rb")), "enough")
    reached = few(enough.select(F.col("rb").alias("c")).distinct(), MOST_IDS)
    own = common.written(followed.join(reached, "c", "left_semi").groupBy(F.col("u").alias("b"), F.col("c").alias("rb"), F.col("size").alias("nb")).agg(F.collect_set("s").alias("sb")), "own")

    def counted(part: DataFrame) -> DataFrame:
        both = enough.join(own, "rb").join(part, "a").where((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") > F.col("a"))))
        both = both.withColumn("both", F.array_intersect("s", "sb")).withColumn("hits", F.size("both")).where("hits >= need")
        return both.select("a", "ra", "na", "b", "rb", "nb", "hits", F.col("both")[0].alias("key"))  # the rarest probe that both have

    both = common.written(united(counted), "by-text")
    whole = F.col("na") <= WHOLE  # their probes are all of their shingles
    best = both.where(whole).groupBy("a", "ra", "na", "rb").agg(F.max(F.struct("hits", "nb", "b")).alias("m")).select("a", "ra", "na", "rb", "m.*")
    exact = best.select("a", "b", "ra", "rb", (F.col("hits") >= F.col("nb") * t - 1e-9).alias("mutual"))
    large = both.where(~whole)
    ends = large.select(F.col("a").alias("u")).unionByName(large.select(F.col("b").alias("u"))).distinct()
    wanted = common.written(nodes.select("th", "rep", "u").join(ends, "u", "left_semi").select("th", "rep"), "wanted")
    sets = common.written(shingle_table(docs, wanted).select(F.xxhash64("th").alias("u"), "shingles").dropDuplicates(["u"]), "sets")
    shared = common.written(counted_in_groups(large.select("key", "a", "b", "na", "nb"), sets), "shared")
    first = F.row_number().over(Window.partitionBy("a", "rb").orderBy(F.desc("hits"), F.desc("nb"), F.desc("b"))) == 1
    linked = large.withColumn("first", first).join(shared.withColumnRenamed("hits", "n"), ["a", "b"]).where(F.col("n") >= F.col("na") * t - 1e-9)
    # if a core's text with the most probes is linked, the link stands for the core
    linked = linked.withColumn("stands", F.max("first").over(Window.partitionBy("a", "rb"))).where("first OR NOT stands")
    found = exact.unionByName(linked.select("a", "b", "ra", "rb", (F.col("n") >= F.col("nb") * t - 1e-9).alias("mutual")))
    found = common.written(found, "contained")
    common.dropped(nodes, other, asks, followed, met, enough, own, both, wanted, sets, shared)
    return found


def classes(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """doc_id, th, class_id, n_links, class_size, n_same of each row.

    n_links: links recorded between the row's text and different texts; n_same: rows of the same id and text."""
    sig = common.written(signed(docs, t), "signed")
    reps = sig.groupBy("th").agg(F.min("doc_id").alias("rep"), F.first("keys", ignorenulls=True).alias("keys"), F.max("size").alias("size"), F.first("probes", ignorenulls=True).alias("probes"))
    links = links_of(docs, reps, t)
    cores = components(links)
    found = contained(docs, reps, cores, t)
    ends = links.select(F.xxhash64("a").alias("u")).unionByName(links.select(F.xxhash64("b").alias("u")))
    ends = ends.unionByName(found.select(F.col("a").alias("u"))).unionByName(found.select(F.col("b").alias("u"))).groupBy("u").agg(F.count("*").alias("n_links"))
    rows = sig.groupBy("th", "doc_id").agg(F.count("*").alias("n_same"))
    by_text = sig.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_text"), F.max("size").alias("size"))
    roots = by_text.join(cores.withColumnRenamed("node", "th"), "th", "left").withColumn("u", F.xxhash64("th")).join(ends, "u", "left").withColumn("core", F.coalesce("root", "th"))
    roots = common.written(roots.select("th", "rep", "n_text", "size", "core", F.xxhash64("core").alias("c"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "texts")
    # cores that a mutual link joins become one
    joined = components(found.where("mutual").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    named = roots.select(F.col("c").alias("root"), F.col("core").alias("to")).distinct()
    joined = common.written(joined.join(named, "root").select(F.col("node").alias("c"), "to"), "joined")
    roots = roots.join(few(joined, MOST_IDS), "c", "left").withColumn("core", F.coalesce("to", "core")).drop("to")
    tops = roots.groupBy("core").agg(F.max("size").alias("top"))
    at = roots.select("c", "core").distinct().join(tops, "core")
    sides = [at.select(F.col("c").alias(f"r{x}"), F.struct("top", "core").alias(f"{x}_core")) for x in "ab"]
    inside = found.where(~F.col("mutual")).select("ra", "rb").distinct()
    into = inside.join(sides[0], "ra").join(sides[1], "rb").where("a_core.top < b_core.top").groupBy(F.col("a_core.core").alias("a")).agg(F.max("b_core")["core"].alias("b"))
    into = common.written(into, "into")
    # each core joins at most one with a larger text: the components are trees, and each has one core that joins none
    roots = roots.join(components(into).withColumnRenamed("node", "core"), "core", "left").join(into.select(F.col("a").alias("core"), F.lit(True).alias("held")), "core", "left")
    roots = common.written(roots.select("th", "rep", "n_text", F.coalesce("root", "core").alias("root"), F.coalesce("held", F.lit(False)).alias("held"), "n_links"), "roots")
    names = roots.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n_text").alias("class_size"), F.min(F.struct("held", F.col("rep").isNull(), "rep", "th"))["th"].alias("kept_th"))
    per_text = roots.join(names, "root").select("th", "class_id", "n_links", "class_size", "kept_th", "rep")
    out = rows.join(per_text, "th")
    kept = (F.col("th") == F.col("kept_th")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    return out.select("doc_id", "th", "class_id", "n_links", "class_size", "n_same", kept.alias("kept"))


def keep_one(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the least id; all columns, whatever their names, stay."""
    names = docs.columns
    mine = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    keep = common.written(classes(docs.select("doc_id", "text"), t).where("kept").select(F.col("doc_id").alias("id"), "th", "n_same"), "keep")
    keep = few(keep, MOST_IDS)  # if they are few no text is exchanged
    at = mine.join(keep, F.unhex(F.md5(F.coalesce(text, F.lit("")))).eqNullSafe(F.col("th")) & doc_id.cast("bigint").eqNullSafe(F.col("id")))
    once = at.where("n_same = 1").unionByName(at.where("n_same > 1").dropDuplicates(["th"]))
    return once.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(common.documents(spark, sf_dir))
    same = F.explode(F.sequence(F.lit(1), F.col("n_same").cast("int")))
    return out.withColumn("same_", same).select("doc_id", "class_id", "n_links", "class_size", F.when(F.col("same_") > 1, False).otherwise(F.col("kept")).alias("kept"))
