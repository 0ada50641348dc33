"""Line deduplication by a deletion-neighbourhood join.

A line is the sequence of its words. Lines with a word are the same if their words are; they are near if one word inserted, deleted or replaced
(edit bound 1) makes them the same and both have NEAR_WORDS words or more, so that the bound is at most an eighth of a line. Of equal lines of the
corpus the earliest stays (by id, hash of the text, place in the text), and a line with an earlier near line goes; lines without a word always stay.

Equal lines are told by 128 bits of a hash of their words. For near ones every line emits, as hashed keys, itself and its variants with one word
deleted; equal variants meet. Lines that lack a different word in the same place share a variant with that place; a line and one that has a word more
share the variant without it. The earliest line of a key is found by a plain minimum, so no pairs within a key are formed, however many lines share it;
the edit distance of each line to that partner is then verified on the words. Lines near each other share their first or last half, so only
lines whose half another line shares emit variants: halves are counted first, a bitmap of fixed size lets few other lines through, and a join leaves these out.
Lines that emit are numbered in the order of their first places, so that keys carry two numbers only.

Defined results: null texts stay null and have no lines; empty texts stay; a text may lose all its lines and is then empty; very long texts
and lines are treated whole; ids that are null come last; rows equal in id and text are one document and keep the same lines; extra columns, whatever
their names, stay in deduplicated() and are ignored by lines(); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlode.llm import common, neardup

MIN_WORDS, NEAR_WORDS = 1, 8
KEY = ["z", "k", "h"]
#: Lines whose words aren't parted by single spaces alone.
UNEVEN = r"^ | $|  |[\t\x0b\f\r]"


class Lines:
    """The lines of some texts that have a word: text, place in it, words joined by single spaces, 128-bit hash."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.split_pattern(common.texts_of(texts), "\n")
        flat = lists.flatten()
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        uneven = pc.match_substring_regex(flat, UNEVEN)
        if pc.any(uneven).as_py():
            flat = pc.replace_with_mask(flat, uneven, pa.array([" ".join(_words(x)) for x in flat.filter(uneven).to_pylist()], pa.string()))
        at = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)
        self.flat, self.doc, self.place = flat.take(pa.array(at)), doc[at], place[at]
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join(map(digest, self.flat.to_pylist())), np.int64).reshape(-1, 2)
        self.lh, self.lg = both[:, 0], both[:, 1]


def positions(n: int, seed: int) -> np.ndarray:
    """A number for each place of a word; sums of mixed words and places tell sequences apart whatever words repeat in them."""
    with np.errstate(over="ignore"):
        return common.mix((np.arange(max(n, 1), dtype=np.uint64) + np.uint64(seed << 40)) * common.GOLDEN)


class Words:
    """The words of some lines, by single spaces, as hashes; sums of stretches of them."""

    def __init__(self, lines: pa.Array) -> None:
        lists = pc.split_pattern(lines, " ")
        ids, distinct = common.encode(lists.flatten())
        self.n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.line = np.repeat(np.arange(len(self.n)), self.n)
        self.pos = np.arange(len(ids)) - self.start[self.line]
        self.word = common.hash64(distinct)[ids] if len(ids) else np.zeros(0, np.uint64)
        self.places = positions(int(self.n.max()) if len(self.n) else 1, 1)
        self.term = common.mix(self.word ^ self.places[self.pos])
        self.sums = sums(self.term)

    def first(self, half: np.ndarray) -> np.ndarray:
        return mark(self.sums[self.start + half] - self.sums[self.start], half, 2)

    def last(self, half: np.ndarray) -> np.ndarray:
        """As first, of the last words: they are counted from the end."""
        if not hasattr(self, "from_end"):
            self.from_end = sums(common.mix(self.word ^ self.places[self.n[self.line] - 1 - self.pos]))
        end = self.start + self.n
        return mark(self.from_end[end] - self.from_end[end - half], half, 3)


def sums(terms: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])


def mark(h: np.ndarray, number: np.ndarray, kind: int) -> np.ndarray:
    """A key from a hash, a number and a kind of key."""
    with np.errstate(over="ignore"):
        return common.mix(h ^ common.mix(number.astype(np.uint64) * np.uint64(8) + np.uint64(kind)))


def line_table(docs: DataFrame) -> DataFrame:
    """z, k, h (the document), place, lh, lg (hash of the line's words), halves (keys of its halves; null for a line that stands before in the batch) of each line."""
    names = [*KEY, "place", "lh", "lg", "halves"]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        ln = Lines(b.column(3))
        near = np.sort(np.unique(ln.lh, return_index=True)[1])
        spaces = pc.count_substring(ln.flat, " ").to_numpy(zero_copy_only=False)
        near = near[spaces[near] >= NEAR_WORDS - 1]
        w = Words(ln.flat.take(pa.array(near)))
        # of a line and one that is a word longer or shorter, either may be the shorter one: so halves of n and of n - 1
        big, small = w.n // 2, (w.n - 1) // 2
        keys = np.stack([w.first(big), w.first(small), w.last(big), w.last(small)], 1).view(np.int64)
        both = np.stack([np.ones(len(near), bool), big != small] * 2, 1)
        counts = np.zeros(len(ln.doc), np.int64)
        counts[near] = both.sum(1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(keys[both]))
        doc = pa.array(ln.doc)
        return pa.RecordBatch.from_arrays([*(b.column(i).take(doc) for i in range(3)), pa.array(ln.place, pa.int32()), pa.array(ln.lh), pa.array(ln.lg), lists], names)

    return common.map_batches(keyed(docs).select(*KEY, "text"), batch, "z int, k bigint, h bigint, place int, lh bigint, lg bigint, halves array<bigint>")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").isNull().cast("int").alias("z"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("k"), F.xxhash64("text").alias("h"), "text")


def numbered(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """r (a number in the order of first places), lh, place (z, k, h, place), line, in_first, in_last of the lines in flags (lh, in_first, in_last)."""
    shared = docs.sparkSession.sparkContext.broadcast(neardup.bitmap(flags, "lh"))
    names = ["lh", *KEY, "place", "line"]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        ln = Lines(b.column(3))
        v = np.mod(ln.lh, neardup.BITS)
        hit = np.flatnonzero(np.frombuffer(shared.value, np.uint8)[v // 8] >> (v % 8).astype(np.uint8) & 1)
        z, k, h = (b.column(i).to_numpy()[ln.doc[hit]] for i in range(3))
        order = np.lexsort((ln.place[hit], h, k, z, ln.lh[hit]))
        lh = ln.lh[hit][order]
        hit = hit[order[np.append(True, lh[1:] != lh[:-1])]] if len(order) else hit
        doc = pa.array(ln.doc[hit])
        return pa.RecordBatch.from_arrays([pa.array(ln.lh[hit]), *(b.column(i).take(doc) for i in range(3)), pa.array(ln.place[hit], pa.int32()), ln.flat.take(pa.array(hit))], names)

    some = common.map_batches(keyed(docs).select(*KEY, "text"), batch, "lh bigint, z int, k bigint, h bigint, place int, line string")
    each = some.join(flags, "lh").groupBy("lh", "in_first", "in_last").agg(F.min(F.struct(*KEY, "place", "line")).alias("at"))
    ordered = each.select("lh", "in_first", "in_last", "at.*").repartitionByRange(*KEY, "place").sortWithinPartitions(*KEY, "place")
    # ranges are numbered in order, and rows within them
    return ordered.select(F.monotonically_increasing_id().alias("r"), "lh", F.struct(*KEY, "place").alias("place"), "line", "in_first", "in_last")


def variants(lines: DataFrame) -> DataFrame:
    """key, kind (0 a variant with its place, 1 the line, 2 a variant), r of numbered lines.

    Where a line's first half is shared the edit is in the rest, where its last half is it is before that: only those words are deleted."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column(1))
        r, in_first, in_last = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        half = (w.n - 1) // 2
        keep = (in_first[w.line] & (w.pos >= half[w.line])) | (in_last[w.line] & (w.pos < (w.n - half)[w.line]))
        at = np.flatnonzero(keep)
        own, p = w.line[at], w.pos[at]
        before, total = w.sums[w.start], w.sums[w.start + w.n] - w.sums[w.start]
        # the words behind the deleted one stand a place lower
        lower = sums(common.mix(w.word ^ w.places[np.maximum(w.pos - 1, 0)]))
        with np.errstate(over="ignore"):
            blank = mark(total[own] - w.term[at], p * 1_000_003 + w.n[own], 4)
            gone = mark((w.sums[at] - before[own]) + (lower[(w.start + w.n)[own]] - lower[at + 1]), w.n[own] - 1, 1)
        # in a run of equal words each deletion gives the same line
        new = np.ones(len(gone), bool)
        new[1:] = (gone[1:] != gone[:-1]) | (own[1:] != own[:-1])
        key = np.concatenate([blank, mark(total, w.n, 1), gone[new]]).view(np.int64)
        kind = np.repeat(np.arange(3, dtype=np.int8), [len(blank), len(total), int(new.sum())])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(np.concatenate([r[own], r, r[own[new]]]))], ["key", "kind", "r"])

    return common.map_batches(lines.select("r", "line", "in_first", "in_last"), batch, "key bigint, kind tinyint, r bigint")


def _words(line: str) -> list[str]:
    return [w for w in line.translate(str.maketrans("\t\v\f\r", "    ")).split(" ") if w]


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two word lists is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


@F.pandas_udf(T.BooleanType())
def verify(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within_one(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype=bool)


def place_of() -> Column:
    return F.struct(*KEY, "place")


def near_lines(docs: DataFrame, table: DataFrame) -> DataFrame:
    """lh, lg of the lines that have an earlier near line."""
    halves = table.select(F.posexplode("halves").alias("i", "half"), "lh", F.size("halves").alias("of")).select("half", "lh", (F.col("i") * 2 < F.col("of")).alias("prefix"))
    shared = halves.groupBy("half").agg(F.min("lh").alias("a"), F.max("lh").alias("b")).where("a <> b").select("half")
    flags = halves.join(shared, "half", "left_semi").groupBy("lh").agg(F.max("prefix").alias("in_first"), F.max(~F.col("prefix")).alias("in_last"))
    lines = common.written(numbered(docs, common.written(flags, "shared-halves")), "numbered-lines")
    var = common.written(variants(lines), "variants")

    def least(kind: int) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col("r")))

    met = var.groupBy("key").agg(least(0).alias("m0"), least(1).alias("m1"), least(2).alias("m2"), F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b")
    partner = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = var.join(met, "key").select(F.col("r").alias("of"), partner.alias("with")).where(F.col("with") < F.col("of")).groupBy("of").agg(F.min("with").alias("with"))
    words = lines.select("r", "lh", "line")
    left, right = words.select(F.col("r").alias("of"), "lh", F.col("line").alias("wa")), words.select(F.col("r").alias("with"), F.col("line").alias("wb"))
    return pairs.join(left, "of").join(right, "with").where(verify("wa", "wb")).select("lh", F.lit(True).alias("near"))


def lines(docs: DataFrame) -> DataFrame:
    """z, k, h, place, near of each line that goes; near: it isn't a copy but has an earlier near line."""
    table = common.written(line_table(docs), "lines")
    first = table.groupBy("lh", "lg").agg(F.min(place_of()).alias("first"), F.count("*").alias("n"))
    near = common.written(near_lines(docs, table), "near-lines")
    doubtful = first.join(near, "lh", "left").where("n > 1 OR near")
    gone = table.join(doubtful, ["lh", "lg"]).where(F.col("near") | (place_of() != F.col("first")))
    return gone.select(*KEY, "place", ((place_of() == F.col("first")) & F.coalesce("near", F.lit(False))).alias("near"))


def without(texts: pa.Array, places: pa.Array) -> pa.Array:
    """The texts without the lines at these places."""
    lists = pc.split_pattern(common.texts_of(texts), "\n")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = np.ones(sizes.sum(), bool)
    keep[(np.cumsum(sizes) - sizes)[pc.list_parent_indices(places).to_numpy(zero_copy_only=False)] + places.flatten().to_numpy()] = False
    left = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), lists.flatten().filter(pa.array(keep))), "\n")


def deduplicated(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs with the lines that go taken out of text (and n_chars, if there is such a column, as the new length); with counts also how many copies and near lines went, as line_copies and line_near."""
    gone = lines(docs).groupBy(*KEY).agg(F.collect_list("place").alias("places"), F.sum((~F.col("near")).cast("bigint")).alias("copies"), F.sum(F.col("near").cast("bigint")).alias("n_near"))
    names = docs.columns
    mine = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    same = (doc_id.isNull().cast("int") == F.col("z")) & (F.coalesce(doc_id.cast("bigint"), F.lit(0)) == F.col("k")) & (F.xxhash64(text) == F.col("h"))
    out = mine.join(gone, same, "left")
    cut = F.when(F.col("places").isNotNull(), shortened(F.when(F.col("places").isNotNull(), text), F.col("places"))).otherwise(text)
    out = out.withColumn("cut", cut)
    changed = {"text": F.col("cut"), "n_chars": F.length("cut").cast("bigint")}
    kept = [changed.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]
    return out.select(*kept, *([F.coalesce("copies", F.lit(0)).alias("line_copies"), F.coalesce("n_near", F.lit(0)).alias("line_near")] if counts else []))


@F.arrow_udf(T.StringType())
def shortened(text: pa.Array, places: pa.Array) -> pa.Array:
    none = pa.array([[]], places.type)[0]
    return without(text, pc.fill_null(places, none) if places.null_count else places)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(common.documents(spark, sf_dir), counts=True)
    return out.select("doc_id", "text", F.col("line_copies").alias("n_copies"), F.col("line_near").alias("n_near"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, p AS place, ls[p] AS line, regexp_extract_all(ls[p], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
d AS (SELECT w, array_to_string(w, ' ') AS t, min({'d': doc_id, 'p': place}) AS first FROM l WHERE len(w) >= 1 GROUP BY w),
v AS (SELECT t, first, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') AS v FROM (SELECT t, w, first, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 8)),
near AS (
  SELECT t FROM (SELECT t, first, min(first) OVER (PARTITION BY v, i, n) AS least FROM v) WHERE least < first
  UNION SELECT v.t FROM v JOIN d s ON s.t = v.v AND len(s.w) >= 8 WHERE s.first < v.first
  UNION SELECT s.t FROM v JOIN d s ON s.t = v.v AND len(s.w) >= 8 WHERE v.first < s.first),
x AS (
  SELECT l.doc_id, l.place, l.line, coalesce({'d': l.doc_id, 'p': l.place} <> d.first, false) AS copy, near.t IS NOT NULL AS near
  FROM l LEFT JOIN d ON d.w = l.w LEFT JOIN near ON near.t = d.t)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT (copy OR near)), '') AS text,
  CAST(count(*) FILTER (WHERE copy) AS BIGINT) AS n_copies, CAST(count(*) FILTER (WHERE near AND NOT copy) AS BIGINT) AS n_near
FROM x GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
