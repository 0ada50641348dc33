"""Work on all pairs of two tables, in blocks: each pair of blocks is one task, held in numpy in bounded memory; what comes out is exact.

Products of vectors are found by matrix products, which add in any order, and those that may count are added again in the order of the elements, as SQL does."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most elements of a matrix that a task holds at once, and most pairs whose products are added again at once.
CELLS, PAIRS = 1 << 21, 1 << 16
#: Stands for the row of a null, which comes first.
FIRST = -(1 << 63)


def parallel(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def grid(n_left: int, n_right: int, left_mb: float, right_mb: float, out_mb: float, most: tuple[float, float], tasks: int) -> tuple[int, int]:
    """Numbers of blocks of the left and the right side: so many that none is larger than most (MB), then up to tasks pairs of blocks with as little copied as may be. out_mb: results of all right rows in one left block."""
    a, b = max(1, math.ceil(left_mb / most[0])), max(1, math.ceil(right_mb / most[1]))
    while a * b < tasks:
        more_a, more_b = a * 64 <= n_left, b * 16 <= n_right
        if more_a and (not more_b or (right_mb + out_mb) * a <= left_mb * b):
            a += 1
        elif more_b:
            b += 1
        else:
            break
    return a, b


def block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def met(left: DataFrame, right: DataFrame, keys: tuple[str, str], n: tuple[int, int]) -> DataFrame:
    """Each partition holds the rows of a block of the left (is_left) and of one of the right."""
    a, b = n
    every = [F.explode(F.sequence(F.lit(0), F.lit(m - 1))) for m in (b, a)]
    lefts = left.withColumn("ba_", block(keys[0], a)).withColumn("bb_", every[0]).withColumn("is_left", F.lit(True))
    rights = right.withColumn("bb_", block(keys[1], b)).withColumn("ba_", every[1]).withColumn("is_left", F.lit(False))
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("at_", F.col("ba_") * b + F.col("bb_")).drop("ba_", "bb_")
    return both.repartitionById(a * b, F.col("at_")).drop("at_")


def tables(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table] | None:
    """Left and right rows of a partition, None if a side is missing."""
    kept = [*batches]
    whole = pa.Table.from_batches(kept) if kept else None
    if whole is None:
        return None
    left, right = whole.filter(whole["is_left"]), whole.filter(pc.invert(whole["is_left"]))
    return (left, right) if len(left) and len(right) else None


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length (-1: null, or with a null in it): places of the vectors and, a row each, the vectors in double."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    ends = np.cumsum(np.maximum(size, 0))
    if flat.null_count:
        bad = np.searchsorted(ends, np.flatnonzero(pc.is_null(flat).to_numpy(zero_copy_only=False)), "right")
        lengths = size.copy()
        size[bad] = -1
    else:
        lengths = size
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        if d < 0:
            out[-1] = (at, np.empty((0, 0)))
        elif len(at) == len(size):
            out[int(d)] = (at, values.reshape(len(at), d))
        else:
            out[int(d)] = (at, values[(ends - lengths)[at][:, None] + np.arange(d)])
    return out


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """a[i] times b[j], pair by pair, elements added in their order from 0."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        s = slice(at, at + PAIRS)
        x, y = a[i[s]].T.copy(), b[j[s]].T.copy()
        x *= y
        for row in x:
            out[s] += row
    return out


def margin(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a more than twice what two orders of adding may differ by, over all rows of b."""
    norms = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (a, b)]
    return (norms[0] * norms[1].max(initial=0.0) * (a.shape[1] + 4) * 2.0**-50)[:, None]


def above(a: np.ndarray, b: np.ndarray, least: Callable[[np.ndarray], np.ndarray | float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places in a and b) that may be at or above least(their products), and the approximate products."""
    with np.errstate(all="ignore"):
        near = a @ b.T
    if np.isfinite(near).all():
        i, j = np.nonzero(near >= least(near) - margin(a, b))
    else:  # rare: every pair is looked at
        i, j = (x.ravel() for x in np.indices(near.shape))
    return i, j, near[i, j]


def nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """qid, id, row_idx, score of the k best rows of the partition for each query; ties go to the earlier row, nulls to the end."""
    if not (both := tables(batches)):
        return
    rows, asked = both
    order = pc.fill_null(rows["row_idx"].cast(pa.int64()), FIRST).to_numpy()
    by_dim = matrices(rows["embedding"])
    for d, (at_q, q) in matrices(asked["qvec"]).items():
        at_r, r = by_dim.get(d, (np.empty(0, np.int64), np.empty((0, max(d, 0))))) if d >= 0 else (np.empty(0, np.int64), np.empty((0, 0)))
        rest = np.setdiff1d(np.arange(len(order)), at_r) if len(at_r) < k else np.empty(0, np.int64)
        rest = rest[np.argsort(order[rest], kind="stable")][: k - len(at_r)] if len(rest) else rest  # pairs without a product come last
        step = max(1, CELLS // max(1, len(at_r), k))
        for lo in range(0, len(at_q), step):
            own = at_q[lo : lo + step]
            if len(at_r):
                part = q[lo : lo + step]
                i, j, _ = above(part, r, lambda s: np.partition(s, s.shape[1] - k, axis=1)[:, -k, None] if s.shape[1] > k else -np.inf)
                with np.errstate(all="ignore"):
                    score = products(part, r, i, j)
                nan = np.isnan(score)
                best = np.lexsort((order[at_r[j]], -np.where(nan, 0, score), ~nan, i))
                i, j, score = i[best], at_r[j[best]], score[best]
                first = np.searchsorted(i, i, "left")
                keep = np.arange(len(i)) - first < k
                i, j, score = i[keep], j[keep], score[keep]
            else:
                i, j, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            none = np.zeros(len(i) + len(rest) * len(own), bool)
            none[len(i) :] = True
            i = np.concatenate([i, np.repeat(np.arange(len(own)), len(rest))])
            j = np.concatenate([j, np.tile(rest, len(own))])
            score = np.concatenate([score, np.zeros(len(rest) * len(own))])
            yield from pa.table({"qid": asked["qid"].take(own[i]), "id": rows["id"].take(j), "row_idx": rows["row_idx"].take(j), "score": pa.array(score, mask=none)}).combine_chunks().to_batches()


def pairs(batches: Iterator[pa.RecordBatch], threshold: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """a, b, score of all pairs of one row of each block (of the same block: of all its pairs) with a < b and a score at the threshold or above; forest: of these only a, b of as many as keep them connected."""
    kept = [*batches]
    if not kept:
        return
    whole = pa.Table.from_batches(kept)
    whole = whole.filter(pc.is_valid(whole["row_idx"]))
    row_idx, blk = whole["row_idx"].to_numpy(), whole["blk"].to_numpy()
    kind = whole.schema.field("row_idx").type
    group = np.arange(len(row_idx))  # of each row, for the forest
    for d, (at, m) in matrices(whole["embedding"]).items():
        if d < 0:
            continue
        own = blk[at]
        one = own == (own[0] if len(own) else 0)
        left, right = (np.arange(len(at)),) * 2 if one.all() else (np.flatnonzero(one), np.flatnonzero(~one))
        if one.all() and len(np.unique(blk)) > 1:  # the other block has no vector of this length
            continue
        r = m[right]
        step = max(1, CELLS // max(1, len(right)))
        for lo in range(0, len(left), step):
            part = left[lo : lo + step]
            i, j, near = above(m[part], r, lambda _: threshold)
            u, v = at[part[i]], at[right[j]]
            keep = row_idx[u] < row_idx[v] if left is right else row_idx[u] != row_idx[v]
            if forest:
                keep &= group[u] != group[v]
            i, j, u, v = i[keep], j[keep], u[keep], v[keep]
            with np.errstate(all="ignore"):
                score = products(m[part], r, i, j)
            keep = (score >= threshold) | np.isnan(score)
            u, v, score = u[keep], v[keep], score[keep]
            if forest:
                u, v, group = joined(u, v, group)
            a, b = np.minimum(row_idx[u], row_idx[v]), np.maximum(row_idx[u], row_idx[v])
            cols = {"a": pa.array(a, kind), "b": pa.array(b, kind)} | ({} if forest else {"score": pa.array(score)})
            yield from pa.table(cols).to_batches(max_chunksize=1 << 18)


def joined(u: np.ndarray, v: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs that join two groups when taken in turn, and the groups after it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    took = []
    for n, (x, y) in enumerate(zip(group[u].tolist(), group[v].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            took.append(n)
    if root:
        names = np.arange(len(group))
        names[[*root]] = [find(x) for x in root]
        group = names[group]
    return u[took], v[took], group


def overlaps(batches: Iterator[pa.RecordBatch], k: int, unit: float) -> Iterator[pa.RecordBatch]:
    """qid, id, row_idx, total, first_pos of the k best items of the partition for each query, by the sum of their weights (id, row_idx, tid, weight) over the query's terms (qid, pos, tid).

    Ties of total * unit go to the earlier first_pos, then row_idx. Weights are whole numbers, so that sums don't depend on their order."""
    posts, asks = [], []
    for x in batches:  # ids repeat, and are held once
        left = x.column("is_left")
        for side, to, own in ((left, posts, ("id", "row_idx", "tid", "weight")), (pc.invert(left), asks, ("qid", "pos", "tid"))):
            part = x.filter(side)
            if len(part):
                to.append({c: pc.dictionary_encode(part.column(c), null_encoding="encode") if c in ("id", "qid") else pc.fill_null(part.column(c), FIRST) if c == "row_idx" else part.column(c) for c in own})
    if not posts or not asks:
        return

    def column(parts: list, name: str) -> np.ndarray:
        return np.concatenate([p.pop(name).to_numpy(zero_copy_only=False) for p in parts])

    def codes(parts: list, name: str) -> tuple[np.ndarray, pa.Array]:
        whole = pa.chunked_array([p.pop(name) for p in parts]).unify_dictionaries()
        return np.concatenate([c.indices.to_numpy() for c in whole.chunks]), whole.chunk(0).dictionary

    # items, numbered in order of id and row
    code, ids = codes(posts, "id")
    row_idx, tid, weight = (column(posts, c) for c in ("row_idx", "tid", "weight"))  # a null row comes first
    by = np.lexsort((row_idx, code))
    new = np.ones(len(by), bool)
    new[1:] = (np.diff(code[by]) != 0) | (np.diff(row_idx[by]) != 0)
    doc = np.empty(len(by), np.int32)
    doc[by] = np.cumsum(new) - 1
    doc_id, doc_row = code[by[new]], row_idx[by[new]]
    n = len(doc_id)
    del code, row_idx
    # postings in order of term and item, a row for each
    by = np.lexsort((doc, tid))
    tid, doc, weight = tid[by], doc[by], weight[by]
    new = np.ones(len(tid), bool)
    new[1:] = (np.diff(tid) != 0) | (np.diff(doc) != 0)
    if not new.all():
        weight = np.add.reduceat(weight, np.flatnonzero(new))
        tid, doc = tid[new], doc[new]
    terms, starts = np.unique(tid, return_index=True)
    ends = np.append(starts[1:], len(tid))
    plain = not (weight <= 0).any()  # else a sum of 0 may be that of a match
    dense = {}
    for t in np.flatnonzero(ends - starts > n // 4) if plain else ():
        dense[int(t)] = line = np.zeros(n, np.int64)
        line[doc[starts[t] : ends[t]]] = weight[starts[t] : ends[t]]

    q, qids = codes(asks, "qid")
    pos, qtid = column(asks, "pos"), column(asks, "tid")
    at = np.searchsorted(terms, qtid)
    there = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == qtid)
    by = there[np.lexsort((pos[there], q[there]))]
    q, pos, at = q[by], pos[by], at[by]
    bounds = np.append(np.flatnonzero(np.diff(q, prepend=-1)), len(q))
    total, held, rows = np.zeros(n, np.int64), [], 0

    def out() -> Iterator[pa.RecordBatch]:
        i, j, s, f = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from pa.table({"qid": qids.take(pa.array(i)), "id": ids.take(pa.array(doc_id[j])), "row_idx": pa.array(doc_row[j], mask=doc_row[j] == FIRST), "total": pa.array(s), "first_pos": pa.array(f.astype(np.int32))}).to_batches()

    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        total[:] = 0
        own = at[lo:hi].tolist()
        for t in own:
            if t in dense:
                total += dense[t]
            else:
                total[doc[starts[t] : ends[t]]] += weight[starts[t] : ends[t]]
        if plain:
            best = total
            match = None
        else:
            hit = np.zeros(n, bool)
            for t in own:
                hit[doc[starts[t] : ends[t]]] = True
            match = np.flatnonzero(hit)
            best = total[match]
        least = 1 if plain else -(1 << 62)
        if len(best) > k:
            kth = int(np.partition(best, len(best) - k)[-k])
            least = max(least, kth - 8 - (abs(kth) >> 50))  # as whole numbers they may differ and be equal as scores
        some = np.flatnonzero(best >= least)
        some = some if match is None else match[some]
        first = np.full(len(some), np.iinfo(np.int32).max)
        left = np.arange(len(some))
        for t, p in zip(own, pos[lo:hi].tolist(), strict=True):
            docs = doc[starts[t] : ends[t]]
            x = np.minimum(np.searchsorted(docs, some[left]), len(docs) - 1)
            seen = docs[x] == some[left]
            first[left[seen]] = p
            left = left[~seen]
            if not len(left):
                break
        keep = np.lexsort((doc_row[some], first, -(total[some] * unit)))[:k]
        held.append((np.full(len(keep), q[lo]), some[keep], total[some[keep]], first[keep]))
        rows += len(keep)
        if rows > PAIRS:
            yield from out()
            held, rows = [], 0
    if held:
        yield from out()
