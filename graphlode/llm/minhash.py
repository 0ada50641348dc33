"""Shingle sets and MinHash signatures of many texts at once, in vectorised numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphlode.llm import common, subword

#: Words in a shingle; a text of fewer words is one shingle.
SHINGLE = 3
#: Shingles that are hashed at once: the arrays stay in the processor's cache.
BLOCK = 1 << 15


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and their distinct shingles as sorted 44-bit hashes. Words count without case and outer punctuation; texts without words have none."""
    texts = common.texts_of(texts)
    n = len(texts)
    parents, flat = common.split_words(texts)
    ids, distinct = common.encode(flat)
    names = subword.normalise(distinct)
    h = common.hash64(common.plain(pc.if_else(pc.equal(pc.binary_length(names), 0), distinct, names)))
    w = h[ids] if len(ids) else np.zeros(0, np.uint64)
    offsets = common.starts_of(parents, n)
    size = np.diff(offsets)
    with np.errstate(over="ignore"):
        pos = np.arange(len(w)) - offsets[parents]
        acc = np.zeros(len(w), np.uint64)
        for j in range(k):
            inside = pos + j < size[parents]
            nxt = np.zeros(len(w), np.uint64)
            nxt[: max(0, len(w) - j)] = w[j:]
            acc += np.where(inside, nxt, np.uint64(0)) * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        acc = common.mix(acc)
    keep = (pos + k <= size[parents]) | ((pos == 0) & (size[parents] < k))
    doc, sh = parents[keep], acc[keep]
    if n >= 1 << 20:
        raise ValueError("at most 2**20 texts at once")
    # one integer sort: the text in the upper 20 bits, 44 bits of the hash below
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (sh >> np.uint64(20)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return np.searchsorted(key, np.arange(n + 1).astype(np.uint64) << np.uint64(44)), key & np.uint64((1 << 44) - 1)


def coefficients(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n members of the multiply-shift family, strongly universal from 32 to 32 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n).astype(np.uint64)


def signatures(offsets: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n hash functions over each text's shingles (texts x n); empty sets have the highest value."""
    mul, add = coefficients(n)
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(full):
            j = i
            while j < len(full) and (j == i or offsets[full[j] + 1] - offsets[full[i]] <= BLOCK):
                j += 1
            a, b = offsets[full[i]], offsets[full[j - 1] + 1]
            x, at = shingles[a:b] >> np.uint64(12), offsets[full[i:j]] - a
            for k in range(n):
                out[full[i:j], k] = np.minimum.reduceat((x * mul[k] + add[k]) >> np.uint64(32), at)
            i = j
    return out
