"""Hashed character n-grams of many words at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are hashed at once; the arrays take about 80 bytes each.
CHUNK = 500_000


def normalise(words: pa.Array) -> pa.Array:
    """Lower case, without what isn't a letter or digit at either end (a word of symbols alone becomes empty)."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def grams(words: list[str], sizes: range, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs [a, b) of words and each n: the bucket of the n-gram at each character, whether it stays in its word, and the offsets of the words.

    Words are written <word>; the same n-grams of any two words share a bucket. Yields one item per run and n."""
    a = 0
    while a < len(words):
        b, size = a, 0
        while b < len(words) and (b == a or size < CHUNK):
            size += len(words[b]) + 2
            b += 1
        cp = np.frombuffer("".join(f"\x02{w}\x03" for w in words[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words[a:b]), np.int64, b - a) + 2
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        left = np.repeat(offsets[1:], lengths) - np.arange(len(cp))
        with np.errstate(over="ignore"):
            h = cp.copy()
            for n in range(1, sizes.stop):
                if n > 1:
                    # the character at the n-gram's end, 0 behind the last one
                    h[:-1] = h[:-1] * np.uint64(0x100000001B3) + np.concatenate([cp[n - 1 :], np.zeros(min(n - 2, len(cp) - 1), np.uint64)])
                if n in sizes:
                    mixed = (h ^ np.uint64(n * 0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
                    yield a, b, ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64), left >= n, offsets
        a = b


def word_sums(words: list[str], table: np.ndarray, sizes: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each word's n-grams (words x columns), and how many n-grams each word has."""
    sums, counts = np.zeros((len(words), table.shape[1])), np.zeros(len(words))
    for a, b, bucket, ok, offsets in grams(words, sizes, bits):
        for k in range(table.shape[1]):
            sums[a:b, k] += np.add.reduceat(np.where(ok, table[bucket, k], 0.0), offsets[:-1])
        counts[a:b] += np.add.reduceat(ok.astype(np.float64), offsets[:-1])
    return sums, counts


def word_buckets(words: list[str], sizes: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, word by word, and the offsets of the words."""
    owner, bucket = [], []
    for a, _, h, ok, offsets in grams(words, sizes, bits):
        owner.append(a + np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[ok])
        bucket.append(h[ok].astype(np.int32))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    owner_, bucket_ = np.concatenate(owner), np.concatenate(bucket)
    del owner, bucket
    order = np.argsort(owner_, kind="stable")
    return bucket_[order], np.searchsorted(owner_[order], np.arange(len(words) + 1))
