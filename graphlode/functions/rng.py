"""A counter-based 32-bit generator as Column expressions: draw n of a seed is a pure function, so draws need no order of execution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 4294967295
STEP = 0x6D2B79F5


def _imul(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of two values below 2**32, without overflow."""
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(65535).cast("bigint")) * 65536
    return (high + a.bitwiseAND(F.lit(65535).cast("bigint")) * b).bitwiseAND(F.lit(M32).cast("bigint"))


def draw(seed: Column, n: Column) -> Column:
    """The n-th draw (from 1) in [0, 1) of a seed."""
    mask = F.lit(M32).cast("bigint")
    a = (seed.cast("bigint") + _imul(n.cast("bigint").bitwiseAND(mask), F.lit(STEP).cast("bigint"))).bitwiseAND(mask)
    t = _imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("bigint")))
    t = (t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint")))).bitwiseAND(mask).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / 4294967296.0


def draw_py(seed: int, n: int) -> float:
    a = (seed + n * STEP) & M32
    t = ((a ^ (a >> 15)) * (a | 1)) & M32
    t = ((t + (((t ^ (t >> 7)) * (t | 61)) & M32)) & M32) ^ t
    return (t ^ (t >> 14)) / 4294967296.0


def fnv1a_py(text: str) -> int:
    """FNV-1a of 32 bits over UTF-16 units."""
    raw, h = text.encode("utf-16-le", "surrogatepass"), 2166136261
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 16777619) & M32
    return h


def shuffled(n: int, seed: int) -> list[int]:
    """A Fisher-Yates order of range(n), from the end."""
    order = [*range(n)]
    for k, i in enumerate(range(n - 1, 0, -1), 1):
        j = int(draw_py(seed, k) * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order
