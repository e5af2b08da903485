"""Keyed counter-based randomness as Column expressions.

A stream is named by a seed and a key; its n-th draw is a pure function of
both, so draws don't depend on partitioning, order or retries. Fixed values:
FNV-1a's offset and prime, the generator's increment and shifts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF
STEP, ZERO_SEED = 0x6D2B79F5, 0xDEADBEEF


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _l(x: int) -> Column:
    return F.lit(x).cast("long")


def fnv_text(text: str, h: int = OFFSET) -> int:
    for u in memoryview(text.encode("utf-16-le")).cast("H"):
        h = ((h ^ u) * PRIME) & MASK
    return h


def fnv(key: Column, prefix: str = "") -> Column:
    """FNV-1a, 32 bits, over the UTF-16 units of prefix and key; the prefix is folded on the driver."""
    step = lambda h, c: (h.bitwiseXOR(c) * _l(PRIME)).bitwiseAND(_l(MASK))
    unit = lambda c: F.when(c > 0xFFFF, F.array(_l(0xD800) + F.shiftright(c - 0x10000, 10), _l(0xDC00) + (c - 0x10000).bitwiseAND(_l(0x3FF)))).otherwise(F.array(c))
    codes = F.flatten(F.transform(F.split(key, ""), lambda c: unit(F.ascii(c).cast("long"))))
    return F.when(key == "", _l(fnv_text(prefix))).otherwise(F.aggregate(codes, _l(fnv_text(prefix)), step))


def stream(seed: int | Column, key: Column, prefix: str = "") -> Column:
    """The seed of the stream of that key; 0 is replaced."""
    seed = _l(seed & MASK) if isinstance(seed, int) else seed
    return let(seed.bitwiseXOR(fnv(key, prefix)), lambda s: F.when(s == 0, _l(ZERO_SEED)).otherwise(s))


def imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, by halves, so that nothing overflows."""
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(_l(0xFFFF)), 16)
    return (high + a.bitwiseAND(_l(0xFFFF)) * b).bitwiseAND(_l(MASK))


def state(seed: Column, n: int | Column) -> Column:
    """The stream's state after n draws."""
    n = _l(n) if isinstance(n, int) else n.cast("long")
    return (seed + n * _l(STEP)).bitwiseAND(_l(MASK))


def uniform(seed: Column, n: int | Column = 1) -> Column:
    """The n-th draw (from 1) of the stream with this seed, in [0, 1)."""
    x = F.shiftright
    first = lambda a: imul(a.bitwiseXOR(x(a, 15)), a.bitwiseOR(_l(1)))
    second = lambda t: t.bitwiseXOR((t + imul(t.bitwiseXOR(x(t, 7)), t.bitwiseOR(_l(61)))).bitwiseAND(_l(MASK)))
    return let(state(seed, n), lambda a: let(first(a), lambda t: let(second(t), lambda u: u.bitwiseXOR(x(u, 14)) / 4294967296.0)))


def keyed(seed: int, key: Column, n: int | Column = 1, prefix: str = "") -> Column:
    return uniform(stream(seed, key, prefix), n)


def bernoulli(u: Column, p: float | Column) -> Column:
    """u < p; p <= 0 is false and p >= 1 true whatever u."""
    return u < (F.lit(p) if isinstance(p, float | int) else p)


def integer(u: Column, low: int | Column, high: int | Column) -> Column:
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    return (F.floor(u * (high - low + 1)) + low).cast("long")


def pick(u: Column, values: Sequence | Column) -> Column:
    array = values if isinstance(values, Column) else F.array(*map(F.lit, values))
    return F.element_at(array, (F.floor(u * F.size(array)) + 1).cast("int"))


def weighted(u: Column, values: Sequence, weights: Sequence[float]) -> Column:
    """The first value at which the running sum of weights reaches u times their total."""
    if not values or len(values) != len(weights) or sum(weights) <= 0:
        raise ValueError("weighted pick needs as many weights as values and a positive total")
    out, run = None, 0.0
    for v, w in zip(values, weights, strict=True):
        run += w
        out = F.when(u * float(sum(weights)) <= F.lit(run), F.lit(v)) if out is None else out.when(u * float(sum(weights)) <= F.lit(run), F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def normal(seed: Column, n: int | Column = 1, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box-Muller, cosine branch, of draws 2n - 1 and 2n."""
    n = _l(n) if isinstance(n, int) else n.cast("long")
    u1, u2 = F.greatest(uniform(seed, n * 2 - 1), F.lit(1e-15)), uniform(seed, n * 2)
    return F.lit(mean) + F.lit(sd) * F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def substream(seed: Column, key: Column, draws: int = 0) -> Column:
    """A stream that starts from another's state after some draws, by key."""
    return let(state(seed, draws).bitwiseXOR(fnv(key)), lambda s: F.when(s == 0, _l(ZERO_SEED)).otherwise(s))


class Stream:
    """The same streams on the driver, for small ordered work and for tests."""

    def __init__(self, seed: int, key: str | None = None):
        s = (seed & MASK) ^ (fnv_text(key) if key is not None else 0)
        self.state = s or ZERO_SEED

    def next(self) -> float:
        self.state = a = (self.state + STEP) & MASK
        t = ((a ^ a >> 15) * (a | 1)) & MASK
        t ^= (t + ((t ^ t >> 7) * (t | 61) & MASK)) & MASK
        return ((t ^ t >> 14) & MASK) / 4294967296.0

    def integer(self, low: int, high: int) -> int:
        return math.floor(self.next() * (high - low + 1)) + low

    def substream(self, key: str) -> Stream:
        return Stream(self.state, key)
