"""Array expressions on one rail of a signal; both rails take the same expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def head(x: Column, n: int) -> Column:
    """The first n samples; a shorter signal raises."""
    return F.when(F.size(x) >= n, F.slice(x, 1, n)).otherwise(F.raise_error(F.lit("the signal is too short")))


def middle(x: Column, n: int) -> Column:
    """n samples after dropping half of the surplus (rounded up) in front; a shorter signal raises."""
    extra = F.size(x) - n
    return F.when(extra >= 0, F.slice(x, F.ceil(extra / 2).cast("int") + 1, F.lit(n))).otherwise(F.raise_error(F.lit("the signal is too short")))


def padded(x: Column, n: int) -> Column:
    """Zeros on both ends up to n samples, the longer part in front; a longer signal raises."""
    lack = F.lit(n) - F.size(x)
    zero = F.lit(0).cast("double")
    front = F.ceil(lack / 2).cast("int")
    return F.when(lack >= 0, F.concat(F.array_repeat(zero, front), x, F.array_repeat(zero, lack - front))).otherwise(F.raise_error(F.lit("the signal is too long")))


def upsampled(x: Column, rate: int) -> Column:
    """rate - 1 zeros after every sample."""
    if not isinstance(rate, int) or rate < 2:
        raise ValueError("the rate must be a whole number above one")
    return F.flatten(F.transform(x, lambda v: F.concat(F.array(v), F.array_repeat(F.lit(0).cast("double"), rate - 1))))


def interleaved(i: Column, q: Column) -> Column:
    """[i0, q0, i1, q1, ...]"""
    return F.flatten(F.zip_with(i, q, lambda a, b: F.array(a, b)))


def stacked(i: Column, q: Column) -> Column:
    """[i, q]"""
    return F.array(i, q)


def partitioned(h: Column, branches: int) -> Column:
    """Taps as one array a branch, scaled by the branches, the last ones zero-padded."""
    per = F.ceil(F.size(h) / branches).cast("int")
    tap = lambda b, k: F.coalesce(F.get(h, (b + k * branches).cast("int")) * branches, F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(branches - 1)), lambda b: F.transform(F.sequence(F.lit(0), per - 1), lambda k: tap(b, k)))


def srrc(samples_per_symbol: int, span: int, alpha: float) -> Column:
    """Root-raised-cosine taps as an array of doubles."""
    s, a, pi = float(samples_per_symbol), float(alpha), math.pi
    x, y = (1 + a) * pi / (4 * a), (1 - a) * pi / (4 * a)
    edge = 0.5 * ((1 + a) * math.sin(x) - (1 - a) * math.cos(y) + 4 * a / pi * math.sin(y))

    def tap(n: Column) -> Column:
        t = n / s
        arg = (1 - a) * pi * t
        sinc = F.when(t == 0, 1.0).otherwise(F.try_divide(F.sin(arg), arg))
        plain = F.try_divide(F.lit(4 * a / pi), 1 - 16 * a * a * t * t) * (F.cos((1 + a) * pi * t) + (1 - a) * pi / (4 * a) * sinc)
        return F.when(F.abs(n * 4 * a) == s, F.lit(edge)).otherwise(plain)

    m = span * samples_per_symbol
    return F.transform(F.sequence(F.lit(-m), F.lit(m)), lambda n: tap(n.cast("double")))


def gaussian(samples_per_symbol: int, bt: float, span: int = 4) -> Column:
    """Gaussian taps of unit sum as an array of doubles."""
    m, k = span * samples_per_symbol, 2 * math.pi**2 * bt**2 / math.log(2) / samples_per_symbol**2
    raw = F.transform(F.sequence(F.lit(-m), F.lit(m)), lambda n: F.exp(-k * n * n))
    total = F.aggregate(raw, F.lit(0.0), lambda u, v: u + v)
    return F.transform(raw, lambda v: v / total)


def chirp(f0: float, f1: float, n: int) -> tuple[Column, Column]:
    """(i, q) of a linear sweep over n samples, frequencies in cycles a sample."""
    angle = lambda t: 2 * math.pi * (f0 * t + 0.5 * (f1 - f0) / n * t * t)
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(at, lambda t: F.cos(angle(t))), F.transform(at, lambda t: F.sin(angle(t)))
