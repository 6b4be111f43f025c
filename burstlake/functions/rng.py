"""Counter-based random columns: a draw depends on seed, keys and the name of the operation, never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(seed: int, op: str, *keys) -> Column:
    """Uniform in (0, 1): 32 bits of md5 over seed|keys|op."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], F.lit(op))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def gauss(seed: int, op: str, *keys) -> Column:
    """Standard normal by Box-Muller from the draws op.a and op.b."""
    return F.sqrt(-2 * F.log(uniform(seed, op + ".a", *keys))) * F.cos(2 * math.pi * uniform(seed, op + ".b", *keys))


def uniform_sql(seed: int, op: str, *keys: str) -> str:
    """The same draw for DuckDB."""
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in keys)}, '{op}')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)"


def gauss_sql(seed: int, op: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(seed, op + '.a', *keys)})) * cos(2 * pi() * {uniform_sql(seed, op + '.b', *keys)}))"


# --- distributions ------------------------------------------------------------------------------------


def choice(u: Column, values) -> Column:
    """One of the values, each as likely."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * (float(high) - float(low))


def log10_between(u: Column, low: float, high: float) -> Column:
    """10^U(log10 low, log10 high); limits must be above zero."""
    if low <= 0 or high <= 0:
        raise ValueError("limits of a logarithmic range must be positive")
    return F.pow(F.lit(10.0), between(u, math.log10(low), math.log10(high)))


def distribution(params, scaling: str = "linear"):
    """Column builder for a parameter: list -> choice, (low, high) -> range (linear or log10), number -> U(0, number)."""
    if callable(params):
        raise NotImplementedError("callables are not columns")
    if scaling not in ("linear", "log10"):
        raise ValueError(f"unknown scaling {scaling!r}")
    if isinstance(params, list):
        return lambda u: choice(u, params)
    if isinstance(params, tuple) and len(params) == 2:
        return lambda u: (log10_between if scaling == "log10" else between)(u, *params)
    if isinstance(params, (int, float)) and not isinstance(params, bool):
        return lambda u: between(u, 0.0, float(params))
    raise ValueError(f"no distribution for {params!r}")


def normal_integers(u: Column, low: int, high: int) -> Column:
    """Whole number in [low, high)."""
    return (F.lit(low) + F.floor(u * (high - low))).cast("bigint")


def several(seed: int, op: str, n: int, params, scaling: str = "linear", keys=()) -> Column:
    """n independent draws of a distribution as an array."""
    make = distribution(params, scaling)
    return F.array(*[make(uniform(seed, f"{op}.{k}", *keys)) for k in range(n)])
