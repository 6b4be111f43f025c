"""Scalar expressions: frequencies, lengths, derived metadata, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_even(n: Column) -> Column:
    return F.pmod(n, F.lit(2)) == 0


def is_odd(n: Column) -> Column:
    return F.pmod(n, F.lit(2)) == 1


def is_multiple_of_4(n: Column) -> Column:
    return F.pmod(n, F.lit(4)) == 0


def center_freq(lower: Column, upper: Column) -> Column:
    return (lower + upper) / 2


def bandwidth(lower: Column, upper: Column) -> Column:
    return upper - lower


def lower_freq(center: Column, width: Column) -> Column:
    return center - width / 2


def upper_freq(center: Column, width: Column) -> Column:
    return center + width / 2


def tone_bandwidth(sample_rate: Column, samples: Column) -> Column:
    """Resolution of a tone; null for an empty signal."""
    return F.try_divide(sample_rate, samples)


def filter_length(transition: Column, attenuation_db: Column, sample_rate: Column) -> Column:
    """fs/transition * attenuation/22, rounded half to even and made odd."""
    n = F.bround(F.try_divide(sample_rate, transition) * (attenuation_db / 22)).cast("bigint")
    return F.when(is_even(n), n + 1).otherwise(n)


def clipped_band(center: Column, width: Column, low: float, high: float) -> tuple[Column, Column]:
    """(center, bandwidth) of the box after the part beyond the limits is filtered off, on both sides."""
    a, b = F.greatest(lower_freq(center, width), F.lit(float(low))), F.least(upper_freq(center, width), F.lit(float(high)))
    return (a + b) / 2, F.greatest(b - a, F.lit(0.0))


def with_derived(df: DataFrame, total: str = "num_iq_samples_dataset") -> DataFrame:
    """Adds start, stop, duration (fractions of the dataset length), stop_in_samples, edges and oversampling rate.

    A missing or zero divisor gives null; existing columns of these names are replaced.
    """
    n, end = F.col(total), F.col("start_in_samples") + F.col("duration_in_samples")
    new = {
        "stop_in_samples": end,
        "start": F.try_divide(F.col("start_in_samples"), n),
        "stop": F.try_divide(end, n),
        "duration": F.try_divide(F.col("duration_in_samples"), n),
        "lower_freq": lower_freq(F.col("center_freq"), F.col("bandwidth")),
        "upper_freq": upper_freq(F.col("center_freq"), F.col("bandwidth")),
        "oversampling_rate": F.try_divide(F.col("sample_rate"), F.col("bandwidth")),
    }
    return df.withColumns(new)


def with_stop(df: DataFrame, stop: Column, total: str = "num_iq_samples_dataset") -> DataFrame:
    """Sets the end as a fraction of the dataset length: the duration follows."""
    return df.withColumn("duration_in_samples", (stop * F.col(total)).cast("bigint") - F.col("start_in_samples"))


def with_edges(df: DataFrame, lower: Column | None = None, upper: Column | None = None) -> DataFrame:
    """Sets one or both band edges; the other edge stays, center and bandwidth follow."""
    lo = lower if lower is not None else lower_freq(F.col("center_freq"), F.col("bandwidth"))
    hi = upper if upper is not None else upper_freq(F.col("center_freq"), F.col("bandwidth"))
    return df.withColumns({"center_freq": center_freq(lo, hi), "bandwidth": bandwidth(lo, hi)})


# --- checks -----------------------------------------------------------------------------------------------


def checked(x: Column, name: str, low=None, high=None, clip_low=False, clip_high=False, exclude_low=False, exclude_high=False) -> Column:
    """x within its bounds: clipped where asked for, else an error that names it.  Null stays null.

    A bound that is excluded cannot be clipped to, so it raises.
    """
    out = x
    for bound, clip, exclude, below in ((low, clip_low, exclude_low, True), (high, clip_high, exclude_high, False)):
        if bound is None:
            continue
        bad = (x < bound) if below else (x > bound)
        bad = (bad | (x == bound)) if exclude else bad
        if clip and not exclude:
            out = F.greatest(out, F.lit(bound)) if below else F.least(out, F.lit(bound))
        else:
            out = F.when(bad, F.raise_error(F.concat(F.lit(f"{name} is out of bounds: "), x.cast("string")))).otherwise(out)
    return F.when(x.isNull(), x).otherwise(out)


def checked_whole(x: Column, name: str, low=0, high=None, **how) -> Column:
    """checked() of a value that must be a whole number (of any numeric type), as bigint; others raise.  Null stays null."""
    whole = F.when(x == F.floor(x), F.floor(x).cast("bigint")).when(x.isNotNull(), F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), x.cast("string"))).cast("bigint"))
    return checked(whole, name, low, high, **how)


def checked_array(values: Column, name: str, least: int | None = None, most: int | None = None, exact: int | None = None) -> Column:
    """The array itself if its length is within the limits and every element is finite, else an error that names it.  Null stays null."""
    out, n = values, F.size(values)
    for bad, what in ((least is not None and n < least, f"shorter than {least}"), (most is not None and n > most, f"longer than {most}"), (exact is not None and n != exact, f"not of length {exact}"), (~all_finite(values), "not finite")):
        if bad is not False:
            out = F.when(bad, F.raise_error(F.lit(f"{name} is {what}"))).otherwise(out)
    return F.when(values.isNotNull(), out)


def checked_text(x: Column, name: str, valid=(), form: str = "lower") -> Column:
    """Trimmed and cased text; values outside ``valid`` raise.  form: lower, upper, title or none."""
    how = {"lower": F.lower, "upper": F.upper, "title": F.initcap, "none": lambda c: c}[form]
    out = how(F.trim(x))
    if valid:
        out = F.when(out.isin(*valid) | out.isNull(), out).otherwise(F.raise_error(F.concat(F.lit(f"{name} has an unknown value: "), out)))
    return out


def shares(weights: Column) -> Column:
    """Weights of an array divided by their sum; a sum of zero gives null."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.when(total != 0, F.transform(weights, lambda w: w / total))


def all_finite(values: Column) -> Column:
    """True if no element is null, NaN or infinite; an empty array passes."""
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def no_duplicates(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def has_keys(values: Column, keys) -> Column:
    """True if a map has all keys."""
    out = F.lit(True)
    for k in keys:
        out = out & F.map_contains_key(values, F.lit(k))
    return out


class MetadataError(AttributeError, ValueError):
    """Metadata that an operator needs is missing or of another type."""


def require(df: DataFrame, columns: dict[str, str] | list[str]) -> DataFrame:
    """df itself if it has the columns (with these types), else MetadataError; checked before anything runs."""
    have = dict(df.dtypes)
    for c in columns:
        if c not in have:
            raise MetadataError(f"missing column {c}")
        if isinstance(columns, dict) and columns[c] != have[c]:
            raise MetadataError(f"column {c} is {have[c]}, not {columns[c]}")
    return df


def names_any(name: Column, possible) -> Column:
    """True if any of the given names occurs in the class name."""
    return F.exists(F.array(*[F.lit(p) for p in possible]), lambda p: F.contains(F.lower(name), p))
