"""Short-time spectra in long form: a join with the transform's rows, so that SQL can check every value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def stft_power(df: DataFrame, by: list[str], size: int, stride: int) -> DataFrame:
    """(by, frame, bin, power): periodic Blackman window, no centring; bin 0 is the highest frequency.

    ``size`` rows a sample and frame meet ``size`` bins inside one signal, so this form is for small
    transforms; spectrograms of long signals take the kernel.
    """
    if stride <= 0:
        raise ValueError("stride must be positive")
    w = lambda m: 0.42 - 0.5 * F.cos(2 * math.pi * m / size) + 0.08 * F.cos(4 * math.pi * m / size)
    last = F.floor((F.max("n").over(Window.partitionBy(*by)) + 1 - size) / stride)
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / stride)), F.least(F.col("_last"), F.floor(F.col("n") / stride))
    d = df.withColumn("_last", F.greatest(last, F.lit(0))).where(lo <= hi).select(*by, "n", "i", "q", F.explode(F.sequence(lo, hi)).alias("frame"))
    d = d.withColumn("m", F.col("n") - F.col("frame") * stride).withColumn("_w", w(F.col("m")))
    d = d.select(*by, "frame", "m", (F.col("i") * F.col("_w")).alias("i"), (F.col("q") * F.col("_w")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    angle = 2 * math.pi * ((F.col("k") * F.col("m")) % size) / size
    d = d.groupBy(*by, "frame", "k").agg(F.sum(F.col("i") * F.cos(angle) + F.col("q") * F.sin(angle)).alias("re"), F.sum(F.col("q") * F.cos(angle) - F.col("i") * F.sin(angle)).alias("im"))
    bin_ = size - 1 - (F.col("k") + size // 2) % size
    return d.select(*by, F.col("frame").cast("bigint").alias("frame"), bin_.cast("bigint").alias("bin"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def in_db(df: DataFrame, by: list[str]) -> DataFrame:
    """power -> db; empty bins count 1e-10 of the maximum of their signal."""
    top = F.max("power").over(Window.partitionBy(*by))
    p = F.when(F.col("power") == 0, top * 1e-10).otherwise(F.col("power"))
    return df.withColumn("db", 10 * F.log10(p)).drop("power")


def drop_fill(df: DataFrame, by: list[str], drops: list[tuple[int, int]], fill: str, value: str = "db") -> DataFrame:
    """Stretches of the flattened spectrogram (bin-major) filled with a neighbour, mean, zero, min, max, low or ones."""
    flat = F.row_number().over(Window.partitionBy(*by).orderBy("bin", "frame")) - 1
    d = df.withColumn("_f", flat)
    gone = F.lit(False)
    for a, k in drops:
        gone = gone | ((F.col("_f") >= a) & (F.col("_f") < a + k))
    w, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_f")
    keep = F.when(~gone, F.col(value))
    v = {
        "ffill": F.last(keep, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "bfill": F.first(keep, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        "mean": F.avg(value).over(w), "zero": F.lit(0.0), "min": F.min(F.abs(value)).over(w), "max": F.max(F.abs(value)).over(w), "low": F.lit(1e-3), "ones": F.lit(1.0),
    }[fill]
    return d.withColumn(value, F.when(gone, F.coalesce(v, F.lit(0.0))).otherwise(F.col(value))).drop("_f")


def image(df: DataFrame, by: list[str], black_hot: bool = True, value: str = "db") -> DataFrame:
    """Grey value 0..255 of the min-max scaled spectrogram, inverted when black is hot."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    grey = F.floor(F.coalesce(F.try_divide((F.col(value) - lo) * 255.0, hi - lo), F.lit(0.0))).cast("int")
    return df.withColumn("grey", (F.lit(255) - grey) if black_hot else grey)


def occupied_band(df: DataFrame, by: list[str], size: int, sample_rate: float, noise_db: float, low: float, high: float, above_db: float = 3.0) -> DataFrame:
    """(by, peak_db, lower_freq, upper_freq, bandwidth): bins whose maximum over time exceeds the noise by 3 dB, half a bin wider, clipped.

    peak_db is the largest time-averaged bin, the basis of the SNR; signals with no such bin have null edges.
    """
    per = df.groupBy(*by, "bin").agg(F.avg("db").alias("avg_db"), F.max("db").alias("max_db"))
    step = sample_rate / size
    freq = (size - 1 - F.col("bin") - size // 2) * step
    hot = F.when(F.col("max_db") > noise_db + above_db, freq)
    d = per.groupBy(*by).agg(F.max("avg_db").alias("peak_db"), F.min(hot).alias("lo"), F.max(hot).alias("hi"))
    lo, hi = F.greatest(F.col("lo") - step / 2, F.when(F.col("lo").isNotNull(), F.lit(float(low)))), F.least(F.col("hi") + step / 2, F.when(F.col("hi").isNotNull(), F.lit(float(high))))
    return d.select(*by, "peak_db", lo.alias("lower_freq"), hi.alias("upper_freq"), (hi - lo).alias("bandwidth"))
