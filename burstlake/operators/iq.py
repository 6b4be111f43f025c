"""Operators on signals in long form: one row a sample, ``by`` names the signal, n its position, i and q the rails.

Every window is within one signal, so tasks are split by signal and a signal stays in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rng
from ..kernels.channel import AGC, TABLE_IN_DB, TABLE_OUT_DB, TABLE_PHASE_DEG


def _i() -> Column:
    return F.col("i")


def _q() -> Column:
    return F.col("q")


def to_long(df: DataFrame, *keep: str) -> DataFrame:
    """Arrays i, q -> rows (n, i, q); signals of unequal rails are padded with null, empty ones give no row."""
    return df.select(*keep, F.posexplode(F.arrays_zip("i", "q")).alias("n", "s")).select(*keep, F.col("n").cast("bigint").alias("n"), "s.i", "s.q")


def to_array(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows -> arrays i, q in the order of n, whatever order the shuffle left."""
    s = F.array_sort(F.collect_list(F.struct("n", "i", "q")))
    return df.groupBy(*by).agg(s.alias("s")).select(*by, F.col("s.i").alias("i"), F.col("s.q").alias("q"))


def _w(by):
    return Window.partitionBy(*by).orderBy("n")


def _all(by):
    return Window.partitionBy(*by)


def power() -> Column:
    return _i() * _i() + _q() * _q()


def times(re: Column, im: Column) -> dict[str, Column]:
    """Complex product of the sample with re + j im."""
    return {"i": _i() * re - _q() * im, "q": _i() * im + _q() * re}


def add_slope(df, by):
    """z[n] + (z[n] - z[n-1]); the first slope is 0."""
    w = _w(by)
    return df.withColumns({c: F.col(c) * 2 - F.coalesce(F.lag(c).over(w), F.col(c)) for c in ("i", "q")})


def channel_swap(df):
    return df.withColumns({"i": _q(), "q": _i()})


def spectral_inversion(df):
    return df.withColumn("q", -_q())


def phase_offset(df, phase: Column):
    return df.withColumns(times(F.cos(phase), F.sin(phase)))


def frequency_shift(df, frequency: Column, sample_rate: Column):
    angle = 2 * math.pi * frequency * F.col("n") / sample_rate
    return df.withColumns(times(F.cos(angle), F.sin(angle)))


def time_reversal(df, by, invert: Column | None = None):
    """Reversed order; where ``invert`` holds the spectrum is inverted too."""
    top = F.max("n").over(_all(by))
    out = df.withColumn("n", top - F.col("n"))
    return out if invert is None else out.withColumn("q", F.when(invert, -_q()).otherwise(_q()))


def coarse_gain(df, gain_db: Column, start: Column):
    g = F.when(F.col("n") >= start, F.pow(F.lit(10.0), gain_db / 10)).otherwise(1.0)
    return df.withColumns({"i": _i() * g, "q": _q() * g})


def cut_out(df, by, start: float, duration: float, fill: str = "zeros", seed: int = 0):
    """[start, start + duration) of the signal (fractions) becomes zeros, 1+1j or noise (low -100 dB, avg, high 40 dB)."""
    n = F.count(F.lit(1)).over(_all(by))
    a = F.floor(F.lit(start) * n)
    inside = (F.col("n") >= a) & (F.col("n") < a + F.floor(n * duration))
    if fill in ("zeros", "ones"):
        v = F.lit(0.0 if fill == "zeros" else 1.0)
        return df.withColumns({"i": F.when(inside, v).otherwise(_i()), "q": F.when(inside, v).otherwise(_q())})
    if fill not in ("low_noise", "avg_noise", "high_noise"):
        raise ValueError(f"unknown fill {fill}")
    level = {"low_noise": F.lit(10.0 ** (-100 / 20)), "high_noise": F.lit(10.0 ** (40 / 20))}.get(fill, F.avg(power()).over(_all(by)))
    g = lambda c: level * rng.gauss(seed, f"cut.{c}", *by, "n") / math.sqrt(2)
    return df.withColumns({"i": F.when(inside, g("i")).otherwise(_i()), "q": F.when(inside, g("q")).otherwise(_q())})


def normalize(df, by, order: float = 2):
    """Divided by the 1-, 2- or infinity-norm of the signal; a zero signal stays zero."""
    mag = F.sqrt(power())
    w = _all(by)
    norm = {1: F.sum(mag).over(w), 2: F.sqrt(F.sum(power()).over(w)), math.inf: F.max(mag).over(w)}[order]
    return df.withColumn("_n", norm).withColumns({c: F.when(F.col("_n") > 0, F.col(c) / F.col("_n")).otherwise(F.col(c)) for c in ("i", "q")}).drop("_n")


def quantize(df, by, bits: int, ref_db: float = 0.0, rounding: str = "floor"):
    """Mid-tread levels k/2^(bits-1) of the peak-scaled signal; NaN or infinite samples raise, a zero signal stays zero."""
    if not isinstance(bits, int):
        raise TypeError("bits must be an integer")
    more = {"floor": 0.5, "ceiling": 1.5}[rounding]
    half, ref = float(2 ** (bits - 1)), 10 ** (ref_db / 20)
    bad = F.isnan(_i()) | F.isnan(_q()) | (F.abs(_i()) == float("inf")) | (F.abs(_q()) == float("inf"))
    peak = F.max(F.when(bad, F.raise_error(F.lit("NaN or infinite samples"))).otherwise(F.greatest(F.abs(_i()), F.abs(_q())))).over(_all(by))
    level = lambda c: F.when(F.col("_p") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-half), F.least(F.lit(half - 1), F.floor(F.try_divide(c * ref, F.col("_p")) * half + more).cast("double"))) / half * F.col("_p") / ref)
    return df.withColumn("_p", peak).withColumns({"i": level(_i()), "q": level(_q())}).drop("_p")


def nonlinear_amplifier(df, by, gain=1.0, backoff=10.0, phi_max=0.1, phi_slope=0.01):
    """tanh saturation at backoff x mean power with a tanh phase shift; no rescaling of the spectral peak."""
    d = df.withColumn("_s", F.avg(power()).over(_all(by)) * backoff)
    p, s = power(), F.col("_s")
    mag = F.sqrt(s * F.tanh(F.coalesce(F.try_divide(p, s / gain), F.lit(0.0))))
    shift = phi_max / 2 * (F.tanh((p - s / gain) / abs(phi_slope)) + 1) if phi_max and phi_slope else F.lit(0.0)
    angle = F.atan2(_q(), _i()) + shift
    return d.withColumns({"i": mag * F.cos(angle), "q": mag * F.sin(angle)}).drop("_s")


def _piecewise(x: Column, xs, ys) -> Column:
    """Linear interpolation between knots, clamped at the ends."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for (a, b), (u, v) in zip(zip(xs, xs[1:]), zip(ys, ys[1:])):
        out = out.when(x <= b, u + (x - a) * ((v - u) / (b - a)))
    return out.otherwise(F.lit(float(ys[-1])))


def amplifier_table(df, p_in=None, p_out=None, phi=None):
    """Tabulated AM/AM and AM/PM curves; tables of unequal length raise ValueError."""
    p_in = [10 ** (x / 10) for x in TABLE_IN_DB] if p_in is None else p_in
    p_out = [10 ** (x / 10) for x in TABLE_OUT_DB] if p_out is None else p_out
    phi = [math.radians(x) for x in TABLE_PHASE_DEG] if phi is None else phi
    if not len(p_in) == len(p_out) == len(phi):
        raise ValueError("the tables differ in length")
    mag, angle = F.sqrt(_piecewise(power(), p_in, p_out)), F.atan2(_q(), _i()) + _piecewise(power(), p_in, phi)
    return df.withColumns({"i": mag * F.cos(angle), "q": mag * F.sin(angle)})


def intermodulation(df, coeffs=(1.0, 0.0, 0.1)):
    """sum c_k |z|^k z without rescaling; even-order terms must be zero."""
    if not coeffs:
        raise IndexError("no coefficients")
    if any(c != 0 for c in coeffs[1::2]):
        raise ValueError("even-order coefficients must be zero")
    g = F.lit(float(coeffs[0]))
    for k in range(2, len(coeffs), 2):
        g = g + coeffs[k] * F.pow(power(), F.lit(k / 2))
    return df.withColumns({"i": _i() * g, "q": _q() * g})


def iq_imbalance(df, by, amplitude_db, phase, dc_db, dc_phase, noise_power_db):
    """Rail gain, skew and an offset dc_db above the known noise floor."""
    g, c, s = 10 ** (amplitude_db / 10), math.cos(phase / 2), math.sin(phase / 2)
    n = F.count(F.lit(1)).over(_all(by))
    dc = F.pow(F.lit(10.0), (noise_power_db + 10 * F.log10(n) - 20 * F.log10(n) + dc_db) / 20)
    # e^{-j p/2} i + e^{j(pi/2 + p/2)} q
    return df.withColumn("_d", dc).withColumns({"i": g * (c * _i() - s * _q()) + F.col("_d") * math.cos(dc_phase), "q": g * (c * _q() - s * _i()) + F.col("_d") * math.sin(dc_phase)}).drop("_d")


def spurs(df, by, freqs, power_db, noise_power_db, sample_rate=1.0):
    """Tones at ``freqs`` relative to the known noise floor; the tone peak is 20 log10 N at bin frequencies."""
    if len(freqs) != len(power_db):
        raise ValueError("one power for each frequency")
    if any(abs(f) >= sample_rate / 2 for f in freqs):
        raise ValueError("spur frequencies must lie within half the sample rate")
    d = df.withColumn("_n", F.count(F.lit(1)).over(_all(by)))
    i, q = _i(), _q()
    for f, p in zip(freqs, power_db):
        g = F.pow(F.lit(10.0), (noise_power_db - 10 * F.log10("_n") + p) / 20)
        angle = 2 * math.pi * f / sample_rate * F.col("n")
        i, q = i + g * F.cos(angle), q + g * F.sin(angle)
    return d.withColumns({"i": i, "q": q}).drop("_n")


def drop_samples(df, by, drops: list[tuple[int, int]], fill: str):
    """Non-overlapping stretches (start, size) filled with the neighbour before or after, the mean or zero."""
    n = F.col("n")
    gone = F.lit(False)
    for a, k in drops:
        gone = gone | ((n >= a) & (n < a + k))
    w = _w(by)
    if fill in ("ffill", "bfill"):
        frame = w.rowsBetween(Window.unboundedPreceding, 0) if fill == "ffill" else w.rowsBetween(0, Window.unboundedFollowing)
        pick = F.last if fill == "ffill" else F.first
        value = lambda c: F.coalesce(pick(F.when(~gone, F.col(c)), ignorenulls=True).over(frame), F.lit(0.0))
    elif fill == "mean":
        value = lambda c: F.avg(c).over(_all(by))
    elif fill == "zero":
        value = lambda c: F.lit(0.0)
    else:
        raise ValueError(f"unknown fill {fill}")
    return df.withColumns({c: F.when(gone, value(c)).otherwise(F.col(c)) for c in ("i", "q")})


def fir(df, by, taps: list[float]):
    """Convolution with real taps, as long as the input, the delay of the taps removed."""
    w = _w(by)
    lead = 1 if len(taps) == 2 else len(taps) // 2
    def one(c):
        out = F.lit(0.0)
        for k, h in enumerate(taps):
            out = out + F.coalesce(F.lag(c, k - lead).over(w), F.lit(0.0)) * h
        return out
    return df.withColumns({c: one(c) for c in ("i", "q")})


def moving_average(df, by, size: int, column: str, out: str):
    """Mean over the last ``size`` rows (fewer at the start)."""
    return df.withColumn(out, F.avg(column).over(_w(by).rowsBetween(-(size - 1), 0)))


def upsample(df, rate: int):
    """rate - 1 zero rows after every sample."""
    k = F.explode(F.sequence(F.lit(0), F.lit(rate - 1))).alias("_k")
    d = df.select("*", k)
    return d.withColumns({"n": F.col("n") * rate + F.col("_k"), "i": F.when(F.col("_k") == 0, _i()).otherwise(0.0), "q": F.when(F.col("_k") == 0, _q()).otherwise(0.0)}).drop("_k")


def decimate(df, rate: int):
    return df.where(F.col("n") % rate == 0).withColumn("n", F.floor(F.col("n") / rate))


def agc(df, by, initial_gain_db: float = 0.0, **params):
    """Sequential gain control as one fold over the samples of a signal; quadratic in the length, for short signals.

    Long signals take the kernel (channel.agc), streams the stateful operator.
    """
    p = AGC | params
    d = to_array(df, by)
    state = F.struct(F.lit(0.0).alias("level"), F.lit(float(initial_gain_db)).alias("gain"), F.lit(0).alias("k"), F.array().cast("array<double>").alias("out"))

    def step(acc, z):
        mag = F.sqrt(z["i"] * z["i"] + z["q"] * z["q"])
        log = F.log(F.when(mag > 0, mag).otherwise(1.0))
        level = F.when(mag == 0, -200.0).when(acc["k"] == 0, log).otherwise(acc["level"] * p["alpha_smooth"] + log * (1 - p["alpha_smooth"]))
        out = level + acc["gain"]
        lack = p["ref_level_db"] - out
        rate = F.when(level <= p["low_level_db"], 0.0).when(out >= p["high_level_db"], p["alpha_overflow"]).when(F.abs(lack) > p["track_range_db"], p["alpha_acquire"]).otherwise(p["alpha_track"])
        gain = acc["gain"] + lack * rate
        return F.struct(level.alias("level"), gain.alias("gain"), (acc["k"] + 1).alias("k"), F.concat(acc["out"], F.array(gain)).alias("out"))

    gains = F.aggregate(F.arrays_zip("i", "q"), state, step, lambda acc: acc["out"])
    d = d.select(*by, F.posexplode(F.arrays_zip("i", "q", gains.alias("g"))).alias("n", "s"))
    e = F.exp(F.col("s")["g"])
    return d.select(*by, F.col("n").cast("bigint").alias("n"), (F.col("s")["i"] * e).alias("i"), (F.col("s")["q"] * e).alias("q"))


# --- random ---------------------------------------------------------------------------------------------------


def awgn(df, by, noise_power_db: float, seed: int = 0):
    g = 10 ** (noise_power_db / 20) / math.sqrt(2)
    return df.withColumns({"i": _i() + g * rng.gauss(seed, "awgn.i", *by, "n"), "q": _q() + g * rng.gauss(seed, "awgn.q", *by, "n")})


def phase_noise(df, by, degrees: float, seed: int = 0):
    return phase_offset(df, rng.gauss(seed, "phase", *by, "n") * math.radians(degrees))


def frequency_drift(df, by, drift_ppm: float, seed: int = 0):
    d = df.withColumn("_d", rng.gauss(seed, "drift", *by, "n") * (drift_ppm * 1e-6))
    angle = F.sum("_d").over(_w(by).rowsBetween(Window.unboundedPreceding, 0)) * (2 * math.pi)
    return phase_offset(d.withColumn("_a", angle), F.col("_a")).drop("_d", "_a")


def shadowing(df, by, mean_db: float, sigma_db: float, seed: int = 0):
    g = F.pow(F.lit(10.0), (mean_db + sigma_db * rng.gauss(seed, "shadow", *by)) / 20)
    return df.withColumns({"i": _i() * g, "q": _q() * g})


def time_varying_noise(df, by, low: float, high: float, inflections: int, seed: int = 0):
    """AWGN whose level runs in straight lines between low and high over equal regions; the rest of the division stays at 0 dB."""
    total = F.count(F.lit(1)).over(_all(by))
    d = df.withColumn("_r", F.floor(total / (inflections + 1)))
    part = F.floor(F.col("n") / F.col("_r"))
    at = F.try_divide(F.col("n") - part * F.col("_r"), F.col("_r") - 1)
    rise = low + (high - low) * F.coalesce(at, F.lit(0.0))
    fall = high + (low - high) * F.coalesce(at, F.lit(0.0))
    db = F.when(part > inflections, 0.0).when(part % 2 == 0, rise).otherwise(fall)
    g = F.pow(F.lit(10.0), db / 20) / math.sqrt(2)
    return d.withColumns({"i": _i() + g * rng.gauss(seed, "tvn.i", *by, "n"), "q": _q() + g * rng.gauss(seed, "tvn.q", *by, "n")}).drop("_r")


def patch_shuffle(df, by, size: int, patches: list[int], seed: int = 0):
    """Samples within the named patches change places at random."""
    patch = F.floor(F.col("n") / size)
    d = df.withColumn("_p", patch).withColumn("_u", F.when(patch.isin(*patches), rng.uniform(seed, "patch", *by, "n")).otherwise(F.col("n").cast("double")))
    place = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_u", "n")) - 1
    return d.withColumn("n", F.col("_p") * size + place).drop("_p", "_u")


def random_apply(df, by, probability: float, change: dict[str, Column], seed: int = 0, op: str = "apply"):
    """The change of columns, for the signals whose draw is below the probability."""
    hit = rng.uniform(seed, op, *by) < probability
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in change.items()})


def rand_augment(df, by, changes: list[tuple[str, dict[str, Column]]], choose: int, seed: int = 0):
    """``choose`` of the named changes for each signal, without replacement, in the order of the list.

    The order matters only for changes that do not commute; drawn orders are for the kernel pipeline.
    """
    names = [n for n, _ in changes]
    us = F.array_sort(F.array(*[F.struct(rng.uniform(seed, f"augment.{n}", *by).alias("u"), F.lit(n).alias("n")) for n in names]))
    d = df.withColumn("_c", F.transform(F.slice(us, 1, choose), lambda s: s["n"]))
    for n, change in changes:
        d = d.withColumns({c: F.when(F.array_contains("_c", n), v).otherwise(F.col(c)) for c, v in change.items()})
    return d.drop("_c")
