"""Queries on filter design, resampling and single kernels: one row a case, run on the executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..kernels import assemble, channel, dsp, modulators

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q(f):
    QUERIES[f.__name__] = f
    return f


def _cases(spark, rows, schema, out, function):
    """One row a case in, any rows out."""

    def run(frames):
        for pdf in frames:
            got = [r for case in pdf.itertuples(index=False) for r in function(*case)]
            yield pd.DataFrame(got, columns=[c.split()[0] for c in out.split(", ")])

    return spark.createDataFrame(rows, schema).repartition(min(len(rows), spark.sparkContext.defaultParallelism)).mapInPandas(run, out)


@q
def dsp_low_pass(spark, d):
    """Kaiser low-pass taps, plain and grown to their measured attenuation: length, gain at 0 Hz, stop band."""

    def one(cutoff, width):
        for kind, f in (("plain", dsp.low_pass), ("measured", dsp.low_pass_measured)):
            h = f(cutoff, width, 1.0)
            yield kind, cutoff, width, len(h), round(float(h.sum()), 9), bool(dsp.stopband_db(h, cutoff + width / 2, 1.0) >= (119.9 if kind == "measured" else 100))

    return _cases(spark, [(0.1, 0.05), (0.25, 0.1), (0.05, 0.01)], "cutoff double, width double", "kind string, cutoff double, width double, taps int, gain double, attenuates boolean", one)


@q
def dsp_half_band(spark, d):
    """Half-band taps of the stages: length, zero taps."""
    return _cases(spark, [(k,) for k in range(4)], "stage int", "stage int, taps int, zeros int", lambda k: [(k, len(h := dsp.half_band(k)), int((h == 0).sum()))])


@q
def dsp_prototypes(spark, d):
    """Prototype filters of polyphase banks: length and gain."""
    return _cases(spark, [(b,) for b in (2, 3, 8, 5000, 10000)], "branches int", "branches int, taps int, gain double", lambda b: [(b, len(h := dsp.prototype(b)), round(float(h.sum()), 9))])


@q
def dsp_resample(spark, d):
    """A tone at 0.03 after resampling by each rate: length and where its peak lies."""

    def one(rate):
        y = dsp.resample(np.exp(2j * np.pi * 0.03 * np.arange(4096)), rate)
        peak = np.argmax(np.abs(np.fft.fft(y * np.hanning(len(y)), 1 << 16))) / (1 << 16)
        yield rate, len(y), bool(abs(peak - 0.03 / rate) < 1e-4)

    return _cases(spark, [(r,) for r in (0.2, 0.25, 0.6, 1.0, 1.37, 2.0, 3.0, 5.7)], "rate double", "rate double, n int, peak_in_place boolean", one)


@q
def dsp_interpolate(spark, d):
    """Half-band interpolation by powers of two, whole-number interpolation and decimation: lengths."""

    def one(rate):
        x = np.ones(500, complex)
        yield rate, len(dsp.interpolate_halfband(x, rate)), len(dsp.interpolate_integer(x, rate)), len(dsp.decimate_integer(x, rate))

    return _cases(spark, [(r,) for r in (2, 4, 8)], "rate int", "rate int, half_band int, whole int, decimated int", one)


@q
def dsp_noise(spark, d):
    """Mean power of the noise colours, continuous and impulsive, and the power of the frequency that their spectrum falls with."""

    def one(color, continuous, power):
        x = dsp.noise(16_384, power, color, continuous, np.random.default_rng(1))
        f, p = np.arange(1, 8192), np.abs(np.fft.fft(x)[1:8192]) ** 2
        edges = 2 ** np.arange(1, 14)
        bands = [(np.log(f[(f >= a) & (f < b)]).mean(), np.log(p[(f >= a) & (f < b)].mean())) for a, b in zip(edges[3:], edges[4:])]
        yield color, continuous, power, round(float(np.mean(np.abs(x) ** 2)), 9), int(round(np.polyfit(*zip(*bands), 1)[0]))

    rows = [(c, k, p) for c in ("white", "pink", "red") for k in (True, False) for p in (0.5, 2.0)]
    return _cases(spark, rows, "color string, continuous boolean, power double", "color string, continuous boolean, power double, mean_power double, slope int", one)


SQL["dsp_noise"] = "SELECT color, continuous, power, power AS mean_power, slope FROM (SELECT unnest(['white', 'pink', 'red']) AS color, unnest([0, -1, -2]) AS slope) CROSS JOIN (SELECT unnest([true, false]) AS continuous) CROSS JOIN (SELECT unnest([0.5e0, 2e0]) AS power)"
# Lengths grown to a measured stop band have no formula: fixed values, found once; the other columns follow from the rule.
SQL["dsp_low_pass"] = """WITH c AS (SELECT unnest([0.1e0, 0.25e0, 0.05e0]) AS cutoff, unnest([0.05e0, 0.1e0, 0.01e0]) AS width, unnest([159, 81, 785]) AS grown), p AS (SELECT *, round_even(1 / width * 120 / 22, 0)::BIGINT AS n FROM c)
SELECT 'plain' AS kind, cutoff, width, (n + 1 - n % 2)::INTEGER AS taps, 1e0 AS gain, false AS attenuates FROM p UNION ALL SELECT 'measured', cutoff, width, grown::INTEGER, 1e0, true FROM p"""
SQL["dsp_prototypes"] = "SELECT branches::INTEGER AS branches, taps::INTEGER AS taps, 1e0 AS gain FROM (SELECT unnest([2, 3, 8, 5000, 10000]) AS branches, unnest([35, 49, 129, 79375, 158751]) AS taps)"
SQL["dsp_resample"] = "SELECT rate, n::INTEGER AS n, true AS peak_in_place FROM (SELECT unnest([0.2e0, 0.25e0, 0.6e0, 1e0, 1.37e0, 2e0, 3e0, 5.7e0]) AS rate, unnest([819, 1024, 2458, 4096, 5611, 8192, 12288, 23340]) AS n)"
SQL["dsp_interpolate"] = "SELECT rate::INTEGER AS rate, (500 * rate)::INTEGER AS half_band, (500 * rate)::INTEGER AS whole, round_even(500e0 / rate, 0)::INTEGER AS decimated FROM (SELECT unnest([2, 4, 8]) AS rate)"
SQL["dsp_clock"] = "SELECT kind, ppm, 4096::INTEGER AS n, true AS keeps_power FROM (SELECT unnest(['drift', 'jitter']) AS kind) CROSS JOIN (SELECT unnest([1e0, 10e0]) AS ppm)"
SQL["dsp_snr"] = "SELECT snr_db, snr_db AS peak_db, true AS band_found FROM (SELECT unnest([10e0, 20e0, 30e0]) AS snr_db)"
SQL["dsp_doppler"] = "SELECT velocity, 8192::INTEGER AS n, true AS moved FROM (SELECT unnest([-3e6, 0e0, 3e6]) AS velocity)"
SQL["dsp_half_band"] = """WITH w AS (SELECT stage, 2 * (0.25e0 - 0.25e0 * 0.8e0 / pow(2, stage)) AS width FROM (SELECT unnest(range(4)) AS stage)), l AS (SELECT stage, round_even(1 / width * (120e0 / 22), 0)::BIGINT AS n FROM w), k AS (SELECT stage, 4 * ceil((n + 1 - n % 2 + 1) / 4e0)::BIGINT - 1 AS taps FROM l)
SELECT stage::INTEGER AS stage, taps::INTEGER AS taps, (2 * ((taps // 2) // 2))::INTEGER AS zeros FROM k"""


@q
def dsp_anti_alias(spark, d):
    """Bands against the limits +-2 MHz: the box that stays."""
    rows = [(c, w) for c in (-2.2e6, -1.5e6, 0.0, 1.5e6, 2.2e6) for w in (0.5e6, 1.5e6)]
    return _cases(spark, rows, "center double, width double", "center double, width double, box_center double, box_width double", lambda c, w: [(c, w, *map(float, dsp.anti_alias(np.ones(256, complex), c, w, 10e6, -2e6, 2e6)[1:]))])


SQL["dsp_anti_alias"] = """SELECT center, width, (greatest(center - width / 2, -2e6) + least(center + width / 2, 2e6)) / 2 AS box_center, greatest(least(center + width / 2, 2e6) - greatest(center - width / 2, -2e6), 0e0) AS box_width
FROM (SELECT unnest([-2.2e6, -1.5e6, 0e0, 1.5e6, 2.2e6]) AS center) CROSS JOIN (SELECT unnest([0.5e6, 1.5e6]) AS width)"""


@q
def dsp_clock(spark, d):
    """Clock drift and jitter keep the length and nearly the power."""

    def one(ppm):
        x = modulators.modulate("qpsk", 1e6, 10e6, 4096, np.random.default_rng(1))
        for kind, f in (("drift", channel.clock_drift), ("jitter", channel.clock_jitter)):
            y = f(x, ppm, rng=np.random.default_rng(2))
            yield kind, ppm, len(y), bool(abs(np.mean(np.abs(y) ** 2) / np.mean(np.abs(x) ** 2) - 1) < 0.05)

    return _cases(spark, [(1.0,), (10.0,)], "ppm double", "kind string, ppm double, n int, keeps_power boolean", one)


@q
def dsp_snr(spark, d):
    """A burst scaled to each SNR: peak of its mean spectrum over the noise, and whether its band is found."""

    def one(snr):
        c = assemble.DatasetConfig(num_iq_samples_dataset=4096, fft_size=64, fft_stride=64)
        y, band = assemble.calibrated(modulators.modulate("ofdm-256", 2e6, 10e6, 4096, np.random.default_rng(1)), snr, c)
        yield snr, round(float(dsp.spectrogram_db(y, 64, 64).mean(axis=1).max()), 6), bool(band and 1.5e6 < band[1] - band[0] < 4e6)

    return _cases(spark, [(10.0,), (20.0,), (30.0,)], "snr_db double", "snr_db double, peak_db double, band_found boolean", one)


@q
def dsp_doppler(spark, d):
    """A tone at 0.1 under Doppler: where it moves."""

    def one(v):
        y = channel.doppler(np.exp(2j * np.pi * 0.1 * np.arange(8192)), v)
        peak = np.argmax(np.abs(np.fft.fft(y * np.hanning(len(y)), 1 << 20))) / (1 << 20)
        yield v, len(y), bool(abs(peak - 0.1 * channel.SPEED_OF_LIGHT / (channel.SPEED_OF_LIGHT - v)) < 2e-4)

    return _cases(spark, [(-3e6,), (0.0,), (3e6,)], "velocity double", "velocity double, n int, moved boolean", one)
