"""Impairments of one burst (complex array in, complex array out), with drawn parameters and a generator passed in."""

from __future__ import annotations

import itertools
import math

import numpy as np

from . import dsp

SPEED_OF_LIGHT = 299_790_000.0
CUT_FILLS = ("zeros", "ones", "low_noise", "avg_noise", "high_noise")


def add_slope(x):
    return x + np.diff(x, prepend=x[:1])


def additive_noise(x, power=1.0, color="white", continuous=True, *, rng):
    return x + dsp.noise(len(x), power, color, continuous, rng)


def adjacent_channel(x, sample_rate=4.0, power=1.0, center=0.2, taps=None, phase_sigma=1.0, time_sigma=0.0, *, rng):
    """Filtered copy at ``center`` with phase noise, shifted by whole samples; what is shifted in is zero on either side."""
    taps = dsp.low_pass(0.25, 0.25, 4.0) if taps is None else taps
    n = len(x)
    y = dsp.convolve_full(x, taps)[-n:] * np.exp(1j * (2 * np.pi * center * np.arange(n) / sample_rate + rng.normal(0, phase_sigma, n)))
    k = int(np.round(rng.normal(0, time_sigma)))
    if k:
        moved = np.zeros_like(y)
        if abs(k) < n:
            moved[max(k, 0) : n + min(k, 0)] = y[max(-k, 0) : n - max(k, 0)]
        y = moved
    level = np.mean(np.abs(y) ** 2)
    return x + (y * np.sqrt(power / level) if level > 0 else y)


def awgn(x, noise_power_db, *, rng):
    n = len(x)
    return x + 10 ** (noise_power_db / 20) * (rng.standard_normal(n) + 1j * rng.standard_normal(n)) / np.sqrt(2)


def channel_swap(x):
    return x.imag + 1j * x.real


def clock_drift(x, drift_ppm=10.0, *, rng):
    return dsp.clock_impaired(x, 0.0, drift_ppm, rng)


def clock_jitter(x, jitter_ppm=10.0, *, rng):
    return dsp.clock_impaired(x, jitter_ppm, 0.0, rng)


def cochannel(x, power=1.0, taps=None, color="white", continuous=True, *, rng):
    taps = dsp.low_pass(0.25, 0.25, 4.0) if taps is None else taps
    y = dsp.convolve_full(dsp.noise(len(x), power, color, continuous, rng), taps)[-len(x) :]
    return x + y * np.sqrt(power / np.mean(np.abs(y) ** 2))


def coarse_gain(x, gain_db, start):
    """From sample ``start`` on the amplitude changes by 10^(dB/10)."""
    return np.where(np.arange(len(x)) >= start, x * 10 ** (gain_db / 10), x)


def cut_out(x, start, duration, fill, *, rng=None):
    """Replaces [start, start + duration), fractions of the length, by zeros, 1+1j or noise."""
    if fill not in CUT_FILLS:
        raise ValueError(f"fill must be one of {CUT_FILLS}")
    n = len(x)
    a = int(start * n)
    b = min(n, a + int(n * duration))
    level = {"low_noise": 10.0 ** (-100 / 20), "high_noise": 10.0 ** (40 / 20)}.get(fill)
    out = x.astype(complex)
    if fill in ("zeros", "ones"):
        out[a:b] = 0 if fill == "zeros" else 1 + 1j
    else:
        level = np.mean(np.abs(x) ** 2) if level is None else level
        out[a:b] = level * (rng.standard_normal(b - a) + 1j * rng.standard_normal(b - a)) / np.sqrt(2)
    return out


def agc_step(level, gain, log_mag, first, p):
    """One sample of the gain control: (level, gain).  log_mag is None for a zero sample; levels are natural logs."""
    if log_mag is None:
        level = -200.0
    else:
        level = log_mag if first else level * p["alpha_smooth"] + log_mag * (1 - p["alpha_smooth"])
    out = level + gain
    lack = p["ref_level_db"] - out
    if level <= p["low_level_db"]:
        rate = 0.0
    elif out >= p["high_level_db"]:
        rate = p["alpha_overflow"]
    else:
        rate = p["alpha_acquire"] if abs(lack) > p["track_range_db"] else p["alpha_track"]
    return level, gain + lack * rate


AGC = {"alpha_smooth": 1e-4, "alpha_track": 1e-3, "alpha_overflow": 0.1, "alpha_acquire": 1e-3, "ref_level_db": 0.0, "track_range_db": 1.0, "low_level_db": -80.0, "high_level_db": 10.0}


def agc(x, initial_gain_db=0.0, state=None, **params):
    """Sample-by-sample gain control.  With ``state`` (level, gain) it continues a chunk; returns (out, state) then."""
    p = AGC | params
    level, gain = state if state else (0.0, initial_gain_db)
    mag = np.abs(x)
    logs = np.log(np.where(mag > 0, mag, 1.0)).tolist()
    gains = np.empty(len(x))
    for k, (m, lg) in enumerate(zip(mag.tolist(), logs)):
        level, gain = agc_step(level, gain, lg if m > 0 else None, k == 0 and state is None, p)
        gains[k] = gain
    out = x * np.exp(gains)
    return (out, (level, gain)) if state is not None else out


def doppler(x, velocity=10.0, speed=SPEED_OF_LIGHT):
    """Wide-band Doppler: time scaled by c/(c - v), as long as x."""
    a = speed / (speed - velocity)
    n = len(x)
    y = np.concatenate([x, np.zeros(math.ceil(n * (a - 1)) + 1)]) if a > 1 else x
    y = dsp.resample(y, 1 / a)
    return y[:n] if len(y) >= n else np.concatenate([y, np.zeros(n - len(y))])


def drop_samples(x, starts, sizes, fill):
    """Drops in the given order; later ones see the fills of earlier ones.  Missing neighbours count as 0."""
    if fill not in ("ffill", "bfill", "mean", "zero"):
        raise ValueError(f"unknown fill {fill}")
    y = x.astype(complex)
    for a, k in zip(starts, sizes):
        value = {"ffill": y[a - 1] if a > 0 else 0, "bfill": y[a + k] if a + k < len(y) else 0, "mean": y.mean(), "zero": 0}[fill]
        y[a : a + k] = value
    return y


def fading(x, coherence_bandwidth, profile=(1.0, 1.0), *, rng):
    """Rayleigh taps, interpolated a hundredfold and weighted by the power-delay profile; the norm is kept."""
    taps = math.ceil(1 / coherence_bandwidth)
    fine = np.linspace(0, 1, 100 * taps)
    knots = rng.standard_normal(taps) + 1j * rng.standard_normal(taps)
    old = np.linspace(0, 1, taps)
    h = (np.interp(fine, old, knots.real) + 1j * np.interp(fine, old, knots.imag)) * np.sqrt(np.interp(fine, np.linspace(0, 1, len(profile)), profile))
    # up 100, down 100: every output meets phase 0 of the taps
    y = dsp.convolve_full(x, h[::100])[-len(x) :]
    return y * (np.linalg.norm(x) / max(np.linalg.norm(y), 1e-300))


def _keep_peak(x, y):
    w = dsp.blackman_harris(len(x))
    return y * (np.abs(np.fft.fft(x * w)).max() / max(np.abs(np.fft.fft(y * w)).max(), 1e-300))


def intermodulation(x, coeffs=(1.0, 0.0, 0.1), rescale=True):
    """sum c_k |z|^k z with zero even-order terms; the windowed spectral peak is kept."""
    if not len(coeffs):
        raise IndexError("no coefficients")
    if any(c != 0 for c in coeffs[1::2]):
        raise ValueError("even-order coefficients must be zero")
    mag = np.abs(x)
    y = x * sum(c * mag**k for k, c in enumerate(coeffs))
    return _keep_peak(x, y) if rescale else y


def iq_imbalance(x, amplitude_db, phase, dc_db, dc_phase, noise_power_db=None):
    """Gain 10^(dB/10) on both rails, skew of +-phase/2, and an offset relative to the noise floor."""
    g = 10 ** (amplitude_db / 10)
    y = g * (np.exp(-0.5j * phase) * x.real + 1j * np.exp(0.5j * phase) * x.imag)
    n = len(x)
    if noise_power_db is not None:
        floor = noise_power_db + 10 * np.log10(n)
    else:
        # the average beside a clean tone is nothing but rounding, which may be below zero
        level = dsp.moving_floor(np.abs(np.fft.fft(y)))
        floor = 20 * np.log10(level) if level > 0 else -np.inf
    return y + 10 ** ((floor - 20 * np.log10(n) + dc_db) / 20) * np.exp(1j * dc_phase)


def frequency_drift(x, drift_ppm=1.0, *, rng):
    return x * np.exp(2j * np.pi * np.cumsum(rng.normal(0, drift_ppm * 1e-6, len(x))))


def phase_noise(x, degrees=1.0, *, rng):
    return x * np.exp(1j * np.deg2rad(rng.normal(0, degrees, len(x))))


def phase_offset(x, phase):
    return x * np.exp(1j * phase)


def nonlinear_amplifier(x, gain=1.0, backoff=10.0, phi_max=0.1, phi_slope=0.01, auto_scale=True):
    """tanh saturation of the power at backoff x mean power, tanh phase shift around it."""
    p = np.abs(x) ** 2
    sat = p.mean() * backoff
    out = np.sqrt(sat * np.tanh(p / (sat / gain))) if sat > 0 else np.zeros(len(x))
    shift = phi_max / 2 * (np.tanh((p - sat / gain) / abs(phi_slope)) + 1) if phi_max and phi_slope else 0.0
    y = out * np.exp(1j * (np.angle(x) + shift))
    return _keep_peak(x, y) if auto_scale else y


# Default AM/AM and AM/PM table (dB, dB, degrees).
TABLE_IN_DB = (-100.0, -20.0, -10.0, 0.0, 5.0, 10.0)
TABLE_OUT_DB = (-90.0, -10.0, 0.0, 9.0, 9.9, 10.0)
TABLE_PHASE_DEG = (0.0, -2.0, -4.0, 7.0, 12.0, 23.0)


def amplifier_table(x, p_in=None, p_out=None, phi=None, auto_scale=False):
    """Piecewise-linear power and phase curves, clamped at their ends."""
    p_in = 10 ** (np.array(TABLE_IN_DB) / 10) if p_in is None else p_in
    p_out = 10 ** (np.array(TABLE_OUT_DB) / 10) if p_out is None else p_out
    phi = np.deg2rad(TABLE_PHASE_DEG) if phi is None else phi
    if not len(p_in) == len(p_out) == len(phi):
        raise ValueError("the tables differ in length")
    p = np.abs(x) ** 2
    y = np.sqrt(np.interp(p, p_in, p_out)) * np.exp(1j * (np.angle(x) + np.interp(p, p_in, phi)))
    return _keep_peak(x, y) if auto_scale else y


def normalize(x, order=2):
    n = np.linalg.norm(np.asarray(x).ravel() if np.ndim(x) == 1 else x, order)
    return x / n if n > 0 else x


def passband_ripple(x, taps=2, max_ripple_db=2.0, decay=1.0, *, rng, tries=None):
    """Random decaying taps, redrawn until their ripple is within the limit, or ``tries`` times where that is given.

    Three taps at decay 1 come within 1 dB once in 400 draws, so a fixed number of them fails for some signal of many.
    A limit that no taps can meet raises ValueError.
    """
    scale = np.exp(-decay * np.arange(taps))
    if not np.isfinite(scale).all() or not (max_ripple_db > 0 or (max_ripple_db == 0 and np.count_nonzero(scale) == 1)):
        raise ValueError("no taps can meet the ripple limit")
    for _ in itertools.count() if tries is None else range(tries):
        w = (rng.normal(size=taps) + 1j * rng.normal(size=taps)) * scale
        w /= np.abs(w).max()
        db = 20 * np.log10(np.maximum(np.abs(np.fft.fft(w, 1024)), 1e-15))
        if db.max() - db.min() <= max_ripple_db:
            return dsp.convolve_same(x, w)
    raise ValueError("no taps within the ripple limit")


def patch_shuffle(x, size, patches, *, rng):
    y = x.copy()
    for k in patches:
        a = int(k * size)
        y[a : a + int(size)] = rng.permutation(y[a : a + int(size)])
    return y


def quantize(x, bits, ref_db=0.0, rounding="floor"):
    """Mid-tread levels k/2^(bits-1) of the peak-scaled signal; 'floor' takes the nearest, 'ceiling' one level more."""
    if not isinstance(bits, (int, np.integer)) or isinstance(bits, bool):
        raise TypeError("bits must be an integer")
    if rounding not in ("floor", "ceiling"):
        raise ValueError("rounding must be floor or ceiling")
    if not np.isfinite(x).all():
        raise ValueError("NaN or infinite samples")
    peak = max(np.abs(x.real).max(initial=0), np.abs(x.imag).max(initial=0))
    if peak == 0:
        return np.zeros(len(x), complex)
    half = 2 ** (int(bits) - 1)
    k = 10 ** (ref_db / 20) / peak
    more = 0.5 if rounding == "floor" else 1.5
    level = lambda v: np.clip(np.floor(v * k * half + more), -half, half - 1) / half / k
    return level(x.real) + 1j * level(x.imag)


def shadowing(x, mean_db=4.0, sigma_db=2.0, *, rng):
    return x * 10 ** (rng.normal(mean_db, sigma_db) / 20)


def spectral_inversion(x):
    return np.conj(x)


def time_reversal(x):
    return x[::-1]


def spectrogram_drop(spec, starts, sizes, fill):
    """Drops in a flattened spectrogram; a 2-channel one is filled per channel, a plain one as a single channel."""
    fills = ("ffill", "bfill", "mean", "zero", "min", "max", "low", "ones")
    if fill not in fills:
        raise ValueError(f"fill must be one of {fills}")
    flat = np.array(spec, float).reshape((spec.shape[0], -1) if spec.ndim == 3 else (1, -1))
    for row in flat:
        for a, k in zip(starts, sizes):
            value = {
                "ffill": lambda: row[a - 1] if a > 0 else 0.0, "bfill": lambda: row[a + k] if a + k < len(row) else 0.0, "mean": row.mean, "zero": lambda: 0.0,
                "min": lambda: np.abs(row).min(), "max": lambda: np.abs(row).max(), "low": lambda: 1e-3, "ones": lambda: 1.0,
            }[fill]()
            row[a : a + k] = value
    return flat.reshape(spec.shape)


def spectrogram_image(x, size, stride, black_hot=True):
    """uint8 image [bin, frame, 3] of the min-max scaled spectrogram."""
    s = dsp.spectrogram_db(x, size, stride)
    span = s.max() - s.min()
    grey = ((s - s.min()) * (255.0 / span) if span > 0 else np.zeros_like(s)).astype(np.uint8)
    grey = 255 - grey if black_hot else grey
    return np.repeat(grey[:, :, None], 3, axis=2)


def spurs(x, sample_rate=1.0, freqs=(0.25,), power_db=(3.0,), noise_power_db=None):
    """Adds tones whose level is relative to the given or estimated noise floor."""
    freqs, power_db = np.atleast_1d(freqs), np.atleast_1d(power_db)
    if (np.abs(freqs) >= sample_rate / 2).any():
        raise ValueError("spur frequencies must lie within half the sample rate")
    if len(freqs) != len(power_db):
        raise ValueError("one power for each frequency")
    n = len(x)
    floor = noise_power_db + 10 * np.log10(n) if noise_power_db is not None else dsp.moving_floor(20 * np.log10(np.maximum(np.abs(np.fft.fft(x)), 1e-15)))
    y = x.astype(complex)
    for f, p in zip(freqs, power_db):
        tone = np.exp(2j * np.pi * f / sample_rate * np.arange(n))
        y += tone * 10 ** ((floor + p) / 20) / np.abs(np.fft.fft(tone)).max()
    return y


def noise_profile(n, low, high, inflections, random_regions, rng=None):
    """Noise level in dB of each sample: straight lines between low and high, turning at the inflections.

    Evenly spaced regions leave the last n mod (inflections + 1) samples at 0 dB.
    """
    if not inflections:
        at = np.array([0, n])
    elif random_regions:
        at = np.concatenate([[0], np.sort(rng.choice(n, inflections, replace=False)), [n]])
    else:
        at = np.arange(inflections + 2) * (n // (inflections + 1))
    out = np.zeros(n)
    for k, (a, b) in enumerate(zip(at, at[1:])):
        out[a:b] = np.linspace(*((low, high) if k % 2 == 0 else (high, low)), b - a)
    return out


def time_varying_noise(x, low, high, inflections, random_regions, *, rng):
    n = len(x)
    level = 10 ** (noise_profile(n, low, high, inflections, random_regions, rng) / 20)
    return x + level * (rng.standard_normal(n) + 1j * rng.standard_normal(n)) / np.sqrt(2)
