"""Filter design, resampling, spectra and noise as pure NumPy functions on one burst (no Spark, no SciPy)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

PROTOTYPE_BRANCHES = 10_000
CLOCK_BRANCHES = 5_000


# --- filter design -------------------------------------------------------------------------------


def filter_length(transition: float, attenuation_db: float, sample_rate: float) -> int:
    """Length rule fs/transition * attenuation/22, rounded half to even and made odd."""
    return int(np.round(sample_rate / transition * attenuation_db / 22)) | 1


def kaiser_beta(attenuation_db: float) -> float:
    """Kaiser's empirical shape parameter."""
    if attenuation_db > 50:
        return 0.1102 * (attenuation_db - 8.7)
    return 0.5842 * (attenuation_db - 21) ** 0.4 + 0.07886 * (attenuation_db - 21) if attenuation_db > 21 else 0.0


def windowed_sinc(length: int, cutoff: float, width: float, sample_rate: float) -> np.ndarray:
    """Kaiser-windowed ideal low-pass with unit gain at 0 Hz; the window follows from length and transition width."""
    nyquist = sample_rate / 2
    attenuation = 2.285 * (length - 1) * np.pi * width / nyquist + 7.95
    m = np.arange(length) - (length - 1) / 2
    taps = np.sinc(cutoff / nyquist * m) * np.kaiser(length, kaiser_beta(attenuation))
    return taps / taps.sum()


def low_pass(cutoff: float, transition: float, sample_rate: float, attenuation_db: float = 120) -> np.ndarray:
    return windowed_sinc(filter_length(transition, attenuation_db, sample_rate), cutoff, transition, sample_rate)


def stopband_db(taps: np.ndarray, edge: float, sample_rate: float) -> float:
    """Measured attenuation beyond ``edge``, on a grid of at least eight points a tap."""
    size = 1 << (8 * len(taps) - 1).bit_length()
    mag = np.abs(np.fft.rfft(taps, size))
    first = min(len(mag) - 1, math.ceil(edge / sample_rate * size))
    return float(-20 * np.log10(max(mag[first:].max(), 1e-15)))


def low_pass_measured(cutoff: float, transition: float, sample_rate: float, attenuation_db: float = 120) -> np.ndarray:
    """low_pass grown until the measured stop band reaches the attenuation."""
    n = filter_length(transition, attenuation_db, sample_rate)
    for _ in range(60):
        taps = windowed_sinc(n, cutoff, transition, sample_rate)
        got = stopband_db(taps, cutoff + transition / 2, sample_rate)
        if got >= attenuation_db - 0.05:
            return taps
        n = max(n + 2, int(n * attenuation_db / max(got, 1.0))) | 1
    raise ValueError("the stop band does not reach the attenuation")


@lru_cache(maxsize=64)
def prototype(branches: int, attenuation_db: float = 120) -> np.ndarray:
    """Prototype of a polyphase bank: cutoff and transition width are 1/(2 branches).  Kept per worker."""
    edge = 1 / (2 * branches)
    if branches > 64:
        # the measured length of a bank scales with the branches; designing at 1/64 scale gives it
        scaled = (len(prototype(64, attenuation_db)) - 1) * branches // 64 | 1
        return windowed_sinc(scaled, edge, edge, 1.0)
    return low_pass_measured(edge, edge, 1.0, attenuation_db)


def by_phase(h: np.ndarray, branches: int) -> np.ndarray:
    """[branch, tap]: the taps of each phase of a polyphase filter."""
    t = -(-len(h) // branches)
    out = np.zeros(t * branches)
    out[: len(h)] = h
    return np.ascontiguousarray(out.reshape(t, branches).T)


@lru_cache(maxsize=16)
def phases(branches: int) -> np.ndarray:
    """The prototype's bank at unit gain.  Kept per worker."""
    return by_phase(prototype(branches) * branches, branches)


@lru_cache(maxsize=32)
def half_band(stage: int = 0, passband: float = 0.8, attenuation_db: float = 120) -> np.ndarray:
    """Half-band low-pass of length 4k - 1 whose every second tap off the middle is zero."""
    width = 2 * (0.25 - 0.25 * passband / 2**stage)
    n = 4 * math.ceil((filter_length(width, attenuation_db, 1.0) + 1) / 4) - 1
    taps = windowed_sinc(n, 0.25, width, 1.0)
    off = np.arange(n) - n // 2
    taps[(off % 2 == 0) & (off != 0)] = 0.0
    return taps


def srrc(samples_per_symbol: int, span: int, alpha: float = 0.35) -> np.ndarray:
    """Root-raised-cosine taps over +-span symbols, with the limits at the singular points."""
    t = np.arange(-span * samples_per_symbol, span * samples_per_symbol + 1) / samples_per_symbol
    singular = np.isclose(np.abs(4 * alpha * t), 1.0, rtol=0, atol=1e-12)
    safe = np.where(singular, 0.0, t)
    taps = 4 * alpha / (np.pi * (1 - (4 * alpha * safe) ** 2)) * (np.cos((1 + alpha) * np.pi * safe) + (1 - alpha) * np.pi / (4 * alpha) * np.sinc((1 - alpha) * safe))
    a, b = (1 + alpha) * np.pi / (4 * alpha), (1 - alpha) * np.pi / (4 * alpha)
    taps[singular] = 0.5 * ((1 + alpha) * np.sin(a) - (1 - alpha) * np.cos(b) + 4 * alpha / np.pi * np.sin(b))
    return taps


def gaussian(samples_per_symbol: int, bt: float = 0.35, span: int = 4) -> np.ndarray:
    """Gaussian pulse over +-span symbols with unit sum."""
    t = np.arange(-span * samples_per_symbol, span * samples_per_symbol + 1) / samples_per_symbol
    taps = np.exp(-2 * (np.pi * bt * t) ** 2 / np.log(2))
    return taps / taps.sum()


def blackman_periodic(n: int) -> np.ndarray:
    w = 2 * np.pi * np.arange(n) / n
    return 0.42 - 0.5 * np.cos(w) + 0.08 * np.cos(2 * w)


def blackman_harris(n: int) -> np.ndarray:
    w = 2 * np.pi * np.arange(n) / max(1, n - 1)
    return 0.35875 - 0.48829 * np.cos(w) + 0.14128 * np.cos(2 * w) - 0.01168 * np.cos(3 * w)


# --- filtering and resampling ----------------------------------------------------------------------


def convolve_full(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(x) + len(h) - 1
    if min(len(x), len(h)) <= 64:
        return np.convolve(x, h)
    size = 1 << (n - 1).bit_length()
    y = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(h, size))[:n]
    return y if np.iscomplexobj(x) or np.iscomplexobj(h) else y.real


def convolve_same(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Full convolution without the delay of the taps, as long as x."""
    lead = 1 if len(taps) == 2 else len(taps) // 2
    return convolve_full(x, taps)[lead : lead + len(x)]


def resample_taps(h: np.ndarray, x: np.ndarray, up: int, down: int, bank: np.ndarray | None = None) -> np.ndarray:
    """Upsample by up, filter, downsample by down, computing only the outputs that stay.

    Output m needs the phase (m * down) % up of the taps and the inputs at and before (m * down) // up.
    """
    n = -(-((len(x) - 1) * up + len(h)) // down)
    if up == 1:
        padded = np.concatenate([np.zeros(len(h) - 1, x.dtype), x, np.zeros(len(h) - 1, x.dtype)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(h))[::down]
        return np.concatenate([windows[a : a + 1_024] @ h[::-1] for a in range(0, n, 1_024)])
    bank = by_phase(h, up) if bank is None else bank
    t = bank.shape[1]
    padded = np.concatenate([np.zeros(t - 1, x.dtype), x, np.zeros(t + down // up + 1, x.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, t)
    out = np.empty(n, np.result_type(x, np.float64))
    for a in range(0, n, 65_536):
        at = np.arange(a, min(n, a + 65_536), dtype=np.int64) * down
        base = np.minimum(at // up, len(windows) - 1)
        out[a : a + 65_536] = np.einsum("ij,ij->i", windows[base][:, ::-1], bank[at % up])
    return out


def resample_fraction(x: np.ndarray, rate: float) -> np.ndarray:
    """Resampling by any rate near one with a bank of 10 000 phases; the filter delay is trimmed."""
    h = prototype(PROTOTYPE_BRANCHES)
    y = resample_taps(h, x, PROTOTYPE_BRANCHES, math.ceil(PROTOTYPE_BRANCHES / rate), phases(PROTOTYPE_BRANCHES))
    trim = (len(h) - 1) / PROTOTYPE_BRANCHES * rate
    return y[math.floor(trim / 2) : len(y) - math.ceil(trim / 2)]


def interpolate_integer(x: np.ndarray, rate: int) -> np.ndarray:
    """Interpolation by a whole number; the result is rate times as long."""
    h = prototype(rate) * rate
    lead = (len(h) - 1) // 2 - rate // 2
    y = resample_taps(h, x, rate, 1, phases(rate))
    return y[lead : lead + rate * len(x)]


def decimate_integer(x: np.ndarray, rate: int) -> np.ndarray:
    """Decimation by a whole number, aligned with the input; the level falls by the rate."""
    h = prototype(rate) / rate
    half = (len(h) - 1) / 2
    y = resample_taps(h, x, 1, rate)
    return y[math.floor(half / rate) : math.floor(half / rate) + max(1, round(len(x) / rate))]


def interpolate_halfband(x: np.ndarray, rate: int) -> np.ndarray:
    """Interpolation by a power of two in half-band stages; other rates raise ValueError."""
    if not isinstance(rate, (int, np.integer)) or rate < 2 or rate & (rate - 1):
        raise ValueError("the rate must be a power of two, at least 2")
    for stage in range(rate.bit_length() - 1):
        h = 2 * half_band(stage)
        lead = (len(h) - 1) // 2
        x = resample_taps(h, x, 2, 1)[lead : lead + 2 * len(x)]
    return x


def resample(x: np.ndarray, rate: float) -> np.ndarray:
    """Whole-number and fractional stages; rate 1 is the identity."""
    if rate == 1:
        return x
    if rate > 1:
        whole = int(rate)
        y = resample_fraction(x, rate / whole) if rate / whole > 1 else x
        return interpolate_integer(y, whole) if whole > 1 else y
    whole = int(1 / rate)
    y = decimate_integer(x, whole) if whole > 1 else x
    rest = 1 / rate / whole
    return resample_fraction(y, 1 / rest) if rest > 1 else y


def fit_length(x: np.ndarray, n: int) -> np.ndarray:
    """Cuts or zero-pads both ends, the longer part in front."""
    extra = len(x) - n
    if extra >= 0:
        front = -(-extra // 2)
        return x[front : front + n]
    front = -(extra // 2)
    return np.concatenate([np.zeros(front, x.dtype), x, np.zeros(-extra - front, x.dtype)])


def clock_impaired(x: np.ndarray, jitter_ppm: float, drift_ppm: float, rng: np.random.Generator, branches: int = CLOCK_BRANCHES) -> np.ndarray:
    """Sampling-clock jitter (white) and drift (integrated) as a variable-phase bank, cut or padded to the input's length.

    The phase track does not depend on the data, so it is a cumulative sum and the outputs are one gather.
    """
    bank = phases(branches)
    t = bank.shape[1]
    padded = np.concatenate([np.zeros(t - 1, complex), x, np.zeros(t, complex)])
    stop = len(padded) - t
    n = stop + 64
    step = np.full(n, float(branches))
    if jitter_ppm or drift_ppm:
        step += rng.normal(0, jitter_ppm * 1e-6, n) + np.cumsum(rng.normal(0, drift_ppm * 1e-6, n))
    q = 1.0 + np.concatenate([[0.0], np.cumsum(step)[:-1]])
    at = np.floor(q / branches).astype(np.int64)
    q, at = q[at < stop], at[at < stop]
    phase = np.clip((q - at * branches).astype(np.int64), 0, branches - 1)
    windows = np.lib.stride_tricks.sliding_window_view(padded, t)
    y = np.einsum("ij,ij->i", windows[at][:, ::-1], bank[phase])[:-1]
    return fit_length(y, len(x))


# --- spectra -----------------------------------------------------------------------------------------


def spectrogram_power(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """[bin, frame] power, bins from the highest frequency down; short inputs are zero-padded to one frame."""
    if stride <= 0:
        raise ValueError("stride must be positive")
    if len(x) < size:
        x = np.concatenate([x, np.zeros(size - len(x), x.dtype)])
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::stride] * blackman_periodic(size)
    p = np.abs(np.fft.fftshift(np.fft.fft(frames, axis=1), axes=1)) ** 2
    return p[:, ::-1].T


def spectrogram_db(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """spectrogram_power in dB; empty bins count 1e-10 of the maximum."""
    p = spectrogram_power(x, size, stride)
    top = p.max()
    p = np.where(p == 0, top * 1e-10 if top > 0 else 1e-300, p)
    return 10 * np.log10(p)


def moving_floor(x: np.ndarray) -> float:
    """Smallest moving average over an eighth of the points (odd length), without the ends."""
    n = len(x) // 8 | 1
    return float(convolve_full(x, np.ones(n) / n).real[n:-n].min())


def noise(n: int, power: float, color: str, continuous: bool, rng: np.random.Generator) -> np.ndarray:
    """Complex noise of exactly this mean power: white, pink or red, continuous or one impulse."""
    if power < 0:
        raise ValueError("power must not be negative")
    if color not in ("white", "pink", "red"):
        raise ValueError(f"unknown color {color}")
    if continuous:
        x = (rng.standard_normal(n) + 1j * rng.standard_normal(n)) / np.sqrt(2)
    else:
        x = np.zeros(n, complex)
        x[rng.integers(0, n)] = (1 + 1j) / np.sqrt(2)
    if color != "white":
        f = np.abs(np.fft.fftfreq(n))
        f[0] = np.inf
        shape = f**-0.5 if color == "pink" else 1 / f
        x = np.fft.ifft(np.fft.fft(x) * shape / np.sqrt(np.mean(shape**2)))
    return x * np.sqrt(power / np.mean(np.abs(x) ** 2))


def rotate(x: np.ndarray, frequency: float, sample_rate: float) -> np.ndarray:
    return x * np.exp(2j * np.pi * frequency / sample_rate * np.arange(len(x)))


def clip_band(center: float, bandwidth: float, low: float, high: float) -> tuple[float, float, float, float] | None:
    """(filter low, filter high, box low, box high) where a band passes the limits, else None; both sides are handled."""
    a, b = center - bandwidth / 2, center + bandwidth / 2
    if a >= low and b <= high:
        return None
    return (0.99 * low if a < low else a), (0.99 * high if b > high else b), max(a, low), min(b, high)


def anti_alias(x: np.ndarray, center: float, bandwidth: float, sample_rate: float, low: float, high: float) -> tuple[np.ndarray, float, float]:
    """(data, center, bandwidth): what passes the limits is filtered off and the box is clipped."""
    edges = clip_band(center, bandwidth, low, high)
    if edges is None:
        return x, center, bandwidth
    f0, f1, b0, b1 = edges
    if f1 <= f0:
        return np.zeros_like(x), (b0 + b1) / 2, max(0.0, b1 - b0)
    edge = (f1 - f0) / 2
    width = max(sample_rate / 2 - edge, sample_rate * 1e-3) / 64
    taps = low_pass(0.999 * (edge + width / 2), width, sample_rate)
    taps = taps * np.exp(2j * np.pi * (f0 + f1) / 2 / sample_rate * (np.arange(len(taps)) - len(taps) // 2))
    return convolve_same(x, taps), (b0 + b1) / 2, b1 - b0
