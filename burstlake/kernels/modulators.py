"""Modulators of the 57 signal classes: complex baseband bursts of a given length and bandwidth."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from . import dsp

OVERSAMPLING = 4

# Subcarrier counts, orders and modes that name the classes.
OFDM_SUBCARRIERS = (64, 72, 128, 180, 256, 300, 512, 600, 900, 1024, 1200, 2048)
FSK_ORDERS = (2, 4, 8, 16)
FSK_KINDS = ("fsk", "gfsk", "msk", "gmsk")
AM_MODES = ("dsb", "dsb-sc", "usb", "lsb")
LFM_KINDS = ("lfm_data", "lfm_radar")
PSK = ("bpsk", "qpsk", "8psk", "16psk", "32psk", "64psk")
QAM = ("16qam", "32qam", "32qam_cross", "64qam", "128qam_cross", "256qam", "512qam_cross", "1024qam")
ASK = ("4ask", "8ask", "16ask", "32ask", "64ask")
OFDM_CONSTELLATIONS = ("bpsk", "qpsk", "16qam", "64qam", "256qam", "1024qam")


@lru_cache(maxsize=1)
def families() -> dict[str, str]:
    """class -> family, in class order (fixed values: the order of the families)."""
    out = {"ook": "ook"}
    out |= {c: "ask" for c in ASK}
    out |= {f"{n}{k}": "fsk" for k in FSK_KINDS for n in FSK_ORDERS}
    out |= {c: "psk" for c in PSK} | {c: "qam" for c in QAM}
    out |= {f"ofdm-{n}": "ofdm" for n in OFDM_SUBCARRIERS}
    out |= {"fm": "fm"} | {f"am-{m}": "am" for m in AM_MODES}
    return out | {k: "chirp" for k in (*LFM_KINDS, "chirpss")} | {"tone": "tone"}


def classes_of(name: str) -> list[str]:
    """Classes that a name stands for: a class, a family, "all", or the aliases lfm and msk; unknown names raise ValueError."""
    name = name.lower().replace("lfm-", "lfm_")
    fam = families()
    if name in fam and not (name in ("fm",)):
        return [name]
    if name == "all":
        return list(fam)
    if name == "lfm":
        return list(LFM_KINDS)
    if name == "msk":
        return [c for c in fam if c.endswith("msk")]
    own = [c for c, f in fam.items() if f == name]
    if not own:
        raise ValueError(f"unknown signal class or family {name!r}")
    return own


def grid(columns: int, rows: int) -> np.ndarray:
    """Rectangular grid over [-1, 1], imaginary parts changing slowest."""
    re, im = np.linspace(-1, 1, columns), np.linspace(-1, 1, rows)
    return (re[None, :] + 1j * im[:, None]).ravel()


def cross(side: int) -> np.ndarray:
    """A square grid without its corners, each side/6 points wide."""
    p = grid(side, side)
    edge = 1 - 2 / (side - 1) * (side / 6 - 0.5)
    return p[(np.abs(p.real) < edge) | (np.abs(p.imag) < edge)]


@lru_cache(maxsize=64)
def constellation(name: str) -> np.ndarray:
    """Points of mean power one."""
    if name == "ook":
        p = np.array([0, 1], complex)
    elif name == "bpsk":
        p = np.array([-1, 1], complex)
    elif name == "qpsk":
        p = grid(2, 2)
    elif name.endswith("psk"):
        n = int(name[:-3])
        p = np.exp(2j * np.pi * np.arange(n) / n)
    elif name.endswith("ask"):
        p = np.linspace(-1, 1, int(name[:-3])) + 0j
    elif name.endswith("qam_cross"):
        p = cross(int(round(math.sqrt(int(name[: -len("qam_cross")]) * 9 / 8))))
    elif name.endswith("qam"):
        bits = int(name[:-3]).bit_length() - 1
        p = grid(2 ** (bits // 2), 2 ** (bits - bits // 2))
    else:
        raise ValueError(f"unknown constellation {name!r}")
    return p / np.sqrt(np.mean(np.abs(p) ** 2))


def fsk_levels(n: int) -> np.ndarray:
    return np.linspace(-1 + 1 / n, 1 - 1 / n, n)


def chirp(f0: float, f1: float, n: int, phase: float = 0.0) -> np.ndarray:
    """Linear sweep from f0 to f1 (cycles a sample) over n samples."""
    t = np.arange(n)
    return np.exp(2j * np.pi * (f0 * t + 0.5 * (f1 - f0) / n * t**2) + 1j * phase)


def _check(bandwidth, sample_rate, n):
    if bandwidth <= 0 or sample_rate <= 0 or n <= 0:
        raise ValueError("bandwidth, sample rate and length must be positive")
    if bandwidth > sample_rate / 2:
        raise ValueError("bandwidth must not exceed half the sample rate")


def _limited(x, bandwidth, rng):
    """Half of the chirps pass a random band-limiting filter (cycles a sample)."""
    if rng.uniform() >= 0.5:
        return x
    cutoff = rng.uniform(0.4 * bandwidth, 0.475)
    width = rng.uniform(0.5, 1.5) * (0.5 - cutoff)
    return dsp.convolve_same(x, dsp.low_pass_measured(cutoff, max(width, 1e-3), 1.0))


def _to_bandwidth(make, bandwidth, sample_rate, n):
    """A baseband at four samples a symbol, resampled to the bandwidth and fitted to the length."""
    rate = sample_rate / bandwidth / OVERSAMPLING
    return dsp.fit_length(dsp.resample(make(max(OVERSAMPLING, math.floor(n / rate))), rate), n)


def _symbols(name, bandwidth, sample_rate, n, rng):
    shaped = rng.integers(0, 2) == 0
    alpha = rng.uniform(0.1, 0.5) if shaped else None

    def make(m):
        points = constellation(name)
        span = math.ceil((dsp.filter_length(alpha, 120, 1.0) - 1) / (2 * OVERSAMPLING)) if shaped else 0
        pulse = dsp.srrc(OVERSAMPLING, span, alpha) if shaped else np.ones(OVERSAMPLING)
        count = max(1, m // OVERSAMPLING - 2 * span)
        while True:
            s = points[rng.integers(0, len(points), count)]
            if np.abs(s).sum() > 0:
                break
        x = dsp.resample_taps(pulse, s, OVERSAMPLING, 1)
        return x[:m] if len(x) >= m else dsp.fit_length(x, m)

    return _to_bandwidth(make, bandwidth, sample_rate, n)


def _fsk(name, bandwidth, sample_rate, n, rng):
    order = int("".join(c for c in name if c.isdigit()))
    kind = name.lstrip("0123456789")
    index = 0.5 if kind in ("msk", "gmsk") else rng.uniform(0.1, 0.5) if kind == "gfsk" else 1.0 if rng.uniform() < 0.5 else rng.uniform(0.7, 1.01)

    def make(m):
        sps = order * OVERSAMPLING
        pulse = np.ones(sps)
        if kind[0] == "g":
            pulse = np.convolve(dsp.gaussian(sps, rng.uniform(0.1, 0.5), int(rng.integers(1, 5))), pulse)
        count = max(1, (m - len(pulse) + 1) // sps)
        f = dsp.resample_taps(pulse, fsk_levels(order)[rng.integers(0, order, count)] / OVERSAMPLING, sps, 1)
        x = np.exp(1j * np.pi * index * np.cumsum(f))
        return x[:m] if len(x) >= m else dsp.fit_length(x, m)

    rate = sample_rate / bandwidth / OVERSAMPLING
    return _to_bandwidth(make, bandwidth, sample_rate, n) / rate


def _ofdm(name, bandwidth, sample_rate, n, rng):
    carriers = int(name.split("-")[1])

    def make(m):
        prefix = 0 if rng.uniform() < 0.5 else int(rng.integers(2, carriers // 2))
        size = OVERSAMPLING * carriers
        count = -(-m // (OVERSAMPLING * (carriers + prefix)))
        points = constellation(OFDM_CONSTELLATIONS[rng.integers(0, len(OFDM_CONSTELLATIONS))])
        s = points[rng.integers(0, len(points), (count, carriers))]
        f = np.zeros((count, size), complex)
        f[:, 1 : carriers // 2 + 1] = s[:, : carriers // 2]
        f[:, size - carriers // 2 :] = s[:, carriers // 2 :]
        t = np.fft.ifft(f, axis=1)
        return np.concatenate([t[:, size - OVERSAMPLING * prefix :], t], axis=1).ravel()[:m]

    return _to_bandwidth(make, bandwidth, sample_rate, n)


def chirp_symbols(name, m, rng):
    """m samples of chirps at four samples a cycle of the bandwidth: sweeps up (radar), up or down by the bits, or cyclically shifted."""
    sps, b = int(rng.integers(128, 4096)), 1 / OVERSAMPLING
    count = -(-m // sps)
    if name == "chirpss":
        twice = np.tile(chirp(-b, b, sps), 2)
        shift = (rng.integers(0, 128, count) / 128 * sps).astype(int)
        return np.concatenate([twice[k : k + sps] for k in shift])[:m]
    up = np.ones(count, bool) if name == "lfm_radar" else rng.integers(0, 2, count) > 0
    sweep = {True: chirp(-b / 2, b / 2, sps), False: chirp(b / 2, -b / 2, sps)}
    return np.concatenate([sweep[bool(u)] for u in up])[:m]


def _chirps(name, bandwidth, sample_rate, n, rng):
    return _to_bandwidth(lambda m: _limited(chirp_symbols(name, m, rng), 1 / OVERSAMPLING, rng), bandwidth, sample_rate, n)


def _fm(name, bandwidth, sample_rate, n, rng):
    index = rng.uniform(1, 10)
    deviation = bandwidth / 2 / (1 + 1 / index)
    top = deviation / index
    message = rng.standard_normal(n)
    message = dsp.convolve_same(message / np.sqrt(np.mean(message**2)), dsp.low_pass_measured(top, top, sample_rate))
    return np.exp(2j * np.pi * deviation / sample_rate * np.cumsum(message))


def _am(name, bandwidth, sample_rate, n, rng):
    mode = name[3:]
    ssb = mode in ("usb", "lsb")
    x = rng.standard_normal(2 * n if ssb else n) + 0j
    x /= np.sqrt(np.mean(np.abs(x) ** 2))
    edge = bandwidth / 2
    taps = dsp.low_pass_measured(edge, rng.uniform(0.05, 0.25) * max(sample_rate / 2 - edge, sample_rate * 1e-3) / 2, sample_rate)
    x = dsp.convolve_same(x, taps)
    if mode == "dsb":
        index = rng.uniform(0.8, 4)
        return index * x + np.abs(x).max() / index
    if not ssb:
        return x
    side = 1 if mode == "lsb" else -1
    x = dsp.rotate(dsp.convolve_same(dsp.rotate(x, side * bandwidth / 2, sample_rate), taps), -side * bandwidth / 4, sample_rate)
    return dsp.fit_length(2 * dsp.decimate_integer(x, 2), n)


def modulate(name: str, bandwidth: float, sample_rate: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """A burst of class ``name``: n samples around 0 Hz."""
    if name == "tone":
        return np.ones(n, complex)
    _check(bandwidth, sample_rate, n)
    fam = families().get(name)
    if fam is None:
        raise ValueError(f"unknown signal class {name!r}")
    make = {"fsk": _fsk, "ofdm": _ofdm, "am": _am, "fm": _fm}.get(fam) or (_chirps if fam == "chirp" else _symbols)
    return make(name, bandwidth, sample_rate, n, rng)
