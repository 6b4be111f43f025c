"""The signal transforms as a table: the distribution of every parameter, the kernel, and what changes in the metadata.

A transform has two halves: its parameters are drawn (as columns from the counter RNG, or here from a
generator inside a kernel), and the kernel applies them; the second half is deterministic but for noise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from . import channel, dsp


@dataclass(frozen=True)
class Op:
    """draws: name -> (params, scaling) as in functions.rng.distribution; fixed: given values; effect: see operators.pipeline."""

    name: str
    kernel: Callable
    draws: dict = field(default_factory=dict)
    fixed: dict = field(default_factory=dict)
    effect: str | None = None
    required: tuple[str, ...] = ()

    def drawn(self, rng: np.random.Generator) -> dict:
        return self.fixed | {k: sample(v, rng) for k, v in self.draws.items()}

    def __call__(self, x: np.ndarray, p: dict, rng: np.random.Generator) -> np.ndarray:
        return self.kernel(x, p, rng)


@dataclass(frozen=True)
class Maybe:
    """Applies ``op`` with a probability."""

    op: object
    probability: float

    def __post_init__(self):
        if not 0 <= self.probability <= 1:
            raise ValueError("a probability lies between 0 and 1")


@dataclass(frozen=True)
class Pick:
    """Applies ``choose`` of the ops, in drawn order, with or without replacement."""

    ops: tuple
    choose: int = 2
    replace: bool = False

    def __post_init__(self):
        if not self.replace and self.choose > len(self.ops):
            raise ValueError("cannot choose more ops than there are")


def sample(spec, rng: np.random.Generator):
    """One value of a parameter specification."""
    params, scaling = spec
    if isinstance(params, list):
        return params[int(rng.integers(0, len(params)))]
    if isinstance(params, tuple):
        lo, hi = params
        return 10 ** rng.uniform(np.log10(lo), np.log10(hi)) if scaling == "log10" else rng.uniform(lo, hi)
    return rng.uniform(0, params)


def lin(*p):
    return (p[0] if len(p) == 1 else tuple(p), "linear")


def log(a, b):
    return ((a, b), "log10")


def one_of(*values):
    return (list(values), "linear")


def _noise(x, p, r):
    return channel.additive_noise(x, p["power"], p["color"], p["continuous"], rng=r)


def _imd(x, p, r):
    """Odd-order coefficients that do not grow: the first is 1, the rest are redrawn until they fall."""
    odd = (int(p["order"]) + 1) // 2 - 1
    for _ in range(1000):
        c = 10 ** r.uniform(-4, -1, odd)
        if all(np.diff(c) <= 0):
            break
    else:
        c = np.sort(c)[::-1]
    coeffs = np.zeros(2 * odd + 1)
    coeffs[0], coeffs[2::2] = 1.0, c
    return channel.intermodulation(x, coeffs)


def _drops(x, p, r):
    n = int(p["rate"] * len(x))
    if n < 1 or len(x) < 3:
        return x
    sizes = np.round(r.uniform(p["size_min"], p["size_max"], n)).astype(int).clip(1, max(1, len(x) // 4))
    starts = np.array([r.integers(1, max(2, len(x) - k - 1)) for k in sizes])
    return channel.drop_samples(x, starts, sizes, p["fill"])


def _patches(x, p, r):
    size = max(1, int(p["size"]))
    n = len(x) // size
    take = int(p["ratio"] * n)
    return channel.patch_shuffle(x, size, r.choice(n, take, replace=False), rng=r) if take else x


def _agc(x, p, r):
    mag = np.abs(x)
    ref = float(np.mean(np.log(mag[mag > 0]))) + p["ref_offset"] if (mag > 0).any() else 0.0
    return channel.agc(x, p["initial_gain_db"], alpha_smooth=p["alpha_smooth"], alpha_track=p["alpha_track"], alpha_overflow=p["alpha_overflow"], alpha_acquire=p["alpha_acquire"], ref_level_db=ref, track_range_db=p["track_range_db"], low_level_db=ref - 10 - p["low_offset"], high_level_db=ref + 10 + p["high_offset"])


def _reverse(x, p, r):
    return np.conj(x[::-1]) if p["undo"] else x[::-1]


def _spurs(x, p, r):
    n = int(round(p["count"]))
    return channel.spurs(x, 1.0, r.uniform(-0.5, 0.5, n).clip(-0.499, 0.499), r.uniform(0, 30, n), p.get("noise_power_db"))


def _cut(x, p, r):
    return channel.cut_out(x, p["start"] * (1 - p["duration"]), p["duration"], p["fill"], rng=r)


TWO_PI = 2 * np.pi
#: name -> Op with the default distributions.
OPS: dict[str, Op] = {
    o.name: o
    for o in (
        Op("AWGN", lambda x, p, r: channel.awgn(x, p["noise_power_db"], rng=r), fixed={"noise_power_db": -40.0}, effect="add_noise_db"),
        Op("AddSlope", lambda x, p, r: channel.add_slope(x)),
        Op("AdditiveNoise", _noise, {"power": lin(0.01, 10.0)}, {"color": "white", "continuous": True}, "add_noise_power"),
        Op("AdjacentChannelInterference", lambda x, p, r: channel.adjacent_channel(x, 1.0, p["power"], p["center"], None, p["phase_sigma"], p["time_sigma"], rng=r), {"power": lin(0.01, 10.0), "center": lin(0.2, 0.3), "phase_sigma": lin(0.0, 1.0), "time_sigma": lin(0.0, 10.0)}),
        Op("CarrierFrequencyDrift", lambda x, p, r: channel.frequency_drift(x, p["drift_ppm"], rng=r), {"drift_ppm": log(0.1, 10)}),
        Op("CarrierPhaseNoise", lambda x, p, r: channel.phase_noise(x, p["degrees"], rng=r), {"degrees": lin(0.25, 1.0)}),
        Op("CarrierPhaseOffset", lambda x, p, r: channel.phase_offset(x, p["phase"]), {"phase": lin(0.0, TWO_PI)}),
        Op("ChannelSwap", lambda x, p, r: channel.channel_swap(x), effect="mirror"),
        Op("ClockDrift", lambda x, p, r: channel.clock_drift(x, p["drift_ppm"], rng=r), {"drift_ppm": log(1, 10)}),
        Op("ClockJitter", lambda x, p, r: channel.clock_jitter(x, p["jitter_ppm"], rng=r), {"jitter_ppm": log(1, 10)}),
        Op("CoarseGainChange", lambda x, p, r: channel.coarse_gain(x, p["gain_db"], 1 + int(p["at"] * max(1, len(x) - 2))), {"gain_db": lin(-20.0, 20.0), "at": lin(1.0)}),
        Op("CochannelInterference", lambda x, p, r: channel.cochannel(x, p["power"], None, p["color"], p["continuous"], rng=r), {"power": lin(0.01, 10.0)}, {"color": "white", "continuous": True}, "add_noise_power"),
        Op("CutOut", _cut, {"duration": lin(0.01, 0.2), "start": lin(1.0), "fill": one_of(*channel.CUT_FILLS)}, effect="cut"),
        Op("DigitalAGC", _agc, {"alpha_smooth": lin(1e-7, 1e-6), "alpha_track": lin(1e-6, 1e-5), "alpha_overflow": lin(0.1, 0.3), "alpha_acquire": lin(1e-6, 1e-5), "track_range_db": lin(0.5, 2.0), "ref_offset": lin(-5.0, 5.0), "low_offset": lin(0.0, 10.0), "high_offset": lin(0.0, 10.0)}, {"initial_gain_db": 0.0}),
        Op("Doppler", lambda x, p, r: channel.doppler(x, p["velocity"], p["speed"]), {"velocity": lin(0.0, 10.0)}, {"speed": channel.SPEED_OF_LIGHT}, "doppler"),
        Op("Fading", lambda x, p, r: channel.fading(x, p["coherence"], rng=r), {"coherence": lin(0.01, 0.1)}),
        Op("IntermodulationProducts", _imd, {"order": one_of(3, 5)}),
        Op("IQImbalance", lambda x, p, r: channel.iq_imbalance(x, p["amplitude"], p["phase"], p["dc_db"], p["dc_phase"]), {"amplitude": lin(-1.0, 1.0), "phase": lin(-np.pi / 90, np.pi / 90), "dc_db": lin(0.0, 3.0), "dc_phase": lin(0.0, TWO_PI)}),
        Op("NonlinearAmplifier", lambda x, p, r: channel.nonlinear_amplifier(x, p["gain"], p["backoff"], p["phi_max"], p["phi_slope"]), {"gain": lin(1.0, 1.0), "backoff": lin(5.0, 20.0), "phi_max": lin(-0.05, 0.05), "phi_slope": lin(-0.1, 0.1)}),
        Op("PassbandRipple", lambda x, p, r: channel.passband_ripple(x, int(p["taps"]), p["ripple_db"], p["decay"], rng=r, tries=p.get("tries")), {"ripple_db": lin(1.0, 2.0), "taps": one_of(2, 3), "decay": lin(1.0, 5.0)}),
        Op("PatchShuffle", _patches, {"size": lin(3.0, 10.0), "ratio": lin(0.01, 0.05)}),
        Op("Quantize", lambda x, p, r: channel.quantize(x, int(round(p["bits"])), p["ref_db"], p["rounding"]), {"bits": lin(6.0, 18.0), "ref_db": lin(-10.0, 3.0), "rounding": one_of("floor", "ceiling")}),
        Op("RandomDropSamples", _drops, {"rate": lin(0.01, 0.05), "fill": one_of("ffill", "bfill", "mean", "zero")}, {"size_min": 1.0, "size_max": 10.0}),
        Op("Shadowing", lambda x, p, r: channel.shadowing(x, p["mean_db"], p["sigma_db"], rng=r), {"mean_db": lin(0.0, 4.0), "sigma_db": lin(2.0, 6.0)}),
        Op("SpectralInversion", lambda x, p, r: np.conj(x), effect="mirror"),
        Op("TimeReversal", _reverse, {"undo": one_of(True, False)}, effect="reverse"),
        Op("TimeVaryingNoise", lambda x, p, r: channel.time_varying_noise(x, p["low"], p["high"], int(p["inflections"]), p["random_regions"], rng=r), {"low": lin(-80.0, -60.0), "high": lin(-40.0, -20.0), "inflections": one_of(0, 10), "random_regions": one_of(True, False)}),
        Op("Spurs", _spurs, {"count": lin(1.0, 4.0)}),
        Op("Normalize", lambda x, p, r: channel.normalize(x, p["order"]), fixed={"order": 2.0}),
    )
}


def op(name: str, **changes) -> Op:
    """An op of the table with other distributions (tuples, lists, numbers) or fixed values (anything else, by fixed_<name>)."""
    o = OPS[name]
    draws, fixed = dict(o.draws), dict(o.fixed)
    for k, v in changes.items():
        if k.startswith("fixed_"):
            k = k[6:]
            draws.pop(k, None)
            fixed[k] = v
        elif k in draws:
            draws[k] = (v, draws[k][1])
        elif k in fixed:
            fixed[k] = v
        else:
            raise ValueError(f"{name} has no parameter {k}")
    return replace(o, draws=draws, fixed=fixed)


def custom(name: str, function: Callable, required: tuple[str, ...] = ()) -> Op:
    """Any function on a complex array as an op."""
    return Op(name, lambda x, p, r: function(x), required=required)


def steps(*items) -> tuple:
    """Names, ops and nested sequences as one flat sequence."""
    out: list = []
    for x in items:
        if isinstance(x, str):
            out.append(OPS[x])
        elif isinstance(x, (list, tuple)):
            out.extend(steps(*x))
        elif isinstance(x, (Op, Maybe, Pick)):
            out.append(x)
        else:
            raise TypeError(f"{x!r} is not a transform")
    return tuple(out)


# The impairment recipes; numbers are probabilities.
_BURST = (("Quantize", 0.75), ("ClockDrift", 0.75), ("ClockJitter", 0.75), ("PassbandRipple", 0.75), ("IQImbalance", 0.25), ("CarrierPhaseNoise", 0.75), ("CarrierFrequencyDrift", 0.75), ("CarrierPhaseOffset", 1.0), ("IntermodulationProducts", 0.5), ("NonlinearAmplifier", 0.75), ("Spurs", 0.75), ("SpectralInversion", 0.25))
_SAMPLE = (("IntermodulationProducts", 0.5), ("NonlinearAmplifier", 0.75), ("CoarseGainChange", 0.25), ("Spurs", 0.75), ("IQImbalance", 0.5), ("CarrierPhaseNoise", 0.75), ("CarrierFrequencyDrift", 0.75), ("CarrierPhaseOffset", 1.0), ("PassbandRipple", 0.75), ("ClockDrift", 0.75), ("ClockJitter", 0.75), ("Quantize", 0.75), ("DigitalAGC", 0.25))


def impairments(level: int) -> tuple[tuple, tuple]:
    """(burst chain, sample chain) of level 0, 1 or 2; other levels raise ValueError."""
    if level not in (0, 1, 2):
        raise ValueError("the impairment level is 0, 1 or 2")
    burst = [] if level == 0 else [Maybe(OPS[n], p) for n, p in _BURST] + ([Maybe(OPS["Fading"], 0.25)] if level == 2 else [])
    first = Pick((op("RandomDropSamples", fixed_rate=0.01, size_min=1.0, size_max=1.0), OPS["ChannelSwap"], OPS["TimeReversal"], OPS["AddSlope"]), 2)
    sample = [first] + ([Maybe(OPS[n], p) for n, p in _SAMPLE] if level else [])
    return tuple(burst), tuple(sample)


def apply(x: np.ndarray, chain, rng: np.random.Generator, log: list | None = None) -> np.ndarray:
    """Runs a chain inside a kernel, drawing as it goes; the names of what was applied go to ``log``."""
    for s in chain:
        if isinstance(s, Maybe):
            if rng.random() < s.probability:
                x = apply(x, steps(s.op), rng, log)
        elif isinstance(s, Pick):
            for k in rng.choice(len(s.ops), s.choose, replace=s.replace):
                x = apply(x, steps(s.ops[k]), rng, log)
        else:
            x = s(x, s.drawn(rng), rng).astype(np.complex64)
            if log is not None:
                log.append(s.name)
    return x


def spectrogram(x: np.ndarray, size: int, stride: int | None = None) -> np.ndarray:
    return dsp.spectrogram_db(x, size, stride or size).astype(np.float32)
