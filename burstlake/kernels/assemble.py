"""One sample of a dataset: noise floor, bursts with calibrated SNR, placement with overlap control."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np

from . import dsp, modulators, ops


@dataclass(frozen=True)
class DatasetConfig:
    """Everything that determines a generated dataset; the defaults are the usual wide-band ones."""

    dataset_length: int = 100
    seed: int = 0
    impairment_level: int = 0
    representation: str = "iq"
    sampling: str = "per_signal"
    classes: tuple[str, ...] = ("all",)
    target_labels: tuple[str, ...] | None = None
    num_iq_samples_dataset: int = 262_144
    num_signals_min: int = 1
    num_signals_max: int = 1
    fft_size: int = 512
    fft_stride: int = 512
    sample_rate: float = 10e6
    noise_power_db: float = 0.0
    snr_db_min: float = 0.0
    snr_db_max: float = 50.0
    cochannel_overlap_probability: float = 0.2
    signal_duration_in_samples_min: int | None = None
    signal_duration_in_samples_max: int | None = None
    bandwidth_min: float | None = None
    bandwidth_max: float | None = None
    signal_center_freq_min: float | None = None
    signal_center_freq_max: float | None = None
    frequency_min: float | None = None
    frequency_max: float | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        n, fs = self.num_iq_samples_dataset, self.sample_rate
        default = {
            "signal_duration_in_samples_min": int(0.8 * n), "signal_duration_in_samples_max": n, "bandwidth_min": fs / 4, "bandwidth_max": fs / 3,
            "signal_center_freq_min": -fs / 4, "signal_center_freq_max": fs / 4 - 1, "frequency_min": -fs / 4, "frequency_max": fs / 4 - 1,
        }
        for k, v in default.items():
            if getattr(self, k) is None:
                object.__setattr__(self, k, v)
        bad = [
            (n <= 0 or self.fft_size <= 0 or self.fft_stride <= 0, "lengths must be positive"),
            (not 0 <= self.num_signals_min <= self.num_signals_max, "num_signals_min must lie between 0 and num_signals_max"),
            (self.impairment_level not in (0, 1, 2), "the impairment level is 0, 1 or 2"),
            (self.representation not in ("iq", "spectrogram"), "representation is iq or spectrogram"),
            (self.sampling not in ("per_signal", "per_family"), "sampling is per_signal or per_family"),
            (not 0 <= self.cochannel_overlap_probability <= 1, "a probability lies between 0 and 1"),
            (not 0 < self.signal_duration_in_samples_min <= self.signal_duration_in_samples_max <= n, "durations must fit the sample"),
            (not 0 < self.bandwidth_min <= self.bandwidth_max <= fs / 2, "bandwidths must lie within half the sample rate"),
        ]
        for wrong, what in bad:
            if wrong:
                raise ValueError(what)

    def metadata(self) -> dict:
        skip = {"dataset_length", "seed", "impairment_level", "representation", "sampling", "classes", "target_labels", "extra"}
        return {k: v for k, v in asdict(self).items() if k not in skip} | self.extra

    def generators(self) -> tuple[list[str], np.ndarray]:
        """Classes and their probabilities: each class alike, or each family alike and its classes alike within it."""
        names = list(dict.fromkeys(c for name in self.classes for c in modulators.classes_of(name)))
        if self.sampling == "per_signal":
            return names, np.full(len(names), 1 / len(names))
        fam = modulators.families()
        size = {f: sum(fam[n] == f for n in names) for f in {fam[n] for n in names}}
        return names, np.array([1 / size[fam[n]] / len(size) for n in names])


def generator(seed: int, sample_id: int, stream: int = 0) -> np.random.Generator:
    """Independent of workers and partitions: keyed by the seed and the sample."""
    return np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, ((sample_id << 8) | stream) & 0xFFFFFFFFFFFFFFFF]))


def noise_floor(n: int, power_db: float, size: int, stride: int, rng: np.random.Generator) -> np.ndarray:
    """White noise whose mean of the dB spectrum, taken on every sixteenth frame, is ``power_db``."""
    x = dsp.noise(n, 1.0, "white", True, rng)
    return x * 10 ** ((power_db - float(dsp.spectrogram_db(x, size, stride * 16).mean())) / 20)


def calibrated(x: np.ndarray, snr_db: float, c: DatasetConfig) -> tuple[np.ndarray, tuple[float, float] | None]:
    """The burst scaled to its SNR (peak of the time-averaged dB spectrum over the noise) and its occupied band, if any bin exceeds noise + 3 dB."""
    s = dsp.spectrogram_db(x, c.fft_size, c.fft_stride)
    fix = snr_db - (s.mean(axis=1).max() - c.noise_power_db)
    hot = np.flatnonzero(s.max(axis=1) + fix > c.noise_power_db + 3)
    x = x * 10 ** (fix / 20)
    if not len(hot):
        return x, None
    step = c.sample_rate / c.fft_size
    freq = lambda k: (c.fft_size - 1 - k - c.fft_size // 2) * step
    return x, (freq(hot[-1]) - step / 2, freq(hot[0]) + step / 2)


def box(start: int, duration: int, center: float, width: float, c: DatasetConfig) -> tuple[float, float, float, float]:
    y = lambda f: float(np.round(f / (c.sample_rate / 2) * c.fft_size))
    return float(np.round(start / c.fft_size)), y(center - width), float(np.round((start + duration) / c.fft_size)), y(center + width)


def boxes_overlap(a, b) -> bool:
    """The literal predicate of functions.geometry.side_overlap for two boxes."""
    inside = lambda u, v: v[0] <= u[0] and u[2] <= v[2] and v[1] <= u[1] and u[3] <= v[3] and v[0] <= u[2] and u[0] <= v[2] and v[1] <= u[3] and u[1] <= v[3]
    if inside(a, b) or inside(b, a):
        return True
    sides = lambda r: (((r[0], r[1]), (r[2], r[1])), ((r[0], r[1]), (r[0], r[3])), ((r[0], r[3]), (r[2], r[3])), ((r[2], r[3]), (r[2], r[1])))
    left = lambda p, q, r: (r[1] - p[1]) * (q[0] - p[0]) > (q[1] - p[1]) * (r[0] - p[0])
    return any(left(p, r, s) != left(q, r, s) and left(p, q, r) != left(p, q, s) for p, q in sides(a) for r, s in sides(b))


def burst(c: DatasetConfig, name: str, rng: np.random.Generator, chain=()) -> tuple[np.ndarray, dict]:
    """A burst of class ``name`` at 0 Hz, impaired and calibrated."""
    n = int(rng.integers(c.signal_duration_in_samples_min, c.signal_duration_in_samples_max + 1))
    width = 1.0 if name == "tone" else float(rng.integers(int(c.bandwidth_min), int(c.bandwidth_max) + 1))
    x = ops.apply(modulators.modulate(name, width, c.sample_rate, n, rng).astype(np.complex64), chain, rng)
    snr = float(np.round(rng.uniform(c.snr_db_min, c.snr_db_max), 1))
    x, band = calibrated(x, snr, c)
    if band:
        width = min(band[1], c.frequency_max) - max(band[0], c.frequency_min)
    return x, {"bandwidth": width, "snr_db": snr, "duration_in_samples": len(x)}


def sample(sample_id: int, c: DatasetConfig, more: tuple = ()) -> dict:
    """A whole sample: i, q, and the list of its components; ``more`` follows the burst chain of the impairment level.  Placement tries at most ten times the number of signals."""
    rng = generator(c.seed, sample_id)
    names, p = c.generators()
    chain = (*ops.impairments(c.impairment_level)[0], *more)
    n = c.num_iq_samples_dataset
    x = noise_floor(n, c.noise_power_db, c.fft_size, c.fft_stride, rng)
    want, placed, comps = int(rng.integers(c.num_signals_min, c.num_signals_max + 1)), [], []
    for _ in range(10 * want):
        if len(comps) == want:
            break
        k = int(rng.choice(len(names), p=p))
        y, meta = burst(c, names[k], rng, chain)
        center = float(rng.uniform(c.signal_center_freq_min, c.signal_center_freq_max))
        y, center, width = dsp.anti_alias(dsp.rotate(y, center, c.sample_rate), center, meta["bandwidth"], c.sample_rate, c.frequency_min, c.frequency_max)
        start = int(rng.integers(0, n - len(y) + 1))
        b = box(start, len(y), center, width, c)
        if any(boxes_overlap(b, o) for o in placed) and rng.random() >= c.cochannel_overlap_probability:
            continue
        placed.append(b)
        x[start : start + len(y)] += y
        comps.append({"class_name": names[k], "class_index": k, "center_freq": center, "bandwidth": width, "snr_db": meta["snr_db"], "start_in_samples": start, "duration_in_samples": len(y)})
    return {"sample_id": sample_id, "x": x.astype(np.complex64), "components": comps, "bandwidth": max((k["bandwidth"] for k in comps), default=0.0)}
