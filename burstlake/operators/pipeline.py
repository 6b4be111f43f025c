"""Chains of transforms over signals in array form: parameters and metadata are columns, samples go through one kernel pass.

``apply`` draws every parameter as a column from the counter RNG, projects what changes in the metadata
(so queries that read only labels never touch the samples), and runs the whole chain as a single
mapInArrow, however many transforms it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import arrays, rng, scalar
from ..kernels.draws import Counter, stream_key
from ..kernels.ops import Maybe, Op, Pick, steps

#: Pairs of these undo each other.
INVOLUTIONS = {"ChannelSwap", "SpectralInversion"}


#: Layouts that may end a chain: the rails become one column.
LAYOUTS = {"ComplexTo2D": arrays.stacked, "InterleaveComplex": arrays.interleaved}


def is_raw(*chains) -> bool:
    """Whether nothing is applied at all, so that stored samples are as they were generated."""
    return not any(steps(*(x for x in c if x not in LAYOUTS)) or any(x in LAYOUTS for x in c if isinstance(x, str)) for c in chains)


def simplified(chain) -> tuple:
    """The chain without pairs that undo each other, adjacent fixed rotations merged."""
    out: list = []
    for s in steps(*chain):
        last = out[-1] if out else None
        if isinstance(s, Op) and isinstance(last, Op) and s.name == last.name:
            if s.name in INVOLUTIONS:
                out.pop()
                continue
            if s.name == "CarrierPhaseOffset" and "phase" in s.fixed and "phase" in last.fixed:
                out[-1] = Op(s.name, s.kernel, {}, {"phase": s.fixed["phase"] + last.fixed["phase"]}, s.effect)
                continue
        out.append(s)
    return tuple(out)


def _flat(chain) -> list[tuple[str, Op, list[str]]]:
    """(name of the draw, op, names of the conditions above it)"""
    out: list = []

    def walk(items, path, above):
        for k, s in enumerate(items):
            at = f"{path}{k}"
            if isinstance(s, Maybe):
                walk(steps(s.op), at + "m", [*above, at])
            elif isinstance(s, Pick):
                for j, o in enumerate(s.ops):
                    walk(steps(o), f"{at}p{j}_", [*above, f"{at}#{j}"])
            else:
                out.append((at, s, above))

    walk(chain, "t", [])
    return out


def _conditions(chain, key: str, seed: int) -> dict[str, Column]:
    """Draw columns of the chain: booleans of Maybe, ordered choices of Pick."""
    out: dict[str, Column] = {}

    def walk(items, path):
        for k, s in enumerate(items):
            at = f"{path}{k}"
            if isinstance(s, Maybe):
                out[at] = rng.uniform(seed, at, key) < s.probability
                walk(steps(s.op), at + "m")
            elif isinstance(s, Pick):
                if s.replace:
                    picks = F.array(*[F.floor(rng.uniform(seed, f"{at}.{j}", key) * len(s.ops)).cast("int") for j in range(s.choose)])
                else:
                    order = F.array_sort(F.array(*[F.struct(rng.uniform(seed, f"{at}.{j}", key).alias("u"), F.lit(j).alias("j")) for j in range(len(s.ops))]))
                    picks = F.transform(F.slice(order, 1, s.choose), lambda x: x["j"])
                out[at] = picks
                for j, o in enumerate(s.ops):
                    walk(steps(o), f"{at}p{j}_")

    walk(chain, "t")
    return out


def draws(df: DataFrame, chain, key: str = "sample_id", seed: int = 0, out: str = "draws") -> DataFrame:
    """Adds a struct with every draw of the chain: conditions, choices and parameters."""
    fields = [c.alias(n) for n, c in _conditions(chain, key, seed).items()]
    for at, o, _ in _flat(chain):
        for p, spec in o.draws.items():
            fields.append(rng.distribution(*spec)(rng.uniform(seed, f"{at}.{p}", key)).alias(f"{at}_{p}"))
    return df.withColumn(out, F.struct(*fields) if fields else F.struct(F.lit(0).alias("none")))


def _on(above: list[str], d: str) -> Column:
    on = F.lit(True)
    for a in above:
        name, _, j = a.partition("#")
        on = on & (F.array_contains(F.col(d)[name], int(j)) if j else F.col(d)[name])
    return on


def _both(df: DataFrame, change) -> DataFrame:
    """A change of fields of the sample and of each of its components."""
    cols = {k: v for k, v in change(lambda c: F.col(c)).items() if k in df.columns}
    if "components" in df.columns:
        names = {f.name for f in df.schema["components"].dataType.elementType.fields}

        def one(c):
            for k, v in change(lambda n: c[n]).items():
                if k in names:
                    c = c.withField(k, v)
            return c

        cols["components"] = F.transform("components", one)
    return df.withColumns(cols) if cols else df


def effects(df: DataFrame, chain, d: str = "draws") -> DataFrame:
    """What the chain changes in the metadata, as columns; ops that are not drawn for a row change nothing."""
    for at, o, above in _flat(chain):
        if not o.effect:
            continue
        on = _on(above, d)
        p = lambda n, at=at, o=o: F.col(d)[f"{at}_{n}"] if n in o.draws else F.lit(o.fixed[n])
        if o.effect == "mirror":
            df = _both(df, lambda c: {"center_freq": F.when(on, -c("center_freq")).otherwise(c("center_freq"))})
        elif o.effect == "reverse":
            total = F.col("num_iq_samples_dataset") if "num_iq_samples_dataset" in df.columns else F.size("i")
            df = _both(df, lambda c: {"start_in_samples": F.when(on, total - c("start_in_samples") - c("duration_in_samples")).otherwise(c("start_in_samples")), "center_freq": F.when(on & ~p("undo"), -c("center_freq")).otherwise(c("center_freq"))})
        elif o.effect == "doppler":
            a = p("speed") / (p("speed") - p("velocity"))
            df = _both(df, lambda c: {k: F.when(on, c(k) * a).otherwise(c(k)) for k in ("center_freq", "bandwidth")})
        elif o.effect in ("add_noise_db", "add_noise_power") and {"noise_power_db", "snr_db"} <= set(df.columns):
            added = F.pow(F.lit(10.0), p("noise_power_db") / 10) if o.effect == "add_noise_db" else p("power")
            floor = F.pow(F.lit(10.0), F.col("noise_power_db") / 10)
            # the signal keeps its power, the noise adds up
            df = _both(df, lambda c: {"snr_db": F.when(on, c("snr_db") + 10 * F.log10(floor / (floor + added))).otherwise(c("snr_db"))})
        elif o.effect == "cut":
            total = F.col("num_iq_samples_dataset") if "num_iq_samples_dataset" in df.columns else F.size("i")
            a = F.floor(p("start") * (1 - p("duration")) * total)
            b = a + F.floor(p("duration") * total)

            def shorten(c, on=on, a=a, b=b):
                s, e = c("start_in_samples"), c("start_in_samples") + c("duration_in_samples")
                ns = F.when(on & (a <= s) & (b > s) & (b < e), b).otherwise(s)
                ne = F.when(on & (a > s) & (a < e) & (b >= e), a).when(on & (a <= s) & (b >= e), s).otherwise(e)
                return {"start_in_samples": ns, "duration_in_samples": ne - ns}

            df = _both(df, shorten)
    return df


def as_complex(col_i: pa.Array, col_q: pa.Array) -> list[np.ndarray | None]:
    """List columns of both rails as one complex array a row; None where either is null."""
    one = lambda c: (c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy())
    (vi, oi), (vq, oq) = one(col_i), one(col_q)
    ok = np.asarray(col_i.is_valid()) & np.asarray(col_q.is_valid())
    return [(vi[a:b] + 1j * vq[c : c + b - a]).astype(np.complex64) if v else None for v, a, b, c in zip(ok, oi[:-1], oi[1:], oq[:-1])]


def as_lists(rows: list[np.ndarray | None]) -> tuple[pa.Array, pa.Array]:
    lens = [0 if r is None else len(r) for r in rows]
    flat = np.concatenate([r for r in rows if r is not None]) if any(lens) else np.zeros(0, np.complex64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
    mask = pa.array([r is None for r in rows])
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.float32)), mask=mask) for v in (flat.real, flat.imag))


def kernel_pass(df: DataFrame, function, read: list[str], key: str = "sample_id") -> DataFrame:
    """i, q := function(key, complex array, dict of the ``read`` columns) in one Arrow pass; other columns stay."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.FloatType()), True) if f.name in ("i", "q") else f for f in df.schema.fields])
    names = df.columns

    def run(batches):
        for b in batches:
            at = {n: k for k, n in enumerate(names)}
            xs = as_complex(b.column(at["i"]), b.column(at["q"]))
            keys = b.column(at[key]).to_pylist()
            extra = [b.column(at[c]).to_pylist() for c in read]
            i, q = as_lists([None if x is None else function(k, x, dict(zip(read, e))) for k, x, *e in zip(keys, xs, *extra)])
            yield pa.RecordBatch.from_arrays([i if n == "i" else q if n == "q" else b.column(at[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def apply(df: DataFrame, *chain, key: str = "sample_id", seed: int = 0, keep_draws: bool = False) -> DataFrame:
    """Runs the chain on signals (key, i array<float>, q array<float>, metadata...).

    Results do not depend on partitioning or order.  Null signals stay null, empty ones stay empty.
    Required columns of the ops are checked before anything runs.  A layout of LAYOUTS may stand last: the column
    ``data`` takes the place of i and q.
    """
    if any(isinstance(x, str) and x in LAYOUTS for x in chain):
        *chain, layout = chain
        if layout not in LAYOUTS or any(isinstance(x, str) and x in LAYOUTS for x in chain):
            raise ValueError("a layout ends the chain")
        return apply(df, *chain, key=key, seed=seed, keep_draws=keep_draws).withColumn("data", LAYOUTS[layout](F.col("i"), F.col("q"))).drop("i", "q")
    chain = simplified(chain)
    for _, o, _ in _flat(chain):
        scalar.require(df, list(o.required))
    if not chain:
        return df
    d = effects(draws(df, chain, key, seed, "draws"), chain)
    # the noise level of the sample, where there is one, is known to the ops
    given = [c for c in ("noise_power_db",) if c in df.columns]

    def run_chain(k, x, row):
        dr = row["draws"]
        known = {n: row[n] for n in given if row[n] is not None}

        def walk(items, path, x):
            for n, s in enumerate(items):
                at = f"{path}{n}"
                if isinstance(s, Maybe):
                    x = walk(steps(s.op), at + "m", x) if dr[at] else x
                elif isinstance(s, Pick):
                    for j in dr[at]:
                        x = walk(steps(s.ops[j]), f"{at}p{j}_", x)
                else:
                    p = known | s.fixed | {name: dr[f"{at}_{name}"] for name in s.draws}
                    x = s(x, p, Counter(stream_key(seed, k, at)))
            return x

        # in double precision throughout, rounded once at the end
        return walk(chain, "t", x.astype(np.complex128)) if len(x) else x

    d = kernel_pass(d, run_chain, ["draws", *given], key)
    return d if keep_draws else d.drop("draws")


def hash_key(k) -> int:
    """64 bits of a key, the same in every process."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little")


def spectrograms(df: DataFrame, size: int, stride: int | None = None, out: str = "spectrogram") -> DataFrame:
    """Adds the dB spectrogram as array<array<float>>, [bin from the highest frequency][frame]."""
    from ..kernels.ops import spectrogram

    return _derived(df, lambda x: spectrogram(x, size, stride), out, T.ArrayType(T.ArrayType(T.FloatType())), as_grids)


def as_grids(rows: list[np.ndarray | None]) -> pa.Array:
    """Two-dimensional float arrays as nested lists, without a Python object for each value."""
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    some = [r for r in rows if r is not None]
    flat = np.concatenate([r.ravel() for r in some]) if some else np.zeros(0)
    inner = pa.ListArray.from_arrays(ends(np.concatenate([np.full(len(r), r.shape[1]) for r in some]) if some else []), pa.array(flat.astype(np.float32)))
    return pa.ListArray.from_arrays(ends([0 if r is None else len(r) for r in rows]), inner, mask=pa.array([r is None for r in rows]))


def spectrogram_drops(df: DataFrame, rate=(0.001, 0.005), size=(1, 10), fill=("ffill", "bfill", "mean", "zero", "low", "min", "max", "ones"), key: str = "sample_id", seed: int = 0, column: str = "spectrogram") -> DataFrame:
    """Random stretches of each spectrogram filled; how many follows from its bins, what with from the draw of the row."""
    from ..kernels.channel import spectrogram_drop

    names = df.columns
    d = df.withColumn("_d", F.struct(rng.distribution(tuple(rate))(rng.uniform(seed, "sdrop.rate", key)).alias("rate"), rng.distribution(list(fill))(rng.uniform(seed, "sdrop.fill", key)).alias("fill")))
    schema = T.StructType([f for f in df.schema.fields])

    def run(batches):
        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            out = []
            for k, s, p in zip(*(b.column(at[c]).to_pylist() for c in (key, column, "_d"))):
                if s:
                    x = np.array(s)
                    r = np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, hash_key(f"sdrop{k}")]))
                    n = max(1, int(p["rate"] * x.size))
                    sizes = np.round(r.uniform(*size, n)).astype(int).clip(1, max(1, x.size // 4))
                    x = spectrogram_drop(x, [int(r.integers(1, max(2, x.size - z - 1))) for z in sizes], sizes, p["fill"])
                    s = x.astype(np.float32).tolist()
                out.append(s)
            new = pa.array(out, pa.list_(pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([new if n == column else b.column(at[n]) for n in names], names=names)

    return d.mapInArrow(run, schema)


def images(df: DataFrame, size: int, stride: int | None = None, black_hot: bool = True, out: str = "image") -> DataFrame:
    """Adds the spectrogram image: struct<h, w, c, data binary>, rows from the highest frequency."""
    from ..kernels.channel import spectrogram_image

    def make(x):
        im = spectrogram_image(x, size, stride or size, black_hot)
        return {"h": im.shape[0], "w": im.shape[1], "c": 3, "data": im.tobytes()}

    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in "hwc"] + [T.StructField("data", T.BinaryType())])
    return _derived(df, make, out, schema, pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())]))


def band_power(df: DataFrame, edge: float, sample_rate: float, out: str = "band_power") -> DataFrame:
    """Adds the share of a signal's power at frequencies within +-edge; null for null, empty and silent signals."""

    def make(x):
        p = np.abs(np.fft.fft(x)) ** 2
        return float(p[np.abs(np.fft.fftfreq(len(x))) * sample_rate <= edge].sum() / p.sum()) if p.any() else None

    return _derived(df, make, out, T.DoubleType(), pa.float64())


def _derived(df, make, out, kind, arrow):
    """Adds make(signal), null for null and empty ones; ``arrow`` is its type, or what makes an Arrow array of a list of them."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, kind)])
    names = df.columns

    def run(batches):
        for b in batches:
            at = {n: k for k, n in enumerate(names)}
            rows = [None if x is None or not len(x) else make(x) for x in as_complex(b.column(at["i"]), b.column(at["q"]))]
            made = arrow(rows) if callable(arrow) else pa.array(rows, arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(at[n]) for n in keep), made], names=[*keep, out])

    return df.mapInArrow(run, schema)
