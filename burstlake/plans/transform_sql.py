"""The transform kernels in SQL: parameters from the same md5 draws, samples from the same counter draws.

Every text returns, for each signal of 32 samples, its metadata after the transform, its length, its mean
power and a checksum in which every sample has its own weight.
"""

from __future__ import annotations

import math

from ..functions import rng
from ..kernels import dsp
from ..kernels.draws import MIX_A, MIX_B, STEP
from ..kernels.ops import OPS

N = 32
SIG = f"""sig AS (SELECT vec_id AS sample_id, n, (CASE WHEN n = vec_id % {N} THEN 0e0 ELSE embedding[2 * n + 1]::DOUBLE * (1 + vec_id % 7) END)::FLOAT::DOUBLE AS i,
  (CASE WHEN n = vec_id % {N} THEN 0e0 ELSE embedding[2 * n + 2]::DOUBLE * (1 + vec_id % 7) END)::FLOAT::DOUBLE AS q FROM embeddings CROSS JOIN (SELECT unnest(range({N}))::BIGINT AS n) AS r)"""


def lit(x) -> str:
    return f"({x:.17e})" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)


def drawn(spec, u: str) -> str:
    """One parameter from its specification, as functions.rng.distribution makes it."""
    params, scaling = spec
    if isinstance(params, list):
        return f"[{', '.join(map(lit, params))}][floor({u} * {len(params)})::INTEGER + 1]"
    lo, hi = params if isinstance(params, tuple) else (0.0, params)
    if scaling == "log10":
        lo, hi = math.log10(lo), math.log10(hi)
        return f"pow(10e0, {lit(float(lo))} + {u} * {lit(float(hi) - float(lo))})"
    return f"({lit(float(lo))} + {u} * {lit(float(hi) - float(lo))})"


def parameters(name: str, at: str = "t0", seed: int = 7) -> str:
    """par(sample_id, one column a parameter)"""
    o = OPS[name]
    cols = [f"{drawn(s, rng.uniform_sql(seed, f'{at}.{p}', 'sample_id'))} AS \"{p}\"" for p, s in o.draws.items()] + [f"{lit(v)} AS \"{p}\"" for p, v in o.fixed.items()]
    return f"par AS (SELECT sample_id{''.join(', ' + c for c in cols)} FROM (SELECT vec_id AS sample_id FROM embeddings))"


def counter(most: int, keys: str) -> str:
    """dr(sample_id, c, u): the first draws of the stream of each row of ``keys``: a query of (sample_id, k text)."""
    m = "18446744073709551616::UHUGEINT"
    return f"""ky AS (SELECT sample_id, ('0x' || substr(md5(k), 1, 16))::UBIGINT::UHUGEINT AS key FROM ({keys})),
 z0 AS (SELECT sample_id, c, (key + (c + 1)::UHUGEINT * {STEP}::UHUGEINT) % {m} AS z FROM ky CROSS JOIN (SELECT unnest(range({most}))::BIGINT AS c) AS r),
 z1 AS (SELECT sample_id, c, (xor(z, z >> 30) * {MIX_A}::UHUGEINT) % {m} AS z FROM z0), z2 AS (SELECT sample_id, c, (xor(z, z >> 27) * {MIX_B}::UHUGEINT) % {m} AS z FROM z1),
 dr AS MATERIALIZED (SELECT sample_id, c, ((xor(z, z >> 31) >> 11)::DOUBLE + 0.5e0) / 9007199254740992e0 AS u FROM z2)"""


def stream(most: int, at: str = "t0", seed: int = 7) -> str:
    return counter(most, f"SELECT vec_id AS sample_id, concat_ws('|', '{seed}', vec_id::VARCHAR, '{at}') AS k FROM embeddings")


def gauss(name: str, at="0", size=N, where: str = "dr") -> str:
    """name(sample_id, n, g): ``size`` normal draws from draw ``at`` on; both may be expressions over par."""
    return f"""{name} AS (SELECT a.sample_id, a.c - ({at}) AS n, sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) AS g FROM dr a JOIN par USING (sample_id)
  JOIN dr b ON b.sample_id = a.sample_id AND b.c = a.c + ({size}) WHERE a.c >= ({at}) AND a.c < ({at}) + ({size}))"""


def peak(name: str, src: str) -> str:
    """name(sample_id, m): the largest magnitude of the windowed spectrum."""
    w = f"0.35875e0 - 0.48829e0 * cos(2 * pi() * n / {N - 1}) + 0.14128e0 * cos(4 * pi() * n / {N - 1}) - 0.01168e0 * cos(6 * pi() * n / {N - 1})"
    return f"""{name} AS (SELECT sample_id, max(sqrt(re * re + im * im)) AS m FROM (SELECT sample_id, k, sum(w * (i * cos(t) + q * sin(t))) AS re, sum(w * (q * cos(t) - i * sin(t))) AS im
  FROM (SELECT sample_id, k, i, q, {w} AS w, 2 * pi() * ((k * n) % {N}) / {N} AS t FROM {src} CROSS JOIN (SELECT unnest(range({N})) AS k) AS r) GROUP BY sample_id, k) GROUP BY sample_id)"""


def bank(branches: int) -> str:
    """hh(k, h): the prototype of a polyphase bank of this many branches, times their number: a Kaiser-windowed sinc with the length of the kernel's."""
    n = len(dsp.prototype(branches))
    half, edge = (n - 1) / 2, 1 / (2 * branches)
    beta = f"(0.1102e0 * (2.285e0 * {n - 1} * pi() * {lit(edge)} / 0.5e0 + 7.95e0 - 8.7e0))"
    i0 = lambda x: f"CASE WHEN {x} <= 0 THEN 1e0 ELSE list_sum(list_transform(range(60), lambda j: exp(2 * (j * ln({x} / 2) - lgamma(j + 1e0))))) END"
    arg = f"({beta} * sqrt(greatest(0e0, 1 - pow((k - {half}) / {half}, 2))))"
    sinc = f"CASE WHEN k = {half} THEN 1e0 ELSE sin(pi() * {lit(edge / 0.5)} * (k - {half})) / (pi() * {lit(edge / 0.5)} * (k - {half})) END"
    return f"hr AS (SELECT k, {sinc} * {i0(arg)} AS v FROM (SELECT unnest(range({n}))::BIGINT AS k)), hh AS MATERIALIZED (SELECT k, v / (SELECT sum(v) FROM hr) * {branches} AS h FROM hr)"


def rotated(angle: str) -> tuple[str, str]:
    return f"i * cos({angle}) - q * sin({angle})", f"i * sin({angle}) + q * cos({angle})"


CHECK = "count(*)::INTEGER AS n, round(avg(i * i + q * q), 3) + 0e0 AS mean_power, round(sum(i * cos(n) + q * sin(n)), 5) + 0e0 AS checksum"
_MEAN = "SELECT sample_id, avg(i * i + q * q) AS m FROM"
_TAPS = ", ".join(lit(float(x)) for x in dsp.low_pass(0.25, 0.25, 4.0))
#: The last N samples of the full convolution with the taps: y(m) is the sum of taps(L - (j - m)) x(j) over j from m on.
_FILTERED = "SELECT a.sample_id, a.n, sum(t.h[len(t.h) - (b.n - a.n)] * b.i) AS i, sum(t.h[len(t.h) - (b.n - a.n)] * b.q) AS q FROM {0} a JOIN {0} b ON a.sample_id = b.sample_id AND b.n >= a.n CROSS JOIN (SELECT [" + _TAPS + "] AS h) t GROUP BY 1, 2"
_G2 = [gauss("g1", "0"), gauss("g2", str(2 * N))]
_NOISE = "(SELECT g1.sample_id, g1.n, g1.g AS i, g2.g AS q FROM g1 JOIN g2 USING (sample_id, n))"
_FLOOR = f"(-20e0 + 10 * log10({N}))"
_CUT_A = f"floor(start * (1 - duration) * {N})::BIGINT"
_CUT_B = f"least({N}, {_CUT_A} + floor(duration * {N})::BIGINT)"
_CUT_N = f"({_CUT_B} - {_CUT_A})"
_snr = lambda added: f"round(20e0 + 10 * log10(pow(10e0, -2e0) / (pow(10e0, -2e0) + {added})), 6)"
_bits = "pow(2, round_even(bits, 0) - 1)"
_scale = "(pow(10e0, ref_db / 20) / p)"
_level = lambda c: f"CASE WHEN p = 0 THEN 0e0 ELSE greatest(-{_bits}, least({_bits} - 1, floor({c} * {_scale} * {_bits} + CASE WHEN rounding = 'floor' THEN 0.5e0 ELSE 1.5e0 END))) / {_bits} / {_scale} END"
_from = lambda *t: "sig JOIN par USING (sample_id)" + "".join(f" JOIN {x} USING (sample_id, n)" for x in t)
_size = "least(8, greatest(1, round_even(1 + u0 * 9, 0)))::BIGINT"
_knot = lambda k: f"(100e0 * {k} / (100 * taps - 1) * (taps - 1))"


def _one(name: str) -> dict | None:
    """What the SQL of one transform is made of: ctes, i, q, source, and what changes in the metadata."""
    flat = {"ctes": [], "source": _from()}
    match name:
        case "AWGN":
            a = "pow(10e0, noise_power_db / 20) / sqrt(2)"
            return {"ctes": [stream(4 * N), *_G2], "i": f"i + {a} * g1.g", "q": f"q + {a} * g2.g", "source": _from("g1", "g2"), "snr": _snr("pow(10e0, noise_power_db / 10)")}
        case "AddSlope":
            w = "OVER (PARTITION BY sample_id ORDER BY n)"
            return flat | {"i": f"2 * i - coalesce(lag(i) {w}, i)", "q": f"2 * q - coalesce(lag(q) {w}, q)"}
        case "AdditiveNoise":
            a = "sqrt(power / m)"
            return {"ctes": [stream(4 * N), *_G2, f"lv AS ({_MEAN} {_NOISE} GROUP BY sample_id)"], "i": f"i + g1.g * {a}", "q": f"q + g2.g * {a}", "source": _from("g1", "g2") + " JOIN lv USING (sample_id)", "snr": _snr("power")}
        case "CochannelInterference":
            return {"ctes": [stream(4 * N), *_G2, f"ns AS {_NOISE}", f"fl AS ({_FILTERED.format('ns')})", f"lv AS ({_MEAN} fl GROUP BY sample_id)"],
                    "i": "sig.i + fl.i * sqrt(power / m)", "q": "sig.q + fl.q * sqrt(power / m)", "source": _from("fl") + " JOIN lv USING (sample_id)", "snr": _snr("power")}
        case "AdjacentChannelInterference":
            turn = "(2 * pi() * center * n + phase_sigma * g)"
            i, q = rotated(turn)
            return {"ctes": [stream(2 * N + 2), gauss("g1"), gauss("g2", str(2 * N), "1"), f"fl AS ({_FILTERED.format('sig')})", f"ro AS (SELECT sample_id, n, {i} AS i, {q} AS q FROM fl JOIN par USING (sample_id) JOIN g1 USING (sample_id, n))",
                             "mv AS (SELECT ro.sample_id, ro.n + round_even(g2.g * time_sigma, 0)::BIGINT AS n, i, q FROM ro JOIN par USING (sample_id) JOIN g2 ON g2.sample_id = ro.sample_id)",
                             f"al AS (SELECT sig.sample_id, sig.n, sig.i AS a, sig.q AS b, coalesce(mv.i, 0e0) AS i, coalesce(mv.q, 0e0) AS q FROM sig LEFT JOIN mv USING (sample_id, n))", f"lv AS ({_MEAN} al GROUP BY sample_id)"],
                    "i": "a + CASE WHEN m > 0 THEN i * sqrt(power / m) ELSE i END", "q": "b + CASE WHEN m > 0 THEN q * sqrt(power / m) ELSE q END", "source": "al JOIN par USING (sample_id) JOIN lv USING (sample_id)"}
        case "CarrierFrequencyDrift":
            i, q = rotated("a")
            return {"ctes": [stream(2 * N), gauss("g1"), "an AS (SELECT sample_id, n, 2 * pi() * sum(g * drift_ppm * 1e-6) OVER (PARTITION BY sample_id ORDER BY n) AS a FROM g1 JOIN par USING (sample_id))"], "i": i, "q": q, "source": _from("an")}
        case "CarrierPhaseNoise":
            i, q = rotated("radians(g * degrees)")
            return {"ctes": [stream(2 * N), gauss("g1")], "i": i, "q": q, "source": _from("g1")}
        case "CarrierPhaseOffset":
            i, q = rotated("phase")
            return flat | {"i": i, "q": q}
        case "ChannelSwap":
            return flat | {"i": "q", "q": "i", "center": "-0.1e0"}
        case "SpectralInversion":
            return flat | {"i": "i", "q": "-q", "center": "-0.1e0"}
        case "TimeReversal":
            return flat | {"i": "i", "q": "CASE WHEN undo THEN -q ELSE q END", "n": f"{N - 1} - n", "center": "CASE WHEN undo THEN 0.1e0 ELSE -0.1e0 END", "start": "9"}
        case "CoarseGainChange":
            a = f"CASE WHEN n >= 1 + floor(\"at\" * {N - 2}) THEN pow(10e0, gain_db / 10) ELSE 1e0 END"
            return flat | {"i": f"i * {a}", "q": f"q * {a}"}
        case "Shadowing":
            a = "pow(10e0, (mean_db + sigma_db * g) / 20)"
            return {"ctes": [stream(2), gauss("g1", "0", "1")], "i": f"i * {a}", "q": f"q * {a}", "source": "sig JOIN par USING (sample_id) JOIN (SELECT sample_id, g FROM g1) USING (sample_id)"}
        case "Normalize":
            a = "sqrt(sum(i * i + q * q) OVER (PARTITION BY sample_id))"
            return flat | {"i": f"i / {a}", "q": f"q / {a}"}
        case "Quantize":
            src = "(SELECT *, max(greatest(abs(i), abs(q))) OVER (PARTITION BY sample_id) AS p FROM sig) JOIN par USING (sample_id)"
            return {"ctes": [], "i": _level("i"), "q": _level("q"), "source": src}
        case "PatchShuffle":
            # of 32 samples the default ratio takes no patch
            return flat | {"i": "i", "q": "q"}
        case "RandomDropSamples":
            hit = f"floor(rate * {N}) >= 1 AND n >= a AND n < a + k"
            pre = f"dp AS (SELECT sample_id, k, 1 + floor(u1 * (greatest(2, {N - 1} - k) - 1))::BIGINT AS a FROM (SELECT a.sample_id, {_size.replace('u0', 'a.u')} AS k, b.u AS u1 FROM dr a JOIN dr b ON a.sample_id = b.sample_id AND a.c = 0 AND b.c = 1))"
            fill = lambda c: f"CASE fill WHEN 'ffill' THEN max(CASE WHEN n = a - 1 THEN {c} END) OVER w WHEN 'bfill' THEN max(CASE WHEN n = a + k THEN {c} END) OVER w WHEN 'mean' THEN avg({c}) OVER w ELSE 0e0 END"
            return {"ctes": [stream(2), pre], **{c: f"CASE WHEN {hit} THEN {fill(c)} ELSE {c} END" for c in "iq"}, "source": _from() + " JOIN dp USING (sample_id) WINDOW w AS (PARTITION BY sample_id)"}
        case "CutOut":
            level = "CASE fill WHEN 'low_noise' THEN pow(10e0, -5e0) WHEN 'high_noise' THEN 100e0 ELSE avg(i * i + q * q) OVER (PARTITION BY sample_id) END / sqrt(2)"
            inside = f"n >= {_CUT_A} AND n < {_CUT_B}"
            g = [gauss("g1", "0", _CUT_N), gauss("g2", f"2 * {_CUT_N}", _CUT_N)]
            src = f"(SELECT sig.*, par.* EXCLUDE (sample_id), g1.g AS ga, g2.g AS gb FROM sig JOIN par USING (sample_id) LEFT JOIN g1 ON g1.sample_id = sig.sample_id AND g1.n = sig.n - {_CUT_A} LEFT JOIN g2 ON g2.sample_id = sig.sample_id AND g2.n = sig.n - {_CUT_A})"
            value = lambda g: f"CASE fill WHEN 'zeros' THEN 0e0 WHEN 'ones' THEN 1e0 ELSE {level} * {g} END"
            b = f"({_CUT_A} + floor(duration * {N})::BIGINT)"
            begin = f"CASE WHEN {_CUT_A} <= 3 AND {b} > 3 AND {b} < 23 THEN {b} ELSE 3 END"
            return {"ctes": [stream(4 * N), *g], "i": f"CASE WHEN {inside} THEN {value('ga')} ELSE i END", "q": f"CASE WHEN {inside} THEN {value('gb')} ELSE q END", "source": src, "start": f"({begin})::BIGINT"}
        case "DigitalAGC":
            pre = f"""rf AS (SELECT sample_id, coalesce(avg(CASE WHEN i <> 0 OR q <> 0 THEN ln(sqrt(i * i + q * q)) END) + any_value(ref_offset), 0e0) AS ref FROM sig JOIN par USING (sample_id) GROUP BY sample_id),
 xs AS (SELECT sample_id, n, i, q, CASE WHEN i = 0 AND q = 0 THEN NULL ELSE ln(sqrt(i * i + q * q)) END AS lm, ref, par.* EXCLUDE (sample_id) FROM sig JOIN par USING (sample_id) JOIN rf USING (sample_id)),
 run AS (SELECT sample_id, -1::BIGINT AS n, 0e0 AS level, 0e0 AS gain FROM par UNION ALL
  SELECT sample_id, n, level, before + (ref - (level + before)) * CASE WHEN level <= ref - 10 - low_offset THEN 0e0 WHEN level + before >= ref + 10 + high_offset THEN alpha_overflow WHEN abs(ref - (level + before)) > track_range_db THEN alpha_acquire ELSE alpha_track END
  FROM (SELECT xs.*, r.gain AS before, CASE WHEN lm IS NULL THEN -200e0 WHEN xs.n = 0 THEN lm ELSE r.level * alpha_smooth + lm * (1 - alpha_smooth) END AS level FROM run r JOIN xs ON xs.sample_id = r.sample_id AND xs.n = r.n + 1))"""
            return {"ctes": [pre], "i": "i * exp(gain)", "q": "q * exp(gain)", "source": _from("run")}
        case "Fading":
            taps = "ceil(1 / coherence)::BIGINT"
            h = f"(SELECT sample_id, n AS k, taps, {_knot('n')} AS x FROM (SELECT sample_id, {taps} AS taps FROM par) JOIN (SELECT sample_id, n FROM g1) USING (sample_id))"
            lerp = lambda t: f"{t}0.g + ({t}1.g - {t}0.g) * (x - floor(x))"
            at = " ".join(f"JOIN g{j} {t}{s} ON {t}{s}.sample_id = h.sample_id AND {t}{s}.n = least(floor(x)::BIGINT + {s}, taps - 1)" for t, j in (("a", 1), ("b", 2)) for s in (0, 1))
            conv = "SELECT x.sample_id, x.n, sum(y.i * hh.i - y.q * hh.q) AS i, sum(y.i * hh.q + y.q * hh.i) AS q FROM sig x JOIN sig y ON x.sample_id = y.sample_id AND y.n >= x.n JOIN hh ON hh.sample_id = x.sample_id AND hh.k = hh.taps - 1 - (y.n - x.n) GROUP BY 1, 2"
            a = "sqrt(ms.m / mv.m)"
            return {"ctes": [stream(400), gauss("g1", "0", taps), gauss("g2", f"2 * {taps}", taps), f"hh AS (SELECT h.sample_id, h.k, h.taps, {lerp('a')} AS i, {lerp('b')} AS q FROM {h} h {at})", f"cv AS ({conv})", f"ms AS ({_MEAN} sig GROUP BY sample_id)", f"mv AS ({_MEAN} cv GROUP BY sample_id)"],
                    "i": f"i * {a}", "q": f"q * {a}", "source": "cv JOIN par USING (sample_id) JOIN ms USING (sample_id) JOIN mv USING (sample_id)"}
        case "IntermodulationProducts":
            c = lambda k: f"pow(10e0, -4 + {k} * 3)"
            co = f"""co AS (SELECT sample_id, CASE WHEN "order" = 3 THEN (SELECT {c('u')} FROM dr WHERE dr.sample_id = par.sample_id AND c = 0) ELSE c0 END AS c0, CASE WHEN "order" = 3 THEN 0e0 ELSE c1 END AS c1
  FROM par JOIN (SELECT sample_id, arg_min(c0, t) AS c0, arg_min(c1, t) AS c1 FROM (SELECT a.sample_id, a.c // 2 AS t, {c('a.u')} AS c0, {c('b.u')} AS c1 FROM dr a JOIN dr b ON a.sample_id = b.sample_id AND b.c = a.c + 1 WHERE a.c % 2 = 0) WHERE c1 <= c0 GROUP BY sample_id) USING (sample_id))"""
            f = "(1 + c0 * (i * i + q * q) + c1 * (i * i + q * q) * (i * i + q * q))"
            return {"ctes": [stream(60), co, f"yy AS (SELECT sample_id, n, i * {f} AS i, q * {f} AS q FROM sig JOIN co USING (sample_id))", peak("px", "sig"), peak("py", "yy")],
                    "i": "i * px.m / py.m", "q": "q * px.m / py.m", "source": "yy JOIN par USING (sample_id) JOIN px USING (sample_id) JOIN py USING (sample_id)"}
        case "NonlinearAmplifier":
            y = "sqrt(s * tanh(p / (s / gain)))"
            turn = "(atan2(q, i) + phi_max / 2 * (tanh((p - s / gain) / abs(phi_slope)) + 1))"
            pre = f"am AS (SELECT *, i * i + q * q AS p, avg(i * i + q * q) OVER (PARTITION BY sample_id) * backoff AS s FROM sig JOIN par USING (sample_id))"
            return {"ctes": [pre, f"yy AS (SELECT sample_id, n, {y} * cos({turn}) AS i, {y} * sin({turn}) AS q FROM am)", peak("px", "sig"), peak("py", "yy")],
                    "i": "i * px.m / py.m", "q": "q * px.m / py.m", "source": "yy JOIN par USING (sample_id) JOIN px USING (sample_id) JOIN py USING (sample_id)"}
        case "IQImbalance":
            g = "pow(10e0, amplitude / 10)"
            yy = f"yy AS (SELECT sample_id, n, {g} * (cos(phase / 2) * i - sin(phase / 2) * q) AS i, {g} * (cos(phase / 2) * q - sin(phase / 2) * i) AS q FROM sig JOIN par USING (sample_id))"
            sp = f"sp AS (SELECT sample_id, k, sqrt(re * re + im * im) AS mag FROM (SELECT sample_id, k, sum(i * cos(t) + q * sin(t)) AS re, sum(q * cos(t) - i * sin(t)) AS im FROM (SELECT sample_id, k, i, q, 2 * pi() * ((k * n) % {N}) / {N} AS t FROM yy CROSS JOIN (SELECT unnest(range({N})) AS k) AS r) GROUP BY sample_id, k))"
            fl = "fl AS (SELECT sample_id, min(m) AS f FROM (SELECT sample_id, k, avg(mag) OVER (PARTITION BY sample_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM sp) WHERE k BETWEEN 5 AND 30 GROUP BY sample_id)"
            a = f"pow(10e0, (20 * log10(f) - 20 * log10({N}) + dc_db) / 20)"
            return {"ctes": [yy, sp, fl], "i": f"i + {a} * cos(dc_phase)", "q": f"q + {a} * sin(dc_phase)", "source": "yy JOIN par USING (sample_id) JOIN fl USING (sample_id)"}
        case "Spurs":
            near = f"list_max(list_transform(range({N}), lambda k: abs(sin(pi() * {N} * (f - k / {N}e0)) / sin(pi() * (f - k / {N}e0)))))"
            tn = f"""tn AS (SELECT a.sample_id, f, pow(10e0, ({_FLOOR} + p) / 20) / {near} AS amp FROM (SELECT a.sample_id, greatest(-0.499e0, least(0.499e0, -0.5e0 + a.u)) AS f, b.u * 30 AS p
  FROM par JOIN dr a USING (sample_id) JOIN dr b ON b.sample_id = a.sample_id AND b.c = a.c + round_even(count, 0)::BIGINT WHERE a.c < round_even(count, 0)) a),
 ad AS (SELECT sample_id, n, sum(amp * cos(2 * pi() * f * n)) AS a, sum(amp * sin(2 * pi() * f * n)) AS b FROM tn CROSS JOIN (SELECT unnest(range({N}))::BIGINT AS n) AS r GROUP BY 1, 2)"""
            return {"ctes": [stream(8), tn], "i": "i + a", "q": "q + b", "source": _from("ad")}
        case "ClockDrift" | "ClockJitter":
            b = dsp.CLOCK_BRANCHES
            t = -(-len(dsp.prototype(b)) // b)
            stop = N + t - 1
            m, front = stop + 64, -(-(stop - 1 - N) // 2)
            ppm = "drift_ppm" if name == "ClockDrift" else "jitter_ppm"
            own = f"sum(g * {ppm} * 1e-6) OVER (PARTITION BY sample_id ORDER BY n)" if name == "ClockDrift" else f"g * {ppm} * 1e-6"
            tr = f"""tr AS (SELECT sample_id, n, 1e0 + coalesce(sum(step) OVER (PARTITION BY sample_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS q FROM (SELECT sample_id, n, {b}e0 + {own} AS step FROM g1 JOIN par USING (sample_id))),
 ph AS (SELECT *, greatest(0, least({b - 1}, floor(q - a * {b})))::BIGINT AS phase FROM (SELECT *, floor(q / {b})::BIGINT AS a, count(*) OVER (PARTITION BY sample_id) AS many FROM tr WHERE floor(q / {b}) < {stop})),
 cv AS (SELECT ph.sample_id, ph.n - {front} AS n, sum(x.i * h) AS i, sum(x.q * h) AS q FROM ph JOIN sig x ON x.sample_id = ph.sample_id AND x.n <= a AND x.n > a - {t} JOIN hh ON hh.k = (a - x.n) * {b} + phase WHERE ph.n < many - 1 GROUP BY 1, 2),
 ot AS (SELECT sample_id, n, coalesce(cv.i, 0e0) AS i, coalesce(cv.q, 0e0) AS q FROM (SELECT sample_id, n FROM sig) LEFT JOIN cv USING (sample_id, n))"""
            return {"ctes": [bank(b), stream(4 * m), gauss("g1", str(2 * m if name == "ClockDrift" else 0), str(m)), tr], "i": "i", "q": "q", "source": "ot JOIN par USING (sample_id)"}
        case "Doppler":
            b = dsp.PROTOTYPE_BRANCHES
            n = len(dsp.prototype(b))
            a = "(speed / (speed - velocity))"
            pr = f"pr AS (SELECT sample_id, 1 / {a} AS rate, {N} + ceil({N} * ({a} - 1))::BIGINT + 1 AS many FROM par), pq AS (SELECT *, ceil({b} / rate)::BIGINT AS down, {n - 1} / {b}e0 * rate AS trim FROM pr), pz AS (SELECT *, -((-((many - 1) * {b} + {n})) // down) AS total FROM pq)"
            cv = f"""cv AS (SELECT o.sample_id, o.m - floor(trim / 2)::BIGINT AS n, sum(x.i * h) AS i, sum(x.q * h) AS q FROM (SELECT *, unnest(range(floor(trim / 2)::BIGINT, total - ceil(trim / 2)::BIGINT)) AS m FROM pz) o JOIN sig x ON x.sample_id = o.sample_id JOIN hh ON hh.k = o.m * down - x.n * {b} GROUP BY 1, 2),
 ot AS (SELECT sample_id, n, coalesce(cv.i, 0e0) AS i, coalesce(cv.q, 0e0) AS q FROM (SELECT sample_id, n FROM sig) LEFT JOIN cv USING (sample_id, n))"""
            return {"ctes": [bank(b), pr, cv], "i": "i", "q": "q", "source": "ot JOIN par USING (sample_id)", "center": f"0.1e0 * {a}"}
        case "TimeVaryingNoise":
            drawn_ = "(inflections > 0 AND random_regions)"
            ed = f"""kn AS (SELECT sample_id, 0::BIGINT AS a FROM par UNION ALL SELECT sample_id, {N} FROM par WHERE inflections = 0 OR random_regions UNION ALL SELECT sample_id, 2 * unnest(range(1, 12)) FROM par WHERE inflections > 0 AND NOT random_regions
  UNION ALL SELECT sample_id, c FROM (SELECT sample_id, c, row_number() OVER (PARTITION BY sample_id ORDER BY u) AS r FROM dr WHERE c < {N}) JOIN par USING (sample_id) WHERE {drawn_} AND r <= 10),
 kd AS (SELECT sample_id, a, lead(a) OVER w AS b, row_number() OVER w - 1 AS k FROM kn WINDOW w AS (PARTITION BY sample_id ORDER BY a)),
 lv AS (SELECT sig.sample_id, sig.n, coalesce(CASE WHEN k % 2 = 0 THEN low + (high - low) * x ELSE high + (low - high) * x END, 0e0) AS db FROM sig JOIN par USING (sample_id)
  LEFT JOIN (SELECT *, CASE WHEN b - a = 1 THEN 0e0 ELSE (m - a) / (b - a - 1e0) END AS x FROM (SELECT *, unnest(range(a, b)) AS m FROM kd WHERE b > a)) s ON s.sample_id = sig.sample_id AND s.m = sig.n)"""
            at = f"CASE WHEN {drawn_} THEN {N} ELSE 0 END"
            a = "pow(10e0, db / 20) / sqrt(2)"
            return {"ctes": [stream(5 * N), ed, gauss("g1", at), gauss("g2", f"{at} + {2 * N}")], "i": f"i + {a} * g1.g", "q": f"q + {a} * g2.g", "source": _from("lv", "g1", "g2")}
    return None


def transform(name: str) -> str | None:
    """The SQL of the query tf_<name>, or None."""
    s = _one(name)
    if s is None:
        return None
    meta = f"round({s.get('center', '0.1e0')}, 9) AS center_freq, ({s.get('start', '3')})::BIGINT AS start_in_samples, {s.get('snr', '20e0')} AS snr_db"
    ctes = ", ".join([SIG, parameters(name), *s["ctes"]])
    n = s.get("n", "n")
    return f"""WITH RECURSIVE {ctes}, o AS (SELECT sample_id, {n} AS n, ({s['i']})::FLOAT::DOUBLE AS i, ({s['q']})::FLOAT::DOUBLE AS q FROM {s['source']}), c AS (SELECT sample_id, {CHECK} FROM o GROUP BY sample_id)
SELECT sample_id, {meta}, n, mean_power, checksum FROM c JOIN par USING (sample_id)"""


SQL = {f"tf_{name}": text for name in OPS if (text := transform(name))}
