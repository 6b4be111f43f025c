"""Queries on signals and their metadata, each beside the SQL that must give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays, geometry, rng, scalar
from ..operators import iq, labels, spectral
from .views import BOXES, BURSTS, IQ, IQ_ARRAY, SERIES, boxes, bursts, iq_array, iq_long, r6, series, t

QUERIES: dict = {}
SQL: dict[str, str] = {}
BY = ["vec_id"]


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def elementwise(name, make, i_sql, q_sql, extra="", source="iq", n_sql="n"):
    """A long-form operator and the SQL of its rails over the view iq (or a view built on it)."""
    QUERIES[name] = lambda spark, d: r6(make(iq_long(spark, d)).select("vec_id", "n", "i", "q"), "i", "q")
    SQL[name] = f"WITH {IQ}{extra} SELECT vec_id, {n_sql} AS n, round({i_sql}, 6) + 0e0 AS i, round({q_sql}, 6) + 0e0 AS q FROM {source}"


def rot(angle):
    return f"i * cos({angle}) - q * sin({angle})", f"i * sin({angle}) + q * cos({angle})"


# --- elementwise ---------------------------------------------------------------------------------------------
elementwise("op_phase_offset", lambda x: iq.phase_offset(x, F.lit(0.7)), *rot("0.7e0"))
elementwise("op_channel_swap", iq.channel_swap, "q", "i")
elementwise("op_spectral_inversion", iq.spectral_inversion, "i", "-q")
elementwise("op_coarse_gain", lambda x: iq.coarse_gain(x, F.lit(-3.0), F.lit(10)), "i * CASE WHEN n >= 10 THEN pow(10e0, -0.3e0) ELSE 1e0 END", "q * CASE WHEN n >= 10 THEN pow(10e0, -0.3e0) ELSE 1e0 END")
elementwise("op_frequency_shift", lambda x: iq.frequency_shift(x, F.lit(0.11), F.lit(1.0)), *rot("2 * pi() * 0.11e0 * n"))
elementwise("op_add_slope", lambda x: iq.add_slope(x, BY), "2 * i - coalesce(lag(i) OVER w, i)", "2 * q - coalesce(lag(q) OVER w, q)", source="iq WINDOW w AS (PARTITION BY vec_id ORDER BY n)")
elementwise("op_time_reversal", lambda x: iq.time_reversal(x, BY, F.col("vec_id") % 2 == 0), "i", "CASE WHEN vec_id % 2 = 0 THEN -q ELSE q END", n_sql="31 - n")
for _o, _norm in ((1, "sum(sqrt(i*i + q*q)) OVER w"), (2, "sqrt(sum(i*i + q*q) OVER w)"), (math.inf, "max(sqrt(i*i + q*q)) OVER w")):
    elementwise(f"op_normalize_{'inf' if _o == math.inf else f'l{_o}'}", lambda x, o=_o: iq.normalize(x, BY, o), f"i / {_norm}", f"q / {_norm}", source="iq WINDOW w AS (PARTITION BY vec_id)")
for _mode, _more in (("floor", 0.5), ("ceiling", 1.5)):
    _lev = lambda c: f"CASE WHEN p = 0 THEN 0e0 ELSE greatest(-32e0, least(31e0, floor({c} / p * 32 + {_more}e0))) / 32 * p END"
    elementwise(f"op_quantize_{_mode}", lambda x, m=_mode: iq.quantize(x, BY, 6, 0.0, m), _lev("i"), _lev("q"), extra=", peak AS (SELECT vec_id, n, i, q, max(greatest(abs(i), abs(q))) OVER (PARTITION BY vec_id) AS p FROM iq)", source="peak")
_dc = f"pow(10e0, (-20e0 - 10 * log10(32) + 2e0) / 20)"
_g, _c, _s = f"pow(10e0, 0.05e0)", "cos(0.02e0)", "sin(0.02e0)"
elementwise("op_iq_imbalance", lambda x: iq.iq_imbalance(x, BY, 0.5, 0.04, 2.0, 0.3, -20.0), f"{_g} * ({_c} * i - {_s} * q) + {_dc} * cos(0.3e0)", f"{_g} * ({_c} * q - {_s} * i) + {_dc} * sin(0.3e0)")
_spur = [f"pow(10e0, (-20e0 - 10 * log10(32) + {p}e0) / 20) * {{}}(2 * pi() * {f}e0 * n)" for f, p in ((0.25, 3), (-0.125, 6))]
elementwise("op_spurs", lambda x: iq.spurs(x, BY, [0.25, -0.125], [3.0, 6.0], -20.0), "i + " + " + ".join(s.format("cos") for s in _spur), "q + " + " + ".join(s.format("sin") for s in _spur))
elementwise("op_nonlinear_amplifier", lambda x: iq.nonlinear_amplifier(x, BY, 1.0, 10.0, 0.1, 0.5),
            "sqrt(s * tanh(p / s)) * cos(atan2(q, i) + 0.05e0 * (tanh((p - s) / 0.5e0) + 1))", "sqrt(s * tanh(p / s)) * sin(atan2(q, i) + 0.05e0 * (tanh((p - s) / 0.5e0) + 1))",
            extra=", amp AS (SELECT *, i*i + q*q AS p, 10 * avg(i*i + q*q) OVER (PARTITION BY vec_id) AS s FROM iq)", source="amp")
elementwise("op_imd", lambda x: iq.intermodulation(x, (1.0, 0.0, 0.1, 0.0, -0.02)), "i * (1 + 0.1e0 * (i*i + q*q) - 0.02e0 * (i*i + q*q) * (i*i + q*q))", "q * (1 + 0.1e0 * (i*i + q*q) - 0.02e0 * (i*i + q*q) * (i*i + q*q))")
_table = """, knots AS (SELECT unnest([-100e0, -20e0, -10e0, 0e0, 5e0, 10e0]) AS a, unnest([-90e0, -10e0, 0e0, 9e0, 9.9e0, 10e0]) AS b, unnest([0e0, -2e0, -4e0, 7e0, 12e0, 23e0]) AS c),
 lin AS (SELECT pow(10e0, a / 10) AS x0, lead(pow(10e0, a / 10)) OVER (ORDER BY a) AS x1, pow(10e0, b / 10) AS p0, lead(pow(10e0, b / 10)) OVER (ORDER BY a) AS p1, radians(c) AS f0, lead(radians(c)) OVER (ORDER BY a) AS f1 FROM knots),
 pw AS (SELECT vec_id, n, i, q, least(greatest(i*i + q*q, pow(10e0, -10e0)), 10e0) AS p FROM iq),
 seg AS (SELECT pw.*, p0 + (p - x0) * ((p1 - p0) / (x1 - x0)) AS po, f0 + (p - x0) * ((f1 - f0) / (x1 - x0)) AS ph FROM pw JOIN lin ON x1 IS NOT NULL AND ((p > x0 AND p <= x1) OR (p = x0 AND x0 = pow(10e0, -10e0))))"""
elementwise("op_amp_table", iq.amplifier_table, "sqrt(po) * cos(atan2(q, i) + ph)", "sqrt(po) * sin(atan2(q, i) + ph)", extra=_table, source="seg")
for _fill, _v in (("zeros", "0e0"), ("ones", "1e0")):
    elementwise(f"op_cutout_{_fill}", lambda x, f=_fill: iq.cut_out(x, BY, 0.25, 0.3, f), *[f"CASE WHEN n >= 8 AND n < 17 THEN {_v} ELSE {c} END" for c in "iq"])
_gone = "((n >= 4 AND n < 7) OR (n >= 20 AND n < 25))"
for _fill, _v in (("ffill", "last_value(CASE WHEN NOT {g} THEN {c} END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), ("bfill", "first_value(CASE WHEN NOT {g} THEN {c} END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"), ("mean", "avg({c}) OVER (PARTITION BY vec_id)"), ("zero", "0e0")):
    elementwise(f"op_drop_{_fill}", lambda x, f=_fill: iq.drop_samples(x, BY, [(4, 3), (20, 5)], f), *[f"CASE WHEN {_gone} THEN {_v.format(g=_gone, c=c)} ELSE {c} END" for c in "iq"])
_taps = [0.1, -0.25, 0.5, 0.3, 0.05]
elementwise("op_fir", lambda x: iq.fir(x, BY, _taps), *[" + ".join(f"coalesce({'lag' if k >= 2 else 'lead'}({c}, {abs(k - 2)}) OVER w, 0e0) * {h}e0" for k, h in enumerate(_taps)) for c in "iq"], source="iq WINDOW w AS (PARTITION BY vec_id ORDER BY n)")
elementwise("op_upsample", lambda x: iq.upsample(x, 3), "CASE WHEN k = 0 THEN i ELSE 0e0 END", "CASE WHEN k = 0 THEN q ELSE 0e0 END", source="iq CROSS JOIN (SELECT unnest(range(3)) AS k) AS u", n_sql="n * 3 + k")
elementwise("op_decimate", lambda x: iq.decimate(x, 4), "i", "q", source="iq WHERE n % 4 = 0", n_sql="n // 4")


# --- recursions -------------------------------------------------------------------------------------------------
@q("op_agc", f"""WITH RECURSIVE {IQ}, run AS (
  SELECT vec_id, n, CASE WHEN i = 0 AND q = 0 THEN -200e0 ELSE ln(sqrt(i*i + q*q)) END AS level, 0e0 AS before, i, q FROM iq WHERE n = 0
  UNION ALL SELECT x.vec_id, x.n, CASE WHEN x.i = 0 AND x.q = 0 THEN -200e0 ELSE r.level * 0.1e0 + ln(sqrt(x.i*x.i + x.q*x.q)) * 0.9e0 END,
     r.before + (0e0 - (r.level + r.before)) * CASE WHEN r.level <= -80 THEN 0e0 WHEN r.level + r.before >= 0.5e0 THEN 0.2e0 WHEN abs(0e0 - (r.level + r.before)) > 1e0 THEN 0.05e0 ELSE 0.01e0 END, x.i, x.q
  FROM run r JOIN iq x ON x.vec_id = r.vec_id AND x.n = r.n + 1),
 g AS (SELECT *, before + (0e0 - (level + before)) * CASE WHEN level <= -80 THEN 0e0 WHEN level + before >= 0.5e0 THEN 0.2e0 WHEN abs(0e0 - (level + before)) > 1e0 THEN 0.05e0 ELSE 0.01e0 END AS gain FROM run)
SELECT vec_id, n, round(i * exp(gain), 6) + 0e0 AS i, round(q * exp(gain), 6) + 0e0 AS q FROM g""")  # fmt: skip
def op_agc(spark, d):
    out = iq.agc(iq_long(spark, d), BY, alpha_smooth=0.1, alpha_track=0.01, alpha_overflow=0.2, alpha_acquire=0.05, high_level_db=0.5)
    return r6(out, "i", "q")


@q("op_moving_average", f"WITH {SERIES} SELECT user_id, n, round(avg(i) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS mean FROM series")
def op_moving_average(spark, d):
    return r6(iq.moving_average(series(spark, d), ["user_id"], 8, "i", "mean").select("user_id", "n", "mean"), "mean")


@q("op_series_slope", f"WITH {SERIES} SELECT user_id, n, round(2 * i - coalesce(lag(i) OVER w, i), 6) + 0e0 AS i, round(2 * q - coalesce(lag(q) OVER w, q), 6) + 0e0 AS q FROM series WINDOW w AS (PARTITION BY user_id ORDER BY n)")
def op_series_slope(spark, d):
    return r6(iq.add_slope(series(spark, d), ["user_id"]), "i", "q")


# --- layout -------------------------------------------------------------------------------------------------------
def layout(name, make, sql):
    @q(name, f"WITH {IQ_ARRAY}, o AS (SELECT vec_id, {sql} AS v FROM arr) SELECT vec_id, unnest(range(len(v))) AS k, round(unnest(v), 6) + 0e0 AS v FROM o")
    def run(spark, d):
        x = iq_array(spark, d).select("vec_id", F.posexplode(make(F.col("i"), F.col("q"))).alias("k", "v"))
        return r6(x.select("vec_id", F.col("k").cast("bigint").alias("k"), "v"), "v")


layout("op_interleave", arrays.interleaved, "flatten(list_transform(range(1, len(i) + 1), lambda k: [i[k], q[k]]))")
layout("op_complex_to_2d", lambda i, qq: F.flatten(arrays.stacked(i, qq)), "list_concat(i, q)")
layout("op_pad", lambda i, qq: arrays.padded(i, 45), "list_concat(list_concat(list_transform(range(7), lambda k: 0e0), i), list_transform(range(6), lambda k: 0e0))")
layout("op_slice_head", lambda i, qq: arrays.head(i, 20), "i[1:20]")
layout("op_slice_middle", lambda i, qq: arrays.middle(i, 21), "i[7:27]")
layout("op_upsample_array", lambda i, qq: arrays.upsampled(i, 2), "flatten(list_transform(i, lambda x: [x, 0e0]))")
layout("op_partition_polyphase", lambda i, qq: F.flatten(arrays.partitioned(i, 5)), "flatten(list_transform(range(5), lambda b: list_transform(range(7), lambda k: coalesce(i[b + k * 5 + 1] * 5, 0e0))))")


@q("op_round_trip", f"WITH {IQ} SELECT vec_id, n, round(i, 6) + 0e0 AS i, round(q, 6) + 0e0 AS q FROM iq")
def op_round_trip(spark, d):
    return r6(iq.to_long(iq.to_array(iq_long(spark, d), BY), "vec_id"), "i", "q")


# --- reductions and scalars ----------------------------------------------------------------------------------------
@q("stat_power", f"WITH {IQ} SELECT vec_id, round(avg(i*i + q*q), 6) AS mean_power, round(max(sqrt(i*i + q*q)), 6) AS peak, round(sqrt(sum(i*i + q*q)), 6) AS norm, count(*) AS n FROM iq GROUP BY vec_id")
def stat_power(spark, d):
    x = iq_long(spark, d).groupBy("vec_id").agg(F.avg(iq.power()).alias("mean_power"), F.max(F.sqrt(iq.power())).alias("peak"), F.sqrt(F.sum(iq.power())).alias("norm"), F.count(F.lit(1)).alias("n"))
    return r6(x, "mean_power", "peak", "norm")


@q("fn_frequencies", f"""WITH {BURSTS} SELECT sample_id, comp_no, center_freq - bandwidth / 2 AS lower_freq, center_freq + bandwidth / 2 AS upper_freq, round(sample_rate / duration_in_samples, 6) AS tone_bandwidth,
  CASE WHEN round_even(sample_rate / bandwidth * (120e0 / 22), 0)::BIGINT % 2 = 0 THEN round_even(sample_rate / bandwidth * (120e0 / 22), 0)::BIGINT + 1 ELSE round_even(sample_rate / bandwidth * (120e0 / 22), 0)::BIGINT END AS taps,
  (greatest(center_freq - bandwidth / 2, -1500000e0) + least(center_freq + bandwidth / 2, 1500000e0)) / 2 AS box_center, greatest(least(center_freq + bandwidth / 2, 1500000e0) - greatest(center_freq - bandwidth / 2, -1500000e0), 0e0) AS box_bandwidth,
  start_in_samples % 2 = 0 AS even_start, start_in_samples % 2 <> 0 AS odd_start, start_in_samples % 4 = 0 AS fourth_start FROM bursts""")  # fmt: skip
def fn_frequencies(spark, d):
    b = bursts(spark, d)
    lo, hi = scalar.lower_freq(F.col("center_freq"), F.col("bandwidth")), scalar.upper_freq(F.col("center_freq"), F.col("bandwidth"))
    center, width = scalar.clipped_band(scalar.center_freq(lo, hi), scalar.bandwidth(lo, hi), -1.5e6, 1.5e6)
    s = F.col("start_in_samples")
    return r6(
        b.select("sample_id", "comp_no", lo.alias("lower_freq"), hi.alias("upper_freq"), scalar.tone_bandwidth(F.col("sample_rate"), F.col("duration_in_samples")).alias("tone_bandwidth"),
                 scalar.filter_length(F.col("bandwidth"), F.lit(120.0), F.col("sample_rate")).alias("taps"), center.alias("box_center"), width.alias("box_bandwidth"),
                 scalar.is_even(s).alias("even_start"), scalar.is_odd(s).alias("odd_start"), scalar.is_multiple_of_4(s).alias("fourth_start")), "tone_bandwidth")


@q("fn_checks", """SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity, 10e0), 40e0), 6) AS clipped, lower(trim(l_returnflag)) AS flag, round(l_extendedprice / (l_extendedprice + l_quantity), 6) AS share FROM lineitem""")
def fn_checks(spark, d):
    x = t(spark, d, "lineitem")
    return r6(x.select("l_orderkey", "l_linenumber", scalar.checked(F.col("l_quantity"), "l_quantity", 10.0, 40.0, True, True).alias("clipped"),
                       scalar.checked_text(F.col("l_returnflag"), "l_returnflag", ("a", "n", "r")).alias("flag"), F.get(scalar.shares(F.array("l_extendedprice", "l_quantity")), F.lit(0)).alias("share")), "clipped", "share")


@q("fn_array_checks", "SELECT vec_id, true AS finite, len(list_distinct(embedding)) = len(embedding) AS distinct_values, len(embedding)::INTEGER AS length FROM embeddings")
def fn_array_checks(spark, d):
    x = t(spark, d, "embeddings")
    return x.select("vec_id", scalar.all_finite(F.col("embedding")).alias("finite"), scalar.no_duplicates(F.col("embedding")).alias("distinct_values"), F.size("embedding").alias("length"))


# --- spectra ----------------------------------------------------------------------------------------------------------
STFT = IQ + """, fr AS (SELECT vec_id, f AS frame, n - f * {stride} AS m, i * w AS i, q * w AS q FROM (SELECT vec_id, f, n, i, q, 0.42e0 - 0.5e0 * cos(2 * pi() * (n - f * {stride}) / {size}) + 0.08e0 * cos(4 * pi() * (n - f * {stride}) / {size}) AS w
   FROM iq JOIN (SELECT unnest(range({frames})) AS f) AS ff ON n >= f * {stride} AND n < f * {stride} + {size})),
 dft AS (SELECT vec_id, frame, k, sum(i * cos(2 * pi() * ((k * m) % {size}) / {size}) + q * sin(2 * pi() * ((k * m) % {size}) / {size})) AS re, sum(q * cos(2 * pi() * ((k * m) % {size}) / {size}) - i * sin(2 * pi() * ((k * m) % {size}) / {size})) AS im
   FROM fr CROSS JOIN (SELECT unnest(range({size})) AS k) AS kk GROUP BY vec_id, frame, k),
 pw AS (SELECT vec_id, frame, {size} - 1 - (k + {size} // 2) % {size} AS bin, re * re + im * im AS power FROM dft),
 sp AS (SELECT vec_id, frame, bin, 10 * log10(CASE WHEN power = 0 THEN max(power) OVER (PARTITION BY vec_id) * 1e-10 ELSE power END) AS db FROM pw)"""


def stft_sql(size, stride):
    return STFT.format(size=size, stride=stride, frames=1 + (32 - size) // stride)


def spectrum(spark, d, size=16, stride=8, *keep):
    return spectral.in_db(spectral.stft_power(iq_long(spark, d), BY, size, stride), BY)


@q("spec_stft", f"WITH {stft_sql(16, 8)} SELECT vec_id, frame, bin, round(db, 6) + 0e0 AS db FROM sp")
def spec_stft(spark, d):
    return r6(spectrum(spark, d), "db")


@q("spec_mean_class", f"WITH {stft_sql(32, 32)} SELECT label, bin, round(10 * log10(avg(power)), 6) + 0e0 AS db FROM pw JOIN embeddings USING (vec_id) GROUP BY label, bin")
def spec_mean_class(spark, d):
    p = spectral.stft_power(iq_long(spark, d, "label"), ["vec_id", "label"], 32, 32)
    return r6(p.groupBy("label", "bin").agg((10 * F.log10(F.avg("power"))).alias("db")), "db")


_flat = "(bin * 3 + frame)"
_sgone = f"(({_flat} >= 5 AND {_flat} < 9) OR ({_flat} >= 30 AND {_flat} < 33))"
for _fill, _v in {
    "ffill": f"coalesce(last_value(CASE WHEN NOT {_sgone} THEN db END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY bin, frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0)",
    "bfill": f"coalesce(first_value(CASE WHEN NOT {_sgone} THEN db END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY bin, frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0e0)",
    "mean": "avg(db) OVER (PARTITION BY vec_id)", "zero": "0e0", "min": "min(abs(db)) OVER (PARTITION BY vec_id)", "max": "max(abs(db)) OVER (PARTITION BY vec_id)", "low": "1e-3", "ones": "1e0",
}.items():
    q(f"spec_drop_{_fill}", f"WITH {stft_sql(16, 8)} SELECT vec_id, frame, bin, round(CASE WHEN {_sgone} THEN {_v} ELSE db END, 6) + 0e0 AS db FROM sp")(
        lambda spark, d, f=_fill: r6(spectral.drop_fill(spectrum(spark, d), BY, [(5, 4), (30, 3)], f), "db")
    )


@q("spec_image", f"WITH {stft_sql(16, 8)}, lim AS (SELECT vec_id, min(db) AS a, max(db) AS b FROM sp GROUP BY vec_id) SELECT vec_id, frame, bin, (255 - floor(coalesce((round(db, 9) - round(a, 9)) * 255e0 / nullif(round(b, 9) - round(a, 9), 0), 0)))::INTEGER AS grey FROM sp JOIN lim USING (vec_id)")
def spec_image(spark, d):
    return spectral.image(spectrum(spark, d).withColumn("db", F.round("db", 9)), BY).drop("db")


@q("spec_bandwidth", f"""WITH {stft_sql(16, 8)}, per AS (SELECT vec_id, bin, avg(db) AS a, max(db) AS m FROM sp GROUP BY vec_id, bin),
 e AS (SELECT vec_id, max(a) AS peak_db, min(CASE WHEN m > 8e0 THEN (7 - bin) * 625000e0 END) AS lo, max(CASE WHEN m > 8e0 THEN (7 - bin) * 625000e0 END) AS hi FROM per GROUP BY vec_id)
SELECT vec_id, round(peak_db, 6) AS peak_db, greatest(lo - 312500e0, CASE WHEN lo IS NOT NULL THEN -4000000e0 END) AS lower_freq, least(hi + 312500e0, CASE WHEN hi IS NOT NULL THEN 4000000e0 END) AS upper_freq,
  least(hi + 312500e0, CASE WHEN hi IS NOT NULL THEN 4000000e0 END) - greatest(lo - 312500e0, CASE WHEN lo IS NOT NULL THEN -4000000e0 END) AS bandwidth FROM e""")  # fmt: skip
def spec_bandwidth(spark, d):
    return r6(spectral.occupied_band(spectrum(spark, d), BY, 16, 10e6, 5.0, -4e6, 4e6), "peak_db")


# --- labels and boxes -----------------------------------------------------------------------------------------------------
@q("lbl_derived", f"""WITH {BURSTS} SELECT sample_id, comp_no, start_in_samples + duration_in_samples AS stop_in_samples, round(start_in_samples / num_iq_samples_dataset, 6) AS "start", round((start_in_samples + duration_in_samples) / num_iq_samples_dataset, 6) AS "stop",
  round(duration_in_samples / num_iq_samples_dataset, 6) AS duration, round(center_freq - bandwidth / 2, 6) AS lower_freq, round(center_freq + bandwidth / 2, 6) AS upper_freq, round(sample_rate / bandwidth, 6) AS oversampling_rate FROM bursts""")  # fmt: skip
def lbl_derived(spark, d):
    x = scalar.with_derived(bursts(spark, d))
    cols = ["start", "stop", "duration", "lower_freq", "upper_freq", "oversampling_rate"]
    return r6(x.select("sample_id", "comp_no", "stop_in_samples", *cols), *cols)


@q("lbl_setters", f"WITH {BURSTS} SELECT sample_id, comp_no, floor(0.9e0 * num_iq_samples_dataset)::BIGINT - start_in_samples AS duration_in_samples, ((center_freq - bandwidth / 2) + (center_freq + bandwidth)) / 2 AS center_freq, (center_freq + bandwidth) - (center_freq - bandwidth / 2) AS bandwidth FROM bursts")
def lbl_setters(spark, d):
    x = scalar.with_stop(bursts(spark, d), F.lit(0.9))
    return scalar.with_edges(x, upper=F.col("center_freq") + F.col("bandwidth")).select("sample_id", "comp_no", "duration_in_samples", "center_freq", "bandwidth")


@q("lbl_yolo", f"""WITH {BURSTS}, k AS (SELECT class_name, row_number() OVER (ORDER BY class_name) - 1 AS class_index FROM (SELECT DISTINCT class_name FROM bursts))
SELECT sample_id, comp_no, class_index::INTEGER AS class_index, round(start_in_samples / num_iq_samples_dataset + duration_in_samples / num_iq_samples_dataset / 2, 9) AS cx, round(1 - (sample_rate / 2 + center_freq) / sample_rate, 9) AS cy,
  round(duration_in_samples / num_iq_samples_dataset, 9) AS w, round(bandwidth / sample_rate, 9) AS h FROM bursts JOIN k USING (class_name)""")  # fmt: skip
def lbl_yolo(spark, d):
    b = bursts(spark, d)
    x = scalar.with_derived(b).join(labels.class_table(b), "class_name")
    box = labels.yolo(F.col("start"), F.col("duration"), F.col("center_freq"), F.col("bandwidth"), F.col("sample_rate"))
    return x.select("sample_id", "comp_no", "class_index", *[F.round(c, 9).alias(k) for k, c in box.items()])


@q("lbl_class_table", f"WITH {BURSTS} SELECT (row_number() OVER (ORDER BY class_name) - 1)::INTEGER AS class_index, class_name FROM (SELECT DISTINCT lower(trim(class_name)) AS class_name FROM bursts)")
def lbl_class_table(spark, d):
    return labels.class_table(bursts(spark, d))


COLLECT = BURSTS + ", c AS (SELECT sample_id, list(snr_db ORDER BY comp_no) AS v FROM bursts GROUP BY sample_id)"


@q("lbl_collect", f"WITH {COLLECT} SELECT sample_id, len(v)::INTEGER AS n, array_to_string(list_transform(v, lambda x: x::INTEGER::VARCHAR), ',') AS labels FROM c")
def lbl_collect(spark, d):
    x = labels.collected(bursts(spark, d), ["sample_id"], "comp_no", F.col("snr_db"))
    return x.select("sample_id", F.size("labels").alias("n"), F.array_join(F.transform("labels", lambda v: v.cast("int").cast("string")), ",").alias("labels"))


@q("lbl_pad", f"WITH {COLLECT}, m AS (SELECT sample_id, sample_id // 8 AS batch, v, max(len(v)) OVER (PARTITION BY sample_id // 8) AS most FROM c) SELECT batch::BIGINT AS batch, sample_id, most::INTEGER AS n, list_sum(v) AS total FROM m")
def lbl_pad(spark, d):
    x = labels.collected(bursts(spark, d), ["sample_id"], "comp_no", F.col("snr_db"))
    x = labels.padded_batches(x, F.floor(F.col("sample_id") / 8))
    return x.select("batch", "sample_id", F.size("labels").alias("n"), F.aggregate("labels", F.lit(0.0), lambda a, b: a + b).alias("total"))


@q("lbl_reads_no_payload", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def lbl_reads_no_payload(spark, d):
    return t(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@q("geo_box", f"WITH {BOXES} SELECT sample_id, comp_no, x0, y0, x1, y1 FROM boxes")
def geo_box(spark, d):
    return boxes(spark, d)


_pair = "boxes a JOIN boxes b ON a.sample_id = b.sample_id AND a.comp_no < b.comp_no AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"


@q("geo_overlap_pairs", f"WITH {BOXES} SELECT a.sample_id, a.comp_no AS a, b.comp_no AS b FROM {_pair}")
def geo_overlap_pairs(spark, d):
    return labels.overlap_pairs(boxes(spark, d), ["sample_id"], "comp_no", 16, literal=False)


@q("geo_overlap_sides", f"WITH {BOXES} SELECT a.sample_id, a.comp_no AS a, b.comp_no AS b FROM {_pair} WHERE {geometry.side_overlap_sql('a', 'b')}")
def geo_overlap_sides(spark, d):
    return labels.overlap_pairs(boxes(spark, d), ["sample_id"], "comp_no", 16)


@q("geo_first_accept", f"WITH {BOXES} SELECT sample_id, comp_no, x0, y0, x1, y1 FROM boxes k WHERE NOT EXISTS (SELECT 1 FROM boxes a JOIN boxes b ON a.sample_id = b.sample_id AND a.comp_no < b.comp_no WHERE b.sample_id = k.sample_id AND b.comp_no = k.comp_no AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND {geometry.side_overlap_sql('a', 'b')})")
def geo_first_accept(spark, d):
    return labels.without_earlier_overlap(boxes(spark, d), ["sample_id"], "comp_no", 16)


@q("geo_cut_relation", f"WITH {BURSTS} SELECT sample_id, comp_no, CASE WHEN 60000 <= start_in_samples OR 50000 >= start_in_samples + duration_in_samples THEN 'outside' WHEN 50000 <= start_in_samples AND 60000 >= start_in_samples + duration_in_samples THEN 'inside' WHEN 50000 <= start_in_samples THEN 'left' WHEN 60000 >= start_in_samples + duration_in_samples THEN 'right' ELSE 'split' END AS relation FROM bursts")
def geo_cut_relation(spark, d):
    s = F.col("start_in_samples")
    return bursts(spark, d).select("sample_id", "comp_no", geometry.cut_relation(s, s + F.col("duration_in_samples"), F.lit(50000), F.lit(60000)).alias("relation"))


@q("meta_inherit", "SELECT n_nationkey, n_regionkey, coalesce(CASE WHEN n_nationkey % 3 > 0 THEN n_name END, r_name) AS name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def meta_inherit(spark, d):
    child = t(spark, d, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("name"))
    parents = t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name"))
    return labels.inherit(child, parents, "n_regionkey", ["name"])


@q("meta_signal_fields", "SELECT s.signal_id, s.sample_id, coalesce(s.class_name, g.class_name) AS class_name, s.snr_db >= g.snr_db_min AND s.snr_db <= g.snr_db_max AS snr_in_range FROM signal_metadata s LEFT JOIN signal_generators g USING (generator_id)")
def meta_signal_fields(spark, d):
    g = t(spark, d, "signal_generators").select("generator_id", "class_name", "snr_db_min", "snr_db_max")
    s = t(spark, d, "signal_metadata").select("generator_id", "signal_id", "sample_id", "class_name", "snr_db", *[F.lit(None).cast("double").alias(c) for c in ("snr_db_min", "snr_db_max")])
    s = labels.inherit(s, g, "generator_id", ["class_name", "snr_db_min", "snr_db_max"])
    return s.select("signal_id", "sample_id", "class_name", ((F.col("snr_db") >= F.col("snr_db_min")) & (F.col("snr_db") <= F.col("snr_db_max"))).alias("snr_in_range"))


# --- random ----------------------------------------------------------------------------------------------------------------
def u(op, *keys):
    return rng.uniform_sql(7, op, *(keys or ("vec_id",)))


def g(op, *keys):
    return rng.gauss_sql(7, op, *(keys or ("vec_id", "n")))


_g40 = "pow(10e0, -40e0 / 20) / sqrt(2)"
elementwise("op_awgn", lambda x: iq.awgn(x, BY, -40.0, 7), f"i + {_g40} * {g('awgn.i')}", f"q + {_g40} * {g('awgn.q')}")
elementwise("op_phase_noise", lambda x: iq.phase_noise(x, BY, 0.8, 7), *rot(f"({g('phase')} * radians(0.8e0))"))
elementwise("op_frequency_drift", lambda x: iq.frequency_drift(x, BY, 500.0, 7), *rot("a"), extra=f", dr AS (SELECT *, 2 * pi() * sum({g('drift')} * 500e-6) OVER (PARTITION BY vec_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS a FROM iq)", source="dr")
elementwise("op_shadowing", lambda x: iq.shadowing(x, BY, 4.0, 2.0, 7), f"i * pow(10e0, (4 + 2 * {g('shadow', 'vec_id')}) / 20)", f"q * pow(10e0, (4 + 2 * {g('shadow', 'vec_id')}) / 20)")
_reg = "CASE WHEN n // 10 > 2 THEN 0e0 WHEN (n // 10) % 2 = 0 THEN -60 + 40 * ((n % 10) / 9e0) ELSE -20 - 40 * ((n % 10) / 9e0) END"
elementwise("op_time_varying_noise", lambda x: iq.time_varying_noise(x, BY, -60.0, -20.0, 2, 7), f"i + pow(10e0, ({_reg}) / 20) / sqrt(2) * {g('tvn.i')}", f"q + pow(10e0, ({_reg}) / 20) / sqrt(2) * {g('tvn.q')}")
elementwise("op_patch_shuffle", lambda x: iq.patch_shuffle(x, BY, 4, [1, 3, 6], 7), "i", "q", extra=f", ps AS (SELECT vec_id, n // 4 AS p, i, q, row_number() OVER (PARTITION BY vec_id, n // 4 ORDER BY CASE WHEN n // 4 IN (1, 3, 6) THEN {u('patch', 'vec_id', 'n')} ELSE n::DOUBLE END, n) - 1 AS k FROM iq)", source="ps", n_sql="p * 4 + k")
elementwise("op_random_apply", lambda x: iq.random_apply(x, BY, 0.4, {"q": -F.col("q")}, 7), "i", f"CASE WHEN {u('apply')} < 0.4e0 THEN -q ELSE q END")
elementwise("op_cutout_noise", lambda x: iq.cut_out(x, BY, 0.25, 0.3, "avg_noise", 7), *[f"CASE WHEN n >= 8 AND n < 17 THEN avg(i*i + q*q) OVER (PARTITION BY vec_id) * {g(f'cut.{c}')} / sqrt(2) ELSE {c} END" for c in "iq"])
_aug = f", pick AS (SELECT vec_id, list(n ORDER BY u)[1:2] AS c FROM (SELECT vec_id, n, CASE n WHEN 'swap' THEN {u('augment.swap')} WHEN 'invert' THEN {u('augment.invert')} ELSE {u('augment.half')} END AS u FROM (SELECT DISTINCT vec_id FROM iq) CROSS JOIN (SELECT unnest(['swap', 'invert', 'half']) AS n)) GROUP BY vec_id), a1 AS (SELECT iq.vec_id, n, c, CASE WHEN list_contains(c, 'swap') THEN q ELSE i END AS i, CASE WHEN list_contains(c, 'swap') THEN i ELSE q END AS q FROM iq JOIN pick USING (vec_id)), a2 AS (SELECT vec_id, n, c, i, CASE WHEN list_contains(c, 'invert') THEN -q ELSE q END AS q FROM a1)"
elementwise("op_rand_augment", lambda x: iq.rand_augment(x, BY, [("swap", {"i": F.col("q"), "q": F.col("i")}), ("invert", {"q": -F.col("q")}), ("half", {"i": F.col("i") / 2, "q": F.col("q") / 2})], 2, 7), "i * CASE WHEN list_contains(c, 'half') THEN 0.5e0 ELSE 1e0 END", "q * CASE WHEN list_contains(c, 'half') THEN 0.5e0 ELSE 1e0 END", extra=_aug, source="a2")


@q("rng_draws", f"SELECT event_id, round({rng.uniform_sql(7, 'u', 'event_id')}, 9) AS u, round({rng.gauss_sql(7, 'g', 'event_id')}, 6) + 0e0 AS g FROM events")
def rng_draws(spark, d):
    return t(spark, d, "events").select("event_id", F.round(rng.uniform(7, "u", "event_id"), 9).alias("u"), (F.round(rng.gauss(7, "g", "event_id"), 6) + F.lit(0.0)).alias("g"))


@q("dist_draws", f"""SELECT event_id, ['a', 'b', 'c'][(floor({rng.uniform_sql(7, 'c', 'event_id')} * 3) + 1)::INTEGER] AS pick, round(2 + {rng.uniform_sql(7, 'r', 'event_id')} * 3, 6) AS ranged,
  round(pow(10e0, -4 + {rng.uniform_sql(7, 'l', 'event_id')} * 3), 9) AS logged, round({rng.uniform_sql(7, 'x', 'event_id')} * 5, 6) AS upto, (6 + floor({rng.uniform_sql(7, 'n', 'event_id')} * 12))::BIGINT AS whole FROM events""")  # fmt: skip
def dist_draws(spark, d):
    k = lambda op: rng.uniform(7, op, "event_id")
    return t(spark, d, "events").select("event_id", rng.distribution(["a", "b", "c"])(k("c")).alias("pick"), F.round(rng.distribution((2, 5))(k("r")), 6).alias("ranged"), F.round(rng.distribution((1e-4, 1e-1), "log10")(k("l")), 9).alias("logged"), F.round(rng.distribution(5)(k("x")), 6).alias("upto"), rng.normal_integers(k("n"), 6, 18).alias("whole"))


@q("gen_categorical", f"""WITH gg AS (SELECT generator_id, class_name, sum((1 + generator_id % 4)::DOUBLE) OVER (ORDER BY generator_id) / sum((1 + generator_id % 4)::DOUBLE) OVER () AS high, (1 + generator_id % 4)::DOUBLE / sum((1 + generator_id % 4)::DOUBLE) OVER () AS p FROM signal_generators),
  lo AS (SELECT *, coalesce(lag(high) OVER (ORDER BY generator_id), 0e0) AS low FROM gg), r AS (SELECT event_id, {rng.uniform_sql(7, 'generator', 'event_id')} AS u FROM events)
SELECT event_id, generator_id, class_name FROM r JOIN lo ON u >= low AND u < high""")  # fmt: skip
def gen_categorical(spark, d):
    g_ = t(spark, d, "signal_generators").select("generator_id", "class_name", (1 + F.col("generator_id") % 4).cast("double").alias("likelihood"))
    return labels.draw_generator(t(spark, d, "events").select("event_id"), g_, "event_id", 7).select("event_id", "generator_id", "class_name")


# --- summaries --------------------------------------------------------------------------------------------------------------
@q("sum_class_counts", "SELECT lower(trim(class_name)) AS class_name, count(*) AS n FROM signal_metadata GROUP BY 1")
def sum_class_counts(spark, d):
    return labels.class_counts(t(spark, d, "signal_metadata"))


def hist(name, table, column, bins):
    @q(name, f"""WITH v AS (SELECT {column}::DOUBLE AS x FROM {table} WHERE isfinite({column}::DOUBLE)), l AS (SELECT min(x) AS a, max(x) AS b FROM v)
SELECT least(floor((x - a) / (b - a) * {bins}), {bins - 1})::INTEGER AS bin, round(a + (b - a) * least(floor((x - a) / (b - a) * {bins}), {bins - 1}) / {bins}, 6) AS low, round(a + (b - a) * (least(floor((x - a) / (b - a) * {bins}), {bins - 1}) + 1) / {bins}, 6) AS high, count(*) AS n
FROM v CROSS JOIN l GROUP BY 1, 2, 3""")  # fmt: skip
    def run(spark, d):
        return r6(labels.histogram(t(spark, d, table), column, bins), "low", "high")


hist("sum_hist_snr", "signal_metadata", "snr_db", 50)
hist("sum_hist_duration", "signal_metadata", "duration_in_samples", 50)
hist("sum_hist_bandwidth", "signal_metadata", "bandwidth", 20)
hist("sum_hist_center_freq", "signal_metadata", "center_freq", 20)
hist("sum_hist_price", "lineitem", "l_extendedprice", 50)


@q("sum_signals_per_sample", "SELECT n AS n_signals, count(*) AS n_samples FROM (SELECT sample_id, count(*) AS n FROM signal_metadata GROUP BY sample_id) GROUP BY n")
def sum_signals_per_sample(spark, d):
    return labels.signals_per_sample(t(spark, d, "signal_metadata"))


@q("sum_rollup", "SELECT family, s.class_name, count(*) AS n FROM signal_metadata s JOIN signal_generators g USING (generator_id) GROUP BY ROLLUP (family, s.class_name)")
def sum_rollup(spark, d):
    g_ = t(spark, d, "signal_generators").select("generator_id", "family")
    return labels.rollup_counts(t(spark, d, "signal_metadata").select("generator_id", "class_name").join(g_, "generator_id"), ["family", "class_name"])


@q("ds_split", f"SELECT sample_id, CASE WHEN {rng.uniform_sql(7, 'split', 'sample_id')} < 0.7e0 THEN 'train' WHEN {rng.uniform_sql(7, 'split', 'sample_id')} < 0.7e0 + 0.2e0 THEN 'val' ELSE 'test' END AS part FROM (SELECT DISTINCT sample_id FROM signal_metadata)")
def ds_split(spark, d):
    return labels.split(t(spark, d, "signal_metadata").select("sample_id").distinct(), "sample_id", {"train": 0.7, "val": 0.2, "test": 0.1}, 7)


@q("ds_split_counts", f"""WITH b AS (SELECT event_id, {rng.uniform_sql(7, 'count', 'event_id')} AS u FROM events), n AS (SELECT count(*) AS n FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY floor(u * 4096), u, event_id) - 1 AS k FROM b)
SELECT event_id, CASE WHEN k < n * 5 // 7 THEN 'train' WHEN k < n * 5 // 7 + n * 3 // 14 THEN 'val' ELSE 'test' END AS part FROM r CROSS JOIN n""")
def ds_split_counts(spark, d):
    from ..sources.loader import split_counts

    x = t(spark, d, "events").select("event_id")
    n = x.count()
    train, val = n * 5 // 7, n * 3 // 14  # as 500 and 150 of 700
    return split_counts(x, "event_id", {"train": train, "val": val, "test": n - train - val}, 7)


@q("lbl_names_match", "SELECT signal_id, written_at, contains(lower(label), 'qam') OR contains(lower(label), 'psk') AS linear FROM signal_metadata")
def lbl_names_match(spark, d):
    return t(spark, d, "signal_metadata").select("signal_id", "written_at", scalar.names_any(F.col("label"), ("qam", "psk")).alias("linear"))


@q("dist_several", f"SELECT event_id, round({' + '.join(rng.uniform_sql(7, f's.{k}', 'event_id') + ' * 5' for k in range(3))}, 6) AS total FROM events")
def dist_several(spark, d):
    x = t(spark, d, "events").select("event_id", rng.several(7, "s", 3, 5, keys=("event_id",)).alias("v"))
    return x.select("event_id", F.round(F.get("v", F.lit(0)) + F.get("v", F.lit(1)) + F.get("v", F.lit(2)), 6).alias("total"))


@q("ds_range_join", """WITH f AS (SELECT run_id, items_written, coalesce(sum(coalesce(items_written, 0)) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_index FROM writer_runs),
 e AS (SELECT *, start_index + coalesce(items_written, 0) AS end_index FROM f) SELECT c.idx, e.run_id, c.idx - e.start_index AS at FROM (SELECT DISTINCT idx FROM capture_metadata) c JOIN e ON c.idx >= e.start_index AND c.idx < e.end_index""")  # fmt: skip
def ds_range_join(spark, d):
    from ..sources.npy import locate

    runs = t(spark, d, "writer_runs").select("run_id", F.coalesce("items_written", F.lit(0)).alias("n"))
    return locate(t(spark, d, "capture_metadata").select("idx").distinct(), runs, "run_id").select("idx", "run_id", "at")


@q("ds_existing_runs", "SELECT run_id, lower(file_handler) AS handler, CASE WHEN NOT is_complete THEN 'partial' WHEN items_written IS DISTINCT FROM dataset_length_requested THEN 'miscounted' ELSE 'complete' END AS state FROM writer_runs")
def ds_existing_runs(spark, d):
    from ..sources.dataset import run_states

    return run_states(t(spark, d, "writer_runs"))


# --- generators in SQL --------------------------------------------------------------------------------------------------------
@q("gen_chirp", "SELECT n, round(cos(2 * pi() * (-0.125e0 * n + 0.5e0 * 0.25e0 / 128 * n * n)), 6) + 0e0 AS i, round(sin(2 * pi() * (-0.125e0 * n + 0.5e0 * 0.25e0 / 128 * n * n)), 6) + 0e0 AS q FROM (SELECT unnest(range(128))::BIGINT AS n)")
def gen_chirp(spark, d):
    i, qq = arrays.chirp(-0.125, 0.125, 128)
    return r6(iq.to_long(spark.range(1).select(i.alias("i"), qq.alias("q"))), "i", "q")


@q("gen_fsk_levels", "SELECT o AS size, k, round(-1 + 1e0 / o + k * (2 - 2e0 / o) / (o - 1), 6) AS level FROM (SELECT unnest([2, 4, 8, 16]) AS o), LATERAL (SELECT unnest(range(o))::INTEGER AS k)")
def gen_fsk_levels(spark, d):
    from ..kernels.modulators import FSK_ORDERS, fsk_levels

    rows = [(o, k, float(x)) for o in FSK_ORDERS for k, x in enumerate(fsk_levels(o))]
    return r6(spark.createDataFrame(rows, "size int, k int, level double"), "level")


@q("gen_constellations", "SELECT name, count(*) AS points, 1e0 AS mean_power FROM (SELECT unnest(['qpsk', '16qam', '64qam', '256qam']) AS name, unnest([2, 4, 8, 16]) AS m), LATERAL (SELECT unnest(range(m * m)) AS k) GROUP BY name UNION ALL SELECT unnest(['32qam_cross', '128qam_cross', '512qam_cross']), unnest([32, 128, 512]), 1e0")
def gen_constellations(spark, d):
    from ..kernels.modulators import constellation

    names = ("qpsk", "16qam", "64qam", "256qam", "32qam_cross", "128qam_cross", "512qam_cross")
    rows = [(n, float(p.real), float(p.imag)) for n in names for p in constellation(n)]
    x = spark.createDataFrame(rows, "name string, i double, q double")
    return r6(x.groupBy("name").agg(F.count(F.lit(1)).alias("points"), F.avg(iq.power()).alias("mean_power")), "mean_power")


@q("gen_srrc_taps", """WITH x AS (SELECT unnest(range(-16, 17))::DOUBLE AS n), c AS (SELECT n, (1 + 0.25e0) * pi() / (4 * 0.25e0) AS a, (1 - 0.25e0) * pi() / (4 * 0.25e0) AS b FROM x)
SELECT (n + 16)::BIGINT AS k, round(CASE WHEN abs(n * 4 * 0.25e0) = 4 THEN 0.5e0 * (1.25e0 * sin(a) - 0.75e0 * cos(b) + 4 * 0.25e0 / pi() * sin(b))
  ELSE 4 * 0.25e0 / pi() / (1 - 16 * 0.25e0 * 0.25e0 * (n / 4) * (n / 4)) * (cos(1.25e0 * pi() * n / 4) + b * CASE WHEN n = 0 THEN 1e0 ELSE sin(0.75e0 * pi() * n / 4) / (0.75e0 * pi() * n / 4) END) END, 6) + 0e0 AS tap FROM c""")  # fmt: skip
def gen_srrc_taps(spark, d):
    x = spark.range(1).select(F.posexplode(arrays.srrc(4, 4, 0.25)).alias("k", "tap"))
    return r6(x.select(F.col("k").cast("bigint").alias("k"), "tap"), "tap")


@q("gen_gaussian_taps", "WITH g AS (SELECT n, exp(-2 * pi() * pi() * 0.35e0 * 0.35e0 / ln(2e0) * (n / 4e0) * (n / 4e0)) AS v FROM (SELECT unnest(range(-16, 17))::DOUBLE AS n)) SELECT (n + 16)::BIGINT AS k, round(v / sum(v) OVER (), 6) AS tap FROM g")
def gen_gaussian_taps(spark, d):
    x = spark.range(1).select(F.posexplode(arrays.gaussian(4, 0.35)).alias("k", "tap"))
    return r6(x.select(F.col("k").cast("bigint").alias("k"), "tap"), "tap")


@q("win_event_hours", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def win_event_hours(spark, d):
    from ..streaming.windows import tumbling

    return r6(tumbling(t(spark, d, "events"), "ts", "value", "1 hour", ("event_type",)).select(F.col("start").alias("hour"), "event_type", "n", "total"), "total")
