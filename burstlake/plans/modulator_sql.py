"""The modulators in SQL, at a bandwidth where nothing is resampled: every draw from the same counter, every sample by its formula."""

from __future__ import annotations

from ..kernels.modulators import ASK, FSK_KINDS, FSK_ORDERS, LFM_KINDS, OFDM_SUBCARRIERS, PSK, QAM
from .transform_sql import CHECK, counter, lit

LINEAR = SHIFT = SWEEPS = 512
CARRIERS = 256
SEED = 3
LAST = f"SELECT class_name, copy, n, mean_power, checksum FROM (SELECT sample_id, {CHECK} FROM o GROUP BY sample_id) JOIN src USING (sample_id)"

#: Constellation points by formula: pts(name, k, re, im) of mean power one, and how many.
POINTS = """gd AS (SELECT name, k, -1 + 2e0 * (k % c) / (c - 1) AS re, -1 + 2e0 * (k // c) / (r - 1) AS im, NULL::DOUBLE AS edge FROM (SELECT unnest(['qpsk', '16qam', '32qam', '64qam', '256qam', '1024qam']) AS name, unnest([2, 4, 4, 8, 16, 32]) AS c, unnest([2, 4, 8, 8, 16, 32]) AS r) g, LATERAL (SELECT unnest(range(c * r)) AS k)),
 cr AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS k, re, im FROM (SELECT name, k, -1 + 2e0 * (k % s) / (s - 1) AS re, -1 + 2e0 * (k // s) / (s - 1) AS im, 1 - 2e0 / (s - 1) * (s / 6e0 - 0.5e0) AS edge FROM (SELECT unnest(['32qam_cross', '128qam_cross', '512qam_cross']) AS name, unnest([6, 12, 24]) AS s) g, LATERAL (SELECT unnest(range(s * s)) AS k)) WHERE abs(re) < edge OR abs(im) < edge),
 pk AS (SELECT o::VARCHAR || 'psk' AS name, k, cos(2 * pi() * k / o) AS re, sin(2 * pi() * k / o) AS im FROM (SELECT unnest([8, 16, 32, 64]) AS o) g, LATERAL (SELECT unnest(range(o)) AS k)),
 ak AS (SELECT o::VARCHAR || 'ask' AS name, k, -1 + 2e0 * k / (o - 1) AS re, 0e0 AS im FROM (SELECT unnest([4, 8, 16, 32, 64]) AS o) g, LATERAL (SELECT unnest(range(o)) AS k)),
 rw AS (SELECT name, k, re, im FROM gd UNION ALL SELECT name, k, re, im FROM cr UNION ALL FROM pk UNION ALL FROM ak UNION ALL SELECT 'ook', k, k::DOUBLE, 0e0 FROM (SELECT unnest([0, 1]) AS k) UNION ALL SELECT 'bpsk', k, 2e0 * k - 1, 0e0 FROM (SELECT unnest([0, 1]) AS k)),
 pts AS (SELECT name, k, re / sqrt(avg(re * re + im * im) OVER w) AS re, im / sqrt(avg(re * re + im * im) OVER w) AS im, count(*) OVER w AS size FROM rw WINDOW w AS (PARTITION BY name))"""


def sources(names, most: int) -> str:
    """src(sample_id, class_name, copy) and their draws dr, with the first three beside each other in d3."""
    return f"""src AS (SELECT class_name || '|' || copy AS sample_id, class_name, copy FROM (SELECT unnest([{', '.join(map(lit, names))}]) AS class_name) CROSS JOIN (SELECT DISTINCT run_id AS copy FROM writer_runs)),
 {counter(most, f"SELECT sample_id, '{SEED}|' || sample_id AS k FROM src")},
 d3 AS (SELECT src.*, a.u AS u0, b.u AS u1, d.u AS u2, e.u AS u3 FROM src JOIN dr a ON a.sample_id = src.sample_id AND a.c = 0 JOIN dr b ON b.sample_id = src.sample_id AND b.c = 1 JOIN dr d ON d.sample_id = src.sample_id AND d.c = 2 JOIN dr e ON e.sample_id = src.sample_id AND e.c = 3)"""


def linear(names) -> str:
    n, tau = LINEAR, "(tap / 4e0 - span)"
    pulse = f"4 * alpha / (pi() * (1 - 16 * alpha * alpha * {tau} * {tau})) * (cos((1 + alpha) * pi() * {tau}) + (1 - alpha) * pi() / (4 * alpha) * CASE WHEN {tau} = 0 THEN 1e0 ELSE sin(pi() * (1 - alpha) * {tau}) / (pi() * (1 - alpha) * {tau}) END)"
    return f"""WITH {sources(names, n // 4 + 2)}, {POINTS},
 pa AS (SELECT sample_id, class_name, u0 < 0.5e0 AS shaped, alpha, CASE WHEN u0 < 0.5e0 THEN ceil((taps + 1 - taps % 2 - 1) / 8e0)::BIGINT ELSE 0 END AS span FROM (SELECT *, 0.1e0 + u1 * {lit(0.5 - 0.1)} AS alpha, round_even(1 / (0.1e0 + u1 * {lit(0.5 - 0.1)}) * (120e0 / 22), 0)::BIGINT AS taps FROM d3)),
 sy AS (SELECT pa.*, c - (CASE WHEN shaped THEN 2 ELSE 1 END) AS j, pts.re, pts.im FROM pa JOIN dr USING (sample_id) JOIN (SELECT DISTINCT name, size FROM pts) z ON z.name = class_name JOIN pts ON pts.name = class_name AND pts.k = floor(u * z.size)::BIGINT
   WHERE c >= CASE WHEN shaped THEN 2 ELSE 1 END AND c - (CASE WHEN shaped THEN 2 ELSE 1 END) < {n // 4} - 2 * span),
 ns AS (SELECT unnest(range({n}))::BIGINT AS n),
 xs AS (SELECT sample_id, n, re AS i, im AS q FROM sy JOIN ns ON n // 4 = j WHERE NOT shaped UNION ALL
   SELECT sample_id, n, sum(re * h), sum(im * h) FROM (SELECT sample_id, n, re, im, {pulse} AS h FROM (SELECT sy.*, n, n - 2 - 4 * j AS tap FROM sy CROSS JOIN ns WHERE shaped) WHERE tap >= 0 AND tap <= 8 * span) GROUP BY ALL),
 o AS (SELECT src.sample_id, ns.n, coalesce(xs.i, 0e0)::FLOAT::DOUBLE AS i, coalesce(xs.q, 0e0)::FLOAT::DOUBLE AS q FROM src CROSS JOIN ns LEFT JOIN xs ON xs.sample_id = src.sample_id AND xs.n = ns.n) {LAST}"""


def shift() -> str:
    n, names = SHIFT, [f"{o}{k}" for k in FSK_KINDS for o in FSK_ORDERS]
    return f"""WITH {sources(names, n // 8 + 6)},
 pa AS (SELECT *, sps + CASE WHEN smooth THEN 2 * span * sps ELSE 0 END AS lp FROM (SELECT *, 4 * o AS sps, kind LIKE 'g%' AS smooth, CASE kind WHEN 'gfsk' THEN 0.1e0 + u0 * {lit(0.5 - 0.1)} WHEN 'fsk' THEN CASE WHEN u0 < 0.5e0 THEN 1e0 ELSE 0.7e0 + u1 * {lit(1.01 - 0.7)} END ELSE 0.5e0 END AS ix,
   0.1e0 + CASE kind WHEN 'gfsk' THEN u1 ELSE u0 END * {lit(0.5 - 0.1)} AS bt, 1 + floor(CASE kind WHEN 'gfsk' THEN u2 ELSE u1 END * 4)::BIGINT AS span, CASE kind WHEN 'msk' THEN 0 WHEN 'gmsk' THEN 2 WHEN 'gfsk' THEN 3 ELSE CASE WHEN u0 < 0.5e0 THEN 1 ELSE 2 END END AS pos
   FROM (SELECT *, regexp_extract(class_name, '[0-9]+')::BIGINT AS o, regexp_extract(class_name, '[a-z]+') AS kind FROM d3))),
 pb AS (SELECT *, greatest(1, floor(({n} - lp + 1) / sps::DOUBLE)::BIGINT) AS cnt FROM pa), pc AS (SELECT *, (cnt - 1) * sps + lp AS total FROM pb),
 ga AS (SELECT sample_id, a, exp(-2 * pow(pi() * bt * (a - span * sps) / sps, 2) / ln(2e0)) AS v FROM (SELECT *, unnest(range(2 * span * sps + 1)) AS a FROM pc WHERE smooth)),
 gs AS (SELECT sample_id, a, sum(v) OVER (PARTITION BY sample_id ORDER BY a) / sum(v) OVER (PARTITION BY sample_id) AS s FROM ga),
 pu AS (SELECT sample_id, t, 1e0 AS v FROM (SELECT *, unnest(range(sps)) AS t FROM pc WHERE NOT smooth) UNION ALL
   SELECT p.sample_id, p.t, x.s - coalesce(y.s, 0e0) FROM (SELECT *, unnest(range(lp)) AS t FROM pc WHERE smooth) p JOIN gs x ON x.sample_id = p.sample_id AND x.a = least(p.t, 2 * p.span * p.sps) LEFT JOIN gs y ON y.sample_id = p.sample_id AND y.a = p.t - p.sps),
 sy AS (SELECT pc.sample_id, sps, c - pos AS j, (-1 + 1e0 / o + floor(u * o) * (2 - 2e0 / o) / (o - 1)) / 4 AS lev FROM pc JOIN dr USING (sample_id) WHERE c >= pos AND c < pos + cnt),
 f AS (SELECT sy.sample_id, j * sps + t AS t, sum(lev * v) AS f FROM sy JOIN pu USING (sample_id) GROUP BY 1, 2),
 ph AS (SELECT f.sample_id, t + CASE WHEN total >= {n} THEN 0 ELSE ceil(({n} - total) / 2e0)::BIGINT END AS n, pi() * ix * sum(f) OVER (PARTITION BY f.sample_id ORDER BY t) AS a FROM f JOIN pc USING (sample_id)),
 o AS (SELECT src.sample_id, ns.n, coalesce(cos(a), 0e0)::FLOAT::DOUBLE AS i, coalesce(sin(a), 0e0)::FLOAT::DOUBLE AS q FROM src CROSS JOIN (SELECT unnest(range({n}))::BIGINT AS n) ns LEFT JOIN ph ON ph.sample_id = src.sample_id AND ph.n = ns.n) {LAST}"""


def carriers() -> str:
    n = CARRIERS
    return f"""WITH {sources([f'ofdm-{k}' for k in OFDM_SUBCARRIERS], max(OFDM_SUBCARRIERS) + 3)}, {POINTS},
 pa AS (SELECT sample_id, k, CASE WHEN u0 < 0.5e0 THEN 0 ELSE 2 + floor(u1 * (k // 2 - 2))::BIGINT END AS prefix, ['bpsk', 'qpsk', '16qam', '64qam', '256qam', '1024qam'][floor(CASE WHEN u0 < 0.5e0 THEN u1 ELSE u2 END * 6)::INTEGER + 1] AS name, CASE WHEN u0 < 0.5e0 THEN 2 ELSE 3 END AS pos
   FROM (SELECT *, regexp_extract(class_name, '[0-9]+')::BIGINT AS k FROM d3)),
 sy AS (SELECT pa.sample_id, pa.k, (c - pos) // pa.k AS b, CASE WHEN (c - pos) % pa.k < pa.k // 2 THEN (c - pos) % pa.k + 1 ELSE (c - pos) % pa.k - pa.k END AS f, pts.re, pts.im FROM pa JOIN dr USING (sample_id) JOIN (SELECT DISTINCT name, size FROM pts) z ON z.name = pa.name JOIN pts ON pts.name = pa.name AND pts.k = floor(u * z.size)::BIGINT WHERE c >= pos),
 tm AS (SELECT sample_id, n, n // (4 * (k + prefix)) AS b, (n % (4 * (k + prefix)) - 4 * prefix + 4 * k) % (4 * k) AS t FROM pa CROSS JOIN (SELECT unnest(range({n}))::BIGINT AS n)),
 o AS (SELECT sample_id, n, sum(re * cos(w) - im * sin(w))::FLOAT::DOUBLE AS i, sum(re * sin(w) + im * cos(w))::FLOAT::DOUBLE AS q FROM (SELECT tm.sample_id, n, re / (4 * k) AS re, im / (4 * k) AS im, 2 * pi() * ((f * t) % (4 * k)) / (4 * k) AS w FROM tm JOIN sy USING (sample_id, b)) GROUP BY 1, 2) {LAST}"""


def sweeps() -> str:
    n = SWEEPS
    return f"""WITH {sources([*LFM_KINDS, 'chirpss'], 6)},
 pa AS (SELECT sample_id, class_name, 128 + floor(u0 * 3968)::BIGINT AS sps FROM d3),
 xs AS (SELECT pa.*, n, n % sps AS t, u FROM pa CROSS JOIN (SELECT unnest(range({n}))::BIGINT AS n) JOIN dr ON dr.sample_id = pa.sample_id AND c = 1 + n // sps),
 ph AS (SELECT sample_id, n, CASE class_name WHEN 'chirpss' THEN -0.25e0 * s + 0.5e0 * 0.5e0 / sps * s * s ELSE CASE WHEN class_name = 'lfm_radar' OR floor(u * 2) > 0 THEN 1 ELSE -1 END * (-0.125e0 * t + 0.5e0 * 0.25e0 / sps * t * t) END AS a
   FROM (SELECT *, (t + floor(floor(u * 128) / 128 * sps)::BIGINT) % sps AS s FROM xs)),
 o AS (SELECT sample_id, n, cos(2 * pi() * a)::FLOAT::DOUBLE AS i, sin(2 * pi() * a)::FLOAT::DOUBLE AS q FROM ph) {LAST}"""


SQL = {
    "gen_psk": linear(PSK), "gen_qam": linear(QAM), "gen_ask": linear(ASK), "gen_ook": linear(["ook"]), "gen_fsk": shift(), "gen_ofdm": carriers(), "gen_chirps": sweeps(),
    "gen_tone": "SELECT n, 1e0 AS i, 0e0 AS q FROM (SELECT unnest(range(64))::BIGINT AS n)",
}
