import math

import numpy as np
import pytest

from burstlake.llm import percentiles as P


@pytest.mark.parametrize("n", [1, 2, 39, 1000, 200_000])
def test_rank_error_and_merge(n):
    v = np.random.default_rng(n).lognormal(size=n)
    s, ordered = P.merged([P.Sketch().add(x).to_bytes() for x in np.array_split(v, 7)]), np.sort(v)
    assert s.n == n and sum(len(x.items) << h for h, x in enumerate(s.levels)) == n
    for p in (1, 5, 25, 50, 75, 95, 99, 99.9):
        rank = np.searchsorted(ordered, s.percentile(p), "right")
        assert abs(rank - max(1, math.ceil(p / 100 * n))) <= max(1, 0.006 * n)
    # multiplicative at the protected tail
    for tail in (1e-3, 1e-4):
        if n >= 100_000:
            rank = n - np.searchsorted(ordered, s.percentile(100 - 100 * tail), "right")
            assert abs(rank - tail * n) <= 0.03 * tail * n + 2
    assert s.percentile(100) == ordered[-1]


def test_sizes_stay_bounded_and_bytes_round_trip():
    s = P.Sketch()
    for k in range(40):
        s.add(np.random.default_rng(k).normal(size=50_000))
    b = s.to_bytes()
    assert len(b) < 80_000 and P.Sketch.from_bytes(b).to_bytes() == b
    assert P.Sketch().percentile(50) is None and P.merged([]).n == 0


def test_ties():
    s = P.Sketch().add(np.repeat([1.0, 2.0, 3.0], 5000))
    assert [s.percentile(p) for p in (10, 50, 90)] == [1.0, 2.0, 3.0]


def test_groups_nulls_and_days(spark):
    rows = [("A ", "d1", float(k)) for k in range(100)] + [("A ", "d2", float(k)) for k in range(100, 200)] + [(None, "d1", 5.0), ("B", "d1", None), ("B", None, float("nan")), ("B", None, float("inf")), ("B", None, 7.0)]
    df = spark.createDataFrame(rows, "_k0 string, day string, n double")
    got = P.sketch(df, ["_k0", "day"], "n")
    assert {(r["_k0"], r.day): r.n for r in got.collect()} == {("A ", "d1"): 100, ("A ", "d2"): 100, (None, "d1"): 1, ("B", None): 1}
    whole = P.percentiles(P.merge_sketches(got, ["_k0"], "sketch"), [50.0])
    assert {r["_k0"]: r.value for r in whole.collect()} == {"A ": 99.0, None: 5.0, "B": 7.0}
    assert P.sketch(df.limit(0), ["_k0"], "n").count() == 0


def test_signal_once(spark):
    s = "signal_id bigint, label string, captured_at timestamp, written_at timestamp, bandwidth double, center_freq double"
    import datetime as dt

    t = dt.datetime(2031, 3, 4)
    df = spark.createDataFrame([(1, " Qpsk", t, t, 5.0, None), (1, "qpsk", t, t + dt.timedelta(hours=1), 6.0, 1.0), (2, None, None, t, 1.0, 2.0)], s)
    got = {(r.label_class, r.capture_day, r.field_name, r.value) for r in P.signal_values(df).collect()}
    assert got == {("qpsk", "2031-03-04", "bandwidth", 5.0), ("qpsk", "2031-03-04", "center_freq", None), (None, None, "bandwidth", 1.0), (None, None, "center_freq", 2.0)}


def test_both_tails(spark):
    import numpy as np

    from burstlake.llm import percentiles as P

    r = np.random.default_rng(5)
    x = r.lognormal(0, 2, 60_000)
    df = spark.createDataFrame([(f"d{k % 3}", "c", float(v)) for k, v in enumerate(x)], "day string, c string, value double").repartition(5)
    got = {(g.day, g.pct): g.value for g in P.two_tailed(df, ["c", "day"], ["c"], [0.1, 1.0, 50.0, 99.0, 99.9]).collect()}
    s = np.sort(x)
    for p in (0.1, 1.0, 50.0, 99.0, 99.9):
        rank = np.searchsorted(s, got[None, p]) / len(s) * 100
        assert abs(rank - p) <= 0.05 * min(p, 100 - p) + 0.01, p
    assert len(got) == 20
