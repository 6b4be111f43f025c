import numpy as np

from burstlake.llm import mixing as M


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    x, pi = r.integers(10, 3000, 4000), np.full(4000, 0.37)
    p = M.fly(pi, x, r.random)
    assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
    assert abs(p.sum() - pi.sum()) < 1e-6 and abs((p * x).sum() - (pi * x).sum()) < 1e-3
    landed = M.fly(pi, x, r.random, land=True)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - pi.sum()) <= 1 and abs((landed * x).sum() - (pi * x).sum()) <= 2 * x.max()


def test_flight_is_unbiased():
    r = np.random.default_rng(2)
    x = np.array([5, 1, 9, 9, 3, 7])
    pi = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3])
    mean = np.mean([M.fly(pi, x, r.random, land=True) for _ in range(6000)], axis=0)
    assert np.abs(mean - pi).max() < 0.03


def test_flight_ties_and_ends():
    r = np.random.default_rng(3)
    assert M.fly(np.array([]), np.array([]), r.random, land=True).tolist() == []
    assert M.fly(np.array([0.0, 1.0]), np.array([1, 1]), r.random).tolist() == [0.0, 1.0]
    same = M.fly(np.full(10, 0.5), np.full(10, 4), r.random, land=True)
    assert same.sum() == 5


def test_mix(spark):
    words = lambda n: "word " * n
    rows = [(k, " A " if k % 2 else "a", words(10 + k % 7)) for k in range(400)] + [(k, "B", words(30)) for k in range(400, 420)] + [(500, "c", words(5)), (501, None, words(9)), (502, "a", None), (503, "a", ""), (504, "other", words(3)), (400, "B", words(30))]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.2, 3), ("C", 0.2, 2), ("d", 0.1, 5)], "source string, target_weight double, max_repeats int")
    copies, report = M.mix(docs, targets, block=50)
    rep = {r.source: r for r in report.collect()}
    total = sum(r.available_tokens for r in rep.values())
    assert {k for k, r in rep.items() if r.is_short} == {"c", "d"}
    assert rep["d"].available_docs == 0 and rep["d"].used_tokens == 0
    for s in ("a", "b"):
        assert abs(rep[s].used_tokens - rep[s].target_tokens) <= 80
        assert abs(rep[s].target_tokens - rep[s].target_weight * total) < 1e-6
    assert rep["c"].used_docs == 2 * rep["c"].available_docs
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    c = copies.collect()
    assert {r.source for r in c} == {"a", "b", "c"} and len(c) == 400 + 21 + 1
    most = {"a": 1, "b": 3, "c": 2}
    assert all(0 <= r.copies <= most[r.source] for r in c)
    again = {(r.doc_id, r.copies) for r in M.mix(docs.repartition(7), targets, block=50)[0].collect()}
    assert {(r.doc_id, r.copies) for r in c} == again  # no matter how the rows lie
    assert M.mix(docs.limit(0), targets)[0].count() == 0
