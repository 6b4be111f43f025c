import itertools
import random

from pyspark.sql import functions as F

from burstlake.llm import proportions as P


def test_flow_against_brute_force():
    r = random.Random(1)
    for _ in range(40):
        caps = [[r.randint(0, 2) for _ in range(3)] for _ in range(2)]
        cost = [[r.randint(0, 9) for _ in range(3)] for _ in range(2)]
        rows, cols = [r.randint(0, 3) for _ in range(2)], [r.randint(0, 3) for _ in range(3)]
        g = P.Flow(7)
        for a, c in enumerate(rows):
            g.arc(0, 1 + a, c, 0)
        for b, c in enumerate(cols):
            g.arc(3 + b, 6, c, 0)
        arcs = [g.arc(1 + a, 3 + b, caps[a][b], cost[a][b]) for a in range(2) for b in range(3)]
        sent = g.run(0, 6, 99)
        paid = sum(g.cap[e ^ 1] * cost[k // 3][k % 3] for k, e in enumerate(arcs))
        best = (-1, 0)
        for f in itertools.product(*[range(caps[a][b] + 1) for a in range(2) for b in range(3)]):
            if all(sum(f[3 * a : 3 * a + 3]) <= rows[a] for a in range(2)) and all(f[b] + f[3 + b] <= cols[b] for b in range(3)):
                best = max(best, (sum(f), -sum(x * cost[k // 3][k % 3] for k, x in enumerate(f))))
        assert (sent, -paid) == best


def test_quotas_round_within_one_and_expose_shortfalls():
    cells = [("a", 0, 0.333, 0, 900), ("a", 1, 0.1, 5, 3), ("b", 0, 0.267, 0, 900), ("b", 1, 0.3, 400, 900), ("c", 7, 0.0, 9, 0)]
    for seed in range(30):
        q = P.quotas(cells, 1000, seed)
        for c, x in zip(cells, q):
            want = max(c[3], c[2] * 1000)
            assert x["quota"] <= c[4] and (x["quota"] in (int(want), int(want) + 1) or x["quota"] == c[4])
            assert x["is_short"] == (c[4] < want) and x["shortfall"] == max(0, -(-want // 1) - c[4])
    assert P.quotas([], 10) == []


def test_random_rounding_is_unbiased():
    cells = [(r, c, 0.25 / 10, 0, 99) for r in "ab" for c in (0, 1)] + [("z", 9, 0.9, 0, 99)]
    got = [sum(P.quotas(cells, 10, s)[k]["quota"] for s in range(400)) / 400 for k in range(4)]
    assert all(abs(g - 0.25) < 0.09 for g in got) and abs(sum(got) - 1) < 0.05


def rows(spark):
    data = [(k, " Qpsk" if k % 2 else "qpsk", 0, "x") for k in range(500)] + [(k, "bpsk", 1, "y") for k in range(500, 560)] + [(k, None, None, "z") for k in range(560, 600)] + [(3, "qpsk", 0, "x"), (None, "qpsk", 0, "x")]
    return spark.createDataFrame(data, "idx bigint, label string, modcod int, quota string")


def test_plan_and_draw(spark):
    t = spark.createDataFrame([("QPSK", 0, 0.6, 0), ("bpsk", 1, 0.3, 70), ("tone", 2, 0.1, 4)], "label_class string, modcod int, target_share double, min_rows bigint")
    one, cells, size = P.plan(rows(spark), t)
    assert one.count() == 600 and size == 120
    q = {r.label_class: r for r in cells.collect()}
    assert q["qpsk"].available == 500 and q["qpsk"].quota == 72 and not q["qpsk"].is_short
    assert q["bpsk"].quota == 60 and q["bpsk"].is_short and q["bpsk"].shortfall == 10
    assert q["tone"].quota == 0 and q["tone"].shortfall == 12
    s = P.draw(one, cells)
    n = {r.label_class: r["count"] for r in s.groupBy("label_class").count().collect()}
    assert n == {"qpsk": 72, "bpsk": 60} and s.select("idx").distinct().count() == 132
    assert s.subtract(P.draw(one.repartition(5), cells)).count() == 0
    few = P.draw(one, cells, bins=2)
    assert few.count() == 132
    assert P.draw(one.limit(0), cells).count() == 0


def test_empty(spark):
    t = spark.createDataFrame([("a", 0, 1.0, 0)], "label_class string, modcod int, target_share double, min_rows bigint")
    one, cells, size = P.plan(rows(spark).limit(0), t)
    assert size == 0 and not cells.where("is_short").count()
    assert P.plan(rows(spark), t.limit(0))[1].count() == 0
    assert P.plan(rows(spark).withColumn("label", F.lit(None).cast("string")), t)[1].where("is_short").count() == 1


def test_shortfalls_are_what_flows_over_the_slack_arcs():
    # the fractions beside a short cell do not take its slack: with 4 x 0.5 in its row, 2 are rounded up and 3 are short
    cells = [("a", 0, 0.5, 0, 2)] + [("a", k, 0.05, 0, 99) for k in range(1, 5)]
    for seed in range(20):
        q = P.quotas(cells, 10, seed)
        assert q[0]["quota"] == 2 and q[0]["shortfall"] == 3 and q[0]["is_short"]
        assert sum(x["quota"] for x in q[1:]) == 2 and not any(x["is_short"] or x["shortfall"] for x in q[1:])
    r = random.Random(8)
    for seed in range(30):
        cells = [(a, b, r.random() / 20, r.choice([0, 0, 12]), r.randint(0, 60)) for a in range(6) for b in range(5)]
        for c, x in zip(cells, P.quotas(cells, 731, seed)):
            want = max(c[3], c[2] * 731)
            assert x["shortfall"] == max(0, -(-want // 1) - c[4]) and x["is_short"] == (c[4] < want)
            assert x["quota"] == c[4] if x["is_short"] else x["quota"] in (int(want), int(want) + 1)


def test_margins_and_total_stay_within_one_and_means_are_right():
    import numpy as np

    r = np.random.default_rng(3)
    share = r.random((6, 5)) ** 2
    share /= share.sum()
    cells = [(f"r{i}", j, float(share[i, j]), 0, 10**6) for i in range(6) for j in range(5)]
    total = np.zeros((6, 5))
    for seed in range(300):
        q = np.array([x["quota"] for x in P.quotas(cells, 997, seed)]).reshape(6, 5)
        want = share * 997
        assert (np.abs(q - want) < 1).all() and q.sum() in (996, 997, 998)
        assert (np.abs(q.sum(0) - want.sum(0)) < 1.001).all() and (np.abs(q.sum(1) - want.sum(1)) < 1.001).all()
        total += q
    assert (np.abs(total / 300 - share * 997) < 0.12).all()


def test_slack_is_what_a_flow_without_it_cannot_send():
    r = random.Random(8)
    for _ in range(20):
        cells = [(a, b, 0.0, r.randint(0, 9), r.randint(0, 9)) for a in "xyz" for b in range(3)]
        g = P.Flow(8 + len(cells))
        for k in range(3):
            g.arc(0, 1 + k, sum(c[3] for c in cells if c[0] == "xyz"[k]), 0)
            g.arc(4 + k, 7, sum(c[3] for c in cells if c[1] == k), 0)
        for n, c in enumerate(cells):
            g.arc(1 + "xyz".index(c[0]), 8 + n, c[3], 0)
            g.arc(8 + n, 4 + c[1], c[4], 0)
        sent = g.run(0, 7, 10**6)
        assert sum(x["shortfall"] for x in P.quotas(cells, 5)) == sum(c[3] for c in cells) - sent
