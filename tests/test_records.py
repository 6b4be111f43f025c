import random

import pytest

from burstlake.operators import hierarchy as H
from burstlake.operators import intervals as I
from burstlake.operators import malformed as M


# --- malformed records ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "line, reason",
    [
        ("1,BPSK,2,5e6", None), (" 1 , BPSK , 2 , 5e6 \r", None), ('"1","B, ""x""\nC","2","5000000.5"\r', None), ("+1,x,-2,.5", None), ("1,a\\,2,5", None),
        ("", "column_count"), (None, "column_count"), ("1,a,2", "column_count"), ("1,a,2,3,4", "column_count"), ("1\ta\t2\t3", "column_count"), (",,,,", "column_count"),
        ('1,"a,2,3', "broken_quoting"), ('1,a",2,3', "broken_quoting"), ('1,"a"x,2,3', "broken_quoting"), ('1, "a",2,3', "broken_quoting"), ('1,"a" ,2,3', "broken_quoting"), ('1,""a"",2,3', "broken_quoting"), ('"', "broken_quoting"), ('1,"a"\r,2,3', "broken_quoting"),
        ("1.0,a,2,3", "invalid_value"), ("x,a,2,3", "invalid_value"), ("1,,2,3", "invalid_value"), ('1,"  ",2,3', "invalid_value"), ("1,a,NULL,3", "invalid_value"), ("1,a,2,0", "invalid_value"), ("1,a,2,-5", "invalid_value"),
        ("1,a,2,NaN", "invalid_value"), ("1,a,2,inf", "invalid_value"), ("1,a,2,1e999", "invalid_value"), ("1,a,2,1e-999", "invalid_value"), ("1,a,2,5d", "invalid_value"), ("1,a,2,5e", "invalid_value"), ('1,a,2," 5"', "invalid_value"),
        ("9223372036854775807,a,2147483647,5", None), ("9223372036854775808,a,2,5", "invalid_value"), ("1,a,2147483648,5", "invalid_value"), ("-9223372036854775808,a,-2147483648,5", None), ("１,a,2,5", "invalid_value"), ("0000000000000000000000000001,a,2,5", None), ("- 1,a,2,5", "invalid_value"),
    ],
)
def test_lines(line, reason):
    (r,) = list(M.Grammar().rows([line]))
    assert r.reason == reason and (r.values is None) == (reason is not None)


def test_neighbours_do_not_leak():
    got = list(M.Grammar().rows(['1,"a,2,3', '2,"b",2,3', None, '3,c",2,3', "4,d,2,3"]))
    assert [r.reason for r in got] == ["broken_quoting", None, "column_count", "broken_quoting", None]
    assert (got[3].field_no, got[3].offset) == (2, 3)


def test_file_resumes_at_validated_anchors():
    text = '1,a,2,5\n2,"broken,2,5\n  still, inside\n3,c,2,5\n4,"d\nd",2,5\r\n5,e\n6,f,2,"7\n'
    got = list(M.Grammar().file(text))
    assert [(r.values[0] if r.values else r.reason) for r in got] == [1, "broken_quoting", 3, 4, "column_count", "broken_quoting"]
    assert text[got[1].start :].startswith('2,"broken') and list(M.Grammar().file("")) == []


def test_load(spark):
    df = spark.createDataFrame([(1, "1,a,2,5", "x"), (2, "1,a", "y"), (3, None, "z")], "line_id bigint, raw_line string, reason string")
    good, bad = M.load(df)
    assert good.drop("reason").collect()[0].asDict() == {"line_id": 1, "index": 1, "label": "a", "modcod": 2, "sample_rate": 5.0}
    assert {(r.line_id, r.reason, r.raw_line) for r in bad.collect()} == {(2, "column_count", "1,a"), (3, "column_count", None)}
    assert M.load(df.limit(0))[1].count() == 0
    long = spark.createDataFrame([(1, '1,"' + "x" * 500_000 + '",2,5')], "line_id bigint, raw_line string")
    assert len(M.load(long)[0].collect()[0].label) == 500_000


def test_files(spark):
    df = spark.createDataFrame([("f", '1,a,2,5\n2,"b,2,5\n3,c,2,5'), ("g", None)], "name string, content string")
    got = M.parse_files(df).orderBy("start").collect()
    assert [(r.name, r.record["index"] if r.record else r.error.reason) for r in got] == [("f", 1), ("f", "broken_quoting"), ("f", 3)]


# --- intervals ------------------------------------------------------------------------------------------------------


def spans(rows):
    out = []
    for e in {r[0] for r in rows if r[0] is not None}:
        cur = None
        for a, b in sorted((s, s + d) for x, s, d in rows if x == e and s is not None and d is not None and d > 0):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    out += [(e, "period", *cur), (e, "gap", cur[1], a)]
                cur = [a, b]
        if cur:
            out.append((e, "period", *cur))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_periods_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None] + [r.randrange(0, 400) for _ in range(9)]), r.choice([None, 0, -3] + [r.randrange(1, 9) for _ in range(7)])) for _ in range(r.choice([1, 30, 300]))]
    df = spark.createDataFrame(rows, "e bigint, s bigint, d bigint")
    for n in (1, 3, 8):
        assert sorted(tuple(x) for x in I.periods(df, "e", "s", "d", n).collect()) == spans(rows)


def test_one_hot_entity_nested_and_touching(spark):
    rows = [("x", k * 10, 10 if k % 50 else 4) for k in range(500)] + [("x", 0, 3000), ("y", 2**40, 5)]
    df = spark.createDataFrame(rows, "t string, s bigint, d bigint")
    assert sorted(tuple(x) for x in I.periods(df, "t", "s", "d", 6).collect()) == spans(rows)
    assert I.periods(df.limit(0), "t", "s", "d").count() == 0
    far = spark.createDataFrame([("x", 2**63 - 2, 5), ("x", 1, 2)], "t string, s bigint, d bigint")
    assert [tuple(x) for x in I.periods(far, "t", "s", "d").collect()] == [("x", "period", 1, 3)]


# --- hierarchies -----------------------------------------------------------------------------------------------------


def climb(rows):
    par = {}
    for i, p in rows:
        if i is not None:
            p = (p or "").strip() or None
            par[i] = min([x for x in (par.get(i), p) if x], default=None)
    out = {}
    for i in par:
        path = [i]
        while True:
            p = par[path[-1]]
            if p is None or p not in par:
                out[i] = (path[-1], len(path) - 1, "tree" if p is None else "dangling", path[::-1])
                break
            if p in path:
                k = path.index(p)
                out[i] = (min(path[k:]), k, "below_cycle" if k else "cycle", path[: k + 1][::-1])
                break
            path.append(p)
    return out


def make(r, n):
    rows = [(f"n{k}", r.choice([None, "", " ", f" n{r.randrange(n + 2)} ", f"n{r.randrange(max(1, n))}", f"n{max(0, k - 1)}"])) for k in range(n)] + [(None, "n1")]
    return rows + r.sample(rows, len(rows) // 4)


@pytest.mark.parametrize("seed, n", [(1, 0), (2, 1), (3, 25), (4, 120)])
def test_hierarchy_against_brute_force(spark, seed, n):
    rows = make(random.Random(seed), n)
    t = H.table(H.hierarchy(spark.createDataFrame(rows, "metadata_id string, parent_metadata_id string")))
    want = climb(rows)
    got = {x.metadata_id: (x.root_id, x.depth, x.state) for x in t.collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    assert {x.metadata_id: x.path for x in H.paths(t).collect()} == {k: "/".join(v[3]) for k, v in want.items()}
    below = sorted((a, k) for k, v in want.items() for a in v[3][:-1])
    assert sorted(tuple(x) for x in H.descendants(t).collect()) == below
    count = {}
    for a, _ in below:
        count[a] = count.get(a, 0) + 1
    assert {x.metadata_id: x.n_descendants for x in t.collect()} == {k: count.get(k, 0) for k in want}


def test_chain_star_and_loop(spark):
    rows = [(f"c{k:03}", f"c{k - 1:03}" if k else None) for k in range(150)] + [(f"s{k:03}", "c000") for k in range(150)] + [("l1", "l3"), ("l2", "l1"), ("l3", "l2"), ("x", "l2"), ("self", "self")]
    t = {x.metadata_id: x for x in H.hierarchy(spark.createDataFrame(rows, "metadata_id string, parent_metadata_id string")).collect()}
    assert t["c149"].depth == 149 and t["c000"].n_descendants == 299
    assert [t[k].state for k in ("l1", "l2", "l3", "x", "self", "s001")] == ["cycle"] * 3 + ["below_cycle", "cycle", "tree"]
    assert t["x"].root_id == "l1" and t["self"].depth == 0


@pytest.mark.parametrize("seed, n, base", [(5, 120, 150), (6, 60, 24)])
def test_lists_and_loops_longer_than_one_task_takes(spark, seed, n, base):
    r = random.Random(seed)
    rows = make(r, n) + [(f"c{k:03}", f"c{k - 1:03}" if k else None) for k in range(90)] + [(f"o{k:02}", f"o{(k + 1) % 40:02}") for k in range(40)] + [(f"p{k}", f"o{k:02}") for k in range(9)]
    want = climb(rows)
    t = H.hierarchy(spark.createDataFrame(rows, "metadata_id string, parent_metadata_id string"), base=base)
    assert {x.metadata_id: (x.root_id, x.depth, x.state) for x in t.collect()} == {k: v[:3] for k, v in want.items()}
    assert {x.metadata_id: x.path for x in H.paths(t, held=64).collect()} == {k: "/".join(v[3]) for k, v in want.items()}
