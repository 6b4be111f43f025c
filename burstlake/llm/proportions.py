"""A sample that matches target category proportions (problem 1).

Method: min-cost flow on the cross-classified cell counts.  Arcs run from the source over the row
margins (label class) and the cells to the column margins (modcod); cells carry floors and
availability, slack arcs with a cost expose what cannot be met.  The integer quotas are drawn randomly:
the fractions of the targets are shifted along cycles of the same network until all are whole.  Rows of a cell are then drawn by a hash threshold, without gathering a cell.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut

MAX_CELLS = 100_000


class Flow:
    """Successive shortest paths with potentials; integer capacities, real costs."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, cap: int, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int, amount: int) -> int:
        """Sends up to ``amount`` from s to t at least cost; costs must not be negative.  Returns what was sent."""
        sent, pot = 0, [0.0] * len(self.out)
        while sent < amount:
            far, via = [math.inf] * len(self.out), [-1] * len(self.out)
            far[s], heap = 0.0, [(0.0, s)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > far[v] + 1e-12:
                    continue
                for e in self.out[v]:
                    if self.cap[e] > 0:
                        w = self.to[e]
                        nd = d + max(0.0, self.cost[e] + pot[v] - pot[w])
                        if nd < far[w] - 1e-12:
                            far[w], via[w] = nd, e
                            heapq.heappush(heap, (nd, w))
            if via[t] < 0:
                return sent
            for v in range(len(pot)):
                if far[v] < math.inf:
                    pot[v] += far[v]
            sent += self._block(s, t, amount - sent, pot)
        return sent

    def _block(self, s: int, t: int, amount: int, pot: list[float]) -> int:
        """Pushes along shortest paths until each has a full arc; an arc lies on one if it costs what the potentials differ by."""
        sent, path, nxt = 0, [], [0] * len(self.out)
        seen = [False] * len(self.out)
        seen[s], v = True, s
        while True:
            if v == t:
                push = min(amount - sent, min(self.cap[e] for e in path))
                for e in path:
                    self.cap[e] -= push
                    self.cap[e ^ 1] += push
                sent += push
                if sent == amount:
                    return sent
                full = next(k for k, e in enumerate(path) if self.cap[e] == 0)
                for e in path[full:]:
                    seen[self.to[e]] = False
                v = self.to[path[full] ^ 1]
                del path[full:]
                continue
            own = self.out[v]
            while nxt[v] < len(own):
                e = own[nxt[v]]
                w = self.to[e]
                if self.cap[e] > 0 and not seen[w] and abs(self.cost[e] + pot[v] - pot[w]) <= 1e-9:
                    break
                nxt[v] += 1
            else:
                if not path:
                    return sent
                # stays seen: nothing more goes through this node now
                v = self.to[path.pop() ^ 1]
                nxt[v] += 1
                continue
            seen[w], v = True, w
            path.append(e)


def rounded(arcs: list[tuple[int, int]], part: list[float], nodes: int, rng) -> list[int]:
    """0 or 1 for the fractions of a flow, drawn so that each arc rounds up with its fraction as the probability.

    The fractions are in balance at every node but for whole units, so arcs that are still fractional close to cycles;
    one cycle after another is shifted, up or down at random with the mean unchanged, until one of its arcs is 0 or 1.
    The balance of every node, hence each margin and the total, stays within one of what it was.
    """
    x, eps = list(part), 1e-9
    at: list[list[int]] = [[] for _ in range(nodes)]
    for k in rng.permutation(len(arcs)).tolist():
        if eps < x[k] < 1 - eps:
            for v in arcs[k]:
                at[v].append(k)
    coins = iter(())
    for start in range(nodes):
        path, where = [start], {start: 0}
        edges: list[int] = []
        while True:
            v, last = path[-1], edges[-1] if edges else -1
            own, k = at[v], -1
            for j in range(len(own) - 1, -1, -1):
                if not eps < x[own[j]] < 1 - eps:
                    own[j] = own[-1]
                    own.pop()
                elif own[j] != last:
                    k = own[j]
                    break
            if k < 0:
                if not edges:
                    break
                # a dead end can only be left over by rounding errors: the arc rounds by its own fraction
                x[last] = float(rng.random() < x[last])
                edges.pop()
                del where[path.pop()]
                continue
            w = arcs[k][0] + arcs[k][1] - v
            if w not in where:
                where[w] = len(path)
                path.append(w)
                edges.append(k)
                continue
            cycle, u = edges[where[w] :] + [k], w
            up, down, signs = 1.0, 1.0, []
            for e in cycle:
                forward = arcs[e][0] == u
                u = arcs[e][0] + arcs[e][1] - u
                signs.append(forward)
                up, down = min(up, 1 - x[e] if forward else x[e]), min(down, x[e] if forward else 1 - x[e])
            coin = next(coins, None)
            if coin is None:
                coins = iter(rng.random(4096).tolist())
                coin = next(coins)
            step = up if coin * (up + down) < down else -down
            for e, forward in zip(cycle, signs):
                x[e] += step if forward else -step
            # the walk goes on from where the cycle was entered
            for y in path[where[w] + 1 :]:
                del where[y]
            del path[where[w] + 1 :], edges[where[w] :]
    return [int(round(y)) for y in x]


def quotas(cells: list[tuple], size: int, seed: int = 7) -> list[dict]:
    """Integer quotas of cells (row, column, share, floor, available) for a sample of ``size`` rows.

    The wanted count of a cell is the larger of its floor and share x size.  Its whole part (the count rounded up where
    that is not available) flows between the margins: over an arc as wide as what is available, and behind it a slack arc
    at a high cost; what flows there is the shortfall, and a cell is short where something does.  The fractions are a
    second flow between the margins that is drawn to whole units at random, cycle by cycle (rounded()).  So each quota is
    the wanted count rounded down or up with the right mean, or all there is, and margins and total stay within one.  The
    sample is smaller than ``size`` by the shortfalls and larger by what floors add; nothing is filled up from other
    cells, which would distort them.  Returns row, column, wanted, available, quota, shortfall, is_short for each cell.
    """
    rng = np.random.default_rng(seed)
    rows = {r: i for i, r in enumerate(dict.fromkeys(c[0] for c in cells))}
    cols = {c: i for i, c in enumerate(dict.fromkeys(c[1] for c in cells))}
    want = [max(float(floor), share * size) for _, _, share, floor, _ in cells]
    part = [w - math.floor(w + 1e-9) if math.ceil(w) <= int(c[4]) else 0.0 for w, c in zip(want, cells)]
    part = [x if x > 1e-9 else 0.0 for x in part]
    whole = [math.floor(w + 1e-9) if math.ceil(w) <= int(c[4]) else math.ceil(w) for w, c in zip(want, cells)]
    t = 1 + len(rows) + len(cols)
    ends = [(1 + rows[c[0]], 1 + len(rows) + cols[c[1]]) for c in cells]
    sums, parts = [0] * (t + 1), [0.0] * (t + 1)
    for (a, z), m, x in zip(ends, whole, part):
        for v in (a, z):
            sums[v] += m
            parts[v] += x
    g = Flow(t + 1 + len(cells))
    margin = [(0, v) if v <= len(rows) else (v, t) for v in range(1, t)]
    for v, (a, z) in enumerate(margin, 1):
        g.arc(a, z, sums[v], 0.0)
    arcs = []
    for v, ((a, z), m, c) in enumerate(zip(ends, whole, cells), t + 1):
        g.arc(a, v, m, 0.0)
        arcs.append((g.arc(v, z, int(c[4]), 0.0), g.arc(v, z, m, 1.0)))
    g.run(0, t, sum(whole))
    # the fractions of cells, margins and the total (an arc back from the sink)
    more = rounded(ends + margin + [(t, 0)], [*part, *(x % 1.0 for x in parts[1:t]), sum(part) % 1.0], t + 1, rng)
    out = []
    for (r, c, *_, av), w, (e, f), up in zip(cells, want, arcs, more):
        out.append({"row": r, "column": c, "wanted": w, "available": int(av), "quota": g.cap[e ^ 1] + up, "shortfall": g.cap[f ^ 1], "is_short": g.cap[f ^ 1] > 0})
    return out


def category_counts(rows: DataFrame, targets: DataFrame, key: str = "idx") -> tuple[DataFrame, DataFrame, int]:
    """(one row per distinct key with its category, target cells with their availability, all distinct keys).

    Of repeated rows of a key the smallest category counts (nulls last); null keys are left out.
    """
    cat = F.struct(F.col("modcod").isNull() | F.col("label").isNull(), F.lower(F.trim("label")).alias("label_class"), "modcod")
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(cat).alias("_c"))
    one = cut(one.select(key, "_c.label_class", "_c.modcod"))
    t = targets.select(F.lower(F.trim("label_class")).alias("label_class"), "modcod", "target_share", "min_rows")
    have = one.groupBy("label_class", "modcod").agg(F.count(F.lit(1)).alias("available"))
    cond = t["label_class"].eqNullSafe(have["label_class"]) & t["modcod"].eqNullSafe(have["modcod"])
    cells = t.join(have, cond, "left").select(t["label_class"], t["modcod"], "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"))
    return one, cells, one.count()


def plan(rows: DataFrame, targets: DataFrame, size: int | None = None, key: str = "idx", seed: int = 7) -> tuple[DataFrame, DataFrame, int]:
    """(one row per key, quotas per target category, sample size); size defaults to a fifth of the distinct keys.

    Only the target cells come to the driver: at most MAX_CELLS of them, else ValueError.
    """
    one, cells, total = category_counts(rows, targets, key)
    size = total // 5 if size is None else size
    got = cells.limit(MAX_CELLS + 1).collect()
    if len(got) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target categories")
    got.sort(key=lambda r: (r["label_class"] or "", -1 if r["modcod"] is None else r["modcod"]))
    q = quotas([(r["label_class"], r["modcod"], r["target_share"] or 0.0, r["min_rows"] or 0, r["available"]) for r in got], size, seed)
    shape = "label_class string, modcod int, target_share double, min_rows bigint, available bigint, wanted double, quota bigint, shortfall bigint, is_short boolean"
    data = [(r["label_class"], r["modcod"], r["target_share"], r["min_rows"], x["available"], x["wanted"], x["quota"], x["shortfall"], x["is_short"]) for r, x in zip(got, q)]
    return one, one.sparkSession.createDataFrame(data, shape), size


def draw(one: DataFrame, cells: DataFrame, key: str = "idx", seed: int = 7, bins: int = 4096) -> DataFrame:
    """(key, label_class, modcod): exactly the quota of every category, drawn at random by the hash of the key.

    Counts per category and hash bin are combined before the shuffle; whole bins below the quota are
    taken and only the bin in which the quota ends is ordered, so no category is gathered in one task.
    """
    h = one.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_bin", F.pmod(F.shiftright("_h", 11), F.lit(bins)).cast("int"))
    h = h.join(F.broadcast(cells.where("quota > 0").select("label_class", "modcod", "quota")), ["label_class", "modcod"])
    per = h.groupBy("label_class", "modcod", "quota", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    w = Window.partitionBy("label_class", "modcod").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_room", F.col("quota") - F.col("_before")).where("_room > 0")
    # one row a category: the last bin that is drawn from, and how many of its rows
    edge = per.groupBy("label_class", "modcod").agg(F.max("_bin").alias("_last"), F.max_by("_room", "_bin").alias("_room"))
    h = h.join(F.broadcast(edge), ["label_class", "modcod"]).where("_bin <= _last")
    nth = F.row_number().over(Window.partitionBy("label_class", "modcod", "_bin").orderBy("_h", key))
    ordered = h.where("_bin = _last").withColumn("_r", nth).where("_r <= _room").drop("_r")
    return h.where("_bin < _last").unionByName(ordered).select(key, "label_class", "modcod")
def quotas(cells: list[tuple], size: int, seed: int = 7) -> list[dict]:
    """Integer quotas of cells (row, column, share, floor, available) for a sample of ``size`` rows.

    The wanted count of a cell is the larger of its floor and share x size.  Its whole part (the count rounded up where
    that is not available) flows between the margins: over an arc as wide as what is available, and behind it a slack arc
    at a high cost; what flows there is the shortfall, and a cell is short where something does.  The fractions are a
    second flow between the margins that is drawn to whole units at random, cycle by cycle (rounded()).  So each quota is
    the wanted count rounded down or up with the right mean, or all there is, and margins and total stay within one.  The
    sample is smaller than ``size`` by the shortfalls and larger by what floors add; nothing is filled up from other
    cells, which would distort them.  Returns row, column, wanted, available, quota, shortfall, is_short for each cell.
    """
    rng = np.random.default_rng(seed)
    rows = {r: i for i, r in enumerate(dict.fromkeys(c[0] for c in cells))}
    cols = {c: i for i, c in enumerate(dict.fromkeys(c[1] for c in cells))}
    want = [max(float(floor), share * size) for _, _, share, floor, _ in cells]
    part = [w - math.floor(w + 1e-9) if math.ceil(w) <= int(c[4]) else 0.0 for w, c in zip(want, cells)]
    part = [x if x > 1e-9 else 0.0 for x in part]
    whole = [math.floor(w + 1e-9) if math.ceil(w) <= int(c[4]) else math.ceil(w) for w, c in zip(want, cells)]
    t = 1 + len(rows) + len(cols)
    ends = [(1 + rows[c[0]], 1 + len(rows) + cols[c[1]]) for c in cells]
    sums, parts = [0] * (t + 1), [0.0] * (t + 1)
    for (a, z), m, x in zip(ends, whole, part):
        for v in (a, z):
            sums[v] += m
            parts[v] += x
    g = Flow(t + 1 + len(cells))
    margin = [(0, v) if v <= len(rows) else (v, t) for v in range(1, t)]
    for v, (a, z) in enumerate(margin, 1):
        g.arc(a, z, sums[v], 0.0)
    arcs = []
    for v, ((a, z), m, c) in enumerate(zip(ends, whole, cells), t + 1):
        g.arc(a, v, m, 0.0)
        arcs.append((g.arc(v, z, int(c[4]), 0.0), g.arc(v, z, m, 1.0)))
    g.run(0, t, sum(whole))
    # the fractions of cells, margins and the total (an arc back from the sink)
    more = rounded(ends + margin + [(t, 0)], [*part, *(x % 1.0 for x in parts[1:t]), sum(part) % 1.0], t + 1, rng)
    out = []
    for (r, c, *_, av), w, (e, f), up in zip(cells, want, arcs, more):
        out.append({"row": r, "column": c, "wanted": w, "available": int(av), "quota": g.cap[e ^ 1] + up, "shortfall": g.cap[f ^ 1], "is_short": g.cap[f ^ 1] > 0})
    return out


def category_counts(rows: DataFrame, targets: DataFrame, key: str = "idx") -> tuple[DataFrame, DataFrame, int]:
    """(one row per distinct key with its category, target cells with their availability, all distinct keys).

    Of repeated rows of a key the smallest category counts (nulls last); null keys are left out.
    """
    cat = F.struct(F.col("modcod").isNull() | F.col("label").isNull(), F.lower(F.trim("label")).alias("label_class"), "modcod")
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(cat).alias("_c"))
    one = cut(one.select(key, "_c.label_class", "_c.modcod"))
    t = targets.select(F.lower(F.trim("label_class")).alias("label_class"), "modcod", "target_share", "min_rows")
    have = one.groupBy("label_class", "modcod").agg(F.count(F.lit(1)).alias("available"))
    cond = t["label_class"].eqNullSafe(have["label_class"]) & t["modcod"].eqNullSafe(have["modcod"])
    cells = t.join(have, cond, "left").select(t["label_class"], t["modcod"], "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"))
    return one, cells, one.count()


def plan(rows: DataFrame, targets: DataFrame, size: int | None = None, key: str = "idx", seed: int = 7) -> tuple[DataFrame, DataFrame, int]:
    """(one row per key, quotas per target category, sample size); size defaults to a fifth of the distinct keys.

    Only the target cells come to the driver: at most MAX_CELLS of them, else ValueError.
    """
    one, cells, total = category_counts(rows, targets, key)
    size = total // 5 if size is None else size
    got = cells.limit(MAX_CELLS + 1).collect()
    if len(got) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target categories")
    got.sort(key=lambda r: (r["label_class"] or "", -1 if r["modcod"] is None else r["modcod"]))
    q = quotas([(r["label_class"], r["modcod"], r["target_share"] or 0.0, r["min_rows"] or 0, r["available"]) for r in got], size, seed)
    shape = "label_class string, modcod int, target_share double, min_rows bigint, available bigint, wanted double, quota bigint, shortfall bigint, is_short boolean"
    data = [(r["label_class"], r["modcod"], r["target_share"], r["min_rows"], x["available"], x["wanted"], x["quota"], x["shortfall"], x["is_short"]) for r, x in zip(got, q)]
    return one, one.sparkSession.createDataFrame(data, shape), size


def draw(one: DataFrame, cells: DataFrame, key: str = "idx", seed: int = 7, bins: int = 4096) -> DataFrame:
    """(key, label_class, modcod): exactly the quota of every category, drawn at random by the hash of the key.

    Counts per category and hash bin are combined before the shuffle; whole bins below the quota are
    taken and only the bin in which the quota ends is ordered, so no category is gathered in one task.
    """
    h = one.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_bin", F.pmod(F.shiftright("_h", 11), F.lit(bins)).cast("int"))
    h = h.join(F.broadcast(cells.where("quota > 0").select("label_class", "modcod", "quota")), ["label_class", "modcod"])
    per = h.groupBy("label_class", "modcod", "quota", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    w = Window.partitionBy("label_class", "modcod").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_room", F.col("quota") - F.col("_before")).where("_room > 0")
    # one row a category: the last bin that is drawn from, and how many of its rows
    edge = per.groupBy("label_class", "modcod").agg(F.max("_bin").alias("_last"), F.max_by("_room", "_bin").alias("_room"))
    h = h.join(F.broadcast(edge), ["label_class", "modcod"]).where("_bin <= _last")
    nth = F.row_number().over(Window.partitionBy("label_class", "modcod", "_bin").orderBy("_h", key))
    ordered = h.where("_bin = _last").withColumn("_r", nth).where("_r <= _room").drop("_r")
    return h.where("_bin < _last").unionByName(ordered).select(key, "label_class", "modcod")
