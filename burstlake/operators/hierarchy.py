"""Parent-child links to full hierarchies (problem 5).

Method: leaves are peeled until only roots and loops are left (2^k layers with k joins: what survives r
rounds of peeling is the image of r steps up); then the loops are cut, an Euler tour of the forest is
laid out as a linked list, and parallel list ranking (contraction, pointer jumping, expansion) gives each
node its entry and exit.  Entry-exit intervals give depth, ancestors, paths and descendants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, functions as F

from ..session import cut, drop, table, table_with_any
from .skew import salted_join

TREE, DANGLING, CYCLE, BELOW = "tree", "dangling", "cycle", "below_cycle"
#: Rows that one task finishes when a graph or list has shrunk to them: a few arrays of 8 MB.
BASE = 1 << 20


def links(df: DataFrame, node: str = "metadata_id", parent: str = "parent_metadata_id") -> DataFrame:
    """(id, parent): one row per distinct node; parents are trimmed, empty means none.

    Null nodes are left out.  If the rows of a node disagree, the smallest parent that is present counts.
    """
    p = F.btrim(F.col(parent).cast("string"), F.lit(" \t\r\n"))
    return df.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("string").alias("id")).agg(F.min(F.when(p != "", p)).alias("parent"))


def _numbered(ids: DataFrame, n: int) -> DataFrame:
    """(v, id, parent): v is a number in the order of the ids; range partitions number themselves."""
    return table(ids.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("v", F.monotonically_increasing_id()))


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """table(df) and its rows, counted while it is written."""
    seen = Observation()
    out = table(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def _counted_open(df: DataFrame) -> tuple[DataFrame, int]:
    """table(df) and how many of its elements have a neighbour."""
    seen = Observation()
    out = table(df.observe(seen, F.count(F.when(F.expr(OPEN), 1)).alias("n")))
    return out, seen.get["n"]


def _alone(df: DataFrame, function, schema: str) -> DataFrame:
    """A step on at most BASE rows in one task: function takes the columns as arrays (null is -1) and returns columns."""

    def run(batches):
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        got = function(*(c.combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for c in t.columns))
        for a in range(0, len(got[0]), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 65_536]) for x in got], names=[f.split()[0] for f in schema.split(", ")])

    return df.repartition(1).mapInArrow(run, schema)


def loops_of(v: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes on loops, smallest node of the loop) of the links v -> f; links that lead to no v end there."""
    by = np.argsort(v, kind="stable")
    v, f, n = v[by], f[by], len(v)
    at = np.minimum(np.searchsorted(v, f), n - 1)
    one = np.append(np.where(v[at] == f, at, n), n)
    far, rounds = one, max(1, n).bit_length()
    for _ in range(rounds):
        far = far[far]
    on = np.unique(far)
    on = on[on < n]
    label, step = np.arange(n + 1), one.copy()
    for _ in range(rounds):
        label, step = np.minimum(label, label[step]), step[step]
    return v[on], v[label[on]]


def _loops(up: DataFrame, base: int) -> DataFrame:
    """(v, label): the nodes on loops, each with the smallest node of its loop.  up: (v, f), every node with a parent in the table.

    Each round drops the nodes that nobody points at and those whose way up has ended, and doubles the
    steps; both ends of every tree shrink until only loops, or at most ``base`` nodes, are left.
    """
    t, n = _counted(up)
    first, rounds = t, 0
    while n > base:
        alive = t.select(F.col("f").alias("v")).distinct()
        kept = t.join(alive, "v", "left_semi")
        up2 = t.select(F.col("v").alias("f"), F.col("f").alias("g"))
        # a node left after k rounds has 2^k layers below it, so a target can be hot only in the first rounds
        both = salted_join(kept, up2, ["f"], spread="v") if rounds < 6 else kept.join(up2, "f")
        (t2, m), rounds = _counted(both.select("v", F.col("g").alias("f"))), rounds + 1
        if t is not first:
            drop(t)
        t, stuck, n = t2, m == n, m
        if stuck:
            return _loop_labels(first.join(t.select("v"), "v", "left_semi"))
    found = _alone(t, loops_of, "v bigint, label bigint")
    if not rounds:
        return found
    # the links left have steps of 2^rounds: the loops are right, their labels need the single steps
    return _alone(first.join(F.broadcast(found.select("v")), "v", "left_semi"), loops_of, "v bigint, label bigint")


def _loop_labels(loops: DataFrame) -> DataFrame:
    """(v, label): the smallest node of the loop of v.  loops: (v, f), closed under f."""
    t = table(loops.withColumn("m", F.least("v", "f")))
    while True:
        b = t.select(F.col("v").alias("f"), F.col("f").alias("g"), F.col("m").alias("m2"))
        t2, moved = table_with_any(t.join(b, "f").select("v", F.col("g").alias("f"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("moved")), F.col("moved"))
        drop(t)
        if not moved:
            return t2.select("v", F.col("m").alias("label"))
        t = t2


def _siblings(edges: DataFrame, n: int) -> DataFrame:
    """(p, c, nxt, head): children of each parent in order, each with the next one; head marks the first.

    The edges are range-sorted by (parent, child) and the first edge of each partition (one row a
    partition) is known to the one before, so a parent with any share of the nodes needs no window.
    """
    ordered = cut(edges.repartitionByRange(n, "p", "c").sortWithinPartitions("p", "c"))

    def ends(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                p, c = b.column(0), b.column(1)
                first = (p[0].as_py(), c[0].as_py()) if first is None else first
                last = p[-1].as_py()
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), *first, last)], names=["part", "p", "c", "last"])

    seen = sorted(ordered.mapInArrow(ends, "part bigint, p bigint, c bigint, last bigint").collect(), key=lambda r: r["part"])
    after = {a["part"]: (b["p"], b["c"]) for a, b in zip(seen, seen[1:])}
    before = {b["part"]: a["last"] for a, b in zip(seen, seen[1:])}

    def link(batches):
        part = TaskContext.get().partitionId()
        prev, held = before.get(part), None

        def out(b, nxt_p, nxt_c):
            nonlocal prev
            p, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            np_, nc = np.append(p[1:], nxt_p), np.append(c[1:], nxt_c)
            head = np.concatenate([[prev is None or p[0] != prev], p[1:] != p[:-1]])
            prev = p[-1]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nc, pa.int64(), mask=np_ != p), pa.array(head)], names=["p", "c", "nxt", "head"])

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield out(held, b.column(0)[0].as_py(), b.column(1)[0].as_py())
            held = b
        if held is not None:
            yield out(held, *after.get(part, (-1, -1)))

    return ordered.mapInArrow(link, "p bigint, c bigint, nxt bigint, head boolean")


def rank_alone(e: np.ndarray, nxt: np.ndarray, steps: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(e, steps, weight, head): list ranking by pointer jumping; nxt is -1 at the end of a list.

    steps and weight are summed from e to the end of its list, both inclusive; head is the first element of the list.
    """
    by = np.argsort(e, kind="stable")
    e, nxt, n = e[by], nxt[by], len(e)
    to = np.where(nxt < 0, n, np.searchsorted(e, nxt))
    s, w = np.append(steps[by], 0), np.append(weight[by], 0)
    head = np.arange(n + 1)
    head[to] = np.arange(n)
    head, jump = head[:n], np.append(to, n)
    while (jump < n).any():
        s, w, jump, head = s + s[jump], w + w[jump], jump[jump], head[head]
    return e, s[:n], w[:n], e[head]


OPEN = "nxt is not null or prv is not null"
RANKED = "e bigint, steps bigint, weight bigint, head bigint"


def _rank(succ: DataFrame, base: int) -> DataFrame:
    """(e, steps, weight, head): list ranking as in rank_alone().  succ: (e, nxt, steps, weight).

    While there are more than ``base`` elements the lists are contracted: coins, a hash of element and round, choose
    elements that no neighbour is chosen beside, about a quarter; their predecessors take them over, and a list of
    which only the head is left is done.  What remains is ranked by pointer jumping and the
    elements taken over are put back, round by round.  All rounds together shuffle about four times the list, where
    jumping alone would shuffle all of it in each of log2 rounds.  Every key is unique, so none is hot.
    """
    t, n = _counted(succ)
    rounds: list[DataFrame] = []
    if n > base:
        back = t.where("nxt is not null").select(F.col("nxt").alias("e"), F.col("e").alias("prv"))
        none = lambda *names: [F.lit(None).cast("bigint").alias(c) for c in names]
        t2, n = _counted_open(t.join(back, "e", "left").select("e", "nxt", "prv", "steps", "weight", *none("x", "s", "w")))
        drop(t)
        rounds.append(t2)
        while n > base:
            t = t2.where(OPEN)
            coin = lambda c, k=len(rounds): F.xxhash64(F.lit(k), c).bitwiseAND(F.lit(1)) == 1
            goes = F.coalesce(coin("e") & F.col("prv").isNotNull() & ~coin("prv"), F.lit(False))
            own = t.where(~goes).select("e", "nxt", "prv", "steps", "weight", *none("x", "x_nxt", "x_steps", "x_weight", "y"))
            out = t.where(goes)
            to_prv = out.select(F.col("prv").alias("e"), *none("nxt", "prv", "steps", "weight"), F.col("e").alias("x"), F.col("nxt").alias("x_nxt"), F.col("steps").alias("x_steps"), F.col("weight").alias("x_weight"), *none("y"))
            to_nxt = out.where("nxt is not null").select(F.col("nxt").alias("e"), *none("nxt", "prv", "steps", "weight", "x", "x_nxt", "x_steps", "x_weight"), F.col("prv").alias("y"))
            rows = own.unionByName(to_prv).unionByName(to_nxt)
            rows = rows.groupBy("e").agg(*[F.max(c).alias(c) for c in rows.columns[1:]])
            more = lambda c: (F.col(c) + F.coalesce(f"x_{c}", F.lit(0))).alias(c)
            nxt = F.when(F.col("x").isNotNull(), F.col("x_nxt")).otherwise(F.col("nxt"))
            t2, n = _counted_open(rows.select("e", nxt.alias("nxt"), F.coalesce("y", "prv").alias("prv"), more("steps"), more("weight"), "x", F.col("steps").alias("s"), F.col("weight").alias("w")))
            rounds.append(t2)
        t = t2.where(OPEN)
    ranked = _alone(t.select("e", "nxt", "steps", "weight"), rank_alone, RANKED)
    for t2 in reversed(rounds):
        ranked = ranked.unionByName(t2.where(f"not ({OPEN})").select("e", "steps", "weight", F.col("e").alias("head")))
        if t2 is not rounds[0]:
            ranked = table(ranked)
            mine = t2.where("x is not null").select("e", "x", "s", "w")
            ranked = ranked.unionByName(mine.join(ranked, "e").select(F.col("x").alias("e"), (F.col("steps") - F.col("s")).alias("steps"), (F.col("weight") - F.col("w")).alias("weight"), "head"))
    return ranked


def hierarchy(df: DataFrame, node: str = "metadata_id", parent: str = "parent_metadata_id", base: int = BASE) -> DataFrame:
    """One row per distinct node: (node, root_id, depth, state, entry, exit, n_descendants).

    state: tree, dangling (the way up ends at a parent that is not in the table), cycle, below_cycle.
    root_id is the last node of the way up, for the last two states the smallest id of the loop; depth
    counts the steps to the root or to the loop.  The descendants of a node are the nodes of the same
    root whose entry lies between its entry and its exit (for a loop node: of the tree that hangs on it).
    An empty table gives no row.  ``base`` is how many rows of a shrunken list or graph one task finishes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = _numbered(links(df, node, parent), n)
    own = nodes.select(F.col("id").alias("parent"), F.col("v").alias("p"))
    up = salted_join(nodes.select("v", "parent"), own, ["parent"], spread="v", how="left")
    up = table(up.select("v", "p", (F.col("parent").isNotNull() & F.col("p").isNull()).alias("lost")))
    loops = table(_loops(up.where("p is not null").select("v", F.col("p").alias("f")), base))
    forest = up.join(loops, "v", "left")
    kind = F.when(F.col("label").isNotNull(), F.lit(2)).when(F.col("p").isNull() & F.col("lost"), F.lit(1)).when(F.col("p").isNull(), F.lit(0))
    forest = table(forest.select("v", F.when(F.col("label").isNull(), F.col("p")).alias("p"), kind.alias("kind"), F.coalesce("label", "v").alias("top")))
    kin = table(_siblings(forest.where("p is not null").select("p", F.col("v").alias("c")), n))
    # element 2v enters v, 2v + 1 leaves it; a node without children is one element of two steps
    per = forest.select("v").join(kin.where("head").select(F.col("p").alias("v"), F.col("c").alias("child")), "v", "left").join(kin.select(F.col("c").alias("v"), "p", "nxt"), "v", "left")
    after = F.coalesce(F.col("nxt") * 2, F.col("p") * 2 + 1)
    element = lambda e, nxt, steps, weight: F.struct(e.alias("e"), nxt.alias("nxt"), F.lit(steps).cast("bigint").alias("steps"), F.lit(weight).cast("bigint").alias("weight"))
    enter, leave = F.col("v") * 2, F.col("v") * 2 + 1
    pair = F.array(element(enter, F.col("child") * 2, 1, 1), element(leave, after, 1, -1))
    ranked = _rank(per.select(F.inline(F.when(F.col("child").isNull(), F.array(element(enter, after, 2, 0))).otherwise(pair))), base)
    odd = F.col("e") % 2 == 1
    per = ranked.groupBy(F.shiftright("e", 1).alias("v")).agg(
        F.max(F.when(~odd, F.col("steps"))).alias("s_in"), F.max(F.when(odd, F.col("steps"))).alias("s_out"), F.max(F.when(~odd, -F.col("weight"))).alias("depth"), F.max(F.shiftright("head", 1)).alias("tree")
    )
    per = table(per.withColumn("s_out", F.coalesce("s_out", F.col("s_in") - 1)))
    tops = forest.where("p is null").select(F.col("v").alias("tree"), "kind", "top").join(nodes.select(F.col("v").alias("top"), F.col("id").alias("root_id")), "top").drop("top")
    full = salted_join(per, tops, ["tree"], spread="v").join(nodes.select("v", "id"), "v")
    state = F.when(F.col("kind") == 0, TREE).when(F.col("kind") == 1, DANGLING).when(F.col("depth") == 0, CYCLE).otherwise(BELOW)
    return full.select(
        F.col("id").alias(node), "root_id", "depth", state.alias("state"), "tree", (-F.col("s_in")).alias("entry"), (-F.col("s_out")).alias("exit"), F.floor((F.col("s_in") - F.col("s_out")) / 2).alias("n_descendants"),
    )


def paths(tree: DataFrame, node: str = "metadata_id", sep: str = "/", held: int = 8 << 20) -> DataFrame:
    """(node, path, n_descendants): ids from the root (or the loop node) down to the node.

    The nodes are range-sorted by tree and entry; a stack of open intervals is carried along.  What is
    open where a partition begins are the ancestors of its first node: each node finds the partitions that
    begin inside it (one start a partition is known to all) and is sent there ahead of the partition's own rows.
    Only ids are held, a stack as deep as the tree; paths leave the task in pieces of about ``held`` characters.
    """
    n = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = cut(tree.select("tree", "entry", "exit", F.col(node).alias("id")).repartitionByRange(n, "tree", "entry").sortWithinPartitions("tree", "entry"))

    def first(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), b.column(0).slice(0, 1), b.column(1).slice(0, 1)], names=["part", "tree", "at"])
                return

    heads = t.mapInArrow(first, "part bigint, tree bigint, at bigint")
    # one row a partition
    begins = sorted((r["tree"], r["at"], r["part"]) for r in heads.collect())
    at_of: dict[int, tuple[np.ndarray, list[int]]] = {}
    for k in {x[0] for x in begins}:
        own = [x for x in begins if x[0] == k]
        at_of[k] = (np.array([x[1] for x in own]), [x[2] for x in own])

    def around(batches):
        """Every row for its own partition, and for those that begin inside its interval."""
        me = TaskContext.get().partitionId()
        for b in batches:
            tree_, lo, hi = (b.column(k).to_numpy() for k in range(3))
            rows, part = [np.arange(b.num_rows)], [np.full(b.num_rows, me)]
            for k in np.intersect1d(np.unique(tree_), np.fromiter(at_of, np.int64, len(at_of))).tolist():
                own, (at, parts) = np.flatnonzero(tree_ == k), at_of[k]
                x, y = np.searchsorted(at, lo[own], "right"), np.searchsorted(at, hi[own], "left")
                for i in np.flatnonzero(y > x).tolist():
                    rows.append(np.full(y[i] - x[i], own[i]))
                    part.append(np.array(parts[x[i] : y[i]]))
            rows, part = np.concatenate(rows).astype(np.int64), np.concatenate(part).astype(np.int64)
            pick = pa.array(rows)
            mine = pa.array(np.arange(len(rows)) < b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(part), mine, *(b.column(k).take(pick) for k in range(4))], names=["part", "mine", "tree", "entry", "exit", "id"])

    laid = t.mapInArrow(around, "part bigint, mine boolean, tree bigint, entry bigint, exit bigint, id string")
    laid = laid.repartition(n, "part").sortWithinPartitions("part", "mine", "tree", "entry")

    def walk(batches):
        stack, current, out, size = [], None, [[], [], []], 0

        def done():
            nonlocal size
            b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["id", "path", "n_descendants"])
            size = 0
            for x in out:
                x.clear()
            return b

        for b in batches:
            for part, mine, k, entry, exit_, id_ in zip(*(c.to_pylist() for c in b.columns)):
                if (part, k) != current:
                    stack, current = [], (part, k)
                while stack and stack[-1][0] < entry:
                    stack.pop()
                stack.append((exit_, id_))
                if mine:
                    out[0].append(id_)
                    out[1].append(sep.join([x[1] for x in stack]))
                    out[2].append((exit_ - entry) // 2)
                    size += len(out[1][-1])
                    if size >= held:
                        yield done()
        if out[0]:
            yield done()

    return laid.mapInArrow(walk, "id string, path string, n_descendants bigint").withColumnRenamed("id", node)


def descendants(tree: DataFrame, node: str = "metadata_id") -> DataFrame:
    """(node, descendant): every pair, as many rows as the depths add up to.

    Read off the paths: each node is a descendant of every id above it, so no interval join is needed.
    """
    p = paths(tree, node, "\x00").withColumn("_up", F.split("path", "\x00"))
    return p.select(F.explode(F.slice("_up", F.lit(1), F.size("_up") - 1)).alias("_a"), F.col(node).alias("descendant")).withColumnRenamed("_a", node)
