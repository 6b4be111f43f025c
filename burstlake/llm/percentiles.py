"""Percentiles of very large numeric columns with mergeable sketches (problem 4).

Method: relative-rank compactors.  A sketch is a stack of levels; an item of level h stands for 2^h
values.  A full level sorts its buffer, leaves the protected (upper) tail alone and promotes every other
item of the rest, so the rank error shrinks in proportion to the distance from the protected tail:
multiplicative at extreme percentiles.  Sketches of partitions or days are merged level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut

SECTION = 64
MIN_SECTION = 8
#: Groups that a task holds at once before it passes its partial sketches on.
MOST_HELD = 20_000
HEAD = np.dtype([("section", "<f8"), ("sections", "<i4"), ("state", "<i8"), ("n", "<i4")])


class Level:
    """One relative-rank compactor."""

    __slots__ = ("items", "section", "sections", "state")

    def __init__(self, section: float = SECTION, sections: int = 3, state: int = 0, items: np.ndarray | None = None):
        self.items = np.zeros(0) if items is None else items
        self.section, self.sections, self.state = section, sections, state

    def capacity(self) -> int:
        return 2 * self.sections * self._width()

    def _width(self) -> int:
        return max(MIN_SECTION, 2 * round(self.section / 2))

    def compact(self, coin: int) -> np.ndarray:
        """Promotes half of the unprotected items; the schedule protects more sections the less often they were due."""
        due = min((~self.state & (self.state + 1)).bit_length(), self.sections)  # trailing ones + 1
        protected = self.sections * self._width() + (self.sections - due) * self._width()
        items = np.sort(self.items)
        cut = len(items) - protected
        cut -= cut % 2
        out = items[coin:cut:2]
        self.items = items[cut:]
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.section / math.sqrt(2) >= MIN_SECTION:
            self.sections *= 2
            self.section /= math.sqrt(2)
        return out


class Sketch:
    """Mergeable percentile sketch; the upper tail is protected.

    With sections of 64 items the rank error at the median is about half a percent of the rows above it
    at most, and smaller in proportion towards the top.
    """

    def __init__(self, section: int = SECTION):
        self.n, self.section = 0, section
        self.levels: list[Level] = [Level(section)]
        self.lo, self.hi = math.inf, -math.inf

    def add(self, values: np.ndarray) -> Sketch:
        """Adds finite values in pieces, so that a buffer stays within its capacity plus one piece."""
        if len(values):
            self.n += len(values)
            self.lo, self.hi = min(self.lo, float(values.min())), max(self.hi, float(values.max()))
            for a in range(0, len(values), 65_536):
                self.levels[0].items = np.concatenate([self.levels[0].items, values[a : a + 65_536]])
                self._settle()
        return self

    def merge(self, other: Sketch) -> Sketch:
        self.n += other.n
        self.lo, self.hi = min(self.lo, other.lo), max(self.hi, other.hi)
        while len(self.levels) < len(other.levels):
            self.levels.append(Level(self.section))
        for a, b in zip(self.levels, other.levels):
            a.state |= b.state
            if b.sections > a.sections:
                a.section, a.sections = b.section, b.sections
            a.items = np.concatenate([a.items, b.items])
        self._settle()
        return self

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            lev = self.levels[h]
            while len(lev.items) >= lev.capacity():
                before = len(lev.items)
                up = lev.compact((self.n * 0x9E3779B1 + h * 0x85EBCA6B + lev.state * 0xC2B2AE35 >> 16) & 1)
                if len(lev.items) == before:
                    break
                if h + 1 == len(self.levels):
                    self.levels.append(Level(self.section))
                self.levels[h + 1].items = np.concatenate([self.levels[h + 1].items, up])
            h += 1

    def percentile(self, p: float, lower: bool = False) -> float | None:
        """The smallest kept value whose estimated rank reaches p per cent of the values; exact ends, None when empty.

        lower: the sketch holds the negatives of the values, so that it is their lower tail that is protected.
        """
        if not self.n:
            return None
        v = np.concatenate([x.items for x in self.levels])
        w = np.concatenate([np.full(len(x.items), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        by = np.argsort(v, kind="stable")
        rank = np.cumsum(w[by])
        need = max(1, math.ceil(p / 100 * self.n))
        if lower:
            need = self.n - min(need, self.n) + 1
        x = self.hi if need >= self.n else float(v[by][min(int(np.searchsorted(rank, need)), len(v) - 1)])
        return -x if lower else x

    def to_bytes(self) -> bytes:
        head = np.array([(x.section, x.sections, x.state, len(x.items)) for x in self.levels], HEAD)
        return np.array([self.n, len(self.levels), self.section], "<i8").tobytes() + np.array([self.lo, self.hi]).tobytes() + head.tobytes() + np.concatenate([x.items for x in self.levels]).astype("<f8").tobytes()

    @staticmethod
    def from_bytes(b: bytes) -> Sketch:
        n, levels, section = np.frombuffer(b, "<i8", 3).tolist()
        out = Sketch(section)
        out.n = n
        out.lo, out.hi = np.frombuffer(b, "<f8", 2, 24).tolist()
        head = np.frombuffer(b, HEAD, levels, 40)
        items = np.frombuffer(b, "<f8", offset=40 + HEAD.itemsize * levels)
        out.levels, at = [], 0
        for h in head:
            out.levels.append(Level(float(h["section"]), int(h["sections"]), int(h["state"]), items[at : at + int(h["n"])]))
            at += int(h["n"])
        return out


def merged(parts: Iterable[bytes]) -> Sketch:
    """One sketch of several, merged as a balanced tree in a fixed order."""
    todo = [Sketch.from_bytes(b) for b in sorted(parts)]
    if not todo:
        return Sketch()
    while len(todo) > 1:
        todo = [a.merge(b) for a, b in zip(todo[::2], todo[1::2])] + todo[len(todo) & ~1 :]
    return todo[0]


def sketch(df: DataFrame, keys: list[str], value: str, section: int = SECTION) -> DataFrame:
    """(keys..., n, sketch): one mergeable sketch of the finite values of every group.

    Every partition sketches its own rows first (pre-aggregation: what is shuffled is bounded by groups
    x partitions x sketch size, so a group with a third of all rows is never gathered); partials of 64
    partitions meet first.  Null, NaN and infinite values are left out, null keys form a group, a group without a
    finite value has no row, repeated rows count each time, an empty table gives no row.
    """
    cols = [f"_k{i}" for i in range(len(keys))]
    src = df.select(*[F.col(k).cast("string").alias(c) for k, c in zip(keys, cols)], F.col(value).cast("double").alias("_v"))
    src = src.where("_v is not null and not isnan(_v) and abs(_v) < double('Infinity')")
    shape = ", ".join(f"{c} string" for c in cols) + ", _part int, _s binary"

    def local(batches):
        held: dict[tuple, Sketch] = {}
        waiting, rows = [], 0

        def absorb():
            t = pa.Table.from_batches(waiting)
            k = t.select(cols).to_pandas()
            v = t.column("_v").to_numpy()
            code = np.zeros(len(v), np.int64)
            for c in cols:
                own, _ = pd.factorize(k[c], use_na_sentinel=False)
                code = pd.factorize(code * (int(own.max()) + 1) + own)[0]
            by = np.argsort(code, kind="stable")
            edge = np.flatnonzero(np.diff(code[by], prepend=-1, append=-1))
            names = k.iloc[by[edge[:-1]]].where(lambda x: x.notna(), None).to_records(index=False).tolist()
            for key, a, b in zip(names, edge[:-1], edge[1:]):
                held.setdefault(tuple(key), Sketch(section)).add(v[by[a:b]])

        def flush():
            part, done = TaskContext.get().partitionId() // 64, list(held.items())
            held.clear()
            for a in range(0, len(done), 2_000):
                piece = done[a : a + 2_000]
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in piece], pa.string()) for i in range(len(cols))), pa.array([part] * len(piece), pa.int32()), pa.array([s.to_bytes() for _, s in piece], pa.binary())], names=[*cols, "_part", "_s"])

        for b in batches:
            if b.num_rows:
                waiting.append(b)
                rows += b.num_rows
            if rows >= 200_000:
                absorb()
                waiting, rows = [], 0
                if len(held) > MOST_HELD:
                    yield from flush()
        if rows:
            absorb()
        yield from flush()

    parts = src.mapInArrow(local, shape)
    step = merge_sketches(parts, [*cols, "_part"], "_s").drop("n")
    whole = merge_sketches(step, cols, "_s")
    return whole.select(*[F.col(c).cast(df.schema[k].dataType).alias(k) for k, c in zip(keys, cols)], "n", F.col("_s").alias("sketch"))


def merge_sketches(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys..., n, column): sketches of partitions, days or other parts, combined per key.

    The sketches of a key meet in one partition, sorted, and are merged as they come in one Arrow pass; 64 are held at most.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "n", column]
    laid = df.select(*keys, column).repartition(*keys).sortWithinPartitions(*keys, column)
    types = [f.type for f in to_arrow_schema(df.select(*keys).schema)]

    def run(batches):
        key, parts, done = None, [], []

        def emit():
            cols = [pa.array([k[j] for k, _ in done], t) for j, t in enumerate(types)]
            b = pa.RecordBatch.from_arrays([*cols, pa.array([s.n for _, s in done], pa.int64()), pa.array([s.to_bytes() for _, s in done], pa.binary())], names=names)
            done.clear()
            return b

        for b in batches:
            for *k, s in zip(*(c.to_pylist() for c in b.columns)):
                if parts and not all(x == y or (x != x and y != y) for x, y in zip(k, key)):
                    done.append((key, merged(parts)))
                    parts = []
                    if len(done) >= 1_000:
                        yield emit()
                key = k
                parts.append(s)
                if len(parts) >= 64:
                    parts = [merged(parts).to_bytes()]
        if parts:
            done.append((key, merged(parts)))
        if done:
            yield emit()

    return laid.mapInArrow(run, f"{kinds}, n bigint, {column} binary")


def percentiles(sketches: DataFrame, pcts: list[float], column: str = "sketch", lower: bool = False) -> DataFrame:
    """One row per sketch and percentile: pct (double) and value are added, the sketch is dropped; lower as in Sketch.percentile()."""
    keys = [c for c in sketches.columns if c != column]
    at = sketches.columns.index(column)
    shape = ", ".join(f"`{c}` {sketches.schema[c].dataType.simpleString()}" for c in keys) + ", pct double, value double"

    def read(batches):
        for b in batches:
            s = [Sketch.from_bytes(x) for x in b.column(at).to_pylist()]
            pick = pa.array(np.repeat(np.arange(b.num_rows), len(pcts)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.names.index(c)).take(pick) for c in keys), pa.array(np.tile(np.array(pcts, float), b.num_rows)), pa.array([x.percentile(p, lower) for x in s for p in pcts], pa.float64())],
                names=[*keys, "pct", "value"],
            )

    return sketches.mapInArrow(read, shape)


def signal_values(signals: DataFrame) -> DataFrame:
    """(label_class, capture_day, field_name, value) with every signal once: of repeated writes the earliest.

    Ties of written_at fall to the smallest values, so the choice does not depend on the order of rows.
    """
    one = signals.select(
        "signal_id",
        F.struct("written_at", F.lower(F.trim("label")).alias("label_class"), F.date_format("captured_at", "yyyy-MM-dd").alias("capture_day"), "bandwidth", "center_freq").alias("s"),
    )
    one = one.groupBy("signal_id").agg(F.min("s").alias("s"))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"s.{f}").alias("value")) for f in ("bandwidth", "center_freq")]))
    return one.select("s.label_class", "s.capture_day", fields.alias("f")).select("label_class", "capture_day", "f.field_name", "f.value")


def signal_sketches(signals: DataFrame) -> DataFrame:
    """Sketches per label class, capture day and field; merge_sketches combines days."""
    return sketch(signal_values(signals), ["label_class", "capture_day", "field_name"], "value")


def two_tailed(values: DataFrame, keys: list[str], combine: list[str], pcts: list[float], value: str = "value") -> DataFrame:
    """percentiles() per keys, and per ``combine`` with the other keys null, each from the sketch that protects its own tail.

    Percentiles below 50 come from sketches of the negated values; both sketches are made in one pass.
    """
    tails = F.explode(F.array(*[F.struct(F.lit(t).alias("_tail"), (F.col(value) * s).alias("_x")) for t, s in (("upper", 1), ("lower", -1))]))
    parts = cut(sketch(values.select(*keys, tails.alias("_t")).select(*keys, "_t.*"), [*keys, "_tail"], "_x"))
    whole = merge_sketches(parts, [*combine, "_tail"], "sketch").withColumns({k: F.lit(None).cast(values.schema[k].dataType) for k in keys if k not in combine})
    both = parts.unionByName(whole)
    read = lambda t, p: percentiles(both.where(F.col("_tail") == t).drop("_tail"), p, lower=t == "lower")
    return read("upper", [p for p in pcts if p >= 50]).unionByName(read("lower", [p for p in pcts if p < 50]))


def drifted(signals: DataFrame, reference: DataFrame, least: int = 40, tolerance: float = 0.25) -> DataFrame:
    """Percentiles 50 and 95 that differ from the reference by more than tolerance x ref_spread."""
    got = percentiles(signal_sketches(signals).where(F.col("n") >= least), [50.0, 95.0])
    ref = reference.select(F.lower(F.trim("label_class")).alias("label_class"), "field_name", "ref_p50", "ref_p95", "ref_spread")
    off = F.abs(F.col("value") - F.when(F.col("pct") == 50, F.col("ref_p50")).otherwise(F.col("ref_p95")))
    return got.join(ref, ["label_class", "field_name"]).where(off > tolerance * F.col("ref_spread")).select("label_class", "capture_day", "field_name", F.col("pct").cast("bigint").alias("pct"))
