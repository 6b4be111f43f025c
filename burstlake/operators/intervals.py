"""Overlapping and gapped intervals (problem 3).

Method: a global range sort by entity and start; each partition summarises its last entity (start of the
last island, maximum end); the summaries, one row a partition, are combined as a prefix; a second pass
over the same sorted rows starts from the carried state and labels the islands.  An entity with any
share of the rows is cut into as many partitions as it fills.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut


class Open(NamedTuple):
    """An island that may still grow."""

    entity: object
    start: int
    end: int


def _islands(entity: np.ndarray, start: np.ndarray, end: np.ndarray, carry: Open | None):
    """Islands of sorted rows after a carried one, as (entity index or -1 for the carry's, from, to) arrays.

    Touching intervals continue each other.  The last island is still open.
    """
    n = len(start)
    first = np.concatenate([[True], entity[1:] != entity[:-1]])
    group = np.cumsum(first)
    order = np.argsort(end, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    top = end[order][np.maximum.accumulate(group * n + rank) - group * n]  # running maximum within the entity
    joins = carry is not None and carry.entity == entity[0]
    if joins:
        mine = group == 1
        top[mine] = np.maximum(top[mine], carry.end)
    new = first.copy()
    new[1:] |= start[1:] > top[:-1]
    if joins:
        new[0] = start[0] > carry.end
    at = np.flatnonzero(new)
    lo, who = start[at], at
    hi = top[np.append(at[1:], n) - 1] if len(at) else np.zeros(0, np.int64)
    if joins and not new[0]:
        lo = np.concatenate([[carry.start], lo])
        who = np.concatenate([[0], who])
        hi = np.concatenate([[top[(at[0] if len(at) else n) - 1]], hi])
    return who, lo, hi, joins


def periods(df: DataFrame, entity: str, start: str, duration: str, partitions: int | None = None) -> DataFrame:
    """(entity, span_kind, span_from, span_to): continuous periods and the gaps between them, per entity.

    A row occupies [start, start + duration) when both are present and the duration is above zero; other
    rows and rows with a null entity are left out, as are rows whose end does not fit 64 bits.  Touching
    intervals continue each other; repeated rows change nothing; an empty table gives no row.  Rows with
    the same entity and start are combined before the shuffle, so ties cannot fill a partition.
    """
    spark = df.sparkSession
    s, d = F.col(start).cast("bigint"), F.col(duration).cast("bigint")
    rows = df.select(F.col(entity).alias("e"), s.alias("s"), F.try_add(s, d).alias("t"), d.alias("d")).where("e is not null and s is not null and d > 0 and t is not null")
    rows = rows.groupBy("e", "s").agg(F.max("t").alias("t"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(n, "e", "s").sortWithinPartitions("e", "s"))
    kind = ordered.schema["e"].dataType.simpleString()

    def summary(batches):
        rows_, first, state = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            e, a, z = _columns(b)
            first = e[0] if first is None else first
            rows_ += len(a)
            who, lo, hi, _ = _islands(e, a, z, state)
            state = Open(e[-1], int(lo[-1]), int(hi[-1]))
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first], b.schema.field(0).type), pa.array([state.entity], b.schema.field(0).type), pa.array([state.start]), pa.array([state.end])], names=["p", "first", "e", "s", "t"])

    # one row for each partition, whatever the data
    seen = sorted(ordered.mapInArrow(summary, f"p bigint, first {kind}, e {kind}, s bigint, t bigint").collect(), key=lambda r: r["p"])
    carries, state = {}, None
    for r in seen:
        carries[r["p"]] = state
        own = Open(r["e"], r["s"], r["t"])
        if state is not None and state.entity == own.entity:
            # the whole partition is of the carried entity
            own = Open(own.entity, own.start if state.end < own.start else state.start, max(state.end, own.end))
        state = own
    last = seen[-1]["p"] if seen else -1

    def rescan(batches):
        p = TaskContext.get().partitionId()
        state = carries.get(p)
        for b in batches:
            if not b.num_rows:
                continue
            e, a, z = _columns(b)
            who, lo, hi, joined = _islands(e, a, z, state)
            own = e[who]
            if state is not None and not (joined and lo[0] == state.start):
                own = np.concatenate([np.array([state.entity], own.dtype), own])
                lo, hi = np.concatenate([[state.start], lo]), np.concatenate([[state.end], hi])
            yield from _spans(own, lo, hi, b.schema.field(0).type)
            state = Open(own[-1], int(lo[-1]), int(hi[-1]))
        if p == last and state is not None:
            yield _batch(b.schema.field(0).type, [state.entity], ["period"], [state.start], [state.end])

    spans = ordered.mapInArrow(rescan, f"e {kind}, span_kind string, span_from bigint, span_to bigint")
    return spans.withColumnRenamed("e", entity)


def _columns(b: pa.RecordBatch):
    e = b.column(0)
    e = np.array(e.to_pylist(), object) if pa.types.is_string(e.type) or pa.types.is_large_string(e.type) else e.to_numpy(zero_copy_only=False)
    return e, b.column(1).to_numpy(), b.column(2).to_numpy()


def _batch(kind, e, what, lo, hi) -> pa.RecordBatch:
    e = e.tolist() if isinstance(e, np.ndarray) and e.dtype == object else e
    return pa.RecordBatch.from_arrays([pa.array(e, kind), pa.array(what, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["e", "span_kind", "span_from", "span_to"])


def _spans(e: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind):
    """All periods but the last, which is still open, and all gaps up to it."""
    if len(lo) < 2:
        return
    yield _batch(kind, e[:-1], ["period"] * (len(lo) - 1), lo[:-1], hi[:-1])
    same = np.flatnonzero(e[1:] == e[:-1])
    yield _batch(kind, e[same], ["gap"] * len(same), hi[same], lo[same + 1])
