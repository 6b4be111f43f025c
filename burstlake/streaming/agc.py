"""Gain control across the chunks of a stream: level and gain of each signal are kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels.channel import agc

OUT = "signal_id bigint, chunk bigint, i array<float>, q array<float>"


def agc_stream(chunks: DataFrame, initial_gain_db: float = 0.0, timeout_ms: int | None = None, **params) -> DataFrame:
    """chunks: a stream of (signal_id, chunk, i, q) -> the same, gain controlled as if each signal were one array.

    Chunks of a signal within a micro-batch are taken in order; a chunk that comes in a later batch than
    its successors continues from the state as it is then.  Null or empty chunks pass.  With ``timeout_ms``
    the state of a signal is dropped after that time without a chunk; processing-time timeouts keep a
    query running, so such a query does not end under an available-now trigger.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        first = held is None
        level, gain = held or (0.0, float(initial_gain_db))
        for row in pd.concat(list(frames)).sort_values("chunk", kind="stable").itertuples():
            if row.i is None or row.q is None or not len(row.i):
                yield pd.DataFrame([{"signal_id": row.signal_id, "chunk": row.chunk, "i": row.i, "q": row.q}])
                continue
            x = np.asarray(row.i, float) + 1j * np.asarray(row.q, float)
            if first:
                # the first sample of a signal is not smoothed
                head = agc(x[:1], gain, **params)
                mag = abs(x[0])
                level, gain = (float(np.log(mag)) if mag > 0 else -200.0), float(np.log(abs(head[0]) / mag)) if mag > 0 else gain_after_zero(gain, params)
                rest, (level, gain) = agc(x[1:], state=(level, gain), **params)
                y, first = np.concatenate([head, rest]), False
            else:
                y, (level, gain) = agc(x, state=(level, gain), **params)
            yield pd.DataFrame([{"signal_id": row.signal_id, "chunk": row.chunk, "i": y.real.astype(np.float32), "q": y.imag.astype(np.float32)}])
        if not first:
            state.update((float(level), float(gain)))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    return chunks.select("signal_id", "chunk", "i", "q").groupBy("signal_id").applyInPandasWithState(run, OUT, "level double, gain double", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def gain_after_zero(gain: float, params: dict) -> float:
    """The gain after a first sample of zero, whose level is -200."""
    from ..kernels.channel import AGC, agc_step

    return agc_step(0.0, gain, None, True, AGC | params)[1]
