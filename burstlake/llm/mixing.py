"""Mixing sources to target weights (problem 7).

Method: cube-method balanced sampling.  Every document of a source starts with the same fractional
inclusion probability; the flight phase moves three probabilities at a time along the null-space of the
constraints (documents, tokens) until one of them is 0 or 1, so both totals stay what they should be.
Blocks of documents fly in parallel, the one or two documents that each block leaves open fly again
in fewer blocks until they fit into one, and the last two of a source land on the document constraint alone.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the pre-split pattern of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict = {}


def encoder(path: str):
    """The byte-level tokenizer of a .tiktoken rank file; read once per worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


_LONE = re.compile("[\ud800-\udfff]")


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """Replaces the text by its number of tokens (0 for null and empty texts); whole texts, map-only."""
    path = vocabulary or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    at = df.columns.index(text)
    keep = [c for c in df.columns if c not in (text, out)]
    shape = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` bigint"])

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(_LONE.sub("?", t))) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in keep), pa.array(n, pa.int64())], names=[*keep, out])

    return df.mapInArrow(run, shape)


def fly(pi: np.ndarray, x: np.ndarray, draw, land: bool = False) -> np.ndarray:
    """Flight phase for the constraints sum(pi) and sum(pi * x); at most two entries stay fractional.

    With ``land`` the rest lands: first on sum(pi) alone, then by a plain draw.
    """
    p = pi.astype(float).tolist()
    x = x.astype(float).tolist()
    eps = 1e-9
    active: list[int] = []
    left = 2 if not land else 1
    queue = iter(range(len(p)))

    def fill(size: int) -> None:
        while len(active) < size:
            k = next(queue, None)
            if k is None:
                return
            if eps < p[k] < 1 - eps:
                active.append(k)

    while True:
        fill(3)
        if len(active) >= 3:
            a, b, c = active[:3]
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            ids = (a, b, c)
        elif len(active) == 2 and left < 2:
            ids, u = (active[0], active[1]), (1.0, -1.0)
        else:
            break
        up = down = float("inf")
        for k, d in zip(ids, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        step = up if draw() * (up + down) < down else -down
        for k, d in zip(ids, u):
            p[k] += step * d
            if p[k] < eps:
                p[k] = 0.0
            elif p[k] > 1 - eps:
                p[k] = 1.0
        active[:] = [k for k in active if 0.0 < p[k] < 1.0]
    if land:
        for k in active:
            p[k] = 1.0 if draw() < p[k] else 0.0
    return np.array(p)


def _flight(df: DataFrame, keys: list[str], seed: int, land: bool) -> DataFrame:
    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_id"], kind="stable")
        rng = np.random.Generator(np.random.Philox(key=[seed, int(pdf["_h"].iloc[0]) & 0x7FFFFFFFFFFFFFFF]))
        pdf["_pi"] = fly(pdf["_pi"].to_numpy(), pdf["tokens"].to_numpy(), rng.random, land)
        return pdf

    return df.groupBy(*keys).applyInPandas(run, shape)


def plan(tokens: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """One row per target source: what is there, what is wanted, how often each document is to be used.

    The budget is the tokens of all documents of the target sources, each once, unless given.
    """
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_docs"))
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_weight", "max_repeats").join(have, "source", "left")
    t = t.fillna(0, ["available_tokens", "available_docs"])
    total = F.lit(budget).cast("double") if budget is not None else F.col("_all").cast("double")
    t = t.join(F.broadcast(t.agg(F.sum("available_tokens").alias("_all"))))
    t = t.withColumn("target_tokens", F.col("target_weight") * total).drop("_all")
    most = F.col("max_repeats") * F.col("available_tokens")
    rate = F.when(most < F.col("target_tokens"), F.col("max_repeats").cast("double")).when(F.col("available_tokens") > 0, F.least(F.col("target_tokens") / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return t.withColumn("repeat_rate", rate)


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, key: str = "doc_id", text: str = "text", seed: int = 7, block: int = 20_000, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, report): how often each document is used, and the actual share of each source.

    copies: (key, source, tokens, copies), one row per row of a target source with at least one token.
    report: plan() with used_tokens, used_docs, actual_share.  Sources are compared trimmed and in lower
    case; other or null sources, null and empty texts are not used; repeated keys are separate records;
    a target source without documents is reported as short unless its target is 0.

    A source is split into blocks of about ``block`` documents by a hash of the key, so a source with a
    third of all rows is flown by as many tasks as it needs; what the blocks leave open, two documents each,
    flies again in blocks until one holds all that a source has left.  A source is short (is_short) when
    every one of its documents came out with max_repeats copies and they still hold fewer tokens than its target.
    """
    wanted = targets.select(F.lower(F.trim("source")).alias("source")).where("source is not null").distinct()
    named = docs.select(F.col(key).alias("_id"), F.lower(F.trim("source")).alias("source"), F.col(text).alias("_text"))
    # the targets are broadcast only while they are few
    sized = F.broadcast if _small(wanted) else lambda x: x
    named = named.join(sized(wanted), "source", "left_semi")
    tokens = cut(count_tokens(named, "_text", "tokens", vocabulary).where("tokens > 0"))
    p = cut(plan(tokens, targets, budget))
    t = tokens.join(sized(p.select("source", "repeat_rate", "available_docs")), "source")
    t = t.withColumn("_base", F.floor("repeat_rate").cast("int")).withColumn("_pi", F.col("repeat_rate") - F.floor("repeat_rate"))
    t = t.withColumn("_h", F.xxhash64(F.lit(seed), "_id")).withColumn("_block", F.pmod(F.shiftright("_h", 7), F.ceil(F.col("available_docs") / block)))
    open_ = (F.col("_pi") > 1e-9) & (F.col("_pi") < 1 - 1e-9)
    whole, rest, level = t.where(~open_).drop("repeat_rate", "available_docs"), t.where(open_).drop("repeat_rate", "available_docs"), 0
    while True:
        flown = cut(_flight(rest, ["source", "_block"], seed + 2 * level, False))
        whole, rest, level = whole.unionByName(flown.where(~open_)), flown.where(open_), level + 1
        left = rest.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if left <= block:
            break
        rest = rest.withColumn("_block", F.pmod(F.xxhash64(F.lit(level), "_h"), F.lit(-(-left // block))))
    whole = whole.unionByName(_flight(rest, ["source"], seed + 1, True))
    copies = cut(whole.select(F.col("_id").alias(key), "source", "tokens", (F.col("_base") + F.round("_pi").cast("int")).alias("copies")))
    used = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("used_docs"))
    report = p.join(used, "source", "left").fillna(0, ["used_tokens", "used_docs"])
    full = F.col("used_docs") == F.col("max_repeats") * F.col("available_docs")
    report = report.withColumn("is_short", full & (F.col("used_tokens") < F.col("target_tokens")))
    report = report.join(F.broadcast(used.agg(F.sum("used_tokens").alias("_all"))))
    return copies, report.withColumn("actual_share", F.when(F.col("_all") > 0, F.col("used_tokens") / F.col("_all")).otherwise(0.0)).drop("_all")


def _small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most
