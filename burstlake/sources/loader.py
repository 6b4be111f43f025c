"""Consuming a stored dataset: create it once, split it, and iterate over padded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import rng
from ..kernels.assemble import DatasetConfig
from ..operators import pipeline
from ..operators.labels import split
from . import dataset, generator


def split_counts(df: DataFrame, key: str, counts: dict[str, int], seed: int = 0, bins: int = 4096) -> DataFrame:
    """Adds ``part`` with exactly these numbers of rows, chosen by a hash of the key; further rows are left out.

    Rows are ranked within hash bins (equally large whatever the keys), and a bin starts where the counts
    of the bins before it end, so the data is never ordered in one task.  Repeated keys are ranked apart.
    """
    d = df.withColumn("_u", rng.uniform(seed, "count", key)).withColumn("_bin", F.floor(F.col("_u") * bins).cast("int"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    d = d.join(F.broadcast(starts), "_bin").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy("_u", key)) - 1)
    out, edge = None, 0
    for name, n in counts.items():
        edge += n
        out = F.when(F.col("_at") < edge, name) if out is None else out.when(F.col("_at") < edge, name)
    return d.where(F.col("_at") < edge).withColumn("part", out).drop("_u", "_bin", "_before", "_at")


def batches(df: DataFrame, size: int, drop_last: bool = False) -> Iterator[dict]:
    """Batches of rows as a dict of columns, one partition in memory at a time.

    Signals of one length come as a complex array [row, sample]; ragged numeric lists are padded with 0 to
    the longest of the batch; other columns stay lists.
    """
    rows: list = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        if len(rows) == size:
            yield _collated(rows)
            rows = []
    if rows and not drop_last:
        yield _collated(rows)


def _collated(rows: list) -> dict:
    out = {}
    for c in rows[0].asDict():
        v = [r[c] for r in rows]
        if all(isinstance(x, list) and all(isinstance(y, (int, float)) for y in x) for x in v):
            longest = max(map(len, v))
            out[c] = np.array([x + [0] * (longest - len(x)) for x in v])
        else:
            out[c] = v
    if isinstance(out.get("i"), np.ndarray) and isinstance(out.get("q"), np.ndarray):
        out["data"] = (out.pop("i") + 1j * out.pop("q")).astype(np.complex64)
    return out


class DataModule:
    """A dataset that is written if it is not there, split by fractions (summing to 1) or counts, and served in batches.

    Only the training part is shuffled: by a hash of the sample and the epoch.
    """

    def __init__(self, spark: SparkSession, root: str, config: DatasetConfig, splits=(0.7, 0.2, 0.1), batch_size: int = 1, overwrite: bool = False, transforms=(), compression: str = "lzf"):
        if len(splits) != 3:
            raise ValueError("three splits: train, val, test")
        whole = all(isinstance(s, int) and not isinstance(s, bool) for s in splits)
        if whole and sum(splits) > config.dataset_length or not whole and abs(sum(splits) - 1) > 1e-9:
            raise ValueError("fractions must sum to 1, counts to at most the length")
        self.spark, self.root, self.config, self.splits, self.whole = spark, root, config, splits, whole
        self.batch_size, self.overwrite, self.transforms, self.compression = batch_size, overwrite, transforms, compression

    def prepare(self) -> bool:
        return dataset.write_dataset(generator.generate(self.spark, self.config), self.root, self.config, self.overwrite, self.compression)

    def part(self, name: str) -> DataFrame:
        df = dataset.read_dataset(self.spark, self.root)
        named = dict(zip(("train", "val", "test"), self.splits))
        df = (split_counts if self.whole else split)(df, "sample_id", named, self.config.seed).where(F.col("part") == name).drop("part")
        df = pipeline.apply(df, *self.transforms, seed=self.config.seed) if self.transforms else df
        return generator.select_targets(df, list(self.config.target_labels) if self.config.target_labels is not None else None, self.config.num_signals_max == 1)

    def train(self, epoch: int = 0) -> Iterator[dict]:
        return batches(self.part("train").orderBy(F.xxhash64(F.lit(self.config.seed), F.lit(epoch), "sample_id")), self.batch_size)

    def val(self) -> Iterator[dict]:
        return batches(self.part("val").orderBy("sample_id"), self.batch_size)

    def test(self) -> Iterator[dict]:
        return batches(self.part("test").orderBy("sample_id"), self.batch_size)
