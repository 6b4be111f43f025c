"""Generated datasets: a DataFrame of samples, the batch source "bursts", and the same source as an endless stream."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..kernels.assemble import DatasetConfig, sample
from ..kernels.ops import impairments, steps
from ..operators import pipeline

COMPONENT = "struct<class_name:string,class_index:int,center_freq:double,bandwidth:double,snr_db:double,start_in_samples:bigint,duration_in_samples:bigint>"
SCHEMA = f"sample_id bigint, i array<float>, q array<float>, sample_rate double, num_iq_samples_dataset bigint, center_freq double, bandwidth double, noise_power_db double, components array<{COMPONENT}>"
_COMPONENT = pa.struct([("class_name", pa.string()), ("class_index", pa.int32()), ("center_freq", pa.float64()), ("bandwidth", pa.float64()), ("snr_db", pa.float64()), ("start_in_samples", pa.int64()), ("duration_in_samples", pa.int64())])
#: Samples an Arrow batch: 16 wide-band samples are 32 MiB.
PER_BATCH = 16


def _batch(ids, c: DatasetConfig, more: tuple = ()) -> pa.RecordBatch:
    s = [sample(int(k), c, more) for k in ids]
    i, q = pipeline.as_lists([x["x"] for x in s])
    n = len(s)
    full = lambda v, t: pa.array([v] * n, t)
    return pa.RecordBatch.from_arrays(
        [pa.array([x["sample_id"] for x in s], pa.int64()), i, q, full(c.sample_rate, pa.float64()), full(c.num_iq_samples_dataset, pa.int64()), full(0.0, pa.float64()),
         pa.array([x["bandwidth"] for x in s], pa.float64()), full(c.noise_power_db, pa.float64()), pa.array([x["components"] for x in s], pa.list_(_COMPONENT))],
        names=["sample_id", "i", "q", "sample_rate", "num_iq_samples_dataset", "center_freq", "bandwidth", "noise_power_db", "components"],
    )


def generate(spark: SparkSession, config: DatasetConfig, partitions: int | None = None, impair: bool = True, component_transforms: tuple = ()) -> DataFrame:
    """dataset_length samples, each generated on its own from (seed, sample_id); no shuffle, any partitioning gives the same rows.

    ``component_transforms`` are applied to every burst after those of the impairment level.  The sample chain of the
    level follows, unless ``impair`` is off.
    """
    more = steps(*component_transforms)
    per = max(1, config.num_iq_samples_dataset * 8)
    n = partitions or max(spark.sparkContext.defaultParallelism, -(-config.dataset_length * per // (64 << 20)))
    ids = spark.range(0, config.dataset_length, 1, min(n, max(1, config.dataset_length)))

    def run(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            for a in range(0, len(k), PER_BATCH):
                yield _batch(k[a : a + PER_BATCH], config, more)

    df = ids.mapInArrow(run, SCHEMA)
    return pipeline.apply(df, *impairments(config.impairment_level)[1], seed=config.seed) if impair else df


def default_dataset(spark: SparkSession, impairment_level: int = 0, transforms: tuple = (), component_transforms: tuple = (), **fields) -> DataFrame:
    """A generated dataset of the usual description: impairments of the level, then the given transforms; fields are those of DatasetConfig."""
    c = DatasetConfig(impairment_level=impairment_level, **fields)
    return pipeline.apply(generate(spark, c, component_transforms=component_transforms), *transforms, seed=c.seed)


def family_bursts(src: DataFrame, n: int, bandwidth: float, sample_rate: float, seed: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """(family, family_index, class_name, copy, i, q): for each row of src (family, copy) a burst of a class of the family, each as likely.

    family_index is the place of the family in ``order`` (by default that of the class table).  Any name that
    modulators.classes_of() knows is a family.
    """
    from ..functions import rng
    from ..kernels.modulators import classes_of, families

    order = list(order or dict.fromkeys(families().values()))
    draw = F.lit(None).cast("string")
    for f in order:
        draw = F.when(F.col("family") == f, rng.choice(rng.uniform(seed, "family", "family", "copy"), classes_of(f))).otherwise(draw)
    drawn = src.select("family", draw.alias("class_name"), "copy").where("class_name is not null")
    made = bursts_of(drawn.select(F.concat_ws("|", "family", "class_name").alias("class_name"), "copy"), n, bandwidth, sample_rate, seed, _of_family)
    made = made.withColumns({"family": F.substring_index("class_name", "|", 1), "class_name": F.substring_index("class_name", "|", -1)})
    return made.select("family", (F.array_position(F.array(*map(F.lit, order)), F.col("family")) - 1).cast("int").alias("family_index"), "class_name", "copy", "i", "q")


def _of_family(name: str, *how):
    from ..kernels.modulators import modulate

    return modulate(name.split("|")[1], *how)


def bursts(spark: SparkSession, names: list[str], n: int, bandwidth: float, sample_rate: float, each: int = 1, seed: int = 0) -> DataFrame:
    """(class_name, copy, i, q): plain bursts of the named classes."""
    src = spark.createDataFrame([(c, j) for c in names for j in range(each)], "class_name string, copy bigint").repartition(min(len(names) * each, spark.sparkContext.defaultParallelism * 2))
    return bursts_of(src, n, bandwidth, sample_rate, seed)


def bursts_of(src: DataFrame, n: int, bandwidth: float, sample_rate: float, seed: int = 0, make=None) -> DataFrame:
    """(class_name, copy, i, q): one burst for each row of src (class_name, copy), drawn by a counter keyed by seed, class and copy.

    ``make`` is another modulator with the arguments of kernels.modulators.modulate().
    """
    from ..kernels.draws import Counter, stream_key
    from ..kernels.modulators import modulate

    make = make or modulate

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, PER_BATCH):
                part = b.slice(a, PER_BATCH)
                i, q = pipeline.as_lists([make(name, bandwidth, sample_rate, n, Counter(stream_key(seed, name, k))) for name, k in zip(*(c.to_pylist() for c in part.columns))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), i, q], names=["class_name", "copy", "i", "q"])

    return src.select("class_name", F.col("copy").cast("bigint").alias("copy")).mapInArrow(run, "class_name string, copy bigint, i array<float>, q array<float>")


def select_targets(df: DataFrame, target_labels: list[str] | None, single: bool) -> DataFrame:
    """The shape a consumer asked for: all columns (None), data only ([]), or data with ``targets``.

    One label gives a list of values over the components, several give an array of such lists; with
    ``single`` (samples hold at most one signal) a value stands alone.
    """
    if target_labels is None:
        return df
    if not target_labels:
        return df.select("sample_id", "i", "q")
    fields = [F.transform(F.col("components")[n], lambda v: v.cast("string")) for n in target_labels]
    if single:
        fields = [F.get(f, F.lit(0)) for f in fields]
    return df.select("sample_id", "i", "q", (fields[0] if len(fields) == 1 else F.array(*fields)).alias("targets"))


def with_yolo(df: DataFrame) -> DataFrame:
    """Adds yolo: one struct<class_index, cx, cy, w, h> a component."""
    n, fs = F.col("num_iq_samples_dataset"), F.col("sample_rate")

    def one(c):
        a, d = c["start_in_samples"] / n, c["duration_in_samples"] / n
        return F.struct(c["class_index"].alias("class_index"), (a + d / 2).alias("cx"), (1 - (fs / 2 + c["center_freq"]) / fs).alias("cy"), d.alias("w"), (c["bandwidth"] / fs).alias("h"))

    return df.withColumn("yolo", F.transform("components", one))


class Range(InputPartition):
    def __init__(self, a: int, b: int):
        super().__init__(a)
        self.a, self.b = a, b


def _config(options) -> DatasetConfig:
    raw = options.get("config")
    d = json.loads(raw) if raw else {}
    for k in ("classes", "target_labels"):
        if d.get(k) is not None:
            d[k] = tuple(d[k])
    return DatasetConfig(**d)


class BurstReader(DataSourceReader):
    def __init__(self, c: DatasetConfig, size: int):
        self.c, self.size = c, size

    def partitions(self):
        return [Range(a, min(self.c.dataset_length, a + self.size)) for a in range(0, self.c.dataset_length, self.size)]

    def read(self, p: Range):
        for a in range(p.a, p.b, PER_BATCH):
            yield _batch(np.arange(a, min(p.b, a + PER_BATCH)), self.c)


class BurstStreamReader(DataSourceStreamReader):
    """Endless: each micro-batch holds the next ``per_trigger`` samples; the offset is the next sample_id."""

    def __init__(self, c: DatasetConfig, per_trigger: int, size: int):
        self.c, self.per_trigger, self.size, self.at = c, per_trigger, size, 0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        self.at += self.per_trigger
        return {"next": self.at}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at, end["next"])
        return [Range(a, min(end["next"], a + self.size)) for a in range(start["next"], end["next"], self.size)]

    def read(self, p: Range):
        for a in range(p.a, p.b, PER_BATCH):
            yield _batch(np.arange(a, min(p.b, a + PER_BATCH)), self.c)


class BurstDataSource(DataSource):
    """spark.read.format("bursts").option("config", json) and spark.readStream of the same.

    Options: config (JSON of DatasetConfig), per_trigger (stream), per_partition.
    """

    @classmethod
    def name(cls) -> str:
        return "bursts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BurstReader:
        return BurstReader(_config(self.options), int(self.options.get("per_partition", 64)))

    def streamReader(self, schema) -> BurstStreamReader:
        return BurstStreamReader(_config(self.options), int(self.options.get("per_trigger", 64)), int(self.options.get("per_partition", 16)))


def config_json(c: DatasetConfig) -> str:
    return json.dumps(asdict(c))


