"""Stored datasets: a star of Parquet tables with two YAML sidecars, written once and completely or not at all.

Layout of a root: samples/ (arrays and sample metadata), components/ (one row a signal), metadata/ (key and
value with the parent of each group), dataset_info.yaml, writer_info.yaml.  The payload is left alone by
queries that read only metadata.
"""

from __future__ import annotations

import math
import time
from dataclasses import asdict

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import hierarchy
from ..kernels.assemble import DatasetConfig

CODECS = {"gzip": "gzip", "lzf": "lz4", "none": "uncompressed", "snappy": "snappy", "zstd": "zstd"}


class Folder:
    """Files of a root through the Hadoop file system, so that any shared storage works."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self._path(a), self._path(b)):
            raise OSError(f"cannot rename {a} to {b}")

    def make(self) -> None:
        self.fs.mkdirs(self._path(""))


class FlowLists(yaml.SafeDumper):
    """Lists in one line."""


FlowLists.add_representer(list, lambda d, v: d.represent_sequence("tag:yaml.org,2002:seq", v, flow_style=True))
FlowLists.add_representer(tuple, lambda d, v: d.represent_sequence("tag:yaml.org,2002:seq", list(v), flow_style=True))


def to_yaml(info: dict) -> str:
    return yaml.dump(info, Dumper=FlowLists, sort_keys=False)


def same(a, b, rtol: float = 1e-9) -> bool:
    """Equal all the way down; numbers to a relative 1e-9, lists and tuples alike, True is not 1."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k], rtol) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(same(x, y, rtol) for x, y in zip(a, b))
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=rtol, abs_tol=0.0) or a == b
    return a == b


def load_config(text: str) -> DatasetConfig:
    """A dataset description in YAML -> DatasetConfig; unknown or missing keys and bad values raise ValueError."""
    d = yaml.safe_load(text)
    if not isinstance(d, dict):
        raise ValueError("the description must be a mapping")
    for k in ("dataset_length", "seed", "dataset_metadata"):
        if k not in d:
            raise ValueError(f"{k} is missing")
    if d.get("schema_version", 1) not in (1, "1", 1.0, "1.0"):
        raise ValueError(f"unknown schema_version {d['schema_version']}")
    if not isinstance(d["dataset_length"], int) or d["dataset_length"] <= 0:
        raise ValueError("dataset_length must be a whole number above 0")
    known = set(DatasetConfig.__dataclass_fields__)
    meta = d["dataset_metadata"] or {}
    extra = {k: v for k, v in meta.items() if k not in known} | ({"dataset_id": d["dataset_id"]} if "dataset_id" in d else {})
    labels = d.get("target_labels")
    return DatasetConfig(
        dataset_length=d["dataset_length"], seed=int(d["seed"]), impairment_level=int(d.get("impairment_level", 0)), representation=(d.get("output") or {}).get("representation", "iq"),
        sampling=(d.get("signal_sampling") or {}).get("mode", "per_signal"), classes=tuple(d.get("signals", ["all"])), target_labels=None if labels is None else tuple(labels), extra=extra, **{k: v for k, v in meta.items() if k in known},
    )


def _info(c: DatasetConfig, length: int) -> dict:
    return {"dataset_length": length, "seed": c.seed, "target_labels": list(c.target_labels) if c.target_labels is not None else None, "dataset_metadata": c.metadata() | {"impairment_level": c.impairment_level, "classes": list(c.classes)}}


def write_dataset(df: DataFrame, root: str, config: DatasetConfig, overwrite: bool = True, compression: str = "lzf", length: int | None = None, metadata: dict | None = None) -> bool:
    """Writes samples (sample_id, i, q, ..., components) under ``root``; returns whether anything was written.

    An existing dataset that is to stay: one with the same description is kept (False), a partial one or
    one with another description raises RuntimeError.  Samples beyond ``length`` are cut off; fewer raise
    RuntimeError and leave the dataset marked incomplete.  The sidecars say complete only at the end.
    """
    spark = df.sparkSession
    f = Folder(spark, root)
    want = length or config.dataset_length
    if f.exists() and not overwrite and f.exists("writer_info.yaml"):
        if not (yaml.safe_load(f.read("writer_info.yaml")) or {}).get("complete"):
            raise RuntimeError(f"{root} exists partially")
        if not same(yaml.safe_load(f.read("dataset_info.yaml")), yaml.safe_load(to_yaml(_info(config, want)))):
            raise RuntimeError(f"{root} exists with another description")
        return False
    if f.exists() and not overwrite and f.exists("samples"):
        raise RuntimeError(f"{root} exists partially")
    if f.exists():
        f.delete()
    f.make()
    writer = {"root": root, "overwrite": overwrite, "file_handler": "parquet", "compression": compression, "dataset_length_requested": want, "items_written": 0, "complete": False, "timestamp_unix": int(time.time())}
    f.write("dataset_info.yaml", to_yaml(_info(config, 0)))
    f.write("writer_info.yaml", to_yaml(writer))
    kept = df.where(F.col("sample_id") < want)
    # the samples are made once: the components are read back from the column they came in
    kept.write.option("compression", CODECS[compression]).parquet(f"{f.root}/samples")
    stored = spark.read.schema(kept.schema).parquet(f"{f.root}/samples")
    parts = stored.select("sample_id", F.posexplode("components").alias("comp_no", "c")).select("sample_id", "comp_no", "c.*")
    parts.write.option("compression", CODECS[compression]).parquet(f"{f.root}/components")
    meta = [("dataset", None, k, str(v)) for k, v in (config.metadata() | (metadata or {})).items() if v is not None]
    meta += [(f"generator-{n}", "dataset", "class_name", n) for n in config.generators()[0]]
    spark.createDataFrame(meta, "metadata_id string, parent_metadata_id string, key string, value string").coalesce(1).write.parquet(f"{f.root}/metadata")
    n = stored.count()
    if n != want:
        f.write("writer_info.yaml", to_yaml(writer | {"items_written": n}))
        raise RuntimeError(f"{n} samples were written, {want} were asked for")
    f.write("dataset_info.yaml", to_yaml(_info(config, n)))
    f.write("writer_info.yaml", to_yaml(writer | {"items_written": n, "complete": True}))
    return True


def read_dataset(spark: SparkSession, root: str, sample_id: int | None = None) -> DataFrame:
    """Samples with their components; one sample by its id, IndexError outside [0, length).

    ValueError for a missing root.  The id reaches the Parquet scan as a pushed filter on both tables.
    """
    f = Folder(spark, root)
    if not f.exists("samples"):
        raise ValueError(f"{root} is not a dataset")
    s, c = spark.read.parquet(f"{f.root}/samples").drop("components"), spark.read.parquet(f"{f.root}/components")
    if sample_id is not None:
        n = yaml.safe_load(f.read("dataset_info.yaml"))["dataset_length"]
        if not 0 <= sample_id < n:
            raise IndexError(f"{sample_id} is outside [0, {n})")
        s, c = s.where(F.col("sample_id") == sample_id), c.where(F.col("sample_id") == sample_id)
    names = [k for k in c.columns if k != "sample_id"]
    per = c.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("components"))
    empty = F.array().cast(per.schema["components"].dataType)
    return s.join(per, "sample_id", "left").withColumn("components", F.coalesce("components", empty))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(metadata_id, key, value): own values first, then those of the parents, up to the root of the chain."""
    return inherited(spark.read.parquet(f"{root.rstrip('/')}/metadata"))


def inherited(m: DataFrame) -> DataFrame:
    """(metadata_id, key, value) of (metadata_id, parent_metadata_id, key, value): the value of the nearest node above, at any depth.

    The nodes above are those of operators.hierarchy, so loops end at their node on the loop and unknown parents give nothing.
    """
    way = hierarchy.paths(hierarchy.hierarchy(m.select("metadata_id", "parent_metadata_id")), sep="\x00").select("metadata_id", F.reverse(F.split("path", "\x00")).alias("up"))
    way = way.select("metadata_id", F.posexplode("up").alias("at", "above"))
    own = m.where("metadata_id is not null").select(F.col("metadata_id").alias("above"), "key", "value")
    return way.join(own, "above").groupBy("metadata_id", "key").agg(F.min_by("value", "at").alias("value"))


def run_states(runs: DataFrame) -> DataFrame:
    """(run_id, handler, state) of the writers' records: partial, miscounted (other than asked for, or unknown) or complete."""
    state = F.when(~F.col("is_complete"), "partial").when(~F.col("items_written").eqNullSafe(F.col("dataset_length_requested")), "miscounted").otherwise("complete")
    return runs.select("run_id", F.lower("file_handler").alias("handler"), state.alias("state"))


def describe(config: DatasetConfig, width: int = 100) -> str:
    """The description as aligned text."""
    rows = {k: v for k, v in asdict(config).items() if v not in (None, {}, ())}
    pad = max(map(len, rows)) + 2
    cut = lambda s: s if len(s) <= width - pad else s[: width - pad - 3] + "..."
    return "\n".join(f"{k:<{pad}}{cut(str(v))}" for k, v in rows.items())


def shipped_configs() -> dict[str, DatasetConfig]:
    """The nine standard descriptions: narrow- and wide-band, clean and impaired, training and validation, and a toy."""
    # Lengths, seeds and bands of the standard sets.
    narrow = {"num_iq_samples_dataset": 4096, "fft_size": 64, "fft_stride": 64, "num_signals_min": 1, "num_signals_max": 1, "cochannel_overlap_probability": 0.0}
    wide = {"num_iq_samples_dataset": 262_144, "fft_size": 512, "fft_stride": 512, "num_signals_min": 3, "num_signals_max": 5, "cochannel_overlap_probability": 0.1, "signal_duration_in_samples_min": 16_384, "signal_duration_in_samples_max": 32_768, "bandwidth_min": 62_500.0, "bandwidth_max": 1e6, "signal_center_freq_min": -5e6, "signal_center_freq_max": 5e6 - 1, "frequency_min": -5e6, "frequency_max": 5e6 - 1, "representation": "spectrogram"}
    sizes = {("narrowband", "clean"): (1_140_000, 11_400), ("narrowband", "impaired"): (5_700_000, 114_000), ("wideband", "clean"): (57_000, 11_400), ("wideband", "impaired"): (57_000, 11_400)}
    out = {"narrowband_toy": DatasetConfig(dataset_length=100, seed=42, **narrow)}
    for (band, kind), lengths in sizes.items():
        for part, n in zip(("train", "val"), lengths):
            seed = 1234567890 + (kind == "impaired") * 2 + (part == "val")
            out[f"{band}_{kind}_{part}"] = DatasetConfig(dataset_length=n, seed=seed, impairment_level=2 if kind == "impaired" else 0, **(narrow if band == "narrowband" else wide))
    return out
