"""SigMF recordings: raw complex floats beside a JSON description with annotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

META = "global struct<`core:datatype`:string,`core:sample_rate`:double>, annotations array<struct<`core:sample_start`:bigint,`core:sample_count`:bigint,`core:label`:string,`core:comment`:string>>"
TYPES = {"cf32_le": "<f4", "cf64_le": "<f8", "ci16_le": "<i2"}


def annotations(spark: SparkSession, root: str) -> DataFrame:
    """(recording, datatype, sample_rate, ann_no, sample_start, sample_count, label, comment): one row an annotation."""
    files = spark.read.text(f"{root}/*.sigmf-meta", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.sigmf-meta$", 1).alias("recording"), F.from_json("value", META).alias("m"))
    d = files.select("recording", F.col("m.global")["core:datatype"].alias("datatype"), F.col("m.global")["core:sample_rate"].alias("sample_rate"), F.posexplode("m.annotations").alias("ann_no", "a"))
    return d.select("recording", "datatype", "sample_rate", "ann_no", F.col("a")["core:sample_start"].alias("sample_start"), F.col("a")["core:sample_count"].alias("sample_count"), F.col("a")["core:label"].alias("label"), F.col("a")["core:comment"].alias("comment"))


def read_signals(spark: SparkSession, root: str) -> DataFrame:
    """One signal an annotation: (recording, ann_no, label, comment, sample_rate, start_in_samples, duration_in_samples, i, q).

    Annotations beyond the end of the data are cut to it; an unknown datatype raises ValueError.
    """
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.sigmf-data").load(root).select(F.regexp_extract("path", r"([^/]+)\.sigmf-data$", 1).alias("recording"), "content")
    d = annotations(spark, root).groupBy("recording", "datatype", "sample_rate").agg(F.array_sort(F.collect_list(F.struct("ann_no", "sample_start", "sample_count", "label", "comment"))).alias("a")).join(data, "recording")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                if r["datatype"] not in TYPES:
                    raise ValueError(f"unknown datatype {r['datatype']}")
                x = np.frombuffer(r["content"], TYPES[r["datatype"]]).astype(np.float32)
                i, q = x[::2], x[1::2]
                for a in r["a"]:
                    s, e = a["sample_start"], a["sample_start"] + a["sample_count"]
                    yield pa.RecordBatch.from_pylist([{"recording": r["recording"], "ann_no": a["ann_no"], "label": a["label"], "comment": a["comment"], "sample_rate": r["sample_rate"], "start_in_samples": s, "duration_in_samples": len(i[s:e]), "i": i[s:e].tolist(), "q": q[s:e].tolist()}], _SCHEMA)

    return d.select("recording", "datatype", "sample_rate", "a", "content").mapInArrow(run, "recording string, ann_no int, label string, comment string, sample_rate double, start_in_samples bigint, duration_in_samples bigint, i array<float>, q array<float>")


_SCHEMA = pa.schema([("recording", pa.string()), ("ann_no", pa.int32()), ("label", pa.string()), ("comment", pa.string()), ("sample_rate", pa.float64()), ("start_in_samples", pa.int64()), ("duration_in_samples", pa.int64()), ("i", pa.list_(pa.float32())), ("q", pa.list_(pa.float32()))])
