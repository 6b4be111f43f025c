"""NPY capture directories: sorted *.npy payloads, a header-less metadata.csv and an info.json with the size.

``idx`` is the global position over the sorted files, not the file's own index column.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators import malformed

#: The class order of this format.
CLASSES = ("BPSK", "QPSK", "Noise")
SCHEMA = "idx bigint, i array<float>, q array<float>, file_no int, at bigint"


def locate(idx: DataFrame, files: DataFrame, file_key: str, count: str = "n") -> DataFrame:
    """(idx, file_key, at): the file that holds a global position, and the position in it.

    A join of ranges as an equi-join: positions are cut into cells as wide as a file is long on average, a file has a row in
    each cell it touches (at most two for each file altogether) and a position meets only the files of its cell.  The files'
    start positions are a running sum over the file list; positions outside every file are left out.
    """
    w = Window.orderBy(file_key)
    f = files.select(file_key, F.coalesce(F.col(count), F.lit(0)).cast("bigint").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    f = f.withColumn("_end", F.col("_start") + F.col("_n")).where("_n > 0")
    wide = F.broadcast(f.agg(F.greatest(F.lit(1), F.ceil(F.sum("_n") / F.count(F.lit(1)))).cast("bigint").alias("_wide")))
    cell = lambda c: F.floor(c / F.col("_wide"))
    f = f.join(wide).withColumn("_cell", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end") - 1)))).drop("_wide")
    d = idx.join(wide).withColumn("_cell", cell(F.col("idx"))).drop("_wide")
    return d.join(f, "_cell").where((F.col("idx") >= F.col("_start")) & (F.col("idx") < F.col("_end"))).withColumn("at", F.col("idx") - F.col("_start")).drop("_start", "_end", "_n", "_cell")


def read_info(root: str) -> int:
    """The size in info.json; FileNotFoundError if it is missing, ValueError if it is not a whole number above -1."""
    path = os.path.join(root, "info.json")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path) as f:
        try:
            size = json.load(f)["size"]
        except (json.JSONDecodeError, KeyError, TypeError) as x:
            raise ValueError(f"{path} has no size") from x
    if not isinstance(size, int) or isinstance(size, bool) or size < 0:
        raise ValueError(f"{path} has the size {size!r}")
    return size


def labels(spark: SparkSession, root: str, classes=CLASSES) -> DataFrame:
    """(idx, meta_index, label, modcod, sample_rate, class_index) of metadata.csv; idx counts the lines.

    Lines that do not parse keep their position with null fields; unknown labels have a null class.
    """
    lines = spark.read.text(os.path.join(root, "metadata.csv"), wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("idx", "raw_line"))
    d = malformed.parse_lines(lines).select(F.col("idx").cast("bigint").alias("idx"), F.col("record.index").alias("meta_index"), "record.label", "record.modcod", "record.sample_rate")
    at = F.array_position(F.array(*[F.lit(c.lower()) for c in classes]), F.lower("label")) - 1
    return d.withColumn("class_index", F.when(at >= 0, at).cast("int"))


def waveforms(spark: SparkSession, root: str) -> DataFrame:
    """(idx, i, q, file_no, at): one row an element of the payload arrays; files are read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(root)
    order = sorted(r["path"] for r in files.select("path").collect())
    known = spark.createDataFrame(list(enumerate(order)) or [], "file_no int, path string")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_shape(c)[0] for c in b.column(1).to_pylist()], pa.int64())], names=["file_no", "n"])

    def rows(batches):
        for b in batches:
            for no, start, content in zip(*(c.to_pylist() for c in b.columns)):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                for a in range(0, len(x), 256):
                    yield _rows(x[a : a + 256], start + a, no, a)

    both = files.join(F.broadcast(known), "path").select("file_no", "content")
    n = both.mapInArrow(sizes, "file_no int, n bigint")
    starts = n.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file_no", "start")
    return both.join(F.broadcast(starts), "file_no").select("file_no", "start", "content").mapInArrow(rows, SCHEMA)


def _shape(content: bytes) -> tuple:
    f = io.BytesIO(content)
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]


def _rows(x: np.ndarray, idx: int, file_no: int, at: int) -> pa.RecordBatch:
    x = x.reshape(len(x), -1)
    flat = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(v).ravel().astype(np.float32)))
    k = np.arange(len(x), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(idx + k), flat(x.real), flat(x.imag), pa.array(np.full(len(x), file_no, np.int32)), pa.array(at + k)], names=["idx", "i", "q", "file_no", "at"])


def read_dataset(spark: SparkSession, root: str, classes=CLASSES) -> DataFrame:
    """Waveforms with their labels by global position; the length is that of info.json, not of the payload.

    ValueError for a missing root; IndexError when metadata.csv has fewer lines than info.json says.
    """
    if not os.path.isdir(root):
        raise ValueError(f"{root} is not a directory")
    size, meta = read_info(root), labels(spark, root, classes)
    if meta.limit(size).count() < size:
        raise IndexError("metadata.csv is shorter than info.json says")
    return waveforms(spark, root).where(F.col("idx") < size).join(meta, "idx", "left")


def write_dataset(df: DataFrame, root: str, per_file: int = 1000) -> None:
    """Writes (idx, i, q, label, modcod, sample_rate) as an NPY directory on a file system all executors share.

    Signals of one file must be equally long.  Rows are placed by idx; a file is one group of ``per_file`` rows.
    """
    os.makedirs(root, exist_ok=True)
    n = df.count()

    def save(pdf):
        pdf = pdf.sort_values("idx")
        x = np.array([np.asarray(i, np.float32) + 1j * np.asarray(q, np.float32) for i, q in zip(pdf["i"], pdf["q"])], np.complex64)
        np.save(os.path.join(root, f"data_{int(pdf['_file'].iloc[0]):08d}.npy"), x)
        return pdf[["_file"]].head(1)

    df.withColumn("_file", F.floor(F.col("idx") / per_file)).select("_file", "idx", "i", "q").groupBy("_file").applyInPandas(save, "_file bigint").count()
    lines = df.orderBy("idx").select(F.concat_ws(",", "idx", "label", "modcod", "sample_rate").alias("line"))
    with open(os.path.join(root, "metadata.csv"), "w") as f:
        f.writelines(r["line"] + "\n" for r in lines.toLocalIterator())
    with open(os.path.join(root, "info.json"), "w") as f:
        json.dump({"size": n}, f)


class FilePartition(InputPartition):
    def __init__(self, no: int, path: str, start: int):
        super().__init__(no)
        self.no, self.path, self.start = no, path, start


class NpyReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        out, start = [], 0
        for no, name in enumerate(sorted(f for f in os.listdir(self.root) if f.endswith(".npy"))):
            path = os.path.join(self.root, name)
            out.append(FilePartition(no, path, start))
            start += len(np.load(path, mmap_mode="r", allow_pickle=False))
        return out

    def read(self, p: FilePartition) -> Iterator[pa.RecordBatch]:
        x = np.load(p.path, mmap_mode="r", allow_pickle=False)
        for a in range(0, len(x), 256):
            yield _rows(np.asarray(x[a : a + 256]), p.start + a, p.no, a)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str], rows: int):
        self.files, self.rows = files, rows


class NpyWriter(DataSourceArrowWriter):
    """Each task writes payload files under a hidden name; the commit names them and writes info.json, an abort removes them."""

    def __init__(self, root: str, overwrite: bool):
        self.root = root
        os.makedirs(root, exist_ok=True)
        if overwrite:
            for f in os.listdir(root):
                if f.endswith(".npy") or f == "info.json":
                    os.remove(os.path.join(root, f))

    def write(self, batches) -> Written:
        c = TaskContext.get()
        files, rows = [], 0
        for k, b in enumerate(x for x in batches if x.num_rows):
            at = {n: j for j, n in enumerate(b.schema.names)}
            x = np.array([np.asarray(i, np.float32) + 1j * np.asarray(q, np.float32) for i, q in zip(b.column(at["i"]).to_pylist(), b.column(at["q"]).to_pylist())], np.complex64)
            name = f"data_{c.partitionId():06d}_{k:04d}.npy"
            with open(os.path.join(self.root, f".{name}.{c.taskAttemptId()}"), "wb") as f:
                np.save(f, x)
            files.append(f.name)
            rows += len(x)
        return Written(files, rows)

    def commit(self, messages) -> None:
        for m in messages:
            for f in m.files if m else []:
                os.rename(f, os.path.join(self.root, os.path.basename(f)[1:].rsplit(".", 1)[0]))
        with open(os.path.join(self.root, "info.json"), "w") as f:
            json.dump({"size": sum(m.rows for m in messages if m)}, f)

    def abort(self, messages) -> None:
        for m in messages:
            for f in m.files if m else []:
                if os.path.exists(f):
                    os.remove(f)


class NpyDataSource(DataSource):
    """spark.read.format("npy_captures").load(root): one partition a file; df.write.format("npy_captures").save(root).

    Written rows (i, q of one length) keep the order of their partitions; labels go through write_dataset.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        root = self.options.get("path")
        if not root or not os.path.isdir(root):
            raise ValueError(f"{root} is not a directory")
        return NpyReader(root)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], overwrite)
