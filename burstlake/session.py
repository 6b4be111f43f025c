"""Session construction and the places where a query may leave intermediate rows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def get_session(master: str | None = None, partitions: int | None = None, app: str = "burstlake") -> SparkSession:
    """A session with the settings this engine is written for.

    Arrow batches are kept small because one row may hold a 262 144-sample burst (2 MiB).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir if the cluster names one.

    Only where the setting is absent, as in local tests, is a temporary folder made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="burstlake-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and drop its lineage (survives a lost executor)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Materialise df as a Parquet table in the shared folder.

    For steps of an iteration: unlike a checkpoint it carries its real size and not the product of the
    estimates of all joins before it.  The order and number of partitions are not kept.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def table_with_any(df: DataFrame, condition) -> tuple[DataFrame, bool]:
    """table(df), and whether any of its rows meets the condition; counted while it is written, without a job of its own."""
    seen = Observation()
    out = table(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
    return out, seen.get["n"] > 0


def drop(df: DataFrame) -> None:
    """Removes a table() that no later plan reads."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_shared_path", None)
    if path:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
