"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.001, floor: int = 20_000) -> DataFrame:
    """Keys that hold more than ``share`` of the rows and more than ``floor`` rows: at most 1/share keys.

    The counts are combined on the map side before they are shuffled.  Null keys never match and are left out.
    """
    some = df.select(*keys)
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    counts = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > floor).join(F.broadcast(counts.agg(F.sum("_n").alias("_all"))), F.col("_n") > F.col("_all") * share).select(*keys)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = 32, share: float = 0.001, floor: int = 20_000) -> DataFrame:
    """Equi-join of big with small in which the rows of a hot key of big are spread over ``salts`` tasks.

    ``spread`` is a column of big that differs between rows of one key.  small is repeated only for the
    hot keys, of which there are at most 1/share, so the broadcast list of them is bounded whatever the data.
    ``how`` is inner or left; rows of big whose key is null come back only with left, unmatched.
    """
    hot = hot_keys(big, keys, share, floor).withColumn("_hot", F.lit(True))
    cond = F.coalesce(F.col("_hot"), F.lit(False))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(cond, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(cond, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
