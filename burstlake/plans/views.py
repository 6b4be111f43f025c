"""How the given tables stand in for signals, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def iq_array(spark, d) -> DataFrame:
    """Embeddings as 32-sample signals: even elements are i, odd ones q, scaled by 1 + vec_id % 7, sample vec_id % 32 zeroed."""
    e = t(spark, d, "embeddings")
    at = F.sequence(F.lit(0), (F.size("embedding") / 2 - 1).cast("int"))
    g = (F.lit(1) + F.col("vec_id") % 7).cast("double")
    rail = lambda o: F.transform(at, lambda n: F.when(n == F.col("vec_id") % 32, F.lit(0.0)).otherwise(F.get("embedding", n * 2 + o).cast("double") * g))
    return e.select("vec_id", "label", rail(0).alias("i"), rail(1).alias("q"))


def iq_long(spark, d, *keep) -> DataFrame:
    from ..operators.iq import to_long

    return to_long(iq_array(spark, d), "vec_id", *keep)


IQ = """iq AS (SELECT vec_id, label, n, CASE WHEN n = vec_id % 32 THEN 0e0 ELSE embedding[2 * n + 1]::DOUBLE * (1 + vec_id % 7) END AS i,
                      CASE WHEN n = vec_id % 32 THEN 0e0 ELSE embedding[2 * n + 2]::DOUBLE * (1 + vec_id % 7) END AS q
               FROM embeddings CROSS JOIN (SELECT unnest(range(32))::BIGINT AS n) AS r)"""
IQ_ARRAY = IQ + ", arr AS (SELECT vec_id, list(i ORDER BY n) AS i, list(q ORDER BY n) AS q FROM iq GROUP BY vec_id)"


def series(spark, d) -> DataFrame:
    """Events of a user as a series: n counts by (ts, event_id); i is the value, q its negative half."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("n"), F.col("value").alias("i"), (-F.col("value") / 2).alias("q"))


SERIES = "series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS i, -value / 2 AS q FROM events)"

N_DATASET, FFT, RATE = 262_144, 512, 10e6


def bursts(spark, d) -> DataFrame:
    """Events as bursts of the sample user_id; positions and bands follow from the event id."""
    e = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t(spark, d, "events").select(
        F.col("user_id").alias("sample_id"), F.row_number().over(w).cast("bigint").alias("comp_no"), F.col("event_type").alias("class_name"),
        (e * 31337 % 200000).alias("start_in_samples"), (F.lit(1000) + F.floor(F.col("value") * 10)).cast("bigint").alias("duration_in_samples"),
        (e * 7919 % 4000001 - 2000000).cast("double").alias("center_freq"), (F.lit(10000) + e * 104729 % 500000).cast("double").alias("bandwidth"),
        (e % 50).cast("double").alias("snr_db"), F.lit(RATE).alias("sample_rate"), F.lit(N_DATASET).cast("bigint").alias("num_iq_samples_dataset"),
    )


BURSTS = f"""bursts AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS comp_no, event_type AS class_name,
   event_id * 31337 % 200000 AS start_in_samples, (1000 + floor(value * 10))::BIGINT AS duration_in_samples, (event_id * 7919 % 4000001 - 2000000)::DOUBLE AS center_freq,
   (10000 + event_id * 104729 % 500000)::DOUBLE AS bandwidth, (event_id % 50)::DOUBLE AS snr_db, {RATE!r}::DOUBLE AS sample_rate, {N_DATASET}::BIGINT AS num_iq_samples_dataset FROM events)"""


def boxes(spark, d) -> DataFrame:
    from ..functions.geometry import box

    b = bursts(spark, d)
    corners = box(F.col("start_in_samples"), F.col("duration_in_samples"), F.col("center_freq"), F.col("bandwidth"), FFT, RATE)
    return b.select("sample_id", "comp_no", *[c.alias(k) for k, c in corners.items()])


BOXES = BURSTS + f""", boxes AS (SELECT sample_id, comp_no, round_even(start_in_samples / {FFT}e0, 0) AS x0, round_even((center_freq - bandwidth) / {RATE / 2!r} * {FFT}, 0) AS y0,
   round_even((start_in_samples + duration_in_samples) / {FFT}e0, 0) AS x1, round_even((center_freq + bandwidth) / {RATE / 2!r} * {FFT}, 0) AS y1 FROM bursts)"""


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Rounded to six places, without negative zero."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})
