"""Queries on generated signals and stored datasets: kernels have no SQL, so these are checked by rows and by tests."""

from __future__ import annotations


import uuid


from pyspark.sql import functions as F

from ..kernels import ops
from ..kernels.assemble import DatasetConfig
from ..kernels.modulators import chirp_symbols, classes_of, families
from ..operators import iq, pipeline
from ..session import ensure_checkpoint_dir
from ..sources import dataset, generator, npy
from . import modulator_sql, transform_sql
from ..functions import rng
from .views import IQ, iq_array, iq_long, r6

QUERIES: dict = {}
SQL: dict[str, str] = transform_sql.SQL | modulator_sql.SQL
NARROW = DatasetConfig(dataset_length=64, seed=42, num_iq_samples_dataset=4096, fft_size=64, fft_stride=64, num_signals_max=3, signal_duration_in_samples_min=1024, signal_duration_in_samples_max=3072, bandwidth_min=5e5, bandwidth_max=1e6)


def q(f):
    QUERIES[f.__name__] = f
    return f


def _signals(spark, d):
    """Embeddings as signals of 32 samples with a little metadata and one component."""
    x = iq_array(spark, d)
    comp = F.array(F.struct(F.lit(5).cast("bigint").alias("start_in_samples"), F.lit(9).cast("bigint").alias("duration_in_samples"), (F.col("label") * 0.01).alias("center_freq"), F.lit(0.04).alias("bandwidth"), F.lit(12.0).alias("snr_db")))
    return x.select(F.col("vec_id").alias("sample_id"), F.col("i").cast("array<float>").alias("i"), F.col("q").cast("array<float>").alias("q"), F.lit(32).cast("bigint").alias("num_iq_samples_dataset"),
                    F.lit(0.1).alias("center_freq"), F.lit(0.2).alias("bandwidth"), F.lit(-20.0).alias("noise_power_db"), F.lit(20.0).alias("snr_db"), F.lit(3).cast("bigint").alias("start_in_samples"), F.lit(20).cast("bigint").alias("duration_in_samples"), comp.alias("components"))


def _stats(df, *keep):
    """Per signal: length, power and a checksum in which every sample has a weight of its own."""
    p = F.aggregate(F.zip_with("i", "q", lambda a, b: a.cast("double") * a + b.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
    weighed = F.zip_with(F.transform("i", lambda v, k: v.cast("double") * F.cos(k)), F.transform("q", lambda v, k: v.cast("double") * F.sin(k)), lambda a, b: a + b)
    total = F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b)
    return df.select(*keep, F.size("i").alias("n"), (F.round(F.try_divide(p, F.size("i")), 3) + F.lit(0.0)).alias("mean_power"), (F.round(total, 5) + F.lit(0.0)).alias("checksum"))


@q
def gen_modulators(spark, d):
    """Bursts of each of the 57 classes, resampled to a tenth of the sample rate: length, and whether nine tenths of the power lie within it."""
    x = generator.bursts(spark, list(families()), 8192, 1e6, 10e6, each=3, seed=3)
    return pipeline.band_power(x, 1e6, 10e6).select("class_name", "copy", F.size("i").alias("n"), (F.col("band_power") >= 0.9).alias("in_band"))


def _bursts(spark, d, family, n, make=None):
    """A burst of every class of the family for every writer run, at four samples a cycle of the bandwidth, where nothing is resampled."""
    names = spark.createDataFrame([(c,) for c in classes_of(family)], "class_name string")
    runs = spark.read.parquet(f"{d}/writer_runs.parquet").select(F.col("run_id").alias("copy")).distinct()
    return _stats(generator.bursts_of(names.join(runs).repartition("class_name", "copy"), n, 2.5e6, 10e6, 3, make), "class_name", "copy")


@q
def gen_psk(spark, d):
    """Phase-shift keying, rectangular and root-raised-cosine pulses."""
    return _bursts(spark, d, "psk", modulator_sql.LINEAR)


@q
def gen_qam(spark, d):
    """Square, rectangular and cross constellations."""
    return _bursts(spark, d, "qam", modulator_sql.LINEAR)


@q
def gen_ask(spark, d):
    """Amplitude-shift keying."""
    return _bursts(spark, d, "ask", modulator_sql.LINEAR)


@q
def gen_ook(spark, d):
    """On-off keying."""
    return _bursts(spark, d, "ook", modulator_sql.LINEAR)


@q
def gen_fsk(spark, d):
    """Frequency-shift keying of two to sixteen tones, plain, minimum and Gaussian."""
    return _bursts(spark, d, "fsk", modulator_sql.SHIFT)


@q
def gen_ofdm(spark, d):
    """Subcarriers with drawn constellations and cyclic prefixes."""
    return _bursts(spark, d, "ofdm", modulator_sql.CARRIERS)


@q
def gen_chirps(spark, d):
    """Chirps before their drawn band limit: sweeps by bits, radar, spread spectrum."""
    return _bursts(spark, d, "chirp", modulator_sql.SWEEPS, lambda name, bandwidth, rate, n, rng: chirp_symbols(name, n, rng))


@q
def gen_family(spark, d):
    """A burst of a drawn class of every family for every writer run."""
    names = spark.createDataFrame([(f,) for f in dict.fromkeys(families().values())], "family string")
    runs = spark.read.parquet(f"{d}/writer_runs.parquet").select(F.col("run_id").alias("copy")).distinct()
    x = generator.family_bursts(names.join(runs).repartition("family", "copy"), 256, 2.5e6, 10e6, 3)
    return x.select("family", "family_index", "class_name", "copy", F.size("i").alias("n"))


@q
def gen_tone(spark, d):
    """A tone at 0 Hz."""
    x = generator.bursts(spark, ["tone"], 64, 1e6, 10e6).select(F.posexplode(F.arrays_zip("i", "q")).alias("n", "x"))
    return x.select(F.col("n").cast("bigint").alias("n"), F.col("x.i").cast("double").alias("i"), F.col("x.q").cast("double").alias("q"))


def _config(spark, d, base=NARROW, every: int = 1, **fields) -> DatasetConfig:
    """The description with as many samples as there are writer runs, or one for ``every`` of them."""
    n = -(-spark.read.parquet(f"{d}/writer_runs.parquet").select("run_id").distinct().count() // every)
    return DatasetConfig(**({f: getattr(base, f) for f in base.__dataclass_fields__} | {"dataset_length": n} | fields))


@q
def gen_dataset(spark, d):
    """Generated samples with up to three signals, impaired at level 2: metadata of every component."""
    c = _config(spark, d, impairment_level=2)
    df = generator.with_yolo(generator.generate(spark, c))
    return df.select("sample_id", F.size("i").alias("n"), F.posexplode("components").alias("comp_no", "c")).select("sample_id", "n", "comp_no", "c.*")


@q
def gen_source(spark, d):
    """The same samples through the data source, without sample impairments; whether each equals the generated one."""
    c = _config(spark, d)
    spark.dataSource.register(generator.BurstDataSource)
    df = spark.read.format("bursts").option("config", generator.config_json(c)).load()
    return _same(df, generator.generate(spark, c, impair=False))


def _same(a, b):
    """(sample_id, n, same): whether the samples of a have the checksum and the components that those of b have."""
    look = lambda x: _stats(x, "sample_id", F.to_json(F.col("components")).alias("parts"))
    b = look(b).select("sample_id", *[F.col(c).alias(f"_{c}") for c in ("n", "mean_power", "checksum", "parts")])
    same = (F.col("n") == F.col("_n")) & (F.col("mean_power") == F.col("_mean_power")) & (F.col("checksum") == F.col("_checksum")) & F.col("parts").eqNullSafe(F.col("_parts"))
    return look(a).join(b, "sample_id").select("sample_id", "n", F.coalesce(same, F.lit(False)).alias("same"))


@q
def gen_wideband(spark, d):
    """Wide-band samples of 262 144 points with three to five signals: whether noise level, boxes and counts are what they should be."""
    c = _config(spark, d, dataset.shipped_configs()["wideband_clean_train"], every=10)
    x = generator.generate(spark, c)
    inside = F.forall("components", lambda k: (k["start_in_samples"] >= 0) & (k["start_in_samples"] + k["duration_in_samples"] <= c.num_iq_samples_dataset) & (k["bandwidth"] > 0) & (F.abs(k["center_freq"]) + k["bandwidth"] / 2 <= c.sample_rate / 2 + 1))
    return x.select("sample_id", F.size("i").alias("n"), F.size("components").between(1, c.num_signals_max).alias("counted"), inside.alias("inside"))


def _layout(name):
    def run(spark, d):
        x = pipeline.apply(_signals(spark, d), "ChannelSwap", name, seed=7)
        x = x.select("sample_id", F.posexplode(F.flatten("data") if name == "ComplexTo2D" else F.col("data")).alias("k", "v"))
        return x.select("sample_id", F.col("k").cast("bigint").alias("k"), (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("v"))

    QUERIES[f"tf_{name}"] = run


for _name in pipeline.LAYOUTS:
    _layout(_name)


def _transform(name):
    def run(spark, d):
        return _stats(pipeline.apply(_signals(spark, d), ops.OPS[name], seed=7), "sample_id", F.round("center_freq", 9).alias("center_freq"), "start_in_samples", F.round("snr_db", 6).alias("snr_db"))

    QUERIES[f"tf_{name}"] = run


for _name in ops.OPS:
    _transform(_name)


@q
def tf_impairments(spark, d):
    """Burst and sample chain of level 2 on every signal, in one kernel pass."""
    burst, sample = ops.impairments(2)
    return _stats(pipeline.apply(_signals(spark, d), burst, sample, seed=7), "sample_id", F.round("center_freq", 9).alias("center_freq"))


@q
def tf_draws(spark, d):
    """What level 1 draws for every signal, without touching a sample."""
    x = pipeline.draws(_signals(spark, d).select("sample_id"), ops.steps(*ops.impairments(1)), seed=7)
    return x.select("sample_id", F.col("draws.t0").alias("quantized"), F.round("draws.t0m0_bits", 6).alias("bits"), F.col("draws.t12").alias("picked"))


SQL_MIRROR = """WITH iq AS (SELECT vec_id AS sample_id, n, CASE WHEN n = vec_id % 32 THEN 0e0 ELSE embedding[2 * n + 1]::DOUBLE * (1 + vec_id % 7) END AS i, CASE WHEN n = vec_id % 32 THEN 0e0 ELSE embedding[2 * n + 2]::DOUBLE * (1 + vec_id % 7) END AS q
 FROM embeddings CROSS JOIN (SELECT unnest(range(32))::BIGINT AS n) AS r) SELECT sample_id, 31 - n AS n, round(i::FLOAT::DOUBLE, 4) + 0e0 AS i, round(-q::FLOAT::DOUBLE, 4) + 0e0 AS q, -0.1e0 AS center_freq, 9::BIGINT AS start_in_samples FROM iq"""


@q
def tf_chain_exact(spark, d):
    """ChannelSwap twice cancels; time reversal that inverts the spectrum again is exact."""
    x = pipeline.apply(_signals(spark, d), "ChannelSwap", "ChannelSwap", ops.op("TimeReversal", fixed_undo=False), "SpectralInversion", seed=7)
    x = iq.to_long(x.withColumns({"i": F.transform("i", lambda v: v.cast("double")), "q": F.transform("q", lambda v: v.cast("double"))}), "sample_id", "center_freq", "start_in_samples")
    return x.select("sample_id", "n", (F.round("i", 4) + F.lit(0.0)).alias("i"), (F.round("q", 4) + F.lit(0.0)).alias("q"), (-F.abs("center_freq")).alias("center_freq"), "start_in_samples")


SQL["tf_chain_exact"] = SQL_MIRROR


@q
def spec_kernel(spark, d):
    """The kernel's spectrogram of every signal, flattened."""
    x = pipeline.spectrograms(_signals(spark, d).select("sample_id", "i", "q"), 16, 8)
    x = x.select(F.col("sample_id").alias("vec_id"), F.posexplode("spectrogram").alias("bin", "row")).select("vec_id", F.col("bin").cast("bigint").alias("bin"), F.posexplode("row").alias("frame", "db"))
    return x.select("vec_id", F.col("frame").cast("bigint").alias("frame"), "bin", F.round(F.col("db").cast("double"), 2).alias("db"))


@q
def tf_SpectrogramDropSamples(spark, d):
    """Random fills of every signal's spectrogram."""
    x = pipeline.spectrogram_drops(pipeline.spectrograms(_signals(spark, d).select("sample_id", "i", "q"), 16, 8), (0.05, 0.2), seed=7)
    return x.select("sample_id", F.size("spectrogram").alias("bins"), F.round(F.aggregate(F.flatten("spectrogram"), F.lit(0.0), lambda a, b: a + b.cast("double")), 2).alias("total"))


@q
def spec_images(spark, d):
    """Image size and mean grey of every signal."""
    x = pipeline.images(_signals(spark, d).select("sample_id", "i", "q"), 16, 8)
    return x.select("sample_id", "image.h", "image.w", "image.c", F.length("image.data").alias("bytes"))


@q
def io_dataset_round_trip(spark, d):
    """Generated, stored, read back: whether each sample is what it was, with its components in order."""
    root, c = f"{ensure_checkpoint_dir(spark)}/dataset-{uuid.uuid4().hex}", _config(spark, d)
    dataset.write_dataset(generator.generate(spark, c), root, c)
    back = dataset.read_dataset(spark, root).withColumn("components", F.transform("components", lambda k: k.dropFields("comp_no")))
    return _same(back, generator.generate(spark, c))


@q
def io_dataset_metadata(spark, d):
    """Metadata of each generator with what it inherits from its dataset."""
    root, c = f"{ensure_checkpoint_dir(spark)}/dataset-{uuid.uuid4().hex}", _config(spark, d)
    dataset.write_dataset(generator.generate(spark, c), root, c)
    return dataset.read_metadata(spark, root)


@q
def io_npy_round_trip(spark, d):
    """Signals written as an NPY directory and read back by global position, with their labels."""
    root = f"{ensure_checkpoint_dir(spark)}/npy-{uuid.uuid4().hex}".removeprefix("file:")
    root = "/" + root.lstrip("/")
    x = iq_array(spark, d).select(F.col("vec_id").alias("k"), "i", "q", "label")
    from pyspark.sql import Window

    x = x.withColumn("idx", (F.row_number().over(Window.orderBy("k")) - 1).cast("bigint"))
    npy.write_dataset(x.select("idx", "i", "q", F.element_at(F.array(*[F.lit(c) for c in npy.CLASSES]), (F.col("label") % 3 + 1).cast("int")).alias("label"), F.lit(0).alias("modcod"), F.lit(1e6).alias("sample_rate")), root, 100)
    return npy.read_dataset(spark, root).select("idx", "file_no", "at", "class_index", F.size("i").alias("n"), F.round(F.get("i", F.lit(1)).cast("double"), 4).alias("second"))


@q
def io_configs(spark, d):
    """The standard dataset descriptions."""
    rows = [(k, c.dataset_length, c.seed, c.impairment_level, c.representation, c.num_iq_samples_dataset, c.num_signals_max) for k, c in dataset.shipped_configs().items()]
    return spark.createDataFrame(rows, "config string, dataset_length bigint, seed bigint, impairment_level int, representation string, num_iq_samples_dataset bigint, num_signals_max int")


@q
def gen_classes(spark, d):
    """The class table: index, class, family."""
    return spark.createDataFrame([(k, n, f) for k, (n, f) in enumerate(families().items())], "class_index int, class_name string, family string")


def _stream(spark, d, name, make):
    """Runs a streaming query over the events table to its end and returns what it wrote."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    src = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    make(src).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@q
def st_tumbling(spark, d):
    """Hourly windows by event type from a stream; windows the watermark has closed."""
    from ..streaming.windows import tumbling

    return r6(_stream(spark, d, "tumbling", lambda s: tumbling(s, "ts", "value", "1 hour", ("event_type",), "10 minutes")), "total", "most")


@q
def st_sessions(spark, d):
    """Sessions of each user from a stream."""
    from ..streaming.windows import sessions

    return r6(_stream(spark, d, "sessions", lambda s: sessions(s, "ts", "value", "2 hours", ("user_id",), "10 minutes")), "total", "most")


@q
def win_sliding(spark, d):
    """Two-hour windows every hour, in batch."""
    from ..streaming.windows import sliding

    return r6(sliding(spark.read.parquet(f"{d}/events.parquet"), "ts", "value", "2 hours", "1 hour"), "total", "most")


SQL["st_tumbling"] = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 6) + 0e0 AS total, round(max(value), 6) + 0e0 AS most
FROM events GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
SQL["st_sessions"] = """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n, round(sum(value), 6) + 0e0 AS total, round(max(value), 6) + 0e0 AS most FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
SQL["win_sliding"] = """WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s, value FROM events)
SELECT s AS start, s + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 6) + 0e0 AS total, round(max(value), 6) + 0e0 AS most FROM w GROUP BY s"""
from .signals import stft_sql  # noqa: E402

SQL["spec_kernel"] = f"WITH {stft_sql(16, 8)} SELECT vec_id, frame, bin, round(db, 2) AS db FROM sp"
SQL["io_npy_round_trip"] = f"""WITH {IQ} SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS idx, ((row_number() OVER (ORDER BY vec_id) - 1) // 100)::INTEGER AS file_no, ((row_number() OVER (ORDER BY vec_id) - 1) % 100)::BIGINT AS at,
 (label % 3)::INTEGER AS class_index, 32::INTEGER AS n, round(i::FLOAT::DOUBLE, 4) + 0e0 AS second FROM iq WHERE n = 1"""
SQL["gen_classes"] = """SELECT (row_number() OVER (ORDER BY f, k) - 1)::INTEGER AS class_index, class_name, family FROM (
 SELECT 0 AS f, 0 AS k, 'ook' AS class_name, 'ook' AS family UNION ALL SELECT 1, k, (4 * pow(2, k))::INTEGER || 'ask', 'ask' FROM (SELECT unnest(range(5)) AS k)
 UNION ALL SELECT 2, 4 * t + k, (2 * pow(2, k))::INTEGER || ['fsk', 'gfsk', 'msk', 'gmsk'][t + 1], 'fsk' FROM (SELECT unnest(range(4)) AS t) CROSS JOIN (SELECT unnest(range(4)) AS k)
 UNION ALL SELECT 3, unnest(range(6)), unnest(['bpsk', 'qpsk', '8psk', '16psk', '32psk', '64psk']), 'psk'
 UNION ALL SELECT 4, unnest(range(8)), unnest(['16qam', '32qam', '32qam_cross', '64qam', '128qam_cross', '256qam', '512qam_cross', '1024qam']), 'qam'
 UNION ALL SELECT 5, unnest(range(12)), 'ofdm-' || unnest([64, 72, 128, 180, 256, 300, 512, 600, 900, 1024, 1200, 2048]), 'ofdm'
 UNION ALL SELECT 6, 0, 'fm', 'fm' UNION ALL SELECT 7, unnest(range(4)), 'am-' || unnest(['dsb', 'dsb-sc', 'usb', 'lsb']), 'am'
 UNION ALL SELECT 8, unnest(range(3)), unnest(['lfm_data', 'lfm_radar', 'chirpss']), 'chirp' UNION ALL SELECT 9, 0, 'tone', 'tone')"""
_u = lambda op: rng.uniform_sql(7, op, "vec_id")
SQL["tf_draws"] = f"""SELECT vec_id AS sample_id, {_u('t0')} < 0.75e0 AS quantized, round(6 + 12 * {_u('t0m0.bits')}, 6) AS bits, [x.j::INTEGER for x in list_sort([{', '.join(f"{{'u': {_u(f't12.{j}')}, 'j': {j}}}" for j in range(4))}])[1:2]] AS picked FROM embeddings"""
SQL["io_configs"] = """WITH b AS (SELECT unnest(['narrowband', 'wideband']) AS band, unnest([4096, 262144]) AS n, unnest([1, 5]) AS most, unnest(['iq', 'spectrogram']) AS representation), k AS (SELECT unnest(['clean', 'impaired']) AS kind, unnest([0, 2]) AS impair), p AS (SELECT unnest(['train', 'val']) AS part, unnest([0, 1]) AS late)
SELECT band || '_' || kind || '_' || part AS config, (CASE WHEN band = 'wideband' THEN [57000, 11400] WHEN kind = 'clean' THEN [1140000, 11400] ELSE [5700000, 114000] END)[late + 1]::BIGINT AS dataset_length, (1234567890 + impair + late)::BIGINT AS seed, impair::INTEGER AS impairment_level, representation, n::BIGINT AS num_iq_samples_dataset, most::BIGINT AS num_signals_max
FROM b CROSS JOIN k CROSS JOIN p UNION ALL SELECT 'narrowband_toy', 100, 42, 0, 'iq', 4096, 1"""
_rails = "round(CASE WHEN first THEN q ELSE i END::FLOAT::DOUBLE, 6) + 0e0 AS v FROM iq CROSS JOIN (SELECT unnest([true, false]) AS first) AS f"
SQL["tf_ComplexTo2D"] = f"WITH {IQ} SELECT vec_id AS sample_id, n + CASE WHEN first THEN 0 ELSE 32 END AS k, {_rails}"
SQL["tf_InterleaveComplex"] = f"WITH {IQ} SELECT vec_id AS sample_id, 2 * n + CASE WHEN first THEN 0 ELSE 1 END AS k, {_rails}"
SQL["gen_family"] = f"""WITH c AS ({SQL['gen_classes']}), f AS (SELECT family, row_number() OVER (ORDER BY min(class_index)) - 1 AS k, list(class_name ORDER BY class_index) AS names FROM c GROUP BY family), r AS (SELECT DISTINCT run_id AS copy FROM writer_runs)
SELECT family, k::INTEGER AS family_index, names[floor({rng.uniform_sql(3, 'family', 'family', 'copy')} * len(names))::INTEGER + 1] AS class_name, copy, 256::INTEGER AS n FROM f CROSS JOIN r"""
_length = "(SELECT unnest(range(n))::BIGINT AS sample_id FROM (SELECT count(DISTINCT run_id) AS n FROM writer_runs))"
SQL["gen_source"] = SQL["io_dataset_round_trip"] = f"SELECT sample_id, 4096::INTEGER AS n, true AS same FROM {_length}"
SQL["gen_wideband"] = f"SELECT sample_id, 262144::INTEGER AS n, true AS counted, true AS inside FROM {_length.replace('count(DISTINCT run_id)', '(count(DISTINCT run_id) + 9) // 10')}"
SQL["spec_images"] = "SELECT vec_id AS sample_id, 16::INTEGER AS h, 3::INTEGER AS w, 3::INTEGER AS c, 144::INTEGER AS bytes FROM embeddings"
_kept = {k: str(v) for k, v in NARROW.metadata().items() if v is not None}
SQL["io_dataset_metadata"] = f"""WITH v AS (SELECT unnest([{', '.join(f"'{k}'" for k in _kept)}]) AS key, unnest([{', '.join(f"'{v}'" for v in _kept.values())}]) AS value), c AS ({SQL['gen_classes']})
SELECT 'dataset' AS metadata_id, key, value FROM v UNION ALL SELECT 'generator-' || class_name, key, value FROM c CROSS JOIN v UNION ALL SELECT 'generator-' || class_name, 'class_name', class_name FROM c"""
SQL["gen_modulators"] = f"SELECT class_name, copy, 8192::INTEGER AS n, true AS in_band FROM ({SQL['gen_classes']}) CROSS JOIN (SELECT unnest(range(3)) AS copy)"
