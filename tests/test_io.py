import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.kernels.assemble import DatasetConfig
from burstlake.operators import pipeline
from burstlake.sources import dataset, detection, generator, npy, sigmf

SMALL = DatasetConfig(dataset_length=6, seed=4, num_iq_samples_dataset=1024, fft_size=64, fft_stride=64, num_signals_max=2, signal_duration_in_samples_min=200, signal_duration_in_samples_max=500, bandwidth_min=5e5, bandwidth_max=1e6)


def changed(**k):
    return DatasetConfig(**({f: getattr(SMALL, f) for f in SMALL.__dataclass_fields__} | k))


def test_generation_does_not_depend_on_partitions(spark):
    a = {r.sample_id: r for r in generator.generate(spark, changed(impairment_level=1), 1).collect()}
    b = {r.sample_id: r for r in generator.generate(spark, changed(impairment_level=1), 5).collect()}
    assert a == b and len(a) == 6


def test_store_and_read(spark, tmp_path):
    root = str(tmp_path / "d")
    df = generator.generate(spark, SMALL)
    assert dataset.write_dataset(df, root, SMALL)
    back = {r.sample_id: r for r in dataset.read_dataset(spark, root).collect()}
    want = {r.sample_id: r for r in df.collect()}
    for k, r in want.items():
        assert back[k].i == r.i and [c.start_in_samples for c in back[k].components] == [c.start_in_samples for c in r.components]
    one = dataset.read_dataset(spark, root, 3)
    assert one.count() == 1 and "sample_id" in one._jdf.queryExecution().executedPlan().toString()
    for bad in (-1, 6):
        with pytest.raises(IndexError):
            dataset.read_dataset(spark, root, bad)
    with pytest.raises(ValueError):
        dataset.read_dataset(spark, str(tmp_path / "none"))
    # kept as it is, refused when it differs or is partial
    mark = os.path.join(root, "mark")
    open(mark, "w").close()
    assert dataset.write_dataset(df, root, SMALL, overwrite=False) is False and os.path.exists(mark)
    with pytest.raises(RuntimeError):
        dataset.write_dataset(df, root, changed(seed=5), overwrite=False)
    f = dataset.Folder(spark, root)
    f.write("writer_info.yaml", "complete: false\n")
    with pytest.raises(RuntimeError):
        dataset.write_dataset(df, root, SMALL, overwrite=False)
    assert dataset.write_dataset(df, root, SMALL) and not os.path.exists(mark)


def test_truncation_and_too_few(spark, tmp_path):
    df = generator.generate(spark, SMALL)
    dataset.write_dataset(df, str(tmp_path / "a"), SMALL, length=4)
    assert dataset.read_dataset(spark, str(tmp_path / "a")).count() == 4
    with pytest.raises(RuntimeError):
        dataset.write_dataset(df, str(tmp_path / "b"), SMALL, length=9)
    assert "complete: false" in dataset.Folder(spark, str(tmp_path / "b")).read("writer_info.yaml")


def test_metadata_inheritance(spark, tmp_path):
    dataset.write_dataset(generator.generate(spark, changed(classes=("psk",))), str(tmp_path / "m"), changed(classes=("psk",)))
    m = {(r.metadata_id, r.key): r.value for r in dataset.read_metadata(spark, str(tmp_path / "m")).collect()}
    assert m["generator-bpsk", "class_name"] == "bpsk" and m["generator-bpsk", "fft_size"] == "64"


def test_targets_and_yolo(spark):
    df = generator.with_yolo(generator.generate(spark, SMALL))
    r = df.where(F.size("components") > 0).first()
    c, y = r.components[0], r.yolo[0]
    assert y.cx == pytest.approx((c.start_in_samples + c.duration_in_samples / 2) / 1024) and y.h == pytest.approx(c.bandwidth / 1e7) and y.cy == pytest.approx(1 - (5e6 + c.center_freq) / 1e7)
    assert generator.select_targets(df, None, False).columns == df.columns
    assert generator.select_targets(df, [], False).columns == ["sample_id", "i", "q"]
    one = generator.select_targets(df, ["class_name"], True).where("sample_id = %d" % r.sample_id).first()
    assert one.targets == c.class_name
    two = generator.select_targets(df, ["class_name", "snr_db"], False).where("sample_id = %d" % r.sample_id).first()
    assert two.targets[0][0] == c.class_name and float(two.targets[1][0]) == c.snr_db


def test_detection_export(spark, tmp_path):
    df = pipeline.images(generator.with_yolo(generator.generate(spark, SMALL)), 64)
    assert detection.export(df, str(tmp_path / "y"), ["a"]) == 6
    assert open(tmp_path / "y/images/train/0.png", "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    r = df.where("sample_id = 0").first()
    lines = open(tmp_path / "y/labels/train/0.txt").read().split("\n")
    assert len([x for x in lines if x]) == len(r.yolo)


def test_yaml_configs():
    text = "schema_version: 1\ndataset_id: x\ndataset_length: 7\nseed: 3\nimpairment_level: 2\noutput: {representation: spectrogram}\nsignal_sampling: {mode: per_family}\ndataset_metadata: {num_iq_samples_dataset: 4096, fft_size: 64, fft_stride: 64, custom: 1}\n"
    c = dataset.load_config(text)
    assert (c.dataset_length, c.representation, c.sampling, c.extra) == (7, "spectrogram", "per_family", {"custom": 1, "dataset_id": "x"})
    for bad in ("[1]", "seed: 1\ndataset_metadata: {}\n", text.replace("dataset_length: 7", "dataset_length: 0"), text.replace("spectrogram", "zzz"), text.replace("schema_version: 1", "schema_version: 9")):
        with pytest.raises(ValueError):
            dataset.load_config(bad)
    assert len(dataset.shipped_configs()) == 9 and "seed" in dataset.describe(c)
    assert "[1, 2]" in dataset.to_yaml({"a": [1, 2]})
    assert dataset.same({"a": [1, 2.0]}, {"a": (1.0, 2.0 + 1e-12)}) and not dataset.same({"a": 1}, {"a": True}) and not dataset.same([1], [1, 2])


def npy_dir(path, sizes=(2, 3, 1), lines=6, info=6):
    os.makedirs(path)
    for k, n in enumerate(sizes):
        np.save(path / f"data_{k}.npy", np.array([[m + 10j * k] * 4 for m in range(n)], np.complex64))
    with open(path / "metadata.csv", "w") as f:
        f.writelines(f"{k % 2},{('BPSK', 'qpsk', 'Noise', 'other')[k % 4]},{k},1e6\n" for k in range(lines))
    if info is not None:
        with open(path / "info.json", "w") as f:
            f.write(info if isinstance(info, str) else json.dumps({"size": info}))
    return str(path)


def test_npy(spark, tmp_path):
    root = npy_dir(tmp_path / "n")
    got = {r.idx: r for r in npy.read_dataset(spark, root).collect()}
    assert [(got[k].file_no, got[k].at, got[k].i[0], got[k].q[0]) for k in range(6)] == [(0, 0, 0, 0), (0, 1, 1, 0), (1, 0, 0, 10), (1, 1, 1, 10), (1, 2, 2, 10), (2, 0, 0, 20)]
    assert [got[k].class_index for k in range(4)] == [0, 1, 2, None] and got[4].meta_index == 0 and got[5].modcod == 5
    spark.dataSource.register(npy.NpyDataSource)
    src = {r.idx: r for r in spark.read.format("npy_captures").load(root).collect()}
    assert src[4].q == got[4].q and len(src) == 6
    out = str(tmp_path / "out")
    spark.read.format("npy_captures").load(root).orderBy("idx").coalesce(1).write.format("npy_captures").mode("overwrite").save(out)
    back = {r.idx: r for r in spark.read.format("npy_captures").load(out).collect()}
    assert {k: (r.i, r.q) for k, r in back.items()} == {k: (r.i, r.q) for k, r in src.items()} and npy.read_info(out) == 6
    assert npy.read_dataset(spark, npy_dir(tmp_path / "short", info=4)).count() == 4  # info.json decides
    for k, (info, error) in enumerate(((None, FileNotFoundError), ("{", ValueError), ('{"size": -1}', ValueError), ('{"size": "x"}', ValueError), (7, IndexError))):
        with pytest.raises(error):
            npy.read_dataset(spark, npy_dir(tmp_path / f"bad{k}", info=info))
    with pytest.raises(ValueError):
        npy.read_dataset(spark, str(tmp_path / "none"))


def test_sigmf(spark, tmp_path):
    x = np.arange(40, dtype="<f4")
    x.tofile(tmp_path / "r.sigmf-data")
    with open(tmp_path / "r.sigmf-meta", "w") as f:
        json.dump({"global": {"core:datatype": "cf32_le", "core:sample_rate": 1e6}, "annotations": [{"core:sample_start": 2, "core:sample_count": 3, "core:label": "bpsk"}, {"core:sample_start": 18, "core:sample_count": 9, "core:label": "x", "core:comment": "c"}]}, f)
    got = sigmf.read_signals(spark, str(tmp_path)).orderBy("ann_no").collect()
    assert got[0].i == [4.0, 6.0, 8.0] and got[0].q == [5.0, 7.0, 9.0] and got[0].label == "bpsk"
    assert got[1].duration_in_samples == 2 and got[1].comment == "c"


def test_bursts_source_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(generator.BurstDataSource)
    cfg = generator.config_json(SMALL)
    batch = {r.sample_id: r.i for r in spark.read.format("bursts").option("config", cfg).option("per_partition", 4).load().collect()}
    want = {r.sample_id: r.i for r in generator.generate(spark, SMALL, impair=False).collect()}
    assert batch == want
    q = spark.readStream.format("bursts").option("config", cfg).option("per_trigger", 2).load().select("sample_id").writeStream.format("memory").queryName("bursts_seen").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        import time

        for _ in range(200):
            if spark.table("bursts_seen").count() >= 4:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    seen = sorted(r.sample_id for r in spark.table("bursts_seen").collect())
    assert len(seen) >= 4 and seen == list(range(len(seen)))


def test_agc_over_chunks_equals_one_array(spark, tmp_path):
    from burstlake.kernels import channel
    from burstlake.streaming.agc import OUT, agc_stream

    r = np.random.default_rng(2)
    x = {k: (r.normal(size=60) + 1j * r.normal(size=60)).astype(np.complex64) for k in (1, 2)}
    x[2][0] = 0
    for c in range(3):
        rows = [(k, c * 2 + h, v[c * 20 + h * 10 : c * 20 + h * 10 + 10].real.tolist(), v[c * 20 + h * 10 : c * 20 + h * 10 + 10].imag.tolist()) for k, v in x.items() for h in (1, 0)]
        spark.createDataFrame(rows, OUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(OUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    p = {"alpha_smooth": 0.1, "alpha_acquire": 0.05}
    agc_stream(src, **p).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    for k, v in x.items():
        got = spark.read.parquet(str(tmp_path / "out")).where(f"signal_id = {k}").orderBy("chunk").collect()
        y = np.concatenate([np.array(g.i) + 1j * np.array(g.q) for g in got])
        assert np.allclose(y, channel.agc(v.astype(complex), **p), atol=1e-4)


def test_windows_drop_late_rows(spark, tmp_path):
    import datetime as dt

    from burstlake.streaming.windows import tumbling

    t = dt.datetime(2031, 1, 1)
    s = "ts timestamp, value double"
    for k, rows in enumerate(([(t, 1.0), (t + dt.timedelta(hours=5), 2.0)], [(t + dt.timedelta(minutes=5), 9.0), (t + dt.timedelta(hours=9), 3.0)])):
        spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(s).parquet(str(tmp_path / "in"))
        tumbling(src, "ts", "value", "1 hour", (), "30 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    got = {r.start.hour: r.total for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {0: 1.0, 5: 2.0}


def test_data_module(spark, tmp_path):
    from burstlake.sources.loader import DataModule, batches, split_counts

    c = changed(target_labels=("class_index",), dataset_length=10)
    m = DataModule(spark, str(tmp_path / "m"), c, (6, 3, 1), batch_size=4, transforms=("ChannelSwap",))
    assert m.prepare() and m.prepare() is False
    seen = list(m.train())
    assert [len(b["sample_id"]) for b in seen] == [4, 2] and seen[0]["data"].shape == (4, 1024)
    ids = [k for part in (m.train(1), m.val(), m.test()) for b in part for k in b["sample_id"]]
    assert sorted(ids) == list(range(10)) and [k for b in m.train() for k in b["sample_id"]] != [k for b in m.train(1) for k in b["sample_id"]]
    for bad in ((0.5, 0.2, 0.1), (9, 9, 9), (0.5, 0.5)):
        with pytest.raises(ValueError):
            DataModule(spark, "x", c, bad)
    ragged = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0, 3.0], None)], "k bigint, v array<double>, s string").coalesce(1)
    (b,) = batches(ragged.orderBy("k"), 5)
    assert b["v"].tolist() == [[1, 0], [2, 3]] and b["s"] == ["a", None]
    n = split_counts(spark.range(3000), "id", {"a": 1000, "b": 500}).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in n} == {"a": 1000, "b": 500}


def test_split_by_counts_covers_the_table(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    spark.range(1999).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = sorted(map(tuple, e.queries()["ds_split_counts"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(e.oracle_sql()["ds_split_counts"]).fetchall()) and len({k for k, _ in got}) == 1999
    n = [sum(p == x for _, p in got) for x in ("train", "val", "test")]
    assert n == [1427, 428, 144]


def test_metadata_is_inherited_at_any_depth(spark):
    rows = [("a", None, "x", "1"), ("a", None, "y", "2"), ("b", "a", "y", "3"), ("c", "b", "z", "4"), ("d", "c", "w", "5"), ("e", "d", "x", "6"), ("l", "m", "x", "7"), ("m", "l", "y", "8")]
    m = spark.createDataFrame(rows, "metadata_id string, parent_metadata_id string, key string, value string")
    got = {(r.metadata_id, r.key): r.value for r in dataset.inherited(m).collect()}
    assert {k: got["d", k] for k in "wxyz"} == {"w": "5", "x": "1", "y": "3", "z": "4"} and got["e", "x"] == "6" and got["e", "w"] == "5" and got["l", "x"] == "7"
