import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywave.sources import files
from skywave.sources.recordings import pgm_header, read_samples, read_snapshots, sample_type, write_snapshots
from skywave.streaming import feed, memory
from skywave.streaming import frames as st

START = datetime.datetime(2024, 1, 1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def frame(channel, k, seconds=None):
    patches = [0, 1, 2] if k % 3 else [0, 2, 5]
    at = START + datetime.timedelta(seconds=10 * k if seconds is None else seconds)
    return (channel, k, at, patches, [((channel * 7 + k * k + x) % 10) / 10 for x in patches], [float(k), channel + 0.5])


END = (99, 0, START + datetime.timedelta(days=1), [0], [0.0], [0.0])


def put(spark, path, rows, schema=memory.FRAMES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, path, name, checkpoint, lateness, idle_ms=None):
    """Takes all there is, a file a batch, in the order of arrival, and gives what has come out so far."""
    frames = spark.readStream.schema(memory.FRAMES).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = memory.remember_stream(frames, lateness, idle_ms).writeStream.format("parquet").option("path", f"{checkpoint}-{name}").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(repr, spark.read.schema(memory.OUT).parquet(f"{checkpoint}-{name}").where("channel < 90").collect()))


def test_late_and_shuffled_frames_give_the_batch_result_across_a_restart(spark, tmp_path):
    rows = [frame(c, k) for c in range(3) for k in range(6)]
    want = sorted(map(repr, memory.remember_batch(spark.createDataFrame(rows, memory.FRAMES)).collect()))
    for k in (1, 3, 2):
        put(spark, tmp_path / "in", [r for r in rows if r[1] == k])
    assert run(spark, tmp_path / "in", "out", tmp_path / "state", "60 seconds") == []
    for k in (0, 5, 4):  # a new run goes on from the state of the first
        put(spark, tmp_path / "in", [r for r in rows if r[1] == k])
    put(spark, tmp_path / "in", [END])
    assert run(spark, tmp_path / "in", "out", tmp_path / "state", "60 seconds") == want
    before = {r.frame_id: r.before for r in memory.remember_batch(spark.createDataFrame(rows, memory.FRAMES)).where("channel = 0").collect()}
    assert before[0] == [None] * 3 and before[1] == [rows[0][4][0], None, rows[0][4][1]]


def test_frames_beyond_the_lateness_are_dropped_and_counted(spark, tmp_path):
    for rows in ([frame(1, 0), frame(1, 2)], [frame(1, 9)], [frame(2, 9, 91)], [frame(1, 1), frame(1, 10)], [END]):
        put(spark, tmp_path / "in", rows)
    run(spark, tmp_path / "in", "out", tmp_path / "state", "5 seconds")
    got = {r.frame_id: r.dropped for r in spark.read.parquet(f"{tmp_path}/state-out").where("channel = 1").collect()}
    assert got == {0: 0, 2: 0, 9: 1, 10: 1}  # frame 1 came when 2 had been taken and 9 was waiting


def test_a_silent_channel_is_forgotten(spark, tmp_path):
    for rows in ([frame(1, 0)], [frame(2, 30)], [frame(2, 31)], [frame(2, 32)], [frame(1, 40)], [frame(2, 42)], [END]):
        put(spark, tmp_path / "in", rows)
    run(spark, tmp_path / "in", "out", tmp_path / "state", "1 seconds", idle_ms=60_000)
    got = {r.frame_id: (r.before[0], r.profile) for r in spark.read.parquet(f"{tmp_path}/state-out").where("channel = 1").collect()}
    assert got[40] == (None, [40.0, 1.5])


def test_means_in_a_stream_are_those_of_the_batch_form(spark, tmp_path):
    rows = [(c, k, START + datetime.timedelta(seconds=k), ((c + k * k) % 10) / 10) for c in range(2) for k in range(4)]
    schema = "channel long, frame_id long, at timestamp, mean_p double"
    want = sorted(map(tuple, st.carry_batch(spark.createDataFrame(rows, schema).drop("at")).collect()))
    for k in (0, 2, 1, 3):
        put(spark, tmp_path / "in", [r for r in rows if r[1] == k], schema)
    put(spark, tmp_path / "in", [(99, 0, START + datetime.timedelta(days=1), 0.0)], schema)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    st.carry_stream(source, "1 minute").writeStream.format("memory").queryName("means").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r)[:5] for r in spark.sql("select * from means where channel < 90").collect()) == want


def snapshots(spark, folder, times):
    rng = np.random.default_rng(5)
    for k in times:
        x = rng.normal(60, 4, (40, 64)).round()
        x[10:30, 20:36] += 60
        (folder / f"s_ch{k % 2}_{k}000_40x64.pgm").write_bytes(b"P5\n# made\n64 40\n255\n" + x.clip(0, 255).astype(np.uint8).tobytes())


def test_feed_takes_each_snapshot_once_after_a_failure(spark, tmp_path, monkeypatch):
    folder, root, state = tmp_path / "in", str(tmp_path / "run"), str(tmp_path / "state")
    folder.mkdir()
    snapshots(spark, folder, range(1, 6))
    real, calls = feed.write_run, []
    bright = lambda cells, axis: cells.where("power_db > 100").groupBy("capture_id", "f").agg(F.min("t").alias("time_start"), F.count("*").alias("filled_area"))
    go_on = lambda: feed.start_detection(spark, str(folder), root, state, detector=bright, files_a_trigger=2, until_done=True).awaitTermination()

    def failing(tables, at):
        calls.append(list(tables))
        if len(calls) == 4:  # the second batch has written its boxes, and its captures fail
            raise RuntimeError("killed")
        real(tables, at)

    monkeypatch.setattr(feed, "write_run", failing)
    with pytest.raises(Exception, match="killed"):
        go_on()
    monkeypatch.setattr(feed, "write_run", real)
    snapshots(spark, folder, [6])
    go_on()
    captures = spark.read.parquet(f"{root}/captures").collect()
    assert sorted(r.epoch_ms for r in captures) == [1000 * k for k in range(1, 7)] and {r.n_cells for r in captures} == {2560}
    cells = read_snapshots(spark, str(folder))
    want = sorted(map(tuple, bright(cells, None).collect()))
    got = sorted((r.capture_id, r.f, r.time_start, r.filled_area) for r in spark.read.parquet(f"{root}/boxes").collect())
    assert got == want and {r[0] for r in got} == {r.capture_id for r in captures}


def test_a_long_backlog_goes_in_few_batches(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    assert feed.backlog_files(spark, str(folder), 2) == 2
    snapshots(spark, folder, range(1, 25))
    bright = lambda cells, axis: cells.where("power_db > 100").groupBy("capture_id", "f").agg(F.min("t").alias("time_start"))
    feed.start_detection(spark, str(folder), f"{tmp_path}/run", f"{tmp_path}/state", detector=bright, files_a_trigger=2, until_done=True).awaitTermination()
    captures = spark.read.parquet(f"{tmp_path}/run/captures").collect()
    assert len(captures) == 24 and len({r.batch_id for r in captures}) == feed.BACKLOG_BATCHES  # not 12
    monkeypatch.setattr(feed, "BACKLOG_BYTES", 10)
    assert feed.backlog_files(spark, str(folder), 2) == 2


def test_feed_as_patch_maps(spark, tmp_path):
    snapshots(spark, tmp_path, [1, 3])
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content", F.lit(1).alias("channel"), F.regexp_extract("path", r"_(\d+)_40x64", 1).cast("long").alias("epoch_ms"))
    got = sorted(feed.snapshot_frames(raw, 8, 5).collect(), key=lambda r: r.frame_id)
    x = files.parse_pgm((tmp_path / "s_ch1_1000_40x64.pgm").read_bytes()).T / 255
    want = x.reshape(8, 8, 5, 8).mean((1, 3))
    assert [r.frame_id for r in got] == [1000, 3000] and np.allclose(got[0].p, want.ravel()) and np.allclose(got[0].profile, want.mean(1)) and got[0].patch == list(range(40))
    assert memory.remember_batch(feed.snapshot_frames(raw, 8, 5)).count() == 2


@pytest.mark.parametrize("datatype", ["ci16_le", "cf32_be", "ri8", "cu8"])
def test_sample_source_reads_windows_by_ranges(spark, tmp_path, datatype):
    rng = np.random.default_rng(3)
    number, pair = sample_type(datatype)
    z = rng.integers(0, 100, (500, 2, 2 if pair else 1)).astype(number)  # two channels
    (tmp_path / "r.sigmf-data").write_bytes(z.tobytes())
    (tmp_path / "r.sigmf-meta").write_text('{"global": {"core:datatype": "%s", "core:sample_rate": 100, "core:num_channels": 2}, "captures": [{"core:sample_start": 0}, {"core:sample_start": 50}]}' % datatype)
    d = read_samples(spark, str(tmp_path), 1.0, 2.0, capture_index=1, channel=1, part_bytes=97)
    got = sorted(map(tuple, d.collect()))
    want = z[150:350, 1].astype(float)
    assert got == [("r", n, want[n, 0], want[n, 1] if pair else 0.0) for n in range(200)]
    assert d.rdd.getNumPartitions() > 4
    narrow = d.where("n >= 20 and n < 25 and capture_id = 'r'")
    assert narrow.count() == 5 and narrow.rdd.getNumPartitions() == 1 and d.where("capture_id = 'other'").count() == 0
    assert read_samples(spark, str(tmp_path), 4.5, 100.0).count() == 50
    with pytest.raises(Exception, match="starts outside"):
        read_samples(spark, str(tmp_path), 6.0).count()
    with pytest.raises(ValueError, match="unknown"):
        sample_type("cx16_le")


def test_a_window_of_a_large_recording_reads_its_own_bytes(spark, tmp_path):
    with open(tmp_path / "big.sigmf-data", "wb") as f:
        f.truncate(3 << 30)  # sparse: beyond what one row of a binary file can hold
        f.seek(4 * 500_000_123)
        f.write(np.array([7, -3], "<i2").tobytes())
    (tmp_path / "big.sigmf-meta").write_text('{"global": {"core:datatype": "ci16_le", "core:sample_rate": 1000000}}')
    d = read_samples(spark, str(tmp_path), 500.0, 1.0, part_bytes=1 << 20)
    assert d.rdd.getNumPartitions() == 4  # 4 MB of 3 GB
    assert [tuple(r) for r in d.where("i <> 0").collect()] == [("big", 123, 7.0, -3.0)] and d.count() == 1_000_000


def test_snapshot_source_and_writer(spark, tmp_path):
    rng = np.random.default_rng(4)
    cells = [(f"c{k}.{kind}", f, t, float(rng.integers(0, 255))) for k in range(2) for kind in ("pgm", "npy") for f in range(5) for t in range(9)]
    frame_ = spark.createDataFrame(cells, "capture_id string, f int, t int, power_db double")
    for kind in ("pgm", "npy"):
        assert write_snapshots(frame_.where(F.col("capture_id").endswith(kind)), str(tmp_path), kind) == 2
    d = read_snapshots(spark, str(tmp_path), part_bytes=11)
    got = sorted((r.capture_id, r.f, r.t, round(r.power_db, 6)) for r in d.collect())
    assert got == sorted(cells) and d.rdd.getNumPartitions() > 10
    assert d.where("t >= 3 and t < 5 and capture_id = 'c1.pgm'").count() == 10
    old = files.read_pgm(spark, f"{tmp_path}/c0.pgm")
    assert old.exceptAll(d.where("capture_id = 'c0.pgm'")).count() == 0
    assert pgm_header(b"P5 # x\n3 2\n255\nabcdef") == (3, 2, 15)
    (tmp_path / "short.pgm").write_bytes(b"P5\n3 2\n255\nabc")
    with pytest.raises(Exception, match="size its header"):
        read_snapshots(spark, str(tmp_path)).count()
