"""One recording in many tasks with pushed filters; streams whose runs end by the watermark, across a restart."""

import numpy as np
import pytest

from spanforge.sources import ranges as source
from spanforge.streaming import processors

from .test_recordings_and_streams import _at


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    path = tmp_path_factory.mktemp("rec") / "a.eeg"
    x = np.random.default_rng(0).integers(-30_000, 30_000, (10_000, 4)).astype("<i2")
    path.write_bytes(b"head" + x.tobytes() + b"\0")  # an incomplete frame at the end
    return path, x


def test_one_file_is_read_by_many_tasks(spark, recording):
    path, x = recording
    df = source.channels(spark, str(path), 4, 1000.0, split_bytes=8000, header=4)
    assert df.rdd.getNumPartitions() == 10
    got = {(r.channel, round(r.t * 1000)): r.y for r in df.collect()}
    assert len(got) == 40_000 and all(got[c, i] == x[i, c] for i in range(0, 10_000, 97) for c in range(4))


def test_filters_are_pushed_down(spark, recording):
    path, x = recording
    df = source.channels(spark, str(path), 4, 1000.0, split_bytes=8000, header=4).where("channel = 2 and t >= 3.0 and t < 4.5")
    assert df.rdd.getNumPartitions() == 2
    assert sorted((round(r.t * 1000), r.y) for r in df.collect()) == [(i, float(x[i, 2])) for i in range(3000, 4500)]
    reader = source.ChannelReader({"path": str(path), "n_channels": "4", "fs": "1000", "split_bytes": "8000", "header": "4"})
    left = list(reader.pushFilters([source.EqualTo(("channel",), 2), source.GreaterThanOrEqual(("t",), 3.0), source.LessThan(("t",), 4.5)]))
    assert len(left) == 3 and reader.channels == [2]
    assert [(p.first, p.last) for p in reader.partitions()] == [(3000, 4000), (4000, 4501)]
    assert source.channels(spark, str(path), 4, 1000.0, header=4).where("channel in (0, 3)").count() == 20_000
    assert source.channels(spark, str(path), 4, 1000.0, header=4).where("channel = 9").count() == 0


def test_a_folder_of_files(spark, tmp_path):
    for name, n in (("a.dat", 5), ("b.dat", 3), ("c.txt", 9)):
        np.arange(n * 2, dtype="<i2").tofile(tmp_path / name)
    assert source.channels(spark, f"{tmp_path}/*.dat", 2, 10.0).count() == 16
    assert source.channels(spark, f"file://{tmp_path}/a.dat", 2, 10.0).count() == 10


def started(spark, tmp_path, make, out):
    schema = "user_id long, event_type string, ts timestamp, value double"
    (tmp_path / "in").mkdir(exist_ok=True)
    processors.use_rocksdb(spark)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    return stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, _: out.extend(df.collect()) and None).start()


def fed(spark, tmp_path, query, name, rows):
    line = spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").toJSON().collect()
    (tmp_path / f"{name}.tmp").write_text("\n".join(line))
    (tmp_path / f"{name}.tmp").rename(tmp_path / "in" / f"{name}.json")
    query.processAllAvailable()


def test_runs_end_by_the_watermark_and_survive_a_restart(spark, tmp_path):
    out = []
    make = lambda s: processors.threshold_runs(s, "value", 4.0, "10 minutes", 30 * 60 * 1_000_000)
    query = started(spark, tmp_path, make, out)
    fed(spark, tmp_path, query, "1", [(1, "a", _at(3), 1.0), (1, "a", _at(2), 7.0), (1, "a", _at(1), 5.0), (2, "a", _at(5), 9.0)])
    query.stop()
    query = started(spark, tmp_path, make, out)  # rows that wait and timers come from the checkpoint folder
    fed(spark, tmp_path, query, "2", [(2, "a", _at(20), 8.0), (1, "a", _at(40), 6.0)])
    fed(spark, tmp_path, query, "3", [(99, "end", _at(300), 0.0)])
    fed(spark, tmp_path, query, "4", [(99, "end", _at(301), 0.0)])
    query.stop()
    minute = lambda t: (t // 60_000_000) % 1440
    # no further row of keys 1 and 2 came: their last runs were ended by time alone
    assert sorted((r.key, minute(r.start), minute(r.stop), r.n, r.best) for r in out) == [(1, 1, 2, 2, 7.0), (1, 40, 40, 1, 6.0), (2, 5, 20, 2, 9.0)]


def test_changes_are_forgotten(spark, tmp_path):
    out = []
    query = started(spark, tmp_path, lambda s: processors.changes(s, "event_type", "10 minutes", 60 * 60 * 1_000_000), out)
    fed(spark, tmp_path, query, "1", [(1, "b", _at(3), 0.0), (1, "a", _at(1), 0.0)])
    fed(spark, tmp_path, query, "2", [(1, "a", _at(2), 0.0), (1, "b", _at(30), 0.0), (1, "b", _at(120), 0.0)])
    fed(spark, tmp_path, query, "3", [(99, "end", _at(300), 0.0)])
    fed(spark, tmp_path, query, "4", [(99, "end", _at(301), 0.0)])
    query.stop()
    got = [(r.t // 60_000_000 % 1440, r.state, r.before) for r in sorted(out, key=lambda r: r.t) if r.key == 1]
    assert got == [(1, "a", None), (3, "b", "a"), (120, "b", None)]
