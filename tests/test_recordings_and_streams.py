"""Readers on files that are written here, and streams with rows that come late or in another order."""

import numpy as np
import pytest

from spanforge.sources import recordings
from spanforge.streaming import windows


def test_spike_lists(spark, tmp_path):
    (tmp_path / "day.clu.1").write_text("3\n0\n1\n2\n2\n")
    (tmp_path / "day.res.1").write_text("20000\n40000\n60000\n80000\n")
    (tmp_path / "day.clu.2").write_text("2\n5\n")
    (tmp_path / "day.res.2").write_text("10\n")
    got = sorted((r.session, r.electrode, r.cluster, r.t) for r in recordings.spikes(spark, str(tmp_path)).collect())
    assert got == [("day", 1, 2, 3.0), ("day", 1, 2, 4.0), ("day", 2, 5, 0.0005)]
    assert recordings.spikes(spark, str(tmp_path), unsorted=True).count() == 4
    assert [(r.session, r.n_electrodes) for r in recordings.electrodes(spark, str(tmp_path)).collect()] == [("day", 2)]


def test_sessions_positions_and_marks(spark, tmp_path):
    (tmp_path / "d1" / "s1").mkdir(parents=True)
    (tmp_path / "d1" / "s1" / "s1.clu.1").write_text("1\n1\n")
    assert [(r.day, r.session) for r in recordings.sessions(spark, str(tmp_path)).collect()] == [("d1", "s1")]
    (tmp_path / "a.whl").write_text("1\t2\t3\t4\n-1\t-1\t-1\t-1\n5\t6\t7\t8\n")
    got = sorted((r.t, r.x, r.y) for r in recordings.positions(spark, str(tmp_path / "a.whl"), 2.0).collect())
    assert got == [(0.0, 2.0, 3.0), (1.0, 6.0, 7.0)]
    (tmp_path / "a.evt").write_text("0 beginning of run\n5000 end of run\n5000.5 beginning of rest\n9000 end of rest\n")
    assert sorted((r.label, r.start, r.stop) for r in recordings.marks(spark, str(tmp_path / "a.evt")).collect()) == [("rest", 5.0005, 9.0), ("run", 0.0, 5.0)]


def test_days_session_frames_and_settings(spark, tmp_path):
    for d, s in (("d1", "s1"), ("d1", "s2"), ("d2", "s3")):
        (tmp_path / d / s).mkdir(parents=True)
        (tmp_path / d / s / f"{s}.clu.1").write_text("3\n2\n0\n3\n")
        (tmp_path / d / s / f"{s}.res.1").write_text("20000\n30000\n60000\n")
    assert {r.day: r.n_sessions for r in recordings.days(spark, str(tmp_path)).collect()} == {"d1": 2, "d2": 1}
    assert [tuple(r) for r in recordings.session_frame(spark, str(tmp_path / "d1" / "s1")).collect()] == [("s1", 1, 2, 2, 1.0, 3.0)]
    (tmp_path / "s1.xml").write_text("<?xml version='1.0'?><parameters><acquisitionSystem><nBits>16</nBits><nChannels>64</nChannels><samplingRate>20000</samplingRate></acquisitionSystem>"
                                     "<fieldPotentials><lfpSamplingRate>1250</lfpSamplingRate></fieldPotentials><neuroscope><spikes><nSamples>32</nSamples><peakSampleIndex>16</peakSampleIndex></spikes></neuroscope></parameters>")
    assert [tuple(r) for r in recordings.parameters(spark, str(tmp_path / "*.xml")).collect()] == [("s1", 20000.0, 1250.0, None, 64, 16, 32, 16)]


def test_marks_of_a_label_that_occurs_again(spark, tmp_path):
    lines = ["1000 start of run", "2000 end of run", "3000 start of rest", "4000 end of run", "5000 start of run", "6000 start of run", "9000 end of run", "9500 start of run", "note"]
    (tmp_path / "a.evt").write_text("\n".join(lines) + "\n")
    assert sorted((r.label, r.start, r.stop) for r in recordings.marks(spark, str(tmp_path / "a.evt")).collect()) == [("run", 1.0, 2.0), ("run", 5.0, 9.0)]


def test_binary_records(spark, tmp_path):
    np.arange(12, dtype="<i2").tofile(tmp_path / "a.eeg")
    got = sorted((r.channel, r.t, r.y) for r in recordings.channels(spark, str(tmp_path / "a.eeg"), 3, 10.0, [0, 2]).collect())
    assert got == [(0, 0.0, 0.0), (0, 0.1, 3.0), (0, 0.2, 6.0), (0, 0.3, 9.0), (2, 0.0, 2.0), (2, 0.1, 5.0), (2, 0.2, 8.0), (2, 0.3, 11.0)]
    v = np.zeros(3, recordings.VIDEO)
    v["time"], v["x"], v["y"] = [1_000_000, 2_000_000, 3_000_000], [10, 0, 30], [20, 0, 40]
    (tmp_path / "a.nvt").write_bytes(b"\0" * recordings.HEADER + v.tobytes())
    got = sorted((r.t, r.x, r.y) for r in recordings.video(spark, str(tmp_path / "a.nvt"), 10.0).collect())
    assert got == [(1.0, 1.0, 2.0), (3.0, 3.0, 4.0)]
    t = np.zeros(2, recordings.TETRODE)
    t["time"], t["cell"] = [5, 6], [1, 2]
    t["wave"][1, 3, 2] = 7
    (tmp_path / "a.ntt").write_bytes(b"\0" * recordings.HEADER + t.tobytes())
    got = {r.cell: r.wave for r in recordings.tetrodes(spark, str(tmp_path / "a.ntt"), 0.5).collect()}
    assert len(got[1]) == 128 and got[2][2 * 32 + 3] == 3.5


def test_results_are_not_overwritten_unasked(spark, tmp_path):
    df = spark.range(3)
    recordings.save(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)exists"):
        recordings.save(df, str(tmp_path / "r"))
    recordings.save(df.limit(1), str(tmp_path / "r"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    both = recordings.stacked({"a": df, "b": df.withColumn("x", df.id)})
    assert both.count() == 6 and both.where("x is null").count() == 3


def _run(spark, tmp_path, parts, make, mode="append"):
    """All rows that a stream gives over files that come one after the other."""
    schema = "user_id long, event_type string, ts timestamp, value double"
    src = tmp_path / "in"
    src.mkdir()
    out = []
    query = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, _: out.extend(df.collect()) and None).start()
    try:
        for k, rows in enumerate(parts):
            df = spark.createDataFrame([(u, e, t, v) for u, e, t, v in rows], "user_id long, event_type string, ts string, value double")
            line = df.toJSON().collect()
            (tmp_path / f"{k}.tmp").write_text("\n".join(line))
            (tmp_path / f"{k}.tmp").rename(src / f"{k}.json")
            query.processAllAvailable()
        return out
    finally:
        query.stop()


def _at(minute, second=0):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}"


END = [(99, "end", _at(600), 0.0)]


def test_late_rows_are_left_out_and_windows_overlap(spark, tmp_path):
    parts = [[(1, "a", _at(5), 1.0), (1, "a", _at(12), 1.0)], [(1, "a", _at(120), 1.0)], [(1, "a", _at(6), 1.0)], END]
    got = {(r.series_id, r.start.minute + 60 * r.start.hour): r.n for r in _run(spark, tmp_path, parts, lambda s: windows.sliding_counts(s, "20 minutes", "10 minutes", "10 minutes"))}
    assert got["a", 0] == 2 and got["a", 10] == 1 and ("a", 110) in got  # the late row at minute 6 is not counted


def test_tumbling_bins(spark, tmp_path):
    parts = [[(1, "a", _at(5), 1.0), (2, "b", _at(61), 1.0), (1, "a", _at(59), 1.0)], END]
    got = {(r.series_id, r.start.hour): r.n for r in _run(spark, tmp_path, parts, lambda s: windows.binned_counts(s, "1 hour", "10 minutes"))}
    assert got == {("a", 0): 2, ("b", 1): 1}


def test_sessions(spark, tmp_path):
    parts = [[(1, "a", _at(0), 1.0), (1, "a", _at(9), 1.0), (1, "a", _at(40), 1.0)], END]
    got = sorted((r.user_id, r.start.minute, r.n) for r in _run(spark, tmp_path, parts, lambda s: windows.sessions(s, "10 minutes", "1 minute")))
    assert got == [(1, 0, 2), (1, 40, 1)]


def test_changes_in_the_order_of_time(spark, tmp_path):
    parts = [[(1, "b", _at(3), 0.0), (1, "a", _at(1), 0.0)], [(1, "a", _at(2), 0.0)], [(1, "b", _at(30), 0.0)], END, [(99, "end", _at(700), 0.0)]]
    got = [(r.state, r.before) for r in sorted(_run(spark, tmp_path, parts, lambda s: windows.changes(s, "event_type", "10 minutes")), key=lambda r: r.t) if r.key == 1]
    assert got == [("a", None), ("b", "a")]


def test_runs_over_a_threshold(spark, tmp_path):
    parts = [[(1, "a", _at(1), 5.0), (1, "a", _at(3), 1.0), (1, "a", _at(2), 7.0)], [(1, "a", _at(40), 9.0), (1, "a", _at(50), 0.0)], END, [(99, "end", _at(700), 0.0)]]
    got = [(r.n, r.best) for r in sorted(_run(spark, tmp_path, parts, lambda s: windows.threshold_runs(s, "value", 4.0, "10 minutes")), key=lambda r: r.start) if r.key == 1]
    assert got == [(2, 7.0), (1, 9.0)]


def test_running_moments(spark, tmp_path):
    parts = [[(1, "a", _at(1), 1.0), (1, "a", _at(2), 3.0)], [(1, "a", _at(3), 5.0)]]
    got = _run(spark, tmp_path, parts, windows.running_moments, "update")
    assert [(r.n, r.mean) for r in got] == [(2, 2.0), (3, 3.0)] and abs(got[1]["std"] - (8 / 3) ** 0.5) < 1e-9


def test_last_values(spark, tmp_path):
    parts = [[(1, "a", _at(5), 1.0), (1, "a", _at(9), 3.0), (2, "a", _at(1), 7.0)], [(1, "a", _at(7), 8.0)], [(2, "a", _at(3), 2.0)]]
    got = _run(spark, tmp_path, parts, windows.last_values, "update")
    assert {r.key: r.value for r in got} == {1: 3.0, 2: 2.0} and sum(r.key == 1 and r.value == 8.0 for r in got) == 0
