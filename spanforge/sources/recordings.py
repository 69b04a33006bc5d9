"""Readers of recordings: spike lists, positions, marks, sampled channels and fixed-size records.

Text files are read whole, one row a file, and cut into numbered lines by built-in functions, because
two files of a pair belong together line by line; binary files come through ``binaryFile``.
A task holds a file; recordings are many files of some megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, line) of all files that match."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n").alias("l"))
    return whole.select("path", F.posexplode("l").alias("place", "line"))


def _named(rows: DataFrame) -> DataFrame:
    """session and electrode of paths like .../name.kind.3"""
    file = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("session", F.regexp_extract(file, r"^(.*)\.\w+\.\d+$", 1)).withColumn("electrode", F.regexp_extract(file, r"\.(\d+)$", 1).cast("int"))


def spikes(spark: SparkSession, folder: str, fs: float = 20_000.0, unsorted: bool = False) -> DataFrame:
    """(session, electrode, cluster, t): pairs of ``name.clu.N`` (cluster numbers behind their count) and
    ``name.res.N`` (sample numbers).  Cluster 0 is noise and left out, 1 is unsorted."""
    clu = _named(_lines(spark, f"{folder}/*.clu.*")).where("place > 0").select("session", "electrode", (F.col("place") - 1).alias("place"), F.trim("line").cast("int").alias("cluster"))
    res = _named(_lines(spark, f"{folder}/*.res.*")).select("session", "electrode", "place", (F.trim("line").cast("double") / fs).alias("t"))
    return clu.join(res, ["session", "electrode", "place"]).where(F.col("cluster") > (0 if unsorted else 1)).drop("place")


def electrodes(spark: SparkSession, folder: str) -> DataFrame:
    """(session, n_electrodes) by the cluster files that are there."""
    files = _named(spark.read.format("binaryFile").option("pathGlobFilter", "*.clu.*").load(folder).select("path"))
    return files.groupBy("session").agg(F.countDistinct("electrode").alias("n_electrodes"))


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """(day, session) of folders root/day/session with cluster files."""
    parts = F.split("path", "/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.clu.*").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(F.element_at(parts, -3).alias("day"), F.element_at(parts, -2).alias("session")).distinct()


def days(spark: SparkSession, root: str) -> DataFrame:
    """(day, n_sessions) of folders root/day/session with cluster files."""
    return sessions(spark, root).groupBy("day").agg(F.count("*").alias("n_sessions"))


def session_frame(spark: SparkSession, folder: str, fs: float = 20_000.0, unsorted: bool = False) -> DataFrame:
    """(session, electrode, n_clusters, n_spikes, first, last): what each electrode of a session recorded, times in seconds."""
    return spikes(spark, folder, fs, unsorted).groupBy("session", "electrode").agg(F.countDistinct("cluster").alias("n_clusters"), F.count("*").alias("n_spikes"), F.min("t").alias("first"), F.max("t").alias("last"))


#: Where the settings of a recording stand in its XML file: fixed values of the file format.
SETTINGS = ("acquisitionSystem struct<nBits:int, nChannels:int, samplingRate:double>, fieldPotentials struct<lfpSamplingRate:double>, "
            "video struct<samplingRate:double, width:int, height:int>, neuroscope struct<spikes:struct<nSamples:int, peakSampleIndex:int>>")


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """(session, fs_wideband, fs_lfp, fs_video, n_channels, n_bits, snippet_len, snippet_peak) from XML files of settings; null where a file has none."""
    x = spark.read.format("xml").option("rowTag", "parameters").schema(SETTINGS).load(path).withColumn("_file", F.input_file_name())
    name = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.xml$", "")
    return x.select(name.alias("session"), F.col("acquisitionSystem.samplingRate").alias("fs_wideband"), F.col("fieldPotentials.lfpSamplingRate").alias("fs_lfp"), F.col("video.samplingRate").alias("fs_video"),
                    F.col("acquisitionSystem.nChannels").alias("n_channels"), F.col("acquisitionSystem.nBits").alias("n_bits"), F.col("neuroscope.spikes.nSamples").alias("snippet_len"), F.col("neuroscope.spikes.peakSampleIndex").alias("snippet_peak"))


def positions(spark: SparkSession, path: str, fs: float, pairs: bool = True) -> DataFrame:
    """(path, t, x, y) from lines of tab-separated numbers, of two diodes (``pairs``) or one; lines with -1 are left out."""
    v = F.transform(F.split(F.trim("line"), r"\s+"), lambda c: c.cast("double"))
    rows = _lines(spark, path).select("path", (F.col("place") / fs).alias("t"), v.alias("v")).where(~F.exists("v", lambda c: c < 0))
    x, y = ((F.col("v")[0] + F.col("v")[2]) / 2, (F.col("v")[1] + F.col("v")[3]) / 2) if pairs else (F.col("v")[0], F.col("v")[1])
    return rows.select("path", "t", x.alias("x"), y.alias("y"))


def marks(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, start, stop) in seconds from lines "milliseconds start|stop label": each start with its next stop.

    A start before the last one of its label was stopped, and a stop without a start, are left out.
    """
    m = _lines(spark, path).select("path", "place", (F.regexp_extract("line", r"^\s*([\d.]+)", 1).cast("double") / 1000).alias("t"),
                                   F.lower(F.regexp_extract("line", r"(?i)\b(beginning|start|stop|end)\b", 1)).alias("kind"),
                                   F.trim(F.regexp_replace("line", r"(?i)^\s*[\d.]+\s+(beginning|start|stop|end)(\s+of)?\s*", "")).alias("label"))
    first, last = F.col("kind").isin("beginning", "start"), F.col("kind").isin("stop", "end")
    ends = m.where(first | last).withColumn("_up", first)
    w = Window.partitionBy("path", "label").orderBy("t", "place")
    pairs = ends.withColumn("_new", F.col("_up") & ~F.coalesce(F.lag("_up").over(w), F.lit(False)))
    pairs = pairs.withColumn("stop", F.first(F.when(last, F.col("t")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return pairs.where("_new and stop is not null").select("path", "label", F.col("t").alias("start"), "stop")


def channels(spark: SparkSession, path: str, n_channels: int, fs: float, picked: list[int] | None = None) -> DataFrame:
    """(path, channel, t, y) of 16-bit samples of several channels by turns."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                x = np.frombuffer(raw, "<i2")
                x = x[: len(x) // n_channels * n_channels].reshape(-1, n_channels)
                for at in range(0, len(x), 1 << 20):
                    part = x[at : at + (1 << 20)]
                    for c in picked if picked is not None else range(n_channels):
                        yield pd.DataFrame({"path": name, "channel": np.int32(c), "t": (at + np.arange(len(part))) / fs, "y": part[:, c].astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, channel int, t double, y double")


#: Layouts of fixed-size records behind a header of 16,384 bytes: fixed values of the file formats.
VIDEO = np.dtype([("start", "<u2"), ("id", "<u2"), ("size", "<u2"), ("time", "<u8"), ("points", "<u4", 400), ("crc", "<i2"), ("x", "<i4"), ("y", "<i4"), ("angle", "<i4"), ("targets", "<i4", 50)])
TETRODE = np.dtype([("time", "<u8"), ("channel", "<u4"), ("cell", "<u4"), ("params", "<u4", 8), ("wave", "<i2", (32, 4))])
HEADER = 16_384


def _records(spark: SparkSession, path: str, layout: np.dtype, columns: dict[str, str], make) -> DataFrame:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                n = max(0, len(raw) - HEADER) // layout.itemsize
                r = np.frombuffer(raw, layout, n, HEADER) if n else np.zeros(0, layout)
                for at in range(0, n, 1 << 16):
                    yield make(name, r[at : at + (1 << 16)])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, ", ".join(f"{k} {v}" for k, v in columns.items()))


def video(spark: SparkSession, path: str, pixels_per_cm: float | None = None) -> DataFrame:
    """(path, t, x, y, angle) of video tracking; t in seconds; records at 0, 0 were not tracked and are left out."""
    by = pixels_per_cm or 1.0

    def make(name: str, r: np.ndarray) -> pd.DataFrame:
        r = r[(r["x"] != 0) | (r["y"] != 0)]
        return pd.DataFrame({"path": name, "t": r["time"] / 1e6, "x": r["x"] / by, "y": r["y"] / by, "angle": r["angle"].astype(np.int32)})

    return _records(spark, path, VIDEO, {"path": "string", "t": "double", "x": "double", "y": "double", "angle": "int"}, make)


def tetrodes(spark: SparkSession, path: str, volts_per_bit: float | None = None) -> DataFrame:
    """(path, t, cell, wave) of spikes on four wires; wave: 32 samples of each wire, in volts if the factor is given."""
    def make(name: str, r: np.ndarray) -> pd.DataFrame:
        wave = np.swapaxes(r["wave"], 1, 2).reshape(len(r), 128) * (volts_per_bit or 1.0)
        return pd.DataFrame({"path": name, "t": r["time"] / 1e6, "cell": r["cell"].astype(np.int64), "wave": list(wave)})

    return _records(spark, path, TETRODE, {"path": "string", "t": "double", "cell": "long", "wave": "array<double>"}, make)


def save(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results as Parquet; a path that is there already is an error unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def stacked(measures: dict[str, DataFrame]) -> DataFrame:
    """Measures of several subjects in one table, with the column subject."""
    out = None
    for name, df in measures.items():
        own = df.withColumn("subject", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
