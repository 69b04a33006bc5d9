"""A data source for recordings of many gigabytes: one file is read by many tasks.

``spark.read.format("sampled_channels")`` gives (path, channel, t, y) of 16-bit samples of several channels by turns.
A file's whole frames (a sample of every channel) are dealt to partitions of about ``split_bytes``; filters on channel
and t are pushed down: other channels are not made into rows, and ranges of samples outside the times
are not read at all.  Files are opened through Arrow's file systems: local paths, s3, gs, hdfs.

Options: n_channels, fs (samples a second), split_bytes (64 MB if it isn't given), header (bytes to skip, 0).
"""

from __future__ import annotations

import fnmatch
import math
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, channel int, t double, y double"


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder, or of those whose name matches a pattern."""
    system, at = _opened(path)
    folder, name = posixpath.split(at)
    if any(c in name for c in "*?["):
        found = [f for f in system.get_file_info(arrow_fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, name)]
    else:
        info = system.get_file_info(at)
        found = system.get_file_info(arrow_fs.FileSelector(at)) if info.type == arrow_fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(at)]
    return sorted((prefix + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File)


@dataclass
class Frames(InputPartition):
    """Frames first to last (not included) of a file."""

    path: str
    first: int
    last: int


class ChannelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.n, self.fs = int(options["n_channels"]), float(options["fs"])
        self.split, self.header = int(options.get("split_bytes", 64 << 20)), int(options.get("header", 0))
        self.channels = list(range(self.n))
        self.low, self.high = -math.inf, math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows channels and times; all filters are left to Spark as well, which then has little to drop."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name == "channel" and isinstance(f, EqualTo):
                self.channels = [c for c in self.channels if c == f.value]
            elif name == "channel" and isinstance(f, In):
                self.channels = [c for c in self.channels if c in f.value]
            elif name == "t" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
            if name == "t" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        step, out = max(1, self.split // (2 * self.n)), []
        if not self.channels:
            return out
        for path, size in files(self.path):
            last = max(0, size - self.header) // (2 * self.n)
            first = max(0, math.ceil(self.low * self.fs - 1e-6)) if self.low > -math.inf else 0
            last = min(last, math.floor(self.high * self.fs + 1e-6) + 1) if self.high < math.inf else last
            out += [Frames(path, a, min(a + step, last)) for a in range(first, last, step)]
        return out

    def read(self, partition: Frames | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no partitions
            return
        system, at = _opened(partition.path)
        width, some = 2 * self.n, 1 << 18
        with system.open_input_file(at) as f:
            for a in range(partition.first, partition.last, some):
                b = min(a + some, partition.last)
                x = np.frombuffer(f.read_at((b - a) * width, self.header + a * width), "<i2")
                x = x[: len(x) // self.n * self.n].reshape(-1, self.n)
                t = pa.array(np.arange(a, a + len(x)) / self.fs)
                path = pa.array([partition.path]).take(pa.array(np.zeros(len(x), np.int32)))
                for c in self.channels:
                    yield pa.RecordBatch.from_arrays([path, pa.array(np.full(len(x), c, np.int32)), t, pa.array(x[:, c].astype(np.float64))], ["path", "channel", "t", "y"])


class SampledChannels(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sampled_channels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChannelReader(dict(self.options))


def channels(spark: SparkSession, path: str, n_channels: int, fs: float, split_bytes: int = 64 << 20, header: int = 0) -> DataFrame:
    """(path, channel, t, y) of a recording through the data source, with filters on channel and t pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SampledChannels)
    return (spark.read.format("sampled_channels").option("n_channels", n_channels).option("fs", fs).option("split_bytes", split_bytes)
            .option("header", header).load(path))
