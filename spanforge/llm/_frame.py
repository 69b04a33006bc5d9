"""Documents with any further columns, whatever their names are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Framed:
    """The columns of a table under positional names; clashes with names used inside can't occur."""

    def __init__(self, df: DataFrame, *needed: str) -> None:
        self.names = df.columns
        self.inner = [f"_in{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)
        self.columns = [self._column(x) for x in needed]

    def _column(self, name: str) -> str:
        if name in self.names:
            return self.inner[self.names.index(name)]
        found = [i for i, x in enumerate(self.names) if x.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name} among {self.names}")
        return self.inner[found[0]]

    def keep(self, change: Callable[[DataFrame], DataFrame], **replaced: Column) -> DataFrame:
        """The original columns of change(df), some replaced by name."""
        out = change(self.df)
        by = {self._column(k): v for k, v in replaced.items()}
        return out.select(*[by.get(x, F.col(x)).alias(x) for x in self.inner]).toDF(*self.names)


def narrow(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, under exactly these names."""
    f = Framed(df, *needed)
    return f.df.select(*[F.col(c).alias(n) for c, n in zip(f.columns, needed, strict=True)])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
