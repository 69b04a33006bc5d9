"""Labelled texts for the classifiers: a bounded sample, and none of the held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frame import narrow


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id's text is divisible by 5; a null id counts as its empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, int]]:
    """At most ``bound`` (text, 0 or 1) of labelled rows that aren't held out, by a hash of the id.

    The bound keeps what comes to the driver and is broadcast independent of the corpus.  An id
    with several labels takes the largest.
    """
    some = (narrow(labels, id_col, label).where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
            .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
            .orderBy(F.xxhash64("id"), "id").limit(bound))
    rows = narrow(docs, id_col, text_col).where(F.col(text_col).isNotNull())
    found = rows.join(F.broadcast(some), rows[id_col] == some["id"]).select("id", F.col(text_col).cast("binary").alias("t"), "y")
    got = found.groupBy("id").agg(F.min(F.struct("t", "y")).alias("r")).select("id", "r.*").collect()
    return [(bytes(r.t), r.y) for r in sorted(got, key=lambda r: str(r.id))]
