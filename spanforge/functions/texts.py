"""Durations, distances, counts and sizes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def duration_text(seconds: Column) -> Column:
    """Such as ``1:01:01 hours``, ``2:05 minutes``, ``7.25 seconds`` or ``12.5 milliseconds``, with days before.

    With minutes or hours a fraction is a further field of milliseconds, unless there are no minutes.
    """
    x = seconds.cast("double")
    tenths = F.round(F.abs(x) * 10000).cast("long")  # of a millisecond
    sub = F.pmod(tenths, F.lit(10000))
    # from half a millisecond below a second on it is the next second
    whole = F.floor(tenths / 10000) + F.when(sub >= 9995, 1).otherwise(0)
    sub = F.when(sub >= 9995, 0).otherwise(sub)
    d, h, m, s = F.floor(whole / 86400), F.pmod(F.floor(whole / 3600), F.lit(24)), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60))
    decimal = F.regexp_replace(F.format_string(".%04d", sub), "0+$", "")
    tail = F.when(sub == 0, "").when(m == 0, decimal).otherwise(F.concat(F.lit(":"), F.lpad(F.floor(sub / 10).cast("string"), 3, "0")))
    ms = F.concat(F.floor(sub / 10).cast("string"), F.lit("."), F.pmod(sub, F.lit(10)).cast("string"))
    body = (F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s), tail, F.lit(" hours")))
            .when(m > 0, F.concat(m.cast("string"), F.lit(":"), _two(s), tail, F.lit(" minutes")))
            .when(s > 0, F.concat(s.cast("string"), tail, F.lit(" seconds"))).otherwise(F.concat(ms, F.lit(" milliseconds"))))
    days = F.when(d > 0, F.concat(d.cast("string"), F.lit(" days "))).otherwise("")
    return F.when(F.abs(x) == float("inf"), "inf").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), days, body))


def length_text(centimetres: Column) -> Column:
    """Kilometres from 1 km on, metres from 1 m on, else centimetres or millimetres, to four digits behind the point."""
    a = F.abs(centimetres)
    parts = [(100000.0, " km"), (100.0, " m"), (1.0, " cm")]
    out = None
    for by, unit in parts:
        v = F.concat(_plain(centimetres / by), F.lit(unit))
        out = F.when(a >= by, v) if out is None else out.when(a >= by, v)
    return out.otherwise(F.concat(_plain(centimetres * 10), F.lit(" mm")))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.format_string("%.4f", x.cast("double")), r"\.?0+$", "")


def count_text(n: Column) -> Column:
    """With a comma at every third digit."""
    return F.format_number(n, 0)


def bytes_text(n: Column) -> Column:
    """Such as ``3.217 kilobytes``, by powers of 1024."""
    x = n.cast("double")
    out = F.when(x < 1024, F.concat(n.cast("long").cast("string"), F.lit(" bytes")))
    for k, unit in ((1, "kilobytes"), (2, "megabytes"), (3, "gigabytes")):
        out = out.when(x < 1024.0 ** (k + 1), F.concat(F.format_string("%.3f", F.bround(x / 1024.0**k, 3)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.3f", F.bround(x / 1024.0**4, 3)), F.lit(" terabytes")))
