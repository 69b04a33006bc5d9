"""Zero-phase filters and envelopes of sampled signals (keys, t, y), in chunks with a halo.

A filter that runs forwards and backwards multiplies the spectrum by the squared magnitude of
its response; that is done on chunks of ``chunk`` samples, each with ``halo`` samples of its
neighbours on both sides, so a long series is as many tasks as it has chunks; samples are numbered
in pieces, see ``scans`` (``width`` is theirs).  At the ends of a
series the signal is continued by its odd reflection.  The response is that of a Chebyshev filter
of the second kind, designed here from its poles and zeros.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from . import scans


def design(fs: float, low: float | None, high: float | None, bandstop: bool = False, gpass: float = 0.1, gstop: float = 30.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(zeros, poles, gain) of the digital filter of least order.

    Only ``high``: low-pass; only ``low``: high-pass; both: band-pass, or band-stop.  The stop edges
    are 1.4 times ``high`` and 0.8 times ``low``; for a band-stop these are the pass edges.
    """
    if low is None and high is None:
        raise ValueError("a filter needs an edge")
    warp = lambda f: np.tan(np.pi * min(f, 0.4999 * fs) / fs)  # noqa: E731  bilinear transform
    inner = [warp(f) for f in (low, high) if f is not None]
    outer = [warp(f) for f in ([0.8 * low] if low is not None else []) + ([1.4 * high] if high is not None else [])]
    stop, passing = (inner, outer) if bandstop else (outer, inner)
    if low is None:
        ratio = stop[0] / passing[0]
    elif high is None:
        ratio = passing[0] / stop[0]
    else:  # the narrower side of the band decides
        centre, width = stop[0] * stop[1], stop[1] - stop[0]
        shift = [abs((w * w - centre) / (w * width)) for w in passing]
        ratio = min(1 / x for x in shift) if not bandstop else min(abs(w * w - centre) / (w * width) for w in passing)
    order = int(np.ceil(np.arccosh(np.sqrt((10 ** (gstop / 10) - 1) / (10 ** (gpass / 10) - 1))) / np.arccosh(max(ratio, 1.0001))))
    # the low-pass prototype with its stop edge at 1
    m = np.arange(-order + 1, order, 2)
    zeros = 1j / np.sin(m[m != 0] * np.pi / (2 * order))
    mu = np.arcsinh(np.sqrt(10 ** (gstop / 10) - 1)) / order
    theta = m * np.pi / (2 * order)
    poles = 1 / (-np.sinh(mu) * np.cos(theta) + 1j * np.cosh(mu) * np.sin(theta))
    gain = np.real(np.prod(-poles) / np.prod(-zeros))
    more = len(poles) - len(zeros)
    if low is None:
        zeros, poles, gain = zeros * stop[0], poles * stop[0], gain * stop[0] ** more
    elif high is None:
        gain *= np.real(np.prod(-zeros) / np.prod(-poles))
        zeros, poles = np.append(stop[0] / zeros, np.zeros(more)), stop[0] / poles
    else:
        centre, width = stop[0] * stop[1], stop[1] - stop[0]
        split = lambda x: np.concatenate((x + np.sqrt(x * x - centre + 0j), x - np.sqrt(x * x - centre + 0j)))
        if bandstop:
            gain *= np.real(np.prod(-zeros) / np.prod(-poles))
            zeros = np.concatenate((split(width / 2 / zeros), np.repeat([1j * np.sqrt(centre), -1j * np.sqrt(centre)], more)))
            poles = split(width / 2 / poles)
        else:
            gain *= width**more
            zeros, poles = np.append(split(zeros * width / 2), np.zeros(more)), split(poles * width / 2)
    more = len(poles) - len(zeros)
    gain *= np.real(np.prod(1 - zeros) / np.prod(1 - poles))
    return np.append((1 + zeros) / (1 - zeros), -np.ones(more)), (1 + poles) / (1 - poles), float(gain)


def sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2): conjugate or real pairs of poles and zeros."""
    def pairs(x: np.ndarray) -> list[np.ndarray]:
        up = [np.array([v, np.conj(v)]) for v in x if v.imag > 1e-9]
        real = sorted(x[np.abs(x.imag) <= 1e-9].real)
        return up + [np.array(real[i : i + 2]) for i in range(0, len(real), 2)]

    z, p = pairs(zeros), pairs(poles)
    rows = []
    for k in range(max(len(z), len(p))):
        b = np.real(np.poly(z[k])) if k < len(z) else np.ones(1)
        a = np.real(np.poly(p[k])) if k < len(p) else np.ones(1)
        rows.append(np.concatenate((np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a))))))
    rows[0][:3] *= gain
    return np.array(rows)


def response(zeros: np.ndarray, poles: np.ndarray, gain: float, f: np.ndarray, fs: float) -> np.ndarray:
    """The magnitude at some frequencies."""
    e = np.exp(2j * np.pi * f / fs)[:, None]
    return np.abs(gain * np.prod(e - zeros, axis=1) / np.prod(e - poles, axis=1))


def extended(y: np.ndarray, before: int, after: int) -> np.ndarray:
    """Odd reflections at the ends, as long as there are samples; then the end's value."""
    left = 2 * y[0] - y[1 : before + 1][::-1]
    right = 2 * y[-1] - y[::-1][1 : after + 1]
    left = np.concatenate((np.full(before - len(left), left[0] if len(left) else y[0]), left))
    return np.concatenate((left, y, right, np.full(after - len(right), right[-1] if len(right) else y[-1])))


def numbered(s: DataFrame, keys: list[str], width: float = 0) -> DataFrame:
    """(keys, t, y, _i, _n): each sample's number from 0, and how many its series has."""
    return scans.numbered(scans.pieces(s.select(*keys, "t", "y"), keys, "t", width), keys, "t", "_i", "_n").drop("_p")


def chunked(s: DataFrame, keys: list[str], chunk: int, halo: int, change: Callable[[np.ndarray, bool, bool], np.ndarray], width: float = 0) -> DataFrame:
    """(keys, t, y) of change(samples of a chunk and its halo, whether it is first, whether it is last)."""
    return _chunked(numbered(s, keys, width), keys, chunk, halo, change).drop("_i", "_n")


def _chunked(n: DataFrame, keys: list[str], chunk: int, halo: int, change: Callable[[np.ndarray, bool, bool], np.ndarray]) -> DataFrame:
    """The same of numbered samples, with their numbers."""
    at = F.explode(F.sequence(F.floor(F.greatest(F.col("_i") - halo, F.lit(0)) / chunk), F.floor(F.least(F.col("_i") + halo, F.col("_n") - 1) / chunk)))
    rows = n.withColumn("_c", at)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_i")
        c, i = int(g["_c"].iloc[0]), g["_i"].to_numpy()
        y = change(g["y"].to_numpy(np.float64), i[0] == 0, i[-1] == g["_n"].iloc[0] - 1)
        own = (i >= c * chunk) & (i < (c + 1) * chunk)
        return g.loc[own, [*keys, "t"]].assign(y=y[own], _i=i[own], _n=g["_n"].to_numpy()[own])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in n.select(*keys, "t").schema)
    return rows.groupBy(*keys, "_c").applyInPandas(run, f"{kinds}, y double, _i long, _n long")


def _spectral(gain_of: Callable[[np.ndarray], np.ndarray], pad: int):
    """Samples times a gain by frequency (cycles a sample), both ends continued where they are real ends."""
    def change(y: np.ndarray, first: bool, last: bool) -> np.ndarray:
        x = extended(y, pad, pad)
        n = 1 << max(1, len(x) - 1).bit_length()
        out = np.fft.irfft(np.fft.rfft(x - y.mean(), n) * gain_of(np.fft.rfftfreq(n)), n)[pad : pad + len(y)]
        return out + y.mean() * gain_of(np.zeros(1))[0]

    return change


def zero_phase(s: DataFrame, keys: list[str], fs: float, low: float | None = None, high: float | None = None, bandstop: bool = False,
               gpass: float = 0.1, gstop: float = 30.0, chunk: int = 1 << 20, halo: int | None = None, width: float = 0) -> DataFrame:
    """(keys, t, y) filtered forwards and backwards; ``halo`` is two seconds if it isn't given."""
    return _filtered(numbered(s, keys, width), keys, fs, low, high, bandstop, gpass, gstop, chunk, halo).drop("_i", "_n")


def _filtered(n: DataFrame, keys: list[str], fs: float, low: float | None, high: float | None, bandstop: bool = False,
              gpass: float = 0.1, gstop: float = 30.0, chunk: int = 1 << 20, halo: int | None = None) -> DataFrame:
    halo = int(2 * fs) if halo is None else halo
    zpk = design(fs, low, high, bandstop, gpass, gstop)
    return _chunked(n, keys, chunk, halo, _spectral(lambda f: response(*zpk, f * fs, fs) ** 2, halo))


def envelope(s: DataFrame, keys: list[str], fs: float, sigma: float | None = 0.004, chunk: int = 1 << 20, halo: int | None = None, width: float = 0) -> DataFrame:
    """(keys, t, y): the absolute analytic signal, smoothed by a Gaussian of ``sigma`` seconds unless it is None or 0."""
    return _enveloped(numbered(s, keys, width), keys, fs, sigma, chunk, halo).drop("_i", "_n")


def _enveloped(n: DataFrame, keys: list[str], fs: float, sigma: float | None = 0.004, chunk: int = 1 << 20, halo: int | None = None) -> DataFrame:
    halo = int(2 * fs) if halo is None else halo

    def change(y: np.ndarray, first: bool, last: bool) -> np.ndarray:
        n = 1 << max(1, len(y) + 2 * halo - 1).bit_length()
        spectrum = np.fft.fft(np.concatenate((np.zeros(halo), y, np.zeros(halo))), n)
        turn = np.zeros(n)
        turn[0] = turn[n // 2] = 1
        turn[1 : n // 2] = 2
        out = np.abs(np.fft.ifft(spectrum * turn))[halo : halo + len(y)]
        if not sigma:
            return out
        r = max(1, int(4 * sigma * fs + 0.5))
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / (sigma * fs)) ** 2)
        return np.convolve(np.pad(out, r, mode="symmetric") if len(out) > r else np.pad(out, r, mode="edge"), k / k.sum(), mode="valid")

    return _chunked(n, keys, chunk, halo, change)


def decimated(s: DataFrame, keys: list[str], fs: float, fs_out: float, width: float = 0, **options) -> DataFrame:
    """Low-pass at half the new rate, then every fs / fs_out-th sample."""
    step = int(round(fs / fs_out))
    return _filtered(numbered(s, keys, width), keys, fs, None, fs_out / 2, **options).where(F.col("_i") % step == 0).drop("_i", "_n")


def ripples(s: DataFrame, keys: list[str], fs: float, low: float = 150.0, high: float = 250.0, sigmas: float = 3.5, least: float = 0.015, width: float = 0, **options) -> DataFrame:
    """(keys, start, stop, best): runs of the band's envelope above its mean that reach mean + sigmas
    deviations for at least ``least`` seconds."""
    from .detect import boundaries

    env = _enveloped(_filtered(numbered(s, keys, width), keys, fs, low, high, **options), keys, fs, **options).drop("_i", "_n")
    env = written(env, "envelope")  # read for its moments and for both levels
    return boundaries(env, keys, "t", "y", sigmas, least_primary=max(1, int(np.ceil(least * fs))), width=width).select(*keys, "start", "stop", "best")
