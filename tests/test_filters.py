"""Zero-phase filters, envelopes and burst detection against recursions and sines."""

import numpy as np
import pytest

from spanforge.operators import filters as Z

FS = 1000.0


def _signal(spark, y, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(y)], "series_id string, t long, y double")


def _values(df):
    return np.array([r.y for r in sorted(df.collect(), key=lambda r: r.t)])


def _recursion(sos, x):
    """Section by section, sample by sample."""
    for b0, b1, b2, _, a1, a2 in sos:
        y, s1, s2 = np.zeros(len(x)), 0.0, 0.0
        for i, v in enumerate(x):
            y[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * y[i] + s2, b2 * v - a2 * y[i]
        x = y
    return x


@pytest.mark.parametrize("low, high, stop", [(None, 50, False), (100, None, False), (150, 250, False), (100, 200, True)])
def test_design_meets_its_edges(low, high, stop):
    zpk = Z.design(FS, low, high, stop)
    assert np.abs(zpk[1]).max() < 1
    gain = lambda *f: 20 * np.log10(np.maximum(Z.response(*zpk, np.array(f, float), FS), 1e-12))
    inside = [x for x in (low, high) if x is not None]
    if stop:
        assert (gain(*inside, 140) <= -29.9).all() and (gain(10, 0.8 * low, 1.4 * high, 450) >= -0.11).all()
    else:
        assert (gain(*inside) >= -0.11).all() and (gain(*[f for f in (0.8 * (low or 0), 1.4 * (high or 1e9)) if 0 < f < 500]) <= -29.9).all()


def test_filter_equals_the_recursion_both_ways(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=3000)
    got = _values(Z.zero_phase(_signal(spark, y), ["series_id"], FS, 60, 120, chunk=700, halo=600))
    sos = Z.sections(*Z.design(FS, 60, 120))
    x = Z.extended(y, 600, 600)
    want = _recursion(sos, _recursion(sos, x)[::-1])[::-1][600:-600]
    assert np.abs(got - want)[50:-50].max() < 1e-3


def test_bands_of_a_mixture(spark):
    t = np.arange(4000) / FS
    slow, fast = np.sin(2 * np.pi * 8 * t), np.sin(2 * np.pi * 200 * t)
    s = _signal(spark, slow + fast + 3)
    assert np.abs(_values(Z.zero_phase(s, ["series_id"], FS, high=50, chunk=1000, halo=500)) - slow - 3)[200:-200].max() < 0.05
    assert np.abs(_values(Z.zero_phase(s, ["series_id"], FS, low=150, high=250, chunk=1000, halo=500)) - fast)[200:-200].max() < 0.06
    some = Z.decimated(s, ["series_id"], FS, 200.0, chunk=1000, halo=500)
    assert some.count() == 800 and np.abs(_values(some) - (slow + 3)[::5])[40:-40].max() < 0.06


def test_envelope_and_bursts(spark):
    t = np.arange(6000) / FS
    size = 0.1 + 2 * np.exp(-0.5 * ((t - 3) / 0.03) ** 2)
    y = size * np.sin(2 * np.pi * 200 * t)
    env = _values(Z.envelope(_signal(spark, y), ["series_id"], FS, chunk=2000, halo=500))
    assert np.abs(env - size)[200:-200].max() < 0.1
    found = Z.ripples(_signal(spark, y), ["series_id"], FS, chunk=10_000, halo=500).collect()
    assert len(found) == 1 and found[0].start < 3000 < found[0].stop < 3200


def test_short_and_empty_signals(spark):
    assert Z.zero_phase(_signal(spark, [1.0, 2.0]), ["series_id"], FS, high=50).count() == 2
    assert Z.envelope(_signal(spark, [1.0]), ["series_id"], FS).count() == 1
    assert Z.zero_phase(_signal(spark, []), ["series_id"], FS, high=50).count() == 0
    with pytest.raises(ValueError):
        Z.design(FS, None, None)
