"""Filters, spectra and pulses over blocks of a series against plain loops over all of it."""

import numpy as np
import pytest

from pixelframe.operators import blocks, pulse


def series_of(spark, **arrays):
    rows = [(name, k + 3, float(v)) for name, x in arrays.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, idx int, value double")


def run_filter(b, a, x, z):
    out = []
    z = [*z, 0.0]
    for v in x:
        y = b[0] * v + z[0]
        for k in range(1, len(b)):
            z[k - 1] = b[k] * v + z[k] - a[k] * y
        out.append(y)
    return np.array(out)


def both_ways(x, b, a):
    m = np.eye(4)
    m[:, 0] += a[1:]
    m[np.arange(3), np.arange(1, 4)] -= 1
    zi = np.linalg.solve(m, b[1:] - a[1:] * b[0])
    ext = np.concatenate((2 * x[0] - x[15:0:-1], x, 2 * x[-1] - x[-2:-17:-1]))
    y = run_filter(b, a, ext, zi * ext[0])[::-1]
    return run_filter(b, a, y, zi * y[0])[::-1][15:-15]


def plain_maxima(x):
    out, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return np.array(out, int)


def plain_apart(x, peaks, distance):
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep &= ~near
    return peaks[keep]


def plain_prominent(x, peaks, least):
    out = []
    for p in peaks:
        left, right = p, p
        while left > 0 and x[left - 1] <= x[p]:
            left -= 1
        while right < len(x) - 1 and x[right + 1] <= x[p]:
            right += 1
        if x[p] - max(x[left : p + 1].min(), x[p : right + 1].min()) >= least:
            out.append(p)
    return np.array(out, int)


@pytest.mark.parametrize("size", [1 << 16, 40, 7])
def test_bandpass_equals_one_loop(spark, size, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", size)
    r = np.random.default_rng(1)
    data = {"a": np.cumsum(r.normal(size=200)) * 50, "b": r.normal(size=37), "c": r.normal(size=16), "d": r.normal(size=15), "e": np.zeros(30)}
    got = pulse.bandpass(series_of(spark, **data), 30.0, 1.0, 4.0).orderBy("idx").toPandas()
    b, a = pulse.band_filter(30.0, 1.0, 4.0)
    for name, x in data.items():
        y = got[got.series_id == name].wave.to_numpy()
        want = both_ways(x, b, a) if len(x) > 15 else x - x.mean()
        assert np.abs(y - want).max() < 1e-9 * max(1.0, np.abs(x).max()), name
    assert pulse.bandpass(series_of(spark, a=[]), 30.0, 1.0, 4.0).count() == 0


def test_states_of_blocks_compose():
    r = np.random.default_rng(4)
    b, a = pulse.band_filter(30.0, 0.5, 2.0)
    x, z = r.normal(size=5000), r.normal(size=4)
    whole, end = blocks.filtered(b, a, x, z)
    near = 1e-9 * np.abs(whole).max()
    assert np.abs(whole - run_filter(b, a, x, z)).max() < near
    parts = []
    for part in np.array_split(x, 7):
        y, z = blocks.filtered(b, a, part, z)
        parts.append(y)
    assert np.abs(np.concatenate(parts) - whole).max() < near and np.abs(z - end).max() < near


@pytest.mark.parametrize("points", [1 << 16, 16, 2])
def test_spectrum_in_two_steps_equals_one_transform(spark, points, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 23)
    r = np.random.default_rng(2)
    data = {"a": r.normal(size=100), "b": r.normal(size=3), "c": np.ones(1), "d": np.full(70, 2.5)}
    cut = blocks.cut(series_of(spark, **data), ["value"])
    for top in (None, 3.0):
        got = blocks.spectrum(cut, "value", 10.0, top, points).orderBy("k").toPandas()
        for name, x in data.items():
            size = blocks.transform_size(len(x))
            want = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)), size)) ** 2
            one = got[got.series_id == name]
            n = len(want) if top is None else min(len(want), int(np.ceil(size * top / 10)) + 1)
            assert one.k.tolist() == list(range(n)) and np.allclose(one.power, want[:n], atol=1e-9)


@pytest.mark.parametrize("size", [1 << 16, 17, 5])
@pytest.mark.parametrize(("distance", "least"), [(1, 0.0), (4, 2.5), (30, 1.0), (9, None)])
def test_pulses_equal_plain_loops(spark, size, distance, least):
    r = np.random.default_rng(distance)
    data = {
        "noise": r.integers(0, 12, 150), "wave": np.rint(20 * np.sin(np.arange(180) / 6) + r.normal(0, 3, 180)), "flat": np.full(40, 7), "step": np.repeat([1, 5, 1, 9, 9, 2], 11),
        "rise": np.arange(60) + np.tile([0, 3], 30), "tiny": [1, 2], "fall": np.repeat(np.arange(40)[::-1], 3) + np.tile([0, 2, 0], 40),
    }
    got = pulse.pulses(series_of(spark, **data), distance, least, size=size).toPandas()
    for name, x in data.items():
        x = np.array(x, float)
        want = plain_apart(x, plain_maxima(x), distance)
        if least is not None:
            want = plain_prominent(x, want, least)
        assert sorted(got[got.series_id == name].idx - 3) == want.tolist(), name
