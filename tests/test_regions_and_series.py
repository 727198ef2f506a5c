"""Segmentation, registration, series and pulse operators on inputs with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import pulse, register, segment, series
from pixelframe.plans import workflows
from tests.test_pixels import disk, frame


def region(spark, array):
    rows = [(0, int(y), int(x)) for y, x in zip(*np.nonzero(array))]
    return spark.createDataFrame(rows, "frame_id int, y int, x int")


def flood(a, steps):
    label, n = np.zeros(a.shape, int), 0
    for y, x in zip(*np.nonzero(a)):
        if not label[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                p = todo.pop()
                if 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and a[p] and not label[p]:
                    label[p] = n
                    todo += [(p[0] + dy, p[1] + dx) for dy, dx in steps]
    return label, n


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_equal_flood_fill(spark, connectivity):
    a = np.random.default_rng(2).random((24, 24)) < 0.55
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0) and (connectivity == 8 or dy * dx == 0)]
    want, n = flood(a, steps)
    got = segment.connected_components(region(spark, a), connectivity).collect()
    assert len(got) == a.sum() and len({g["label"] for g in got}) == n
    assert len({(g["label"], want[g["y"], g["x"]]) for g in got}) == n


def test_morphology_equals_numpy(spark):
    a = np.random.default_rng(3).random((12, 12)) < 0.6
    se = segment.disk(1)
    pts = lambda df: {(r["y"], r["x"]) for r in df.collect()}
    inside = lambda y, x: 0 <= y < 12 and 0 <= x < 12
    dil = {(y, x) for y in range(12) for x in range(12) if any(inside(y + b, x + c) and a[y + b, x + c] for b, c in se)}
    ero = {(y, x) for y in range(12) for x in range(12) if all(not inside(y + b, x + c) or a[y + b, x + c] for b, c in se)}
    assert pts(segment.dilate(region(spark, a), se, 12, 12)) == dil
    assert pts(segment.erode(region(spark, a), se, 12, 12)) == ero


def test_holes_and_largest(spark):
    a = np.zeros((12, 12), int)
    a[2:8, 2:8] = 1
    a[4:6, 4:6] = 0
    a[10, 10] = 1
    full = segment.fill_holes(region(spark, a), 12, 12)
    assert full.count() == 37
    best = segment.largest_component(segment.connected_components(full), 5)
    assert best.count() == 36
    m = segment.region_measures(best).head()
    assert (m["bx"], m["by"], m["width"], m["height"], m["cx"], m["cy"], m["polygon_area"]) == (2, 2, 6, 6, 4, 4, 25.0)
    assert segment.largest_component(segment.connected_components(full), 100).count() == 0
    core = region(spark, np.pad(np.ones((2, 2), int), ((4, 6), (4, 6))))
    assert segment.containing_component(segment.connected_components(full), core).count() == 36


def test_tracking_of_growing_disks(spark):
    p = None
    for k, radius in enumerate((6, 8, 10)):
        f = frame(spark, disk(32, 32, 16, 16, radius, 60, 220), k, 0, k)
        p = f if p is None else p.unionByName(f)
    got = workflows.track_regions(p, 32, 32, min_area=50, tiles=2).orderBy("frame_id").collect()
    areas = [g["area_pixels"] for g in got]
    assert all(g["contour_found"] for g in got) and areas == sorted(areas) and areas[0] < areas[2]


def test_drift_is_recovered(spark):
    p = None
    for k in range(4):
        f = frame(spark, disk(24, 24, 12, 9 + 2 * k, 4, 200, 30), k, 0, k)
        p = f if p is None else p.unionByName(f)
    ref = p.filter("z = 0").select("stack_id", "y", "x", "v")
    got = register.estimate_shift(p, ref, 6).orderBy("frame_id").collect()
    assert [(g["dy"], g["dx"]) for g in got] == [(0, 0), (0, 2), (0, 4), (0, 6)]
    aligned = register.align_stack(p, 6)
    assert aligned.groupBy("z").agg(F.avg(F.when(F.col("v") == 200, F.col("x"))).alias("c")).select("c").distinct().count() == 1
    s = p.select(F.lit("s").alias("session"), F.when(F.col("z") < 2, F.col("z")).otherwise(F.col("z") + 5).alias("timepoint"), F.lit(0).alias("z"), "y", "x", "v", "frame_id")
    chained = register.align_session(s, 0, 6).orderBy("timepoint").collect()
    assert [(c["timepoint"], c["sum_dx"]) for c in chained] == [(0, 0), (1, 2), (7, 0), (8, 2)]


def test_flat_frame_has_no_shift(spark):
    p = frame(spark, np.full((6, 6), 9))
    assert register.estimate_shift(p, p.select("stack_id", "y", "x", "v"), 1).head()["corr"] is None


def test_t_quantiles():
    for df, want in zip(range(1, 6), (12.7062, 4.3027, 3.1824, 2.7764, 2.5706)):
        assert series.t_quantile(0.975, df) == pytest.approx(want, abs=1e-4)


def make(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "series_id string, idx int, value double")


def test_smoothing_and_baseline(spark):
    v = np.random.default_rng(1).normal(100, 5, 20)
    got = series.confidence_band(make(spark, v), 5).orderBy("idx").toPandas()
    for i in range(20):
        w = v[max(0, i - 2) : i + 3]
        assert got.ma[i] == pytest.approx(w.mean())
        assert got.ci[i] == pytest.approx(series.t_quantile(0.975, len(w) - 1) * w.std(ddof=1) / math.sqrt(len(w)))
    assert series.percent_of_initial(make(spark, [0, 0, 5]), 2).orderBy("idx").toPandas().pct.tolist() == [0, 0, 5]
    assert series.moving_average(make(spark, v[:3]), 9).filter("ma IS NOT NULL").count() == 0


def test_pulse_of_a_90_bpm_wave(spark):
    t = np.arange(300) / 30
    x = 1 + 0.5 * np.sin(2 * np.pi * 1.5 * t) + np.random.default_rng(1).normal(0, 0.03, 300)
    summary, wave = pulse.analyze_pulsatility(make(spark, x).unionByName(make(spark, x[::-1], "back")), 30.0)
    for row in summary.collect():
        assert row["bpm_spectral"] == pytest.approx(90, abs=6) and row["bpm"] == pytest.approx(90, abs=8)
        assert row["snr"] > 0.5 and row["pulsatility_index"] > 0 and row["p2p"] > 0
    assert wave.count() == 600
    wide = pulse.roi_waveforms_wide(wave, ["s", "back"])
    assert wide.count() == 300 and {"s_wave", "back_motion"} <= set(wide.columns)


def test_spectrum_equals_fft(spark):
    x = np.random.default_rng(9).normal(0, 1, 50)
    got = pulse.power_spectrum(make(spark, x), 10.0, "value").orderBy("k").toPandas()
    want = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(50), 256)) ** 2
    assert np.allclose(got.power, want) and np.allclose(got.freq, np.fft.rfftfreq(256, 0.1))


def test_detrend_reflects(spark):
    x = np.random.default_rng(4).normal(0, 1, 40)
    got = pulse.detrend(make(spark, x), 10.0, 3.0).orderBy("idx").toPandas()
    assert np.allclose(got.baseline, np.convolve(np.pad(x, 2, mode="reflect"), np.ones(5) / 5, "valid"))


def test_bandpass_keeps_phase(spark):
    t = np.arange(600) / 30
    x = np.sin(2 * np.pi * 2 * t)
    y = pulse.bandpass(make(spark, x + 3 + t), 30.0, 1.4, 3.2).orderBy("idx").toPandas().wave.to_numpy()
    assert np.abs(y[60:-60] - x[60:-60]).max() < 0.1
    short = pulse.bandpass(make(spark, x[:10]), 30.0, 1, 2).orderBy("idx").toPandas().wave
    assert np.allclose(short, x[:10] - x[:10].mean())


def test_times_and_growth(spark):
    f = spark.createDataFrame([(3, "3_zs+1.png", "2024-01-01 00:01:00"), (1, "1_zs+1.png", "2024-01-01 00:02:00"), (1, "1_zs+0.png", "2024-01-01 00:00:30.5")], "N int, filename string, m string").withColumn("mtime", F.to_timestamp("m"))
    got = series.extract_times(f, -60).orderBy("N").collect()
    assert [(g["filename"], g["elapsed_seconds"], g["elapsed_time"]) for g in got] == [("1_zs+0.png", -60.0, "-1:59:00.000"), ("3_zs+1.png", -30.5, "-1:59:29.500")]
    tracks = spark.createDataFrame([("a", 1, 100, True, 1.0), ("a", 2, 0, True, 1.0), ("a", 3, 50, True, 1.0), ("a", 4, 70, False, 1.0), ("a", 5, 75, True, 1.0)], "series_id string, timepoint int, area_pixels int, contour_found boolean, average_darkness double")
    assert [(g["timepoint"], g["growth_pct"]) for g in series.growth_rate(tracks).orderBy("timepoint").collect()] == [(2, -100.0), (5, 50.0)]
    with pytest.raises(ValueError):
        series.load_tracks(tracks.drop("timepoint"))
    with pytest.raises(ValueError):
        series.require_rows(tracks.filter("false"), "detections")


def test_moving_texture_rate(spark):
    t = np.arange(120) / 30
    shift = 0.9 * t + (0.7 / (2 * np.pi)) * np.sin(2 * np.pi * t)
    y, x = np.mgrid[:24, :24]
    rows = []
    for k, s in enumerate(shift):
        img = 128 + 60 * np.sin((x - s) / 2.5) * np.cos(y / 3.0) + 30 * np.sin((x - s + y) / 4.0)
        rows += [(0, k, int(a), int(b), float(img[a, b]), k) for a in range(24) for b in range(24)]
    p = spark.createDataFrame(pd.DataFrame(rows, columns=["stack_id", "z", "y", "x", "v", "frame_id"]))
    speed = pulse.block_motion(p, 8).groupBy("stack_id", "z").agg(F.avg("speed").alias("value"))
    s = speed.select(F.col("stack_id").cast("string").alias("series_id"), F.col("z").alias("idx"), "value")
    row = pulse.analyze_pulsatility(s, 30.0)[0].head()
    assert row["bpm_spectral"] == pytest.approx(60, abs=8) and row["n_pulses"] >= 3


def test_contours_and_hulls(spark):
    square = {(y, x) for y in range(5) for x in range(5)}
    assert segment.polygon_area(segment.hull(sorted(square))) == 16
    a = np.zeros((20, 20), int)
    a[2:12, 2:12] = 1
    a[4:6, 8:12] = 0  # a dent
    c = segment.connected_components(region(spark, a))
    row = segment.convexity(c).head()
    assert row["hull_area"] == 81 and 0.5 < row["convexity"] < 1
    m = segment.with_circularity(segment.region_measures(c), segment.perimeter(c), F.lit(0.5)).head()
    assert m["perimeter_um"] == m["perimeter"] / 2 and 0 < m["circularity"] < 1
    assert segment.hull_fallback(c, least=0.99, growth=0.9).count() == 100
    assert segment.hull_fallback(c, least=0.1).count() == a.sum()


def test_core_and_outer(spark):
    y, x = np.mgrid[:32, :32]
    d = np.hypot(y - 16, x - 16)
    p = frame(spark, np.where(d < 4, 240, np.where(d < 10, 120 - 3 * d, 10 + x // 8)))
    got = workflows.core_outer(p, 32, 32, 2, 8, 8, 1).collect()
    assert len(got) == 1 and got[0]["core_area"] > 20 and got[0]["total_pixels"] == 1024
    assert got[0]["core_sum"] / got[0]["core_area"] > got[0]["total_sum"] / 1024


@pytest.mark.parametrize("limit", [0, 20])
def test_components_of_large_frames_are_the_same(spark, limit, monkeypatch):
    r = np.random.default_rng(21)
    df = None
    for k, share in enumerate((0.3, 0.6, 0.02)):
        a = region(spark, r.random((16, 16)) < share).withColumn("frame_id", F.lit(k))
        df = a if df is None else df.unionByName(a)
    want = sorted(map(tuple, segment.connected_components(df).collect()))
    monkeypatch.setattr(segment, "FRAME_RUNS", limit)
    assert sorted(map(tuple, segment.connected_components(df).collect())) == want


@pytest.mark.parametrize("offsets", [segment.ELLIPSE5, segment.disk(3), [(0, -2), (0, 0), (0, 2), (1, 1)]])
def test_morphology_of_frames_equals_numpy(spark, offsets):
    r = np.random.default_rng(22)
    images = {0: r.random((13, 17)) < 0.7, 1: np.ones((13, 17), bool), 2: r.random((13, 17)) < 0.1}
    df = None
    for k, a in images.items():
        one = region(spark, a).withColumn("frame_id", F.lit(k))
        df = one if df is None else df.unionByName(one)
    h, w = 13, 17

    def dil(a):
        return np.array([[any(0 <= y + b < h and 0 <= x + c < w and a[y + b, x + c] for b, c in offsets) for x in range(w)] for y in range(h)])

    def ero(a):
        return np.array([[all(not (0 <= y + b < h and 0 <= x + c < w) or a[y + b, x + c] for b, c in offsets) for x in range(w)] for y in range(h)])

    pts = lambda d: {tuple(x) for x in d.select("frame_id", "y", "x").collect()}
    of = lambda f: {(k, int(y), int(x)) for k, a in images.items() for y, x in zip(*np.nonzero(f(a)))}
    assert pts(segment.dilate(df, offsets, h, w)) == of(dil)
    assert pts(segment.erode(df, offsets, h, w)) == of(ero)
    assert pts(segment.open_(df, offsets, h, w)) == of(lambda a: dil(ero(a)))
    assert pts(segment.close_(df, offsets, h, w)) == of(lambda a: ero(dil(a)))


def equalized(a, tiles, clip_limit=2.0):
    """Local equalization in numpy: mirrored to whole tiles, clipped histograms, bilinear look-up."""
    h, w = a.shape
    pad = (0, 0) if h % tiles == 0 and w % tiles == 0 else (tiles - h % tiles, tiles - w % tiles)
    b = np.pad(a, ((0, pad[0]), (0, pad[1])), mode="reflect")
    th, tw = b.shape[0] // tiles, b.shape[1] // tiles
    clip = max(1, int(clip_limit * th * tw / 256))
    lut = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(b[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            extra = int(np.maximum(n - clip, 0).sum())
            n = np.minimum(n, clip) + extra // 256
            left = extra % 256
            if left:
                n[:: max(256 // left, 1)][:left] += 1
            lut[i, j] = np.minimum(np.rint(np.cumsum(n) * 255 / (th * tw)), 255)
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y0, x0 = math.floor(fy), math.floor(fx)
            at = lambda i, j: lut[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1), a[y, x]]  # noqa: B023, E731
            s = (at(y0, x0) * (1 - fx + x0) + at(y0, x0 + 1) * (fx - x0)) * (1 - fy + y0) + (at(y0 + 1, x0) * (1 - fx + x0) + at(y0 + 1, x0 + 1) * (fx - x0)) * (fy - y0)
            out[y, x] = round(round(s, 6))
    return out


@pytest.mark.parametrize(("shape", "tiles"), [((16, 24), 4), ((13, 22), 4), ((12, 13), 3)])
def test_equalization_of_any_size_equals_numpy(spark, shape, tiles):
    a = np.random.default_rng(23).integers(0, 256, shape)
    got = np.zeros(shape, int)
    for x in segment.clahe(frame(spark, a), *shape, 2.0, tiles).collect():
        got[x["y"], x["x"]] = x["v"]
    assert (got == equalized(a, tiles)).all()
    with pytest.raises(ValueError, match="rgb"):
        segment.clahe(frame(spark, a), *shape, channel="red")


def test_subpixel_drift_and_bilinear_resampling(spark):
    y, x = np.mgrid[:32, :32]
    blob = lambda cy, cx: np.rint(200 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 18)).astype(int) + 10
    p = frame(spark, blob(15, 15), 0, 0, 0).unionByName(frame(spark, blob(15.4, 17.7), 1, 0, 1))
    ref = p.filter("z = 0").select("stack_id", "y", "x", "v")
    got = register.estimate_shift(p, ref, 4, subpixel=True).orderBy("frame_id").collect()
    assert (got[0]["dy"], got[0]["dx"]) == pytest.approx((0, 0), abs=0.05) and (got[1]["dy"], got[1]["dx"]) == pytest.approx((0.4, 2.7), abs=0.1)
    moved = {(r["y"], r["x"]): r["v"] for r in register.align_stack(p, 4, subpixel=True).filter("z = 1").collect()}
    assert len(moved) == 32 * 32
    assert max(abs(moved[int(a), int(b)] - blob(15, 15)[a, b]) for a in range(4, 28) for b in range(4, 26)) <= 8


def test_session_with_other_slices_and_a_reference(spark):
    y, x = np.mgrid[:28, :28]
    dot = lambda cx: np.where((y - 13) ** 2 + (x - cx) ** 2 <= 16, 200, 30)
    df = None
    for k, (t, z, cx) in enumerate([(0, 0, 10), (1, 0, 12), (0, 1, 11), (1, 1, 14), (5, 0, 9)]):
        f = frame(spark, dot(cx), k, 0, z).withColumns({"session": F.lit("s"), "timepoint": F.lit(t)})
        df = f if df is None else df.unionByName(f)
    at = lambda **k: {(r["timepoint"], r["z"]): (r["sum_dy"], r["sum_dx"]) for r in register.align_session(df, 0, 5, **k).collect()}
    assert at() == {(0, 0): (0, 0), (1, 0): (0, 2), (0, 1): (0, 1), (1, 1): (0, 4), (5, 0): (0, 0)}
    fixed = frame(spark, dot(8)).select("y", "x", "v")
    assert at(reference=fixed) == {(0, 0): (0, 2), (1, 0): (0, 4), (0, 1): (0, 3), (1, 1): (0, 6), (5, 0): (0, 1)}
    assert at(reference=fixed, temporal=False) == {(0, 0): (0, 2), (1, 0): (0, 4), (0, 1): (0, 3), (1, 1): (0, 6), (5, 0): (0, 1)}


def test_focal_sequence_of_16_bits(spark):
    a = np.random.default_rng(24).integers(0, 65536, (2, 8, 8))
    p = frame(spark, a[0], 0, 3, 0, 16).unionByName(frame(spark, a[1], 1, 3, 1, 16))
    got = workflows.focal_stack_sequence(p, 8, 8, "edf", tiles=2, wavelet="haar", levels=1, channel="red").collect()
    assert len(got) == 64 and {g["frame_id"] for g in got} == {3}
    assert max(g["rgb"]["r"] for g in got) == 255 and min(g["rgb"]["r"] for g in got) == 0 and {g["rgb"]["g"] for g in got} == {0}
    with pytest.raises(ValueError, match="no focal stacks"):
        workflows.focal_stack_sequence(p.limit(0), 8, 8)
