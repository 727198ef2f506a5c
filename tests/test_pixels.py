"""Pixel operators on frames with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.functions import keys, scalars
from pixelframe.operators import pixels as P
from pixelframe.operators import wavelet


def frame(spark, array, frame_id=0, stack_id=0, z=0, bit_depth=8):
    rows = [(frame_id, stack_id, z, int(y), int(x), int(v), bit_depth) for (y, x), v in np.ndenumerate(np.asarray(array))]
    return spark.createDataFrame(rows, "frame_id int, stack_id int, z int, y int, x int, v int, bit_depth int")


def back(df, height, width):
    out = np.full((height, width), -1.0)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def disk(height, width, cy, cx, radius, on, off):
    y, x = np.mgrid[:height, :width]
    return np.where((y - cy) ** 2 + (x - cx) ** 2 <= radius**2, on, off)


def test_masked_sum_and_background(spark):
    p = frame(spark, np.full((10, 10), 100))
    mask = spark.createDataFrame([(y, x, 255.0 if 2 <= y <= 4 and 2 <= x <= 4 else 0.0) for y in range(10) for x in range(10)], "y int, x int, m double")
    row = P.sum_brightness(p, mask=mask).head()
    assert (row["sum_brightness"], row["masked_area"]) == (900.0, 9)
    assert P.sum_brightness(p, background=100).head()["sum_brightness"] == 0.0


def test_projections_of_two_levels(spark):
    p = frame(spark, np.full((8, 8), 10)).unionByName(frame(spark, np.full((8, 8), 50), 1, 0, 1))
    assert {r["v"] for r in P.fuse_project(p, "mean").collect()} == {30}
    assert {r["v"] for r in P.fuse_project(p, "max").collect()} == {50}
    with pytest.raises(ValueError):
        P.fuse_project(p, "mode")


def test_global_normalization_keeps_relative_brightness(spark):
    block = np.zeros((8, 8), int)
    block[2:6, 2:6] = 40_000
    p = frame(spark, block, 0, bit_depth=16).unionByName(frame(spark, block // 4, 1, z=1, bit_depth=16))
    top = lambda mode: {r[0]: r[1] for r in P.normalize_frames(p, mode).groupBy("frame_id").agg(F.max("v")).collect()}
    assert top("per-frame") == {0: 255, 1: 255}
    assert top("global") == {0: 255, 1: 63}
    with pytest.raises(ValueError):
        P.normalize_frames(p, "local")


def test_crop_scale_bar_and_channel_errors(spark):
    p = frame(spark, np.arange(30).reshape(5, 6))
    assert back(P.crop(p, 1, 2, 1, 0), 3, 4).tolist() == np.arange(30).reshape(5, 6)[2:, 1:5].tolist()
    for call in (lambda: P.crop(p, -1), lambda: P.overlay_scale_bar(p, 0, 1), lambda: P.grey_to_color(p, "pink"), lambda: P.scale_colors(p, 5, 5)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="too long"):
        P.overlay_scale_bar(p, 50, 1).collect()


def test_blur_equals_numpy(spark):
    a = np.random.default_rng(1).integers(0, 256, (7, 9))
    w = np.array(P.taps(5))
    pad = np.pad(a.astype(float), 2, mode="reflect")
    rows = sum(w[k] * pad[:, k : k + 9] for k in range(5))
    want = sum(w[k] * rows[k : k + 7] for k in range(5))
    assert np.allclose(back(P.gaussian_blur(frame(spark, a), 5), 7, 9), want)
    edge = np.pad(a.astype(float), 2, mode="edge")
    rows = sum(w[k] * edge[:, k : k + 9] for k in range(5))
    assert np.allclose(back(P.gaussian_blur(frame(spark, a), 5, border="clamp"), 7, 9), sum(w[k] * rows[k : k + 7] for k in range(5)))


def test_lone_pixel_is_found_and_repaired(spark):
    a = np.full((6, 6), 50)
    a[2, 3], a[0, 0] = 200, 200
    p = frame(spark, a)
    assert [(r["y"], r["x"]) for r in P.lone_pixels(p).filter("lone").collect()] == [(2, 3)]
    flags = P.persistent_lone_pixels(p, min_count=1)
    assert back(P.repair_pixels(p, flags), 6, 6)[2, 3] == 50
    assert P.persistent_lone_pixels(p, min_fraction=0.2).count() == 36  # int(1 * 0.2) is 0


def test_roi_specs():
    assert P.parse_rois(["a=20,40,80,100"], 200, 100, 0.5) == [("a", 10, 20, 50, 70)]
    assert P.parse_rois(["0.5;0.5;0.25;0.25"], 200, 100, units="fraction") == [("roi1", 100, 50, 150, 75)]
    assert P.parse_rois(["0,0,1,1"], 200, 100) == [("roi1", 0, 0, 1, 1)]
    assert P.parse_rois(["40,40,100,100"], 50, 50) == [("roi1", 40, 40, 50, 50)]
    for bad in (["1,1,2,2"] * 6, ["300,1,5,5"], ["1,2,3"], ["1,1,0,4"]):
        with pytest.raises(ValueError):
            P.parse_rois(bad, 200, 100)


def test_assign_rois_raises_above_the_bound(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 5)], "frame_id int, y int, x int, v int")
    rois = lambda n: spark.createDataFrame([(f"r{k}", 0, 0, 1, 1) for k in range(n)], "roi string, x0 int, y0 int, x1 int, y1 int")
    assert P.assign_rois(pixels, rois(6)).count() == 6
    with pytest.raises(ValueError, match="at most five"):
        P.assign_rois(pixels, rois(7))


def test_label_rois(spark):
    rows = [(y, x, 1 if 5 <= y < 20 and 5 <= x < 30 else 2 if 30 <= y < 50 and 40 <= x < 70 else 0) for y in range(60) for x in range(80)]
    got = P.label_rois(spark.createDataFrame(rows, "y int, x int, label int")).orderBy("roi").collect()
    assert [(g["roi"], g["label"], g["x0"], g["y0"], g["x1"], g["y1"]) for g in got] == [("roi1", 2, 40, 30, 70, 50), ("roi2", 1, 5, 5, 30, 20)]


def test_label_rois_by_frame(spark):
    rows = [(f, 0, x, 1 + (x + f) % 7) for f in range(3) for x in range(60 + f)]
    got = P.label_rois(spark.createDataFrame(rows, "frame_id int, y int, x int, label int"), by=["frame_id"]).collect()
    for f in range(3):
        areas = sorted(((-sum(r[0] == f and r[3] == k for r in rows), k) for k in range(1, 8)))[:5]
        assert sorted((g["roi"], -g["area"], g["label"]) for g in got if g["frame_id"] == f) == [(f"roi{k}", *a) for k, a in enumerate(areas, 1)]


@pytest.mark.parametrize(("name", "sql"), [("j_label_rois_frames", "frame_id"), ("j_nearest_asof_extrema", "series_id")])
def test_whole_tables_equal_sql(spark, name, sql):
    import duckdb

    from pixelframe.plans import fixtures, queries

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    columns = queries.QUERIES[name](spark, at).columns
    got = sorted(map(tuple, queries.QUERIES[name](spark, at).collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())
    every = {"frame_id": fixtures.li_raster, "series_id": fixtures.ev_series}[sql](spark, at).select(sql).distinct().count()
    assert len({g[0] for g in got}) == every


@pytest.mark.parametrize(("name", "levels", "shape"), [("haar", 1, (8, 8)), ("db3", 2, (16, 12)), ("db3", 1, (9, 11))])
def test_wavelets_rebuild_a_single_slice(spark, name, levels, shape):
    a = np.random.default_rng(3).integers(0, 256, shape)
    assert np.abs(back(wavelet.edf_fuse(frame(spark, a), name, levels), *shape) - a).max() <= 1


def test_depth_of_field_takes_the_sharp_half_of_each_slice(spark):
    sharp = np.random.default_rng(4).integers(0, 256, (16, 16))
    left, right = sharp.copy(), sharp.copy()
    left[:, 8:], right[:, :8] = 128, 128
    p = frame(spark, left).unionByName(frame(spark, right, 1, 0, 1))
    got = back(wavelet.edf_fuse(p, "haar", 1), 16, 16)
    assert np.abs(got - sharp).mean() < 25


def test_depth_over_32_slices(spark):
    r = np.random.default_rng(5)
    stack = None
    for z in range(40):
        f = frame(spark, r.integers(0, 256, (8, 8)), z, 0, z)
        stack = f if stack is None else stack.unionByName(f)
    stack = spark.createDataFrame(stack.collect(), stack.schema)
    assert wavelet.edf_fuse(stack, "haar", 1).count() == 64


def test_one_partition_equals_many(spark):
    p = frame(spark, np.random.default_rng(6).integers(0, 256, (12, 12)))
    one, many = (sorted(map(tuple, P.gaussian_blur(x, 3).collect())) for x in (p.coalesce(1), p.repartition(9)))
    assert one == many


def test_pixel_size(spark):
    df = spark.createDataFrame([('<Pixels PhysicalSizeX="0.65">', 3, 20_000.0, 20_000.0), ('PhysicalSizeX="1250" PhysicalSizeXUnit="nm"', 2, 0.0, 50_800.0), (None, 1, 5.0, 5.0), ('PhysicalSizeX="-1"', None, 25_400.0, None)], "xml string, unit int, x double, y double")
    got = df.select(scalars.ome_pixel_size_um(F.col("xml")).alias("o"), scalars.resolution_to_um(F.col("unit"), F.col("x"), F.col("y")).alias("t")).collect()
    assert [g["o"] for g in got] == [0.65, 1.25, None, None]
    assert [g["t"] for g in got] == [0.5, 0.5, None, 1.0]
    with pytest.raises(Exception, match="no pixel size"):
        df.select(scalars.pixel_size(F.lit(None).cast("double"), scalars.ome_pixel_size_um(F.col("xml")), F.lit(None).cast("double"), True)).collect()


def test_colors():
    assert scalars.parse_color("#0f8") == (0, 255, 136) and scalars.parse_color("Orange") == (255, 165, 0) and scalars.parse_color("12") == (12.0, 12.0, 12.0)
    for bad in ("#12345", "1,2", "70000", "nothing"):
        with pytest.raises(ValueError):
            scalars.parse_color(bad)


def test_name_keys(spark):
    names = [("12_zs+3.png",), ("a_3_b_7_c.tif",), ("T15b.tif",), ("x",)]
    got = spark.createDataFrame(names, "f string").select(keys.key_timepoint_raw(F.col("f")), keys.key_index(F.col("f")), keys.key_timepoint(F.col("f")), keys.key_prefix(F.col("f"))).collect()
    assert [tuple(g) for g in got] == [(12, None, 12, "12"), (None, 7, 3, "a"), (None, None, 15, "T15b"), (None, None, 0, "x")]


def test_width_targets_and_label_sizes(spark):
    a = np.random.default_rng(4).integers(0, 256, (7, 10))
    got, scale = P.downscale_to(frame(spark, a), 7, 10, 4)
    assert scale == 0.4 and got.count() == 12
    fine = np.repeat(np.repeat(a, 3, 0), 4, 1).astype(float)  # 21 by 40: whole parts of 3 by 4 targets
    want = fine.reshape(3, 7, 4, 10).mean((1, 3))
    assert np.allclose(back(got, 3, 4), want)
    same, scale = P.downscale_to(frame(spark, a), 7, 10, 10)
    assert scale == 1.0 and (back(same, 7, 10) == a).all()
    labels = frame(spark, a).select("y", "x", F.col("v").alias("label"))
    for h, w in ((5, 23), (14, 3)):
        out = np.full((h, w), -1)
        for r in P.resize_labels(labels, 7, 10, h, w).collect():
            out[r["y"], r["x"]] = r["label"]
        assert (out == a[np.arange(h) * 7 // h][:, np.arange(w) * 10 // w]).all()


def test_decimation_counts_frames(spark):
    f = spark.createDataFrame([(0, i, 10.0) for i in range(3, 40, 3)], "stack_id int, frame_idx int, fps double")
    got = P.decimate(f, 2, 4).orderBy("frame_idx").collect()
    assert [g["frame_idx"] for g in got] == [3, 9, 15, 21] and {g["fps"] for g in got} == {5.0}
    with pytest.raises(Exception, match="too few frames"):
        P.decimate(f, 7).collect()


def test_empty_regions_have_no_motion(spark):
    p = frame(spark, np.full((4, 4), 10)).unionByName(frame(spark, np.full((4, 4), 30), 1, 0, 1))
    rois = spark.createDataFrame([("in", 0, 0, 2, 2), ("out", 9, 9, 12, 12)], "roi string, x0 int, y0 int, x1 int, y1 int")
    assert {r["roi"]: r["motion"] for r in P.motion_diff(p, rois).collect()} == {"in": 20.0, "out": 0.0}


def test_masks_paint_color_frames(spark):
    p = frame(spark, [[1, 2]]).withColumn("rgb", F.struct(*(F.lit(k).alias(c) for k, c in enumerate("rgba"))))
    mask = spark.createDataFrame([(0, 0, 255.0), (0, 1, 0.0)], "y int, x int, m double")
    got = {r["x"]: tuple(r["rgb"]) for r in P.apply_mask(p, mask, (9, 8, 7)).collect()}
    assert got == {0: (0, 1, 2, 3), 1: (9, 8, 7, 255)}


def test_files_that_no_pattern_fits_are_left_out(spark):
    f = spark.createDataFrame([("a12b.png",), ("b.png",), ("a3b.png",)], "filename string")
    assert sorted(r["key"] for r in keys.files_by_pattern(f, r"a(\d+)b").collect()) == [3, 12]
    assert keys.files_by_pattern(f, r"a\d").count() == 2
