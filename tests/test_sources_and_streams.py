"""Readers, writers, user functions, and streams against their batch forms."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pixelframe.operators import series
from pixelframe.sources import frames as S
from pixelframe.streaming import live


@pytest.fixture
def frames(spark):
    return spark.createDataFrame([(i, i // 2, i % 2, 2, 2, 8, [i, i, i, i]) for i in range(6)], "frame_id int, stack_id int, z int, height int, width int, bit_depth int, data array<int>")


def test_frame_tables(spark, frames, tmp_path):
    path = f"{tmp_path}/frames"
    S.write_frames(frames, path)
    assert sorted(r["frame_id"] for r in S.read_frame_table(spark, path).collect()) == list(range(6))
    frames.withColumn("height", F.lit(3)).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="does not fit"):
        S.read_frame_table(spark, f"{tmp_path}/bad").collect()
    with pytest.raises(ValueError):
        S.write_frames(frames.filter("false"), f"{tmp_path}/none")


def test_listing_by_extension(spark, tmp_path):
    for name in ("b.PNG", "a.png", "c.tif", "png"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in S.list_frames(spark, str(tmp_path), ["png"]).collect()] == ["a.png", "b.PNG"]


def test_mixed_folder_keeps_color_frames(spark, tmp_path):
    import struct
    import zlib

    def png(name, kind, row):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        width = len(row) // {0: 1, 2: 3, 6: 4}[kind]
        head = struct.pack(">IIBBBBB", width, 1, 8, kind, 0, 0, 0)
        (tmp_path / name).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" + bytes(row))) + chunk(b"IEND", b""))

    png("gray.png", 0, [0, 7, 255])
    png("rgb.png", 2, [255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])
    png("rgba.png", 6, [10, 200, 30, 255, 0, 0, 0, 255])
    got = {r["frame_id"].rsplit("/", 1)[1]: (r["height"], r["width"], r["data"]) for r in S.read_frames(spark, str(tmp_path)).collect()}
    assert got == {"gray.png": (1, 3, [0, 7, 255]), "rgb.png": (1, 4, [76, 150, 29, 255]), "rgba.png": (1, 2, [124, 0])}


def test_large_images(spark, tmp_path):
    """Four megapixels, gray and color, decoded as arrays."""
    import struct
    import zlib

    import numpy as np

    def png(a):
        h, w = a.shape[:2]
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        raw = b"".join(b"\0" + row.tobytes() for row in a)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")

    r = np.random.default_rng(0)
    gray, color = r.integers(0, 256, (2000, 2100), np.uint8), r.integers(0, 256, (2000, 2000, 3), np.uint8)
    for name, a in (("gray.png", gray), ("color.png", color)):
        (tmp_path / name).write_bytes(png(a))
    luminance = (color.astype(np.int64) @ [19595, 38470, 7471] + 0x8000) >> 16
    total = F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v)
    got = {x["frame_id"].rsplit("/", 1)[1]: tuple(x)[1:] for x in S.read_frames(spark, str(tmp_path)).select("frame_id", "height", "width", total, F.get("data", F.lit(12345))).collect()}
    assert got == {n: (*a.shape, int(a.sum()), int(a.ravel()[12345])) for n, a in (("gray.png", gray.astype(np.int64)), ("color.png", luminance))}


def test_csv_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("N,actual_time\n1,a\nx,b\n2,c\n1,d\n")
    assert {r["N"]: r["actual_time"] for r in S.read_timestamps(spark, str(tmp_path / "t.csv")).collect()} == {1: "d", 2: "c"}
    (tmp_path / "s.csv").write_text("filename,index,sum_brightness,actual_time\nf,0,10.9,2024-01-01 00:00:00\nf,1,bad,\nf,2,5,1700000000\n")
    got = S.read_sum_series(spark, str(tmp_path / "s.csv")).orderBy("idx").collect()
    assert [(g["idx"], g["value"]) for g in got] == [(0, 10), (2, 5)] and all(g["ts"] for g in got)
    S.write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/out", ["b", "a"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["b", "a"]


def test_user_functions(spark, frames):
    fn = lambda row: {"frame_id": row["frame_id"], "total": 10 // int(row["frame_id"])}
    got = {r["frame_id"]: (r["total"], r["error"]) for r in S.map_frames(frames, fn, "frame_id int, total int", "null").collect()}
    assert got[2] == (5, None) and got[0][0] is None and "zero" in got[0][1]
    with pytest.raises(Exception, match="zero"):
        S.map_frames(frames, fn, "frame_id int, total int").collect()
    first = lambda pdf: pdf[["stack_id", "frame_id"]].head(1)
    assert sorted(map(tuple, S.map_stacks(frames, first, "stack_id int, frame_id int").collect())) == [(0, 0), (1, 2), (2, 4)]


def test_resume(spark):
    names = spark.createDataFrame([("10_a.tif",), ("9_a.tif",), ("b_x.tif",), ("a_x.tif",)], "filename string")
    assert {r[0] for r in S.resume_from(names, "10").collect()} == {"10_a.tif", "a_x.tif", "b_x.tif"}
    assert S.resume_from(names, "77").count() == 0


def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_equal_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    events(spark).repartition(3).write.parquet(src)
    batch = {tuple(r) for r in live.tumbling_sums(events(spark), "1 hour").collect()}
    stream = live.new_frames(spark, src, events(spark).schema.json() and events(spark).schema)
    live.run_available(live.tumbling_sums(stream, "1 hour", "60 days"), f"{tmp_path}/o1", f"{tmp_path}/c1")
    q = live.tumbling_sums(stream, "1 hour").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("sums").select("event_type", "window_start", "n", "total").collect()} == batch
    live.run_available(stream.select("event_id"), f"{tmp_path}/o2", f"{tmp_path}/c2")
    n = spark.read.parquet(f"{tmp_path}/o2").count()
    live.run_available(stream.select("event_id"), f"{tmp_path}/o2", f"{tmp_path}/c2")
    assert spark.read.parquet(f"{tmp_path}/o2").count() == n == events(spark).count()
    once = live.once(stream.union(stream), "event_id", "60 days")
    live.run_available(once.select("event_id"), f"{tmp_path}/o3", f"{tmp_path}/c3")
    assert spark.read.parquet(f"{tmp_path}/o3").count() == n


def test_live_growth_equals_batch(spark, tmp_path):
    """Rows out of order over many files and two batches, repeated deliveries, rows without detection, a heartbeat at the end."""
    rows = [(s, t, 100 + 7 * t * (s + 1), t % 4 != 2) for s in range(3) for t in range(1, 12)]
    tracks = spark.createDataFrame(rows, "series_id int, timepoint int, area_pixels long, contour_found boolean")
    timed = tracks.withColumn("ts", F.timestamp_seconds(F.col("timepoint") * 60))
    beat = spark.createDataFrame([(-1, 0, 0, False)], tracks.schema).withColumn("ts", F.timestamp_seconds(F.lit(10**6)))
    run = lambda: live.run_available(live.live_growth(live.new_frames(spark, f"{tmp_path}/in", timed.schema), "1 hour"), f"{tmp_path}/out", f"{tmp_path}/c")
    timed.filter("timepoint % 3 = 0").repartition(5, "timepoint").write.parquet(f"{tmp_path}/in")
    run()
    late = timed.filter("timepoint % 3 != 0")
    late.unionByName(late.filter("series_id = 1")).repartition(5, "timepoint").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    beat.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(tuple(r) for r in series.growth_rate(tracks).collect())


def test_live_growth_beside_null_heartbeats(spark, tmp_path):
    """A heartbeat of nulls (key -1) in one partition with keys 6 and 9 leaves their rows as they are; so do unknown areas and the session's time zone."""
    rows = [(s, t, None if (s, t) == (9, 4) else 100.0 + 7 * t * (s + 1), True) for s in (6, 9) for t in range(1, 8)]
    tracks = spark.createDataFrame(rows, "series_id int, timepoint int, area_pixels double, contour_found boolean")
    timed = tracks.withColumn("ts", F.timestamp_seconds(F.col("timepoint") * 60))
    beat = spark.createDataFrame([(-1, None, None, None)], tracks.schema).withColumn("ts", F.timestamp_seconds(F.lit(10**5)))
    timed.unionByName(beat).coalesce(1).write.parquet(f"{tmp_path}/in")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
    try:
        live.run_available(live.live_growth(live.new_frames(spark, f"{tmp_path}/in", timed.schema), "20 hours"), f"{tmp_path}/out", f"{tmp_path}/c")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == 11 and sorted(got, key=str) == sorted((tuple(r) for r in series.growth_rate(tracks).collect()), key=str)


def test_live_motion_beside_null_heartbeats(spark, tmp_path):
    rows = [(s, z, [s * z, 3, z * z, None if z == 3 else 1], datetime(2020, 1, 1, 0, z)) for s in (6, 9) for z in range(5)]
    rows += [(6, None, [1, 2, 3, 4], datetime(2020, 1, 1, 1)), (9, 6, [1], datetime(2020, 1, 1, 1)), (-1, None, None, datetime(2021, 1, 1))]
    frames = spark.createDataFrame(rows, "stack_id int, z int, data array<int>, ts timestamp")
    frames.coalesce(1).write.parquet(f"{tmp_path}/in")
    live.run_available(live.live_motion(live.new_frames(spark, f"{tmp_path}/in", frames.schema)), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {(r["stack_id"], r["z"]): r["motion"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(s, z): (s + 2 * z - 1) / (3 if z in (3, 4) else 4) for s in (6, 9) for z in range(1, 5)} | {(6, None): (23 + 1 + 13 + 3) / 4}
    assert got == pytest.approx(want)


def test_stream_static_join(spark, tmp_path):
    p = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "y int, x int, v int")
    p.write.parquet(f"{tmp_path}/in")
    mask = spark.createDataFrame([(0, 1, 255.0)], "y int, x int, m double")
    live.run_available(live.enriched(live.new_frames(spark, f"{tmp_path}/in", p.schema), mask), f"{tmp_path}/out", f"{tmp_path}/c")
    assert [r["v"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [6]


def test_written_tables_need_a_shared_folder_and_can_be_dropped(spark):
    from types import SimpleNamespace

    from pixelframe.operators import durable

    unset = SimpleNamespace(get=lambda key, default=None: default, set=lambda key, value: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        durable.shared_folder(cluster)
    made = durable.written(spark.range(3), "three")
    assert made.count() == 3 and durable.drop_written(spark) >= 1
    with pytest.raises(Exception, match="(?i)path|file"):
        made.count()


def test_missing_folders_and_deep_images(spark, tmp_path):
    import struct

    assert S.list_frames(spark, f"{tmp_path}/none", ["png"]).count() == 0
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 1, 1, 16, 0, 0, 0, 0))
    with pytest.raises(ValueError, match="16-bit"):
        S.read_frames(spark, f"{tmp_path}/deep")
