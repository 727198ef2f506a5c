"""Every frame, pixel, region and series operator as a query, with its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import scalars as X
from ..operators import pixels as P
from ..operators import pulse, register, segment, series
from ..operators.durable import shared_folder
from ..sources import frames as S
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PX = ["frame_id", "y", "x"]
STACK = ["stack_id", "y", "x"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fx.with_fixtures(sql)
        return f

    return add


def r(c: str | object, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- names and scalars

@query(r"""
SELECT p_partkey, filename, try_cast(nullif(regexp_extract(filename, '^(\d+)_(-?\d+)\.png$', 1), '') AS INT) AS x,
  try_cast(nullif(regexp_extract(filename, '^(\d+)_(-?\d+)\.png$', 2), '') AS INT) AS y,
  try_cast(nullif(regexp_extract(filename, '(?i).*_(\d+)_.*\.tiff?$', 1), '') AS INT) AS idx,
  coalesce(try_cast(nullif(regexp_extract(stem, '_(\d+)$', 1), '') AS INT), try_cast(nullif(regexp_extract(stem, '(?i)t(\d+)', 1), '') AS INT),
    try_cast(nullif(regexp_extract(stem, '(\d+)_', 1), '') AS INT), try_cast(nullif(regexp_extract(stem, '(\d+)', 1), '') AS INT), 0) AS timepoint,
  CASE WHEN contains(filename, '_') THEN split_part(filename, '_', 1) ELSE stem END AS prefix,
  try_cast(nullif(regexp_extract(filename, '(?i)stack_(\d+)\.tiff?$', 1), '') AS INT) AS stack,
  try_cast(nullif(regexp_extract(filename, '(\d+)b', 1), '') AS INT) AS by_pattern
FROM (SELECT *, regexp_replace(filename, '\.[^.]*$', '') AS stem FROM nam)
""")
def k_file_keys(spark, sf):
    n = fx.names_mixed(spark, sf)
    f = F.col("filename")
    xy = K.key_xy(f)
    return n.select("p_partkey", "filename", xy["x"].alias("x"), xy["y"].alias("y"), K.key_index(f).alias("idx"), K.key_timepoint(f).alias("timepoint"),
        K.key_prefix(f).alias("prefix"), K.key_stack(f).alias("stack"), K.key_by_pattern(f, r"(\d+)b").alias("by_pattern"))


@query(r"""
SELECT filename, n, CASE WHEN n IS NULL THEN filename ELSE concat(CAST(n + 5 AS VARCHAR), regexp_extract(filename, '^\d+(_zs.*)', 1)) END AS moved, count(*) AS files
FROM (SELECT filename, try_cast(nullif(regexp_extract(filename, '^(\d+)_zs.*', 1), '') AS INT) AS n,
  try_cast(regexp_extract(filename, '_zs\+(\d+)\.png$', 1) AS INT) AS z FROM ord)
WHERE z BETWEEN 1 AND 5 AND (z - 1) % 2 = 0 GROUP BY ALL
""")
def k_subset_and_offset(spark, sf):
    n = K.subset_z(fx.names_orders(spark, sf), 1, 5, 2).withColumn("original", F.col("filename"))
    moved = K.offset_timepoints(n, 5)
    return moved.groupBy(F.col("original").alias("filename"), K.key_timepoint_raw(F.col("original")).alias("n"), F.col("filename").alias("moved")).agg(F.count("*").alias("files"))


@query(r"""
SELECT p_partkey, stem || '_edf.tif' AS edf, stem || '_superimposed' || ext AS fused, stem || '_brightfield_max' || ext AS bright_max, stem || '.png' AS png,
  regexp_replace(stem, '(?i)\.ome$', '') || '.ome.tif' AS ome, stem || '_contour' || ext AS contour
FROM (SELECT p_partkey, regexp_replace(filename, '\.[^.]*$', '') AS stem, regexp_extract(filename, '\.[^.]*$') AS ext FROM nam)
""")
def s_output_names(spark, sf):
    f = F.col("filename")
    return fx.names_mixed(spark, sf).select("p_partkey", K.output_name(f, "edf").alias("edf"), K.output_name(f, "fuse").alias("fused"),
        K.output_name(f, "fuse", "max", True).alias("bright_max"), K.output_name(f, "png").alias("png"), K.output_name(f, "ome").alias("ome"), K.output_name(f, "contour").alias("contour"))


@query("""
SELECT p_partkey, round(ome, 9) AS ome_um, round(tag, 9) AS tag_um, round(coalesce(ome, tag), 9) AS pixel_um, round(round_even(1e7 / ome, 0) / 1000, 6) AS per_cm
FROM (SELECT p_partkey, (xres + 0.5)::DOUBLE * CASE unit WHEN 0 THEN 0.001 WHEN 2 THEN 1000.0 ELSE 1.0 END AS ome,
  CASE WHEN unit = 2 THEN 25400.0 WHEN unit = 3 THEN 10000.0 END / ((xres + yres) / 2) AS tag FROM met)
""")
def s_calibration(spark, sf):
    m = fx.meta_part(spark, sf).withColumns({"ome": X.ome_pixel_size_um(F.col("ome_xml")), "tag": X.resolution_to_um(F.col("unit"), F.col("xres"), F.col("yres"))})
    found = X.pixel_size(F.lit(None).cast("double"), F.col("ome"), F.col("tag"))
    return m.select("p_partkey", r("ome", 9).alias("ome_um"), r("tag", 9).alias("tag_um"), r(found, 9).alias("pixel_um"), r(X.um_to_resolution(F.col("ome"))).alias("per_cm"))


@query("""
SELECT s AS offset_text, round(sec, 3) AS seconds, CASE WHEN sec IS NULL THEN NULL ELSE
  printf('%02d:%02d:%06.3f', CAST(floor(sec / 3600) AS INT), CAST(floor((sec - floor(sec / 3600) * 3600) / 60) AS INT),
    sec - floor(sec / 3600) * 3600 - floor((sec - floor(sec / 3600) * 3600) / 60) * 60) END AS elapsed
FROM (SELECT DISTINCT s, CASE WHEN k = 0 THEN -(60.0 * m + 7.5) WHEN k = 1 THEN 3600.0 * h + 60.0 * m + 5 WHEN k = 2 THEN m::DOUBLE END AS sec
  FROM (SELECT k, m, h, CASE k WHEN 0 THEN '-' || m || ':07.5' WHEN 1 THEN '+' || h || ':' || m || ':05' WHEN 2 THEN ' ' || m ELSE 'x' || m END AS s
    FROM (SELECT p_partkey % 4 AS k, p_size % 60 AS m, p_partkey % 23 AS h FROM part)))
""")
def x_time_offsets(spark, sf):
    p = fx.table(spark, sf, "part").select((F.col("p_partkey") % 4).alias("k"), (F.col("p_size") % 60).cast("string").alias("m"), (F.col("p_partkey") % 23).cast("string").alias("h"))
    s = F.when(F.col("k") == 0, F.concat(F.lit("-"), "m", F.lit(":07.5"))).when(F.col("k") == 1, F.concat(F.lit("+"), "h", F.lit(":"), "m", F.lit(":05"))).when(
        F.col("k") == 2, F.concat(F.lit(" "), "m")).otherwise(F.concat(F.lit("x"), "m"))
    t = p.select(s.alias("offset_text")).distinct().withColumn("sec", X.parse_time_offset(F.col("offset_text")))
    return t.select("offset_text", r("sec", 3).alias("seconds"), F.when(F.col("sec").isNotNull(), X.format_elapsed(F.col("sec"))).alias("elapsed"))


@query("""
SELECT p_partkey, c AS color, CASE k WHEN 0 THEN 255.0 WHEN 1 THEN n * 17.0 WHEN 2 THEN 7.0 WHEN 3 THEN n * 1.0 END AS red, CASE k WHEN 0 THEN 165.0 WHEN 1 THEN 170.0
  WHEN 2 THEN n * 1.0 WHEN 3 THEN n * 1.0 END AS green, CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 51.0 WHEN 2 THEN 300.0 WHEN 3 THEN n * 1.0 END AS blue
FROM (SELECT p_partkey, p_partkey % 5 AS k, p_size % 10 AS n, CASE p_partkey % 5 WHEN 0 THEN 'Orange' WHEN 1 THEN '#' || (p_size % 10) || 'A3' WHEN 2 THEN '7,' || (p_size % 10) || ',300'
  WHEN 3 THEN CAST(p_size % 10 AS VARCHAR) ELSE 'no color' END AS c FROM part)
""")
def p_colors(spark, sf):
    n = (F.col("p_size") % 10).cast("string")
    k = F.col("p_partkey") % 5
    c = F.when(k == 0, "Orange").when(k == 1, F.concat(F.lit("#"), n, F.lit("A3"))).when(k == 2, F.concat(F.lit("7,"), n, F.lit(",300"))).when(k == 3, n).otherwise("no color")
    rgb = fx.table(spark, sf, "part").select("p_partkey", c.alias("color")).withColumn("rgb", X.color_of(F.col("color")))
    return rgb.select("p_partkey", "color", F.col("rgb.r").alias("red"), F.col("rgb.g").alias("green"), F.col("rgb.b").alias("blue"))


@query("""
WITH d AS (SELECT o_orderkey, o_orderkey % 11 AS k, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS t FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN epoch_us(t) WHEN 1 THEN epoch_us(t) + 250000 WHEN 2 THEN epoch_us(t) WHEN 3 THEN epoch_us(date_trunc('minute', t))
  WHEN 4 THEN epoch_us(date_trunc('day', t)::TIMESTAMP) WHEN 5 THEN epoch_us(date_trunc('day', t)::TIMESTAMP) WHEN 6 THEN epoch_us(TIMESTAMP '1900-01-01' + (t - date_trunc('day', t)))
  WHEN 7 THEN epoch_us(TIMESTAMP '1900-01-01' + (date_trunc('minute', t) - date_trunc('day', t))) WHEN 8 THEN epoch_us(t) END::BIGINT AS micros FROM d
""")
def x_timestamps(spark, sf):
    k = F.col("o_orderkey") % 11
    t = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.'25'", "MM/dd/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "yyyy-MM-dd", "MM/dd/yyyy", "HH:mm:ss", "H:mm"]
    s = F.when(k == 8, F.unix_seconds(t).cast("string")).when(k == 9, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
    for n, form in enumerate(formats):
        s = s.when(k == n, F.date_format(t, form))
    return fx.table(spark, sf, "orders").select("o_orderkey", F.unix_micros(X.parse_timestamp(s.otherwise("soon"))).alias("micros"))


@query("""
SELECT p_partkey, 'r' || (p_partkey % 3) AS name, (p_size * 1.0) AS x, 4.0 AS h, greatest(0, CAST(round_even(p_size / 0.65, 0) AS INT)) AS bar_px FROM part
""")
def x_roi_spec_and_bar(spark, sf):
    p = fx.table(spark, sf, "part")
    spec = F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string"), F.lit("="), F.col("p_size").cast("string"), F.lit(";2;3, 4"))
    roi = X.parse_roi(spec)
    return p.select("p_partkey", roi["name"].alias("name"), F.get(roi["v"], F.lit(0)).alias("x"), F.get(roi["v"], F.lit(3)).alias("h"), X.scale_bar_px(F.col("p_size"), F.lit(0.65)).alias("bar_px"))


@query("""
SELECT s.p_partkey, s.filename FROM nam s WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_partkey FROM part WHERE p_size < 25) d WHERE d.p_partkey = s.p_partkey)
""")
def s_resume_skip_existing(spark, sf):
    from ..sources.frames import skip_existing

    return skip_existing(fx.names_mixed(spark, sf), fx.table(spark, sf, "part").filter("p_size < 25"), "p_partkey")


@query("""
WITH k AS (SELECT *, try_cast(prefix AS INT) IS NULL AS txt, coalesce(try_cast(prefix AS INT), 0) AS num
  FROM (SELECT p_partkey, filename, CASE WHEN contains(filename, '_') THEN split_part(filename, '_', 1) ELSE regexp_replace(filename, '\\.[^.]*$', '') END AS prefix FROM nam))
SELECT p_partkey, filename FROM k WHERE (txt, num, prefix) >= (SELECT (txt, num, prefix) FROM k WHERE prefix = '30' LIMIT 1)
""".replace("\\\\", "\\"))
def s_resume_from_prefix(spark, sf):
    from ..sources.frames import resume_from

    return resume_from(fx.names_mixed(spark, sf), "30")


# --- pixel projections

@query("SELECT frame_id, stack_id, 8 AS height, 8 AS width, list(v ORDER BY y, x) AS data FROM px8 GROUP BY 1, 2")
def s_frames_and_back(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("stack_id"), F.lit(8).alias("width"),
        F.transform("embedding", lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((v.cast("double") + 1) * 127.5))).cast("int")).alias("data"))
    p = P.explode_frames(e)
    return P.implode_pixels(p).join(e.select("frame_id", "stack_id"), "frame_id").select("frame_id", "stack_id", "height", "width", "data")


@query("SELECT frame_id, y - 1 AS y, x - 2 AS x, v FROM px8 WHERE y >= 1 AND y < 8 AND x >= 2 AND x < 5")
def p_crop(spark, sf):
    return P.crop(fx.px8(spark, sf), left=2, top=1, right=3).select(*PX, "v")


@query("""
SELECT 8 AS bits, frame_id, y, x, CAST(least(255, round_even(v * 1.3, 0)) AS INT) AS v FROM px8 UNION ALL
SELECT 16, frame_id, y, x, CAST(trunc(least(65535, v * 1.3)) AS INT) FROM px16
""")
def p_scale_brightness(spark, sf):
    a, b = (P.scale_brightness(p, 1.3) for p in (fx.px8(spark, sf), fx.px16(spark, sf)))
    return a.unionByName(b).select(F.col("bit_depth").alias("bits"), *PX, "v")


@query("""
SELECT 8 AS bits, frame_id, y, x, CAST(trunc(greatest(0, least(65535, (v - 80.0) * 65535 / 120))) AS INT) AS v FROM px8 UNION ALL
SELECT 16, frame_id, y, x, CAST(trunc(greatest(0, least(65535, (v * 255.0 / max(v) OVER (PARTITION BY frame_id) - 80.0) * 65535 / 120))) AS INT) FROM px16
""")
def p_scale_colors(spark, sf):
    a, b = (P.scale_colors(p, 200, 80).withColumn("bits", F.lit(n)) for n, p in ((8, fx.px8(spark, sf)), (16, fx.px16(spark, sf))))
    return a.unionByName(b).select("bits", *PX, "v")


@query("""
SELECT 8 AS bits, frame_id, y, x, 0 AS r, CAST(trunc(round(pow(v / 255.0, 1.5) * 255, 9)) AS INT) AS g, 0 AS b FROM px8 UNION ALL
SELECT 16, frame_id, y, x, 0, CAST(trunc(trunc(round(pow(v / 65535.0, 1.5) * 65535, 9)) * 255.0 / 65535.0) AS INT), 0 FROM px16
""")
def p_grey_to_color(spark, sf):
    a, b = (P.grey_to_color(p, "green", 1.5) for p in (fx.px8(spark, sf), fx.px16(spark, sf)))
    return a.unionByName(b).select(F.col("bit_depth").alias("bits"), *PX, "rgb.r", "rgb.g", "rgb.b")


@query("SELECT 16 AS bits, frame_id, y, x, v * 257 AS v FROM px8 UNION ALL SELECT 8, frame_id, y, x, v // 257 FROM px16")
def p_to_bit_depth(spark, sf):
    both = P.to_bit_depth(fx.px8(spark, sf), 16).unionByName(P.to_bit_depth(fx.px16(spark, sf), 8))
    return both.select(F.col("bit_depth").alias("bits"), *PX, "v")


@query("""
SELECT frame_id, y, x, CASE WHEN first8 = (z % 3 = 0) THEN v WHEN first8 THEN v // 257 ELSE v * 257 END AS v
FROM (SELECT *, true AS first8 FROM (SELECT frame_id, y, x, z, v FROM px8 WHERE z % 3 = 0 UNION ALL SELECT frame_id, y, x, z, v FROM px16 WHERE z % 3 <> 0))
""")
def p_bundle_depth(spark, sf):
    mixed = fx.px8(spark, sf).filter("z % 3 = 0").unionByName(fx.px16(spark, sf).filter("z % 3 <> 0"))
    return P.bundle_depth(mixed).select(*PX, "v")


@query("""
WITH d AS (SELECT frame_id, y, x, v // 256 AS v FROM px16), m AS (SELECT *, min(v) OVER (PARTITION BY frame_id) AS lo, max(v) OVER (PARTITION BY frame_id) AS hi FROM d)
SELECT frame_id, y, x, CASE WHEN hi > lo THEN CAST(trunc((v - lo) * 255.0 / (hi - lo)) AS INT) ELSE 128 END AS v FROM m
""")
def p_to_8bit_scaled(spark, sf):
    return P.to_8bit_scaled(fx.px16(spark, sf)).select(*PX, "v")


def _normalized(mode: str, part: str) -> str:
    if mode == "none":
        return "SELECT frame_id, y, x, least(v, 255) AS v FROM px16"
    return f"""SELECT frame_id, y, x, CAST(trunc((v - lo) * 255.0 / (hi - lo)) AS INT) AS v FROM (
  SELECT *, min(v) OVER (PARTITION BY {part}) AS lo, max(v) OVER (PARTITION BY {part}) AS hi FROM px16)"""


@query(_normalized("global", "stack_id"))
def p_normalize_global(spark, sf):
    return P.normalize_frames(fx.px16(spark, sf), "global").select(*PX, "v")


@query(_normalized("per-frame", "frame_id"))
def p_normalize_per_frame(spark, sf):
    return P.normalize_frames(fx.px16(spark, sf), "per-frame").select(*PX, "v")


@query(_normalized("none", ""))
def p_normalize_none(spark, sf):
    return P.normalize_frames(fx.px16(spark, sf), "none").select(*PX, "v")


@query("""SELECT frame_id, y, x, CAST(round_even((v - lo) * 255.0 / (hi - lo), 0) AS INT) AS v FROM (
  SELECT *, min(v) OVER (PARTITION BY frame_id) AS lo, max(v) OVER (PARTITION BY frame_id) AS hi FROM px8)""")
def p_minmax_normalize(spark, sf):
    return P.minmax_normalize(fx.px8(spark, sf)).select(*PX, "v")


@query("SELECT frame_id, y, x, greatest(255 - v - 100, 0) AS v FROM px8")
def p_optical_density(spark, sf):
    return P.subtract_background(P.optical_density(fx.px8(spark, sf)), 100).select(*PX, "v")


@query("SELECT frame_id, CASE WHEN max(v) > 255 THEN 16 ELSE 8 END AS bit_depth FROM li GROUP BY 1")
def p_detect_bit_depth(spark, sf):
    return P.detect_bit_depth(fx.li_raster(spark, sf))


@query("SELECT frame_id, y, x, round(0.299 * v + 0.587 * (255 - v) + 0.114 * y, 6) AS gray FROM px8")
def p_luminance(spark, sf):
    rgb = F.struct(F.col("v").alias("r"), (255 - F.col("v")).alias("g"), F.col("y").alias("b"))
    return fx.px8(spark, sf).withColumn("rgb", rgb).select(*PX, r(X.luminance(F.col("rgb"))).alias("gray"))


@query("SELECT frame_id, y, x, CASE WHEN y BETWEEN 6 AND 7 AND x BETWEEN 1 AND 4 THEN 255 ELSE v END AS v FROM px8")
def p_scale_bar(spark, sf):
    return P.overlay_scale_bar(fx.px8(spark, sf), 1.5, 0.5, margin=1, bar_height=1).select(*PX, "v")


@query("SELECT frame_id, stack_id AS video, z AS frame_idx, 5.0 AS fps, round((z + 0.5) / 10.0, 6) AS time_s FROM (SELECT DISTINCT frame_id, stack_id, z FROM px8) WHERE z % 2 = 0 AND z < 20")
def p_decimate(spark, sf):
    frames = fx.px8(spark, sf).select("frame_id", F.col("stack_id").alias("video"), F.col("z").alias("frame_idx"), F.lit(10.0).alias("fps")).distinct()
    return pulse.with_times(P.decimate(frames, 2, 10, by="video").withColumn("idx", F.col("frame_idx")), 10.0).select("frame_id", "video", "frame_idx", "fps", r("time_s").alias("time_s"))


# --- joins

@query("SELECT frame_id, y, x, CASE WHEN m / 255.0 < 0.5 THEN 76 ELSE v END AS v FROM px8 JOIN mask8 USING (y, x)")
def j_hard_mask(spark, sf):
    return P.apply_mask(fx.px8(spark, sf), fx.mask8(spark), X.parse_color("red")).select(*PX, "v")


@query("SELECT frame_id, sum(v)::DOUBLE AS sum_brightness, count(*) AS masked_area FROM px8 JOIN mask8 USING (y, x) WHERE m > 127 GROUP BY 1")
def j_masked_sum(spark, sf):
    return P.sum_brightness(fx.px8(spark, sf), mask=fx.mask8(spark))


@query("""
WITH g AS (SELECT frame_id, y, x FROM px8 WHERE v >= 165), p AS (SELECT px8.*, g.y IS NOT NULL AS inside FROM px8 LEFT JOIN g USING (frame_id, y, x))
SELECT frame_id, CASE WHEN count(*) FILTER (inside) > 0 THEN sum(v) FILTER (inside) ELSE sum(v) END::DOUBLE AS sum_brightness, count(*) FILTER (inside) AS masked_area FROM p GROUP BY 1
""")
def j_region_sum(spark, sf):
    p = fx.px8(spark, sf)
    return P.region_sum(p, p.filter("v >= 165"))


@query("SELECT s.series_id, s.idx, coalesce(CAST(t.at AS VARCHAR), '') AS actual_time FROM evs s LEFT JOIN (SELECT idx, min(strftime(ts, '%Y-%m-%d')) AS at FROM evs WHERE idx % 3 <> 0 GROUP BY 1) t USING (idx)")
def j_merge_timestamps(spark, sf):
    s = fx.ev_series(spark, sf)
    times = s.filter("idx % 3 <> 0").groupBy(F.col("idx").alias("N")).agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("actual_time"))
    return P.merge_timestamps(s.withColumnRenamed("idx", "index"), times).select("series_id", F.col("index").alias("idx"), "actual_time")


_AROUND = """
n AS (SELECT c.frame_id, c.stack_id, c.y, c.x, c.v, q.v AS nv FROM px8 c, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dy, dx), px8 q
  WHERE q.frame_id = c.frame_id AND q.y = greatest(0, least(7, c.y + dy)) AND q.x = greatest(0, least(7, c.x + dx))),
a AS (SELECT frame_id, stack_id, y, x, v, bool_and(v > nv * 1.05) AS lone, sum(nv) AS s FROM n GROUP BY 1, 2, 3, 4, 5)"""


@query(f"WITH {_AROUND} SELECT frame_id, y, x, lone FROM a")
def j_lone_pixels(spark, sf):
    return P.lone_pixels(fx.px8(spark, sf), 0.05).select(*PX, "lone")


@query(f"WITH {_AROUND}, f AS (SELECT stack_id, y, x FROM a GROUP BY 1, 2, 3 HAVING count(*) FILTER (lone) >= floor(count(*) * 0.02)) SELECT a.frame_id, a.y, a.x, CASE WHEN f.y IS NULL THEN a.v ELSE CAST(a.s AS INT) // 8 END AS v FROM a LEFT JOIN f USING (stack_id, y, x)")
def j_repair_lone_pixels(spark, sf):
    p = fx.px8(spark, sf)
    return P.repair_pixels(p, P.persistent_lone_pixels(p, 0.05, 0.02)).select(*PX, "v")


@query("SELECT roi, frame_id, avg(v)::DOUBLE AS mean_v, count(*) AS n FROM (SELECT r.roi, p.frame_id, p.v FROM px8 p JOIN rois8 r ON p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1) GROUP BY 1, 2")
def j_roi_join(spark, sf):
    return P.assign_rois(fx.px8(spark, sf), fx.rois8(spark)).groupBy("roi", "frame_id").agg(F.avg("v").alias("mean_v"), F.count("*").alias("n"))


_BLUR = """
t(d, w) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
rx AS (SELECT p.frame_id, p.y, p.x, sum(q.v * w) AS v FROM px8 p, t, px8 q WHERE q.frame_id = p.frame_id AND q.y = p.y AND q.x = 7 - abs(((p.x + d + 14) % 14) - 7) GROUP BY 1, 2, 3),
bl AS (SELECT p.frame_id, p.y, p.x, sum(q.v * w) / 256.0 AS v FROM rx p, t, rx q WHERE q.frame_id = p.frame_id AND q.x = p.x AND q.y = 7 - abs(((p.y + d + 14) % 14) - 7) GROUP BY 1, 2, 3)"""


@query(f"WITH {_BLUR} SELECT frame_id, y, x, round(v, 6)::DOUBLE AS v FROM bl")
def j_gaussian_blur(spark, sf):
    return P.gaussian_blur(fx.px8(spark, sf), 5).withColumn("v", r("v"))


@query(f"WITH {_BLUR} SELECT frame_id, max(floor(v + 0.5))::DOUBLE AS max_value, 255.0::DOUBLE AS abs_max, round(max(floor(v + 0.5)) / 255.0, 6)::DOUBLE AS ratio FROM bl GROUP BY 1")
def a_max_brightness(spark, sf):
    return P.find_max_brightness(fx.px8(spark, sf)).withColumn("ratio", r("ratio"))


@query("""
WITH s(dy, dx) AS (SELECT a.i, b.i FROM range(-1, 2) a(i), range(-1, 2) b(i)),
c AS (SELECT f.frame_id, dy, dx, round(corr(f.v::DOUBLE, g.v::DOUBLE), 9) AS c FROM px8 f, s, px8 g WHERE g.stack_id = f.stack_id AND g.z = 0 AND g.y = f.y - dy AND g.x = f.x - dx GROUP BY 1, 2, 3)
SELECT frame_id, arg_max(dy, k)::INT AS dy, arg_max(dx, k)::INT AS dx, round(max(c), 6) AS corr FROM (SELECT *, row(c, -(abs(dy) + abs(dx)), -dy, -dx) AS k FROM c) GROUP BY 1
""")
def j_estimate_shift(spark, sf):
    p = fx.px8(spark, sf)
    return register.estimate_shift(p, p.filter("z = 0").select("stack_id", "y", "x", "v"), 1).withColumn("corr", r("corr"))


@query("""
WITH s(dy, dx) AS (SELECT a.i, b.i FROM range(-2, 3) a(i), range(-2, 3) b(i)),
c AS (SELECT f.frame_id, dy, dx, round(corr(f.v::DOUBLE, g.v::DOUBLE), 9) AS c FROM px8 f, s, px8 g WHERE g.stack_id = f.stack_id AND g.z = 0 AND g.y = f.y - dy AND g.x = f.x - dx GROUP BY 1, 2, 3),
b AS (SELECT frame_id, arg_max(dy, k) AS dy, arg_max(dx, k) AS dx, max(c) AS c FROM (SELECT *, row(c, -(abs(dy) + abs(dx)), -dy, -dx) AS k FROM c) GROUP BY 1),
n AS (SELECT b.*, (SELECT max(c) FROM c WHERE c.frame_id = b.frame_id AND c.dy = b.dy - 1 AND c.dx = b.dx) AS up, (SELECT max(c) FROM c WHERE c.frame_id = b.frame_id AND c.dy = b.dy + 1 AND c.dx = b.dx) AS down,
  (SELECT max(c) FROM c WHERE c.frame_id = b.frame_id AND c.dy = b.dy AND c.dx = b.dx - 1) AS l, (SELECT max(c) FROM c WHERE c.frame_id = b.frame_id AND c.dy = b.dy AND c.dx = b.dx + 1) AS r FROM b)
SELECT frame_id, round(dy + CASE WHEN up - 2 * c + down < 0 THEN (up - down) / (2 * (up - 2 * c + down)) ELSE 0 END, 4)::DOUBLE AS dy,
  round(dx + CASE WHEN l - 2 * c + r < 0 THEN (l - r) / (2 * (l - 2 * c + r)) ELSE 0 END, 4)::DOUBLE AS dx, round(c, 6) AS corr FROM n
""")
def j_estimate_shift_subpixel(spark, sf):
    p = fx.px8(spark, sf)
    s = register.estimate_shift(p, p.filter("z = 0").select("stack_id", "y", "x", "v"), 2, subpixel=True)
    return s.select("frame_id", r("dy", 4).alias("dy"), r("dx", 4).alias("dx"), r("corr").alias("corr"))


@query("SELECT a.frame_id, a.y, a.x, coalesce(b.v, 0) AS v FROM px8 a LEFT JOIN px8 b ON b.frame_id = a.frame_id AND b.y = a.y + (a.z % 3) - 1 AND b.x = a.x + (a.z % 2)")
def j_apply_shift(spark, sf):
    p = fx.px8(spark, sf)
    shifts = p.select("frame_id", (F.col("z") % 3 - 1).alias("dy"), (F.col("z") % 2).alias("dx")).distinct()
    return register.apply_shift(p, shifts).select(*PX, "v")


@query("""
WITH p AS (SELECT series_id, idx FROM evs WHERE idx % 7 = 3), t AS (SELECT series_id, idx AS trough FROM evs WHERE idx % 5 = 0)
SELECT series_id, idx, arg_min(trough, row(abs(trough - idx), trough)) AS trough FROM p JOIN t USING (series_id) GROUP BY 1, 2
""")
def j_nearest_asof(spark, sf):
    s = fx.ev_series(spark, sf)
    return pulse.nearest_asof(s.filter("idx % 7 = 3"), s.filter("idx % 5 = 0"))


@query("""
WITH l AS (SELECT y + 32 * frame_id AS y, x, v % 9 AS label FROM li WHERE v % 9 > 0),
b AS (SELECT label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM l GROUP BY 1)
SELECT 'roi' || row_number() OVER (ORDER BY area DESC, label) AS roi, * FROM b ORDER BY area DESC, label LIMIT 5
""")
def j_label_rois(spark, sf):
    tall = fx.li_raster(spark, sf).select((F.col("y") + 32 * F.col("frame_id")).alias("y"), "x", (F.col("v") % 9).alias("label"))
    return P.label_rois(tall)


@query("""
WITH l AS (SELECT frame_id, y, x, v % 9 AS label FROM li WHERE v % 9 > 0),
b AS (SELECT frame_id, label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM l GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, label) AS k FROM b)
SELECT frame_id, 'roi' || k AS roi, label, area, x0, y0, x1, y1 FROM k WHERE k <= 5
""")
def j_label_rois_frames(spark, sf):
    return P.label_rois(fx.li_raster(spark, sf).select("frame_id", "y", "x", (F.col("v") % 9).alias("label")), by=["frame_id"])


@query("""
WITH n AS (SELECT series_id, idx, value, lag(value) OVER w AS p, lead(value) OVER w AS q FROM evs WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
p AS (SELECT series_id, idx FROM n WHERE value > p AND value > q), t AS (SELECT series_id, idx AS trough FROM n WHERE value < p AND value < q)
SELECT series_id, idx, arg_min(trough, row(abs(trough - idx), trough)) AS trough FROM p JOIN t USING (series_id) GROUP BY 1, 2
""")
def j_nearest_asof_extrema(spark, sf):
    s = fx.ev_series(spark, sf)
    return pulse.nearest_asof(pulse.local_maxima(s), pulse.local_maxima(s.withColumn("value", -F.col("value"))))


# --- aggregations

@query("SELECT frame_id, sum(v)::DOUBLE AS sum_brightness FROM px8 GROUP BY 1")
def a_sum_brightness(spark, sf):
    return P.sum_brightness(fx.px8(spark, sf))


@query("SELECT frame_id, sum(greatest(255 - v - 110, 0))::DOUBLE AS sum_optical_density FROM px8 GROUP BY 1")
def a_sum_optical_density(spark, sf):
    return P.sum_brightness(fx.px8(spark, sf), brightfield=True, background=110)


for _name, _sql in {"mean": "round(avg(v), 9)", "max": "max(v)", "median": "median(v)", "std": "round(stddev_pop(v), 9)", "percentile": "quantile_cont(v, 0.9)"}.items():

    def _fuse(spark, sf, name=_name):
        return P.fuse_project(fx.px8(spark, sf), name).select(*STACK, "v")

    _fuse.__name__ = f"a_project_{_name}"
    query(f"SELECT stack_id, y, x, CAST(trunc({_sql}) AS INT) AS v FROM px8 GROUP BY 1, 2, 3")(_fuse)


@query("""SELECT stack_id, y, x, CAST(trunc(round((v - lo)::DOUBLE / (hi - lo) * 255, 9)) AS INT) AS v FROM (
  SELECT *, min(v) OVER (PARTITION BY stack_id) AS lo, max(v) OVER (PARTITION BY stack_id) AS hi FROM (SELECT stack_id, y, x, max(v) AS v FROM px8 GROUP BY 1, 2, 3))""")
def a_project_brightfield(spark, sf):
    return P.fuse_project(fx.px8(spark, sf), "max", brightfield=True).select(*STACK, "v")


@query("SELECT frame_id, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY frame_id ORDER BY v)::BIGINT AS cdf FROM px8 GROUP BY 1, 2")
def a_histogram(spark, sf):
    return P.histogram(fx.px8(spark, sf), ["frame_id"])


@query("SELECT stack_id, list(frame_id ORDER BY z) AS frame_ids FROM (SELECT DISTINCT stack_id, frame_id, z FROM px8) GROUP BY 1")
def a_bundle_stacks(spark, sf):
    return P.bundle_stacks(fx.px8(spark, sf).select("stack_id", "frame_id", "z").distinct())


@query("SELECT frame_id, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, round(avg(v), 6) AS v FROM px8 GROUP BY 1, 2, 3")
def a_downscale(spark, sf):
    return P.downscale(fx.px8(spark, sf), 4).withColumn("v", r("v"))


_DIFF = "d AS (SELECT stack_id, z, y, x, abs(v - lag(v) OVER (PARTITION BY stack_id, y, x ORDER BY z)) AS diff FROM px8)"


@query(f"WITH {_DIFF} SELECT stack_id, y, x, round(stddev_pop(diff), 6) AS amplitude FROM d WHERE diff IS NOT NULL GROUP BY 1, 2, 3")
def a_amplitude_map(spark, sf):
    return P.amplitude_map(P.frame_diff(fx.px8(spark, sf))).withColumn("amplitude", r("amplitude"))


@query("SELECT stack_id, y, x, median(v) AS v FROM px8 GROUP BY 1, 2, 3")
def a_reference_frame(spark, sf):
    return P.reference_frame(fx.px8(spark, sf))


@query(f"WITH {_DIFF} SELECT stack_id, roi, z, round(avg(diff), 6) AS motion FROM d JOIN rois8 ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 WHERE diff IS NOT NULL GROUP BY 1, 2, 3")
def a_motion_by_roi(spark, sf):
    return P.motion_diff(fx.px8(spark, sf), fx.rois8(spark)).withColumn("motion", r("motion"))


@query("SELECT stack_id, y, x, round(avg(v), 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, y, x ORDER BY v DESC, z) AS k FROM px8) WHERE k <= 3 GROUP BY 1, 2, 3")
def w_top_n_mean(spark, sf):
    return P.top_n_mean(fx.px8(spark, sf), 3).withColumn("v", r("v"))


# --- series

@query("SELECT series_id, idx, round(avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS ma FROM evs")
def w_moving_average(spark, sf):
    return series.moving_average(fx.ev_series(spark, sf), 5).select("series_id", "idx", r("ma").alias("ma"))


_T = ", ".join(f"({df}, {series.t_quantile(0.975, df)!r})" for df in range(1, 7))


@query(f"""
SELECT series_id, idx, round(CASE WHEN n > 1 THEN q * s / sqrt(n) ELSE 0 END, 6) AS ci FROM (
  SELECT series_id, idx, count(*) OVER w AS n, stddev_samp(value) OVER w AS s FROM evs WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
LEFT JOIN (VALUES {_T}) t(df, q) ON df = n - 1
""")
def w_confidence_band(spark, sf):
    return series.confidence_band(fx.ev_series(spark, sf), 7).select("series_id", "idx", r("ci").alias("ci"))


@query("SELECT series_id, idx, round(value / avg(CASE WHEN idx <= 4 THEN value END) OVER (PARTITION BY series_id) * 100, 6) AS pct FROM evs")
def w_percent_of_initial(spark, sf):
    return series.percent_of_initial(fx.ev_series(spark, sf), 4).select("series_id", "idx", r("pct").alias("pct"))


@query("""
WITH m AS (SELECT series_id, idx, (epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY series_id ORDER BY idx))) / 6e7 AS minutes FROM evs),
k AS (SELECT * FROM m WHERE minutes <= 20 * 1440.0)
SELECT series_id, idx, round(minutes, 6) AS minutes, 'days' AS unit, round(minutes / 1440, 6) AS t FROM k
""")
def w_time_axis(spark, sf):
    s = series.auto_time_unit(series.days_limit(series.relative_minutes(fx.ev_series(spark, sf)), 20))
    return s.select("series_id", "idx", r("minutes").alias("minutes"), "unit", r("t").alias("t"))


@query("""
WITH f AS (SELECT try_cast(regexp_extract(filename, '^(\\d+)_zs', 1) AS INT) AS N, filename, mtime FROM ord),
g AS (SELECT N, arg_min(filename, row(filename, mtime)) AS filename, arg_min(mtime, row(filename, mtime)) AS mtime FROM f GROUP BY 1),
e AS (SELECT *, (epoch_us(mtime) - epoch_us(arg_min(mtime, N) OVER ())) / 1e6 AS raw FROM g), a AS (SELECT *, raw - 90.5 AS el FROM e)
SELECT N, filename, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS actual_time, round(el, 3) AS elapsed_seconds, round(raw, 3) AS raw_elapsed_seconds,
  printf('%02d:%02d:%06.3f', CAST(floor(el / 3600) AS INT), CAST(floor((el - floor(el / 3600) * 3600) / 60) AS INT),
    el - floor(el / 3600) * 3600 - floor((el - floor(el / 3600) * 3600) / 60) * 60) AS elapsed_time FROM a
""".replace("\\\\", "\\"))
def w_extract_times(spark, sf):
    f = fx.names_orders(spark, sf).withColumn("N", K.key_timepoint_raw(F.col("filename")))
    return series.extract_times(f, -90.5).select("N", "filename", "actual_time", "elapsed_seconds", "raw_elapsed_seconds", "elapsed_time")


@query("""
SELECT series_id, timepoint, round((area_pixels - a) * 100.0 / a, 6) AS growth_pct FROM (
  SELECT *, lag(area_pixels) OVER w AS a, lag(timepoint) OVER w AS t FROM trk WHERE contour_found WINDOW w AS (PARTITION BY series_id ORDER BY timepoint)) WHERE a <> 0 AND t <> timepoint
""")
def w_growth_rate(spark, sf):
    return series.growth_rate(fx.ev_tracks(spark, sf)).withColumn("growth_pct", r("growth_pct"))


@query("""
SELECT series_id, count(*) AS n, min(timepoint) AS first_tp, max(timepoint) AS last_tp, round(avg(area_pixels), 6) AS area_mean, round(stddev_samp(area_pixels), 6) AS area_std,
  round(avg(average_darkness), 6) AS darkness_mean, round(stddev_samp(average_darkness), 6) AS darkness_std FROM trk WHERE contour_found GROUP BY 1
""")
def a_growth_summary(spark, sf):
    s = series.growth_summary(fx.ev_tracks(spark, sf))
    return s.select("series_id", "n", "first_tp", "last_tp", *(r(c).alias(c) for c in ("area_mean", "area_std", "darkness_mean", "darkness_std")))


@query("SELECT series_id, round(corr(area_pixels, average_darkness), 6) AS corr FROM trk WHERE contour_found GROUP BY 1")
def a_area_darkness_corr(spark, sf):
    return series.area_darkness_corr(fx.ev_tracks(spark, sf)).withColumn("corr", r("corr"))


# --- pulses

@query("""
WITH p AS (SELECT series_id, idx, value, idx AS a FROM evs UNION ALL SELECT series_id, idx, value, 2 - idx FROM evs WHERE idx BETWEEN 2 AND 4
  UNION ALL SELECT series_id, idx, value, 2 * m - idx FROM (SELECT *, max(idx) OVER (PARTITION BY series_id) AS m FROM evs) WHERE idx < m AND idx >= m - 3),
b AS (SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY a ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS base FROM p)
SELECT series_id, idx - 1 AS idx, round(base, 6) AS baseline, round(value - base, 6) AS detrended FROM b WHERE a = idx
""")
def w_detrend(spark, sf):
    s = fx.ev_series(spark, sf).withColumn("idx", F.col("idx") - 1)
    return pulse.detrend(s, 1.0, 0.25).select("series_id", "idx", r("baseline").alias("baseline"), r("detrended").alias("detrended"))


_SPECTRUM = """
s AS (SELECT series_id, idx - 1 AS i, value - avg(value) OVER (PARTITION BY series_id) AS v, count(*) OVER (PARTITION BY series_id) AS n FROM evs),
h AS (SELECT series_id, i, v * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS v FROM s),
sp AS (SELECT series_id, k::INT AS k, k / 256.0 AS freq, pow(sum(v * cos(2 * pi() * k * i / 256)), 2) + pow(sum(v * sin(2 * pi() * k * i / 256)), 2) AS power
  FROM h, range(0, 129) f(k) GROUP BY 1, 2, 3)"""


@query(f"WITH {_SPECTRUM} SELECT series_id, k, round(freq, 9)::DOUBLE AS freq, round(log10(power + 1), 5) AS log_power FROM sp")
def a_power_spectrum(spark, sf):
    s = pulse.power_spectrum(fx.ev_series(spark, sf), 1.0, "value")
    return s.select("series_id", "k", r("freq", 9).alias("freq"), r(F.log10(F.col("power") + 1), 5).alias("log_power"))


@query(f"""WITH {_SPECTRUM}, b AS (SELECT series_id, arg_max(freq, row(power, -freq)) AS f0, sum(power) AS total FROM sp WHERE freq BETWEEN 0.05 AND 0.4 GROUP BY 1)
SELECT series_id, round(f0, 9)::DOUBLE AS f0, round(sum(power) FILTER (freq BETWEEN f0 * 0.85 AND f0 * 1.15) / any_value(total), 5) AS snr FROM sp JOIN b USING (series_id) GROUP BY 1, 2""")
def a_dominant_frequency(spark, sf):
    s = pulse.dominant_frequency(pulse.power_spectrum(fx.ev_series(spark, sf), 1.0, "value"), 1.0, 0.05, 0.4)
    return s.select("series_id", r("f0", 9).alias("f0"), r("snr", 5).alias("snr"))


_PEAKS = "pk AS (SELECT series_id, idx FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM evs WINDOW w AS (PARTITION BY series_id ORDER BY idx)) WHERE a < value AND b < value)"


@query(f"WITH {_PEAKS} SELECT * FROM pk")
def w_local_maxima(spark, sf):
    return pulse.local_maxima(fx.ev_series(spark, sf))


@query(f"WITH {_PEAKS}, g AS (SELECT series_id, (idx - lag(idx) OVER (PARTITION BY series_id ORDER BY idx)) / 2.0 AS s FROM pk) SELECT series_id, count(*) AS n_pulses, round(60 / avg(s), 6) AS bpm, round(stddev_pop(s) / avg(s), 6) AS cv FROM g GROUP BY 1")
def a_pulse_rate(spark, sf):
    return pulse.pulse_rate(pulse.local_maxima(fx.ev_series(spark, sf)), 2.0).select("series_id", "n_pulses", r("bpm").alias("bpm"), r("cv").alias("cv"))


@query(f"WITH {_PEAKS} SELECT series_id, idx, round(s, 6)::DOUBLE AS interval_s FROM (SELECT series_id, idx, (idx - lag(idx) OVER (PARTITION BY series_id ORDER BY idx)) / 2.0 AS s FROM pk) WHERE s IS NOT NULL")
def w_pulse_intervals(spark, sf):
    return pulse.pulse_intervals(pulse.local_maxima(fx.ev_series(spark, sf)), 2.0).select("series_id", "idx", r("interval_s").alias("interval_s"))


@query("SELECT series_id, round((quantile_cont(value - 5, 0.95) - quantile_cont(value - 5, 0.05)) / avg(value), 6) AS pulsatility_index FROM evs GROUP BY 1")
def a_pulsatility_index(spark, sf):
    return pulse.pulsatility_index(fx.ev_series(spark, sf).withColumn("detrended", F.col("value") - 5)).withColumn("pulsatility_index", r("pulsatility_index"))


def _bandpass_sql(lo: float, hi: float) -> str:
    """Daily sums between two frequencies, forward and backward, one sample after the other."""
    from ..operators.blocks import start_state

    b, a = pulse.band_filter(1.0, lo, hi)
    zi = start_state(b, a)
    step = lambda v, y: ", ".join(f"{float(b[k + 1])!r} * {v} - {float(a[k + 1])!r} * {y}" + (f" + z{k + 1}" if k < 3 else "") for k in range(4))
    start = lambda v: ", ".join(f"{float(x)!r} * {v}" for x in zi)
    states = ", ".join(f"z{k}" for k in range(4))
    run = lambda name, source: f"""
{name}0 AS (SELECT series_id, k, v, {float(b[0])!r}::DOUBLE * v AS bv FROM {source}),
{name}(series_id, k, y, {states}) AS (SELECT series_id, -1::BIGINT, 0::DOUBLE, {start('v')} FROM {source} WHERE k = 0
  UNION ALL SELECT t.series_id, t.k, bv + z0, {step('v', '(bv + z0)')} FROM {name} r JOIN {name}0 t ON t.series_id = r.series_id AND t.k = r.k + 1)"""  # noqa: E731
    return f"""WITH RECURSIVE s AS (SELECT series_id, idx - 1 AS i, idx, value::DOUBLE AS v, count(*) OVER (PARTITION BY series_id) AS n FROM evs),
h AS (SELECT series_id, n, max(v) FILTER (i = 0) AS a, max(v) FILTER (i = n - 1) AS b FROM s GROUP BY 1, 2),
g AS (SELECT h.*, unnest(range(n + 30)) AS k FROM h WHERE n > 15),
x AS (SELECT g.series_id, k, CASE WHEN k < 15 THEN 2 * a - s.v WHEN k < g.n + 15 THEN s.v ELSE 2 * b - s.v END AS v FROM g JOIN s ON s.series_id = g.series_id
  AND s.i = CASE WHEN k < 15 THEN 15 - k WHEN k < g.n + 15 THEN k - 15 ELSE 2 * g.n + 13 - k END),
{run('f', 'x')},
u AS (SELECT f.series_id, h.n + 29 - k AS k, y AS v FROM f JOIN h USING (series_id) WHERE k >= 0),
{run('w', 'u')}
SELECT s.series_id, s.idx, round(coalesce(w.y, s.v - avg(s.v) OVER (PARTITION BY s.series_id)), 5)::DOUBLE AS wave FROM s LEFT JOIN w ON w.series_id = s.series_id AND w.k = s.n + 14 - s.i"""


@query(_bandpass_sql(0.08, 0.3))
def z_bandpass(spark, sf):
    return pulse.bandpass(fx.ev_series(spark, sf), 1.0, 0.08, 0.3).withColumn("wave", r("wave", 5))


@query("""
WITH s AS (SELECT series_id, idx, (value * 100)::BIGINT AS v FROM evs),
g AS (SELECT *, sum(CASE WHEN v = o THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY idx) AS g FROM (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY idx) AS o FROM s)),
i AS (SELECT series_id, g, min(idx) AS a, max(idx) AS b, min(v) AS v FROM g GROUP BY 1, 2),
m AS (SELECT series_id, (a + b) // 2 AS idx, v FROM (SELECT *, lag(v) OVER w AS o, lead(v) OVER w AS q FROM i WINDOW w AS (PARTITION BY series_id ORDER BY g)) WHERE v > o AND v > q),
k AS (SELECT series_id, unnest(list_reduce(list([idx] ORDER BY v DESC, idx DESC), lambda kept, p: CASE WHEN len(list_filter(kept, lambda q: abs(q - p[1]) < 4)) = 0 THEN list_append(kept, p[1]) ELSE kept END)) AS idx FROM m GROUP BY 1),
p AS (SELECT k.series_id, k.idx, s.v, (SELECT coalesce(max(o.idx), 0) FROM s o WHERE o.series_id = k.series_id AND o.idx < k.idx AND o.v > s.v) AS a,
  (SELECT coalesce(min(o.idx), 1000000) FROM s o WHERE o.series_id = k.series_id AND o.idx > k.idx AND o.v > s.v) AS b FROM k JOIN s ON s.series_id = k.series_id AND s.idx = k.idx)
SELECT p.series_id, p.idx::INT AS idx FROM p JOIN s ON s.series_id = p.series_id AND s.idx > a AND s.idx < b
GROUP BY p.series_id, p.idx, p.v HAVING p.v - greatest(min(s.v) FILTER (s.idx <= p.idx), min(s.v) FILTER (s.idx >= p.idx)) >= 3000
""")
def z_pulses(spark, sf):
    cents = F.round(F.col("value") * 100).cast("double").alias("value")
    return pulse.pulses(fx.ev_series(spark, sf).select("series_id", "idx", cents), 4, 3000.0).select("series_id", F.col("idx").cast("int").alias("idx"))


@query()
def z_analyze_pulsatility(spark, sf):
    s = fx.ev_series(spark, sf).withColumn("idx", F.col("idx") - 1)
    return pulse.analyze_pulsatility(s, 1.0, 4.0, 24.0)[0]


# --- segmentation

@query("""
WITH h AS (SELECT frame_id, v, count(*) AS n FROM px8 GROUP BY 1, 2),
c AS (SELECT frame_id, v, sum(n) OVER w / 64.0 AS o, sum(v * n) OVER w / 64.0 AS m, sum(v * n) OVER (PARTITION BY frame_id) / 64.0 AS t FROM h WINDOW w AS (PARTITION BY frame_id ORDER BY v))
SELECT frame_id, greatest(arg_max(v, row(round(CASE WHEN o < 1 THEN pow(t * o - m, 2) / (o * (1 - o)) ELSE 0 END, 9), -v)) - 3, 0)::INT AS threshold FROM c GROUP BY 1
""")
def t_otsu(spark, sf):
    return segment.otsu(fx.px8(spark, sf), 3)


@query("SELECT frame_id, y, x FROM px8 WHERE v <= 120")
def t_manual_threshold(spark, sf):
    return segment.manual_threshold(fx.px8(spark, sf), 120)


@query("""
WITH q AS (SELECT frame_id, quantile_cont(v, 0.9) AS a, quantile_cont(v, 0.4) AS b, quantile_cont(v, 0.8) AS c FROM px8 GROUP BY 1)
SELECT frame_id, y, x, v > a AS core, v > b AND v < c AS outer FROM px8 JOIN q USING (frame_id)
""")
def t_percentile_masks(spark, sf):
    return segment.percentile_masks(fx.px8(spark, sf))


_SE = ", ".join(str(o) for o in segment.disk(1))


@query(f"SELECT DISTINCT frame_id, y - dy AS y, x - dx AS x FROM reg8, (VALUES {_SE}) o(dy, dx) WHERE y - dy BETWEEN 0 AND 7 AND x - dx BETWEEN 0 AND 7")
def m_dilate(spark, sf):
    return segment.dilate(fx.regions8(spark, sf), segment.disk(1), 8, 8)


@query(f"""SELECT p.frame_id, p.y, p.x FROM reg8 p WHERE NOT EXISTS (SELECT 1 FROM (VALUES {_SE}) o(dy, dx) WHERE p.y + dy BETWEEN 0 AND 7 AND p.x + dx BETWEEN 0 AND 7
  AND NOT EXISTS (SELECT 1 FROM reg8 q WHERE q.frame_id = p.frame_id AND q.y = p.y + dy AND q.x = p.x + dx))""")
def m_erode(spark, sf):
    return segment.erode(fx.regions8(spark, sf), segment.disk(1), 8, 8)


def _near(src: str) -> str:
    return f"FROM px8 g JOIN {src} b ON b.frame_id = g.frame_id AND b.y BETWEEN g.y - 1 AND g.y + 1 AND b.x BETWEEN g.x - 1 AND g.x + 1 GROUP BY g.frame_id, g.y, g.x"


_WHOLE = "HAVING count(*) = (CASE WHEN g.y IN (0, 7) THEN 2 ELSE 3 END) * (CASE WHEN g.x IN (0, 7) THEN 2 ELSE 3 END)"
_CELL = "SELECT g.frame_id, g.y, g.x"


@query(f"""
WITH e1 AS ({_CELL} {_near("reg8")} {_WHOLE}), d1 AS ({_CELL} {_near("e1")}), d2 AS ({_CELL} {_near("d1")}), e2 AS ({_CELL} {_near("d2")} {_WHOLE})
SELECT frame_id, y, x FROM e2
""")
def m_open_close(spark, sf):
    return segment.close_(segment.open_(fx.regions8(spark, sf), segment.SQUARE3, 8, 8), segment.SQUARE3, 8, 8)


def _components(reach: str) -> str:
    return f"""RECURSIVE
r(frame_id, y, x, oy, ox) AS (SELECT frame_id, y, x, y, x FROM reg8 UNION
  SELECT r.frame_id, q.y, q.x, r.oy, r.ox FROM r JOIN reg8 q ON q.frame_id = r.frame_id AND {reach}),
cc AS (SELECT frame_id, y, x, min(oy * 16777216 + ox)::BIGINT AS label FROM r GROUP BY 1, 2, 3)"""


_EIGHT = _components("abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1")
_FOUR = _components("abs(q.y - r.y) + abs(q.x - r.x) = 1")


@query(f"WITH {_EIGHT} SELECT * FROM cc")
def m_components_8(spark, sf):
    return segment.connected_components(fx.regions8(spark, sf))


@query(f"WITH {_FOUR} SELECT frame_id, y, x FROM cc JOIN (SELECT frame_id, label FROM cc GROUP BY 1, 2 HAVING count(*) >= 6) k USING (frame_id, label)")
def m_remove_small(spark, sf):
    return segment.remove_small(fx.regions8(spark, sf), 6)


@query(f"WITH {_EIGHT}, n AS (SELECT frame_id, label, count(*) AS n FROM cc GROUP BY 1, 2), b AS (SELECT frame_id, arg_max(label, row(n, -label)) AS label, max(n) AS n FROM n GROUP BY 1) SELECT frame_id, label, y, x FROM cc JOIN b USING (frame_id, label) WHERE n >= 12")
def m_largest_component(spark, sf):
    return segment.largest_component(segment.connected_components(fx.regions8(spark, sf)), 12)


@query(f"""WITH {_EIGHT},
b AS (SELECT * FROM cc c WHERE (SELECT count(*) FROM cc q WHERE q.frame_id = c.frame_id AND q.label = c.label AND abs(q.y - c.y) + abs(q.x - c.x) = 1) < 4),
n AS (SELECT frame_id, label, count(*) AS border FROM b GROUP BY 1, 2)
SELECT frame_id, label, count(*) AS area_pixels, min(x) AS bx, min(y) AS by, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, trunc(avg(x))::INT AS cx, trunc(avg(y))::INT AS cy,
  border, round((max(x) - min(x) + 1) / (max(y) - min(y) + 1), 6) AS aspect_ratio, count(*) - border / 2 - 1 AS polygon_area FROM cc JOIN n USING (frame_id, label) GROUP BY frame_id, label, border""")
def a_region_measures(spark, sf):
    return segment.region_measures(segment.connected_components(fx.regions8(spark, sf))).withColumn("aspect_ratio", r("aspect_ratio"))


@query("""
WITH e AS (SELECT frame_id, y, x FROM (SELECT frame_id, y, x FROM reg8)), bg AS (SELECT frame_id, y, x FROM px8 EXCEPT SELECT frame_id, y, x FROM reg8)
SELECT frame_id, count(*) AS background FROM bg GROUP BY 1
""")
def o_mask_difference(spark, sf):
    back = segment.grid(fx.px8(spark, sf), 8, 8).join(fx.regions8(spark, sf), PX, "left_anti")
    return back.groupBy("frame_id").agg(F.count("*").alias("background"))


@query("""
WITH RECURSIVE bg AS (SELECT frame_id, y, x FROM px8 WHERE v < 128),
o(frame_id, y, x) AS (SELECT frame_id, y, x FROM bg WHERE y IN (0, 7) OR x IN (0, 7) UNION
  SELECT b.frame_id, b.y, b.x FROM o JOIN bg b ON b.frame_id = o.frame_id AND abs(b.y - o.y) + abs(b.x - o.x) = 1)
SELECT frame_id, y, x FROM reg8 UNION ALL SELECT bg.frame_id, bg.y, bg.x FROM bg ANTI JOIN o USING (frame_id, y, x)
""")
def m_fill_holes(spark, sf):
    return segment.fill_holes(fx.regions8(spark, sf), 8, 8)


@query("""
WITH g AS (SELECT * FROM px8 WHERE v >= 160), s AS (SELECT frame_id, sum(255 - v)::DOUBLE AS total_darkness, avg(255 - v) AS average_darkness, min(255 - v)::DOUBLE AS min_darkness,
  max(255 - v)::DOUBLE AS max_darkness, avg(v) AS raw_mean, min(v)::DOUBLE AS raw_min, max(v)::DOUBLE AS raw_max FROM g GROUP BY 1)
SELECT f.frame_id, s.frame_id IS NOT NULL AS contour_found, coalesce(total_darkness, 0) AS total_darkness, round(coalesce(average_darkness, 0), 6) AS average_darkness, coalesce(min_darkness, 0) AS min_darkness,
  coalesce(max_darkness, 0) AS max_darkness, round(coalesce(raw_mean, 0), 6) AS raw_mean, coalesce(raw_min, 0) AS raw_min, coalesce(raw_max, 0) AS raw_max
FROM (SELECT DISTINCT frame_id FROM px8) f LEFT JOIN s USING (frame_id)
""")
def a_darkness_stats(spark, sf):
    p = fx.px8(spark, sf)
    return segment.darkness_stats(p, p.filter("v >= 160")).withColumns({c: r(c) for c in ("average_darkness", "raw_mean")})


@query("""
WITH q AS (SELECT frame_id, quantile_cont(v, 0.9) AS a, quantile_cont(v, 0.4) AS b, quantile_cont(v, 0.8) AS c FROM px8 GROUP BY 1),
m AS (SELECT frame_id, v, v > a AS core, v > b AND v < c AS outer_ FROM px8 JOIN q USING (frame_id))
SELECT frame_id, coalesce(sum(v) FILTER (core), 0)::BIGINT AS core_sum, coalesce(sum(v) FILTER (outer_), 0)::BIGINT AS outer_sum, sum(v)::BIGINT AS total_sum, count(*) FILTER (core) AS core_area, count(*) FILTER (outer_) AS outer_area,
  count(*) AS total_pixels, round(count(*) FILTER (core) / count(*), 6) AS core_area_fraction, round(count(*) FILTER (outer_) / count(*), 6) AS outer_area_fraction,
  round(coalesce(sum(v) FILTER (core), 0) / sum(v), 6) AS core_intensity_fraction, round(coalesce(sum(v) FILTER (outer_), 0) / sum(v), 6) AS outer_intensity_fraction FROM m GROUP BY 1
""")
def a_core_outer_stats(spark, sf):
    p = fx.px8(spark, sf)
    s = segment.core_outer_stats(p, segment.percentile_masks(p))
    return s.withColumns({c: r(c) for c in s.columns if c.endswith("fraction")})


def _even(source: str, padded: str | None = None, size: int = 4) -> str:
    """CTEs: `ev`, `source` (frame_id, y, x, v) equalized in 2 by 2 tiles of `size` pixels, histograms from `padded`."""
    area = size * size
    clip = max(1, 2 * area // 256)
    return f"""
t AS (SELECT frame_id, y // {size} AS ty, x // {size} AS tx, v, count(*) AS n FROM {padded or source} GROUP BY 1, 2, 3, 4),
e AS (SELECT frame_id, ty, tx, sum(greatest(n - {clip}, 0)) AS ex FROM t GROUP BY 1, 2, 3),
g AS (SELECT e.frame_id, e.ty, e.tx, e.ex, r.u::INT AS v FROM e, range(256) r(u)),
l AS (SELECT g.frame_id, g.ty, g.tx, g.v, least(255, round_even((sum(least(coalesce(n, 0), {clip})) OVER (PARTITION BY g.frame_id, g.ty, g.tx ORDER BY g.v) + (ex // 256) * (g.v + 1)
  + CASE WHEN ex % 256 > 0 THEN least(g.v // greatest(256 // (ex % 256), 1) + 1, ex % 256) ELSE 0 END) * 255.0 / {area}, 0)) AS lut FROM g LEFT JOIN t ON t.frame_id = g.frame_id AND t.ty = g.ty AND t.tx = g.tx AND t.v = g.v),
p AS (SELECT frame_id, y, x, v, y / {size}.0 - 0.5 AS fy, x / {size}.0 - 0.5 AS fx FROM {source}),
c AS (SELECT p.*, a, b, greatest(0, least(1, floor(fy) + a))::INT AS ty, greatest(0, least(1, floor(fx) + b))::INT AS tx,
  (CASE WHEN a = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE WHEN b = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
ev AS (SELECT c.frame_id, c.y, c.x, round_even(round(sum(w * lut), 6), 0)::INT AS v FROM c JOIN l USING (frame_id, ty, tx, v) GROUP BY 1, 2, 3)"""


@query(f"WITH {_even('px8')} SELECT * FROM ev")
def c_clahe(spark, sf):
    return segment.clahe(fx.px8(spark, sf), 8, 8, 2.0, 2)


@query(f"""
WITH s7 AS (SELECT frame_id, y, x, v FROM px8 WHERE y < 7 AND x < 7), m(k, j) AS (SELECT range, range FROM range(7) UNION ALL VALUES (5, 7)),
pad AS (SELECT frame_id, a.j AS y, b.j AS x, v FROM s7 JOIN m a ON a.k = y JOIN m b ON b.k = x), {_even('s7', 'pad')} SELECT * FROM ev
""")
def c_clahe_mirrored(spark, sf):
    return segment.clahe(fx.px8(spark, sf).filter("y < 7 AND x < 7"), 7, 7, 2.0, 2)


@query(f"WITH s AS (SELECT frame_id, y, x, 255 - v AS v FROM px8), {_even('s')} SELECT frame_id, y, x, px8.v AS r, ev.v AS g, (px8.v + 1) // 2 AS b FROM ev JOIN px8 USING (frame_id, y, x)")
def c_clahe_channel(spark, sf):
    v = F.col("v")
    rgb = F.struct(v.alias("r"), (255 - v).alias("g"), F.floor((v + 1) / 2).cast("int").alias("b"))
    return segment.clahe(fx.px8(spark, sf).withColumn("rgb", rgb), 8, 8, 2.0, 2, channel="green").select(*PX, "rgb.*")


@query("""
WITH t AS (SELECT frame_id, y // 4 AS ty, x // 4 AS tx, v, count(*) AS n FROM px16 GROUP BY 1, 2, 3, 4),
p AS (SELECT frame_id, y, x, v, y / 4.0 - 0.5 AS fy, x / 4.0 - 0.5 AS fx FROM px16),
c AS (SELECT p.*, greatest(0, least(1, floor(fy) + a))::INT AS ty, greatest(0, least(1, floor(fx) + b))::INT AS tx, a, b,
  (CASE WHEN a = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE WHEN b = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
k AS (SELECT c.frame_id, c.y, c.x, c.v, c.w, c.a, c.b, sum(least(t.n, 1)) FILTER (t.v <= c.v) AS run, sum(greatest(t.n - 1, 0)) AS ex FROM c JOIN t USING (frame_id, ty, tx) GROUP BY c.frame_id, c.y, c.x, c.v, c.w, c.a, c.b),
l AS (SELECT *, least(65535, round_even((coalesce(run, 0) + (ex // 65536) * (v + 1) + CASE WHEN ex % 65536 > 0 THEN least(v // greatest(65536 // (ex % 65536), 1) + 1, ex % 65536) ELSE 0 END) * 65535.0 / 16, 0)) AS lut FROM k)
SELECT frame_id, y, x, round_even(round(sum(w * lut), 6), 0)::INT AS v FROM l GROUP BY 1, 2, 3
""")
def c_clahe_16_bit(spark, sf):
    return segment.clahe(fx.px16(spark, sf), 8, 8, 2.0, 2, bins=65536)


@query(f"""
WITH f AS (SELECT stack_id AS frame_id, y, x, CAST(trunc(round(avg(v), 9)) AS INT) AS v FROM px8 GROUP BY 1, 2, 3),
b AS (SELECT frame_id, y, x, CAST(least(255, round_even(v * 1.5, 0)) AS INT) AS v FROM f), {_even('b')}
SELECT frame_id, y, x, bar::INT * 255 AS r, CASE WHEN bar THEN 255 ELSE v END AS g, bar::INT * 255 AS b FROM (SELECT *, y BETWEEN 6 AND 7 AND x BETWEEN 1 AND 4 AS bar FROM ev)
""")
def v_focal_sequence(spark, sf):
    from .workflows import focal_stack_sequence

    return focal_stack_sequence(fx.px8(spark, sf), 8, 8, "average", 1.5, 2.0, 2, scale_um=3.0, pixel_size_um=1.0, bar_height=1, bar_margin=1).select(*PX, "rgb.*")


@query("""
SELECT frame_id, y, x, CASE WHEN m < 128 THEN 10 ELSE v END AS r, CASE WHEN m < 128 THEN 20 ELSE 255 - v END AS g, CASE WHEN m < 128 THEN 30 ELSE 0 END AS b, CASE WHEN m < 128 THEN 255 ELSE v // 2 END AS a
FROM px8 JOIN mask8 USING (y, x)
""")
def j_color_mask(spark, sf):
    v = F.col("v")
    rgb = F.struct(v.alias("r"), (255 - v).alias("g"), F.lit(0).alias("b"), F.floor(v / 2).cast("int").alias("a"))
    return P.apply_mask(fx.px8(spark, sf).withColumn("rgb", rgb), fx.mask8(spark), X.parse_color("10,20,30")).select(*PX, "rgb.*")


@query("""
WITH w AS (SELECT frame_id, t.i AS y, u.i AS x, v, (least((y + 1) * 0.375, t.i + 1) - greatest(y * 0.375, t.i)) * (least((x + 1) * 0.375, u.i + 1) - greatest(x * 0.375, u.i)) AS w FROM px8, range(3) t(i), range(3) u(i)
  WHERE (y + 1) * 0.375 > t.i AND y * 0.375 < t.i + 1 AND (x + 1) * 0.375 > u.i AND x * 0.375 < u.i + 1)
SELECT frame_id, y::INT AS y, x::INT AS x, round(sum(v * w)::DOUBLE / sum(w)::DOUBLE, 6) AS v FROM w GROUP BY 1, 2, 3
""")
def a_downscale_to_width(spark, sf):
    return P.downscale_to(fx.px8(spark, sf), 8, 8, 3)[0].withColumn("v", r("v"))


@query("SELECT li.frame_id, a.i::INT AS y, b.i::INT AS x, v AS label FROM range(20) a(i), range(48) b(i), li WHERE li.y = floor(a.i * 1.6) AND li.x = floor(b.i * 2 / 3)")
def j_resize_labels(spark, sf):
    return P.resize_labels(fx.li_raster(spark, sf).withColumnRenamed("v", "label"), 32, 32, 20, 48).select(*PX, "label")


@query("""
WITH a AS (SELECT stack_id, z, y // 2 AS y, x // 2 AS x, sum(v) AS a FROM px8 GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY stack_id, y, x ORDER BY abs(a) DESC, z) AS k FROM a)
SELECT stack_id, min(z)::INT AS min_z, max(z)::INT AS max_z FROM k WHERE k <= 2 GROUP BY 1
""")
def e_edf_z_range(spark, sf):
    from ..operators.wavelet import edf_z_range

    return edf_z_range(fx.px8(spark, sf), "haar", 1, 2)


@query(f"WITH {_EIGHT}, core AS (SELECT frame_id, trunc(avg(y))::INT AS y, trunc(avg(x))::INT AS x FROM px8 WHERE v >= 150 GROUP BY 1), h AS (SELECT frame_id, label FROM cc JOIN core USING (frame_id, y, x)) SELECT cc.* FROM cc JOIN h USING (frame_id, label)")
def m_containing_component(spark, sf):
    cores = fx.px8(spark, sf).filter("v >= 150").select(*PX)
    return segment.containing_component(segment.connected_components(fx.regions8(spark, sf)), cores).select(*PX, "label")


@query(f"WITH {_EIGHT} SELECT * FROM cc c WHERE (SELECT count(*) FROM cc q WHERE q.frame_id = c.frame_id AND q.label = c.label AND abs(q.y - c.y) + abs(q.x - c.x) = 1) < 4")
def m_boundary(spark, sf):
    return segment.boundary(segment.connected_components(fx.regions8(spark, sf))).select(*PX, "label")


_ROOT2 = repr(2**0.5)


@query(f"""
WITH {_EIGHT},
bg AS (SELECT frame_id, y, x FROM (SELECT DISTINCT frame_id FROM reg8), range(-1, 9) a(y), range(-1, 9) b(x) EXCEPT SELECT frame_id, y, x FROM reg8),
f(frame_id, label, y, x) AS (SELECT DISTINCT frame_id, label, label // 16777216 - 1, label % 16777216 FROM cc UNION
  SELECT f.frame_id, f.label, g.y, g.x FROM f JOIN bg g ON g.frame_id = f.frame_id AND abs(g.y - f.y) + abs(g.x - f.x) = 1),
q AS (SELECT frame_id, label, y - dy AS qy, x - dx AS qx, sum(1 << (2 * dy + dx))::INT AS bits FROM cc, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx) GROUP BY ALL),
p(bits, dy, dx, len) AS (VALUES (3, 1, 0, 1.0::DOUBLE), (12, 0, 0, 1), (5, 0, 1, 1), (10, 0, 0, 1), (14, 0, 0, {_ROOT2}), (13, 0, 1, {_ROOT2}), (11, 1, 0, {_ROOT2}), (7, 1, 1, {_ROOT2}),
  (6, 0, 0, {_ROOT2}), (6, 1, 1, {_ROOT2}), (9, 0, 1, {_ROOT2}), (9, 1, 0, {_ROOT2})),
l AS (SELECT q.frame_id, q.label, sum(len) AS p FROM q JOIN p USING (bits) JOIN f ON f.frame_id = q.frame_id AND f.label = q.label AND f.y = qy + dy AND f.x = qx + dx GROUP BY 1, 2),
e AS (SELECT frame_id, label, count(*) AS border FROM cc c WHERE (SELECT count(*) FROM cc q WHERE q.frame_id = c.frame_id AND q.label = c.label AND abs(q.y - c.y) + abs(q.x - c.x) = 1) < 4 GROUP BY 1, 2),
a AS (SELECT frame_id, label, count(*) - border / 2 - 1 AS area FROM cc JOIN e USING (frame_id, label) GROUP BY 1, 2, border),
t AS (SELECT DISTINCT frame_id, label, y, unnest([min(x), max(x)]) AS x FROM cc GROUP BY 1, 2, 3),
b AS (SELECT u.frame_id, u.label, u.y * v.x - u.x * v.y AS c FROM t u JOIN t v ON v.frame_id = u.frame_id AND v.label = u.label AND (v.y, v.x) <> (u.y, u.x)
  JOIN t w ON w.frame_id = u.frame_id AND w.label = u.label GROUP BY u.frame_id, u.label, u.y, u.x, v.y, v.x
  HAVING count_if((v.y - u.y) * (w.x - u.x) - (v.x - u.x) * (w.y - u.y) > 0 OR ((v.y - u.y) * (w.x - u.x) - (v.x - u.x) * (w.y - u.y) = 0
    AND (w.y - u.y) * (w.y - v.y) + (w.x - u.x) * (w.x - v.x) > 0)) = 0),
h AS (SELECT frame_id, label, abs(sum(c)) / 2 AS hull FROM b GROUP BY 1, 2)
SELECT a.frame_id, a.label, round(coalesce(p, 0), 6)::DOUBLE AS perimeter, round(CASE WHEN p > 0 THEN 4 * pi() * area / (p * p) ELSE 0 END, 6)::DOUBLE AS circularity, coalesce(hull, 0)::DOUBLE AS hull_area,
  round(CASE WHEN hull > 0 THEN area / hull ELSE 1 END, 6)::DOUBLE AS convexity FROM a LEFT JOIN l USING (frame_id, label) LEFT JOIN h USING (frame_id, label)
""")
def m_contours_and_hulls(spark, sf):
    c = segment.connected_runs(fx.regions8(spark, sf))
    shapes = segment.convexity(c, segment.with_circularity(segment.region_measures(c), segment.perimeter(c), F.lit(0.5)))
    return shapes.select("frame_id", "label", r("perimeter").alias("perimeter"), r("circularity").alias("circularity"), "hull_area", r("convexity").alias("convexity"))


@query("""
SELECT frame_id, area_pixels, round(CASE WHEN frame_id % 3 > 0 THEN area_pixels * pow(frame_id % 3 * 0.25, 2) ELSE 0 END, 6) AS area_um2 FROM (SELECT frame_id, count(*) AS area_pixels FROM reg8 GROUP BY 1)
""")
def a_physical_area(spark, sf):
    areas = fx.regions8(spark, sf).groupBy("frame_id").agg(F.count("*").alias("area_pixels"))
    px = F.when(F.col("frame_id") % 3 > 0, F.col("frame_id") % 3 * 0.25)
    return segment.with_physical_units(areas, px).withColumn("area_um2", r("area_um2"))


@query("""
WITH n AS (SELECT series_id, idx, value, lag(value) OVER w AS p, lead(value) OVER w AS q, value - avg(value) OVER (PARTITION BY series_id) AS wave FROM evs WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
p AS (SELECT series_id, idx, value FROM n WHERE value > p AND value > q), t AS (SELECT series_id, idx AS trough, value AS low FROM n WHERE value < p AND value < q),
m AS (SELECT series_id, idx, any_value(value) AS value, arg_min(low, row(abs(trough - idx), trough)) AS low FROM p JOIN t USING (series_id) GROUP BY 1, 2),
d AS (SELECT series_id, median(abs(value - low)) AS p2p FROM m GROUP BY 1)
SELECT series_id, round(sqrt(avg(wave * wave)), 6) AS rms, round(any_value(p2p), 6) AS p2p FROM n LEFT JOIN d USING (series_id) GROUP BY 1
""")
def a_amplitudes(spark, sf):
    s = fx.ev_series(spark, sf)
    high, low = (pulse.local_maxima(s.withColumn("value", sign * F.col("value"))).select("series_id", "idx", F.lit(True).alias(n)) for sign, n in ((1, "is_peak"), (-1, "is_trough")))
    marked = s.join(high, ["series_id", "idx"], "left").join(low, ["series_id", "idx"], "left").na.fill(False, ["is_peak", "is_trough"])
    wave = marked.withColumn("wave", F.col("value") - F.avg("value").over(Window.partitionBy("series_id")))
    return pulse.amplitudes(wave).withColumns({"rms": r("rms"), "p2p": r("p2p")})


# --- streaming twins and the flagship

@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / 100, 2) AS total FROM events GROUP BY 1, 2")
def r_tumbling_sums(spark, sf):
    from ..streaming.live import tumbling_sums

    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling_sums(e, "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k
""")
def r_sessions(spark, sf):
    from ..streaming.live import sessions

    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "6 hours").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("""
WITH s AS (SELECT stack_id, z, sum(v)::DOUBLE AS value FROM px8 GROUP BY 1, 2),
p AS (SELECT stack_id, z, value / avg(CASE WHEN z < 5 THEN value END) OVER (PARTITION BY stack_id) * 100 AS pct FROM s)
SELECT stack_id, z, round(pct, 6) AS pct, round(avg(pct) OVER (PARTITION BY stack_id ORDER BY z ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS ma FROM p
""")
def v_fluorescence_curve(spark, sf):
    from .workflows import fluorescence_curve

    c = fluorescence_curve(fx.px8(spark, sf), 5)
    return c.select(F.col("series_id").cast("int").alias("stack_id"), F.col("idx").alias("z"), r("pct").alias("pct"), r("ma").alias("ma"))


@query("""
WITH f AS (SELECT stack_id, y, x, CAST(trunc(round(avg(v), 9)) AS INT) AS v FROM px8 GROUP BY 1, 2, 3), b AS (SELECT stack_id, y, x, CAST(least(255, round_even(v * 1.2, 0)) AS INT) AS v FROM f)
SELECT stack_id, y, x, v AS g FROM b
""")
def v_stills(spark, sf):
    from .workflows import stack_stills

    return stack_stills(fx.px8(spark, sf), 1.2).select(F.col("frame_id").alias("stack_id"), "y", "x", F.col("rgb.g").alias("g"))


@query("SELECT p_partkey, printf('%g um', p_size * CASE p_partkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 ELSE 15000.0 END) AS label FROM part")
def x_scale_bar_label(spark, sf):
    k = F.col("p_partkey") % 3
    scale = F.col("p_size") * F.when(k == 0, 0.25).when(k == 1, 1.0).otherwise(15000.0)
    return fx.table(spark, sf, "part").select("p_partkey", X.scale_bar_label(scale).alias("label"))


# --- sources, sinks, user functions and streams: what goes to files lies in the folder that driver and executors share

def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT frame_id, stack_id, 64 AS pixels, sum(v)::BIGINT AS total FROM px8 GROUP BY 1, 2")
def s_frame_table(spark, sf):
    at = _place(spark, "frames")
    S.write_frames(P.implode_pixels(fx.px8(spark, sf)).withColumn("stack_id", F.col("frame_id") % 5), at)
    back = S.read_frame_table(spark, at).drop("stack_id").join(fx.px8(spark, sf).select("frame_id", "stack_id").distinct(), "frame_id")
    total = F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select("frame_id", "stack_id", F.size("data").alias("pixels"), total.alias("total"))


@query("SELECT o_orderkey::INT AS N, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS actual_time FROM orders WHERE o_orderkey % 7 <> 0")
def s_timestamps_csv(spark, sf):
    at = _place(spark, "timestamps")
    key = F.col("o_orderkey")
    rows = fx.table(spark, sf, "orders").select(F.when(key % 7 == 0, "none").otherwise(key.cast("string")).alias("N"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("actual_time"))
    S.write_csv(rows, at)
    return S.read_timestamps(spark, at)


@query("SELECT o_orderkey::INT AS idx, trunc(o_totalprice)::BIGINT AS value, epoch_us(date_trunc('minute', o_orderdate))::BIGINT AS micros FROM orders WHERE o_orderkey % 5 <> 0")
def s_sum_series_csv(spark, sf):
    at = _place(spark, "sums")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    o = fx.table(spark, sf, "orders")
    S.write_csv(o.select(key.alias("index"), F.when(key % 5 == 0, "missing").otherwise(price).alias("sum_brightness"), F.date_format("o_orderdate", "MM/dd/yyyy HH:mm").alias("actual_time")), at)
    return S.read_sum_series(spark, at).select("idx", "value", F.unix_micros("ts").alias("micros"))


@query("SELECT series_id, idx, printf('%.5f', (idx + 0.5) / 8.0) AS time_s, printf('%.6f', value::DOUBLE) AS value, CASE WHEN idx % 4 = 0 THEN 1 ELSE 0 END AS is_pulse_peak FROM evs")
def s_waveform_text(spark, sf):
    wave = pulse.with_times(fx.ev_series(spark, sf), 8.0).withColumns({"detrended": F.col("value"), "wave": F.col("value"), "is_peak": F.col("idx") % 4 == 0})
    return S.format_waveform(wave).select("series_id", "idx", "time_s", "value", "is_pulse_peak")


@query("SELECT frame_id, round(avg(v), 6) AS mean, max(v)::INT AS top, CASE WHEN max(v) > 200 THEN 'too bright' END AS error FROM px8 GROUP BY 1 HAVING max(v) <= 200 UNION ALL SELECT frame_id, NULL, NULL, 'too bright' FROM px8 GROUP BY 1 HAVING max(v) > 200")
def u_map_frames(spark, sf):
    def measure(row: dict) -> dict:
        if max(row["data"]) > 200:
            raise ValueError("too bright")
        return {"frame_id": row["frame_id"], "mean": sum(row["data"]) / len(row["data"]), "top": max(row["data"])}

    return S.map_frames(P.implode_pixels(fx.px8(spark, sf)), measure, "frame_id long, mean double, top int", on_error="null").withColumn("mean", r("mean"))


@query("SELECT stack_id, count(DISTINCT z) AS frames, arg_min(v, z)::INT AS first_value, arg_max(v, z)::INT AS last_value FROM px8 WHERE y = 0 AND x = 0 GROUP BY 1")
def u_map_stacks(spark, sf):
    def ends(pdf):
        return pdf.iloc[:1][["stack_id"]].assign(frames=len(pdf), first_value=int(pdf["v"].iloc[0]), last_value=int(pdf["v"].iloc[-1]))

    corner = fx.px8(spark, sf).filter("y = 0 AND x = 0").select("stack_id", "z", "v")
    return S.map_stacks(corner, ends, "stack_id int, frames long, first_value int, last_value int")


@query("SELECT idx, round((idx + 0.5) / 4.0, 6) AS time_s, round(max(value - m) FILTER (series_id = 'click'), 6) AS click_wave, round(max(value) FILTER (series_id = 'click'), 6) AS click_motion, round(max(value - m) FILTER (series_id = 'view'), 6) AS view_wave, round(max(value) FILTER (series_id = 'view'), 6) AS view_motion FROM (SELECT *, min(value) OVER (PARTITION BY series_id) AS m FROM evs) GROUP BY 1")
def a_wide_waveform(spark, sf):
    s = fx.ev_series(spark, sf)
    wave = pulse.with_times(s.withColumn("wave", F.col("value") - F.min("value").over(Window.partitionBy("series_id"))), 4.0)
    return pulse.roi_waveforms_wide(wave, ["click", "view"]).withColumns({c: r(c) for c in ("time_s", "click_wave", "click_motion", "view_wave", "view_motion")})


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY 1")
def r_once(spark, sf):
    from ..streaming.live import once

    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return once(e.unionByName(e), "event_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT frame_id, sum(v)::BIGINT AS inside FROM px8 JOIN mask8 USING (y, x) WHERE m > 127 GROUP BY 1")
def r_stream_with_mask(spark, sf):
    from ..streaming.live import enriched, new_frames, run_available

    source, out = _place(spark, "arriving"), _place(spark, "enriched")
    fx.px8(spark, sf).select("frame_id", "y", "x", "v").write.parquet(source)
    run_available(enriched(new_frames(spark, source, "frame_id long, y int, x int, v int"), fx.mask8(spark)), out, _place(spark, "progress"))
    return spark.read.parquet(out).filter("m > 127").groupBy("frame_id").agg(F.sum("v").alias("inside"))


def _arriving(spark, rows, schema: str):
    """A stream of `rows` (with a timepoint `at`) from many files in no order, some rows twice, ended by a late heartbeat."""
    from ..streaming.live import new_frames

    source = _place(spark, "arriving")
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("at") * 60)).drop("at")
    timed.unionByName(timed.filter(F.pmod(F.xxhash64(*timed.columns[:2]), F.lit(3)) == 0)).repartition(12, F.xxhash64("ts", *timed.columns[:1])).write.parquet(source)
    beat = {"ts": F.timestamp_seconds(F.lit(10**9)), timed.columns[0]: F.lit(-1)}
    spark.range(1).select(*(beat.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in timed.schema)).write.mode("append").parquet(source)
    return new_frames(spark, source, schema)


@query()
def r_live_growth(spark, sf):
    from ..streaming.live import live_growth, run_available

    tracks = fx.ev_tracks(spark, sf).select("series_id", "timepoint", F.col("area_pixels").cast("double").alias("area_pixels"), "contour_found", F.col("timepoint").alias("at"))
    stream = _arriving(spark, tracks, "series_id int, timepoint int, area_pixels double, contour_found boolean, ts timestamp")
    out = _place(spark, "growth")
    run_available(live_growth(stream), out, _place(spark, "progress"))
    return spark.read.parquet(out).withColumn("growth_pct", r("growth_pct"))


@query("""
SELECT stack_id, z, round(avg(d), 6)::DOUBLE AS motion FROM (SELECT stack_id, z, abs(v - lag(v) OVER (PARTITION BY stack_id, y, x ORDER BY z)) AS d FROM px8) WHERE d IS NOT NULL GROUP BY 1, 2
""")
def r_live_motion(spark, sf):
    from ..streaming.live import live_motion, run_available

    cells = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda c: c["v"])
    frames = fx.px8(spark, sf).groupBy("stack_id", "z").agg(cells.alias("data")).withColumn("at", F.col("z") + 1)
    out = _place(spark, "motion")
    run_available(live_motion(_arriving(spark, frames, "stack_id int, z int, data array<int>, ts timestamp")), out, _place(spark, "progress"))
    return spark.read.parquet(out).withColumn("motion", r("motion"))


ORACLES["r_live_growth"] = ORACLES["w_growth_rate"]


# --- depth of field, kernels and compositions

@query("""
WITH q AS (SELECT stack_id, z, y // 2 AS y, x // 2 AS x, sum(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v ELSE 0 END) AS p00, sum(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v ELSE 0 END) AS p01,
  sum(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v ELSE 0 END) AS p10, sum(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v ELSE 0 END) AS p11 FROM px8 GROUP BY 1, 2, 3, 4),
c AS (SELECT stack_id, z, y, x, (p00 + p01 + p10 + p11) / 2 AS a, (p00 + p01 - p10 - p11) / 2 AS h, (p00 - p01 + p10 - p11) / 2 AS v, (p00 - p01 - p10 + p11) / 2 AS d FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY stack_id, y, x ORDER BY round(sqrt(h * h + v * v), 9) DESC, z) AS kd, row_number() OVER (PARTITION BY stack_id, y, x ORDER BY abs(a) DESC, z) AS ka FROM c),
s AS (SELECT stack_id, y, x, max(a) FILTER (ka = 1) AS a, max(h) FILTER (kd = 1) AS h, max(v) FILTER (kd = 1) AS v, max(d) FILTER (kd = 1) AS d FROM k GROUP BY 1, 2, 3)
SELECT stack_id, CAST(2 * y + i AS INT) AS y, CAST(2 * x + j AS INT) AS x, CAST(trunc(round(least(255, greatest(0,
  (a + (1 - 2 * i) * h + (1 - 2 * j) * v + (1 - 2 * i) * (1 - 2 * j) * d) / 2)), 6)) AS INT) AS v FROM s, range(2) a(i), range(2) b(j)
""")
def e_edf_haar(spark, sf):
    from ..operators.wavelet import edf_fuse

    return edf_fuse(fx.px8(spark, sf), "haar", 1)


def _taps(name: str) -> str:
    from ..operators.wavelet import filters

    lo, hi = filters(name)
    return f"taps(k, lo, hi) AS (VALUES {', '.join(f'({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for k, (a, b) in enumerate(zip(lo, hi, strict=True)))})"


def _mirror(i: str, n: int = 8) -> str:
    """The line's sample under tap k of coefficient i, of n with half-sample symmetric borders."""
    at = f"((2 * {i} + {2 * n} + 1 - k) % {2 * n})"
    return f"CASE WHEN {at} < {n} THEN {at} ELSE {2 * n - 1} - {at} END"


def _levels(n: int, levels: int) -> list[int]:
    """Lengths of a line at each level, for six taps."""
    out = [n]
    for _ in range(levels):
        out.append((out[-1] + 5) // 2)
    return out


def _edf_sql(levels: int, top_n: int) -> str:
    """Fusion of px8 by db3: transform, choice and inverse of all levels."""
    size = _levels(8, levels)
    parts = [_taps("db3"), "f AS (SELECT 5 - k AS k, lo, hi FROM taps)", "a0 AS (SELECT stack_id, z, y, x, v::DOUBLE AS a FROM px8)"]
    for k in range(1, levels + 1):
        n, m = size[k - 1], size[k]
        parts += [
            f"x{k} AS (SELECT stack_id, z, y, i AS x, sum(lo * a) AS l, sum(hi * a) AS h FROM a{k - 1}, taps, range({m}) r(i) WHERE x = {_mirror('i', n)} GROUP BY 1, 2, 3, 4)",
            f"a{k} AS MATERIALIZED (SELECT stack_id, z, i AS y, x, sum(lo * l) AS a, sum(hi * l) AS h, sum(lo * h) AS v, sum(hi * h) AS d FROM x{k}, taps, range({m}) r(i) WHERE y = {_mirror('i', n)} GROUP BY 1, 2, 3, 4)",
            f"k{k} AS (SELECT *, row_number() OVER (PARTITION BY stack_id, y, x ORDER BY round(sqrt(h * h + v * v), 9) DESC, z) AS r FROM a{k})",
            f"d{k} AS (SELECT stack_id, y, x, avg(h) AS h, avg(v) AS v, avg(d) AS d FROM k{k} WHERE r <= {top_n} GROUP BY 1, 2, 3)",
        ]
    parts += [
        f"ka AS (SELECT *, row_number() OVER (PARTITION BY stack_id, y, x ORDER BY round(abs(a), 9) DESC, z) AS r FROM a{levels})",
        f"u{levels} AS (SELECT stack_id, y, x, avg(a) AS a FROM ka WHERE r <= {top_n} GROUP BY 1, 2, 3)",
    ]
    for k in range(levels, 0, -1):
        n = 2 * size[k] - 4
        parts += [
            f"s{k} AS (SELECT * FROM u{k} JOIN d{k} USING (stack_id, y, x))",
            f"y{k} AS (SELECT stack_id, j AS y, x, sum(a * lo + h * hi) AS l, sum(v * lo + d * hi) AS h FROM s{k}, f, range({n}) r(j) WHERE (j + 4 - k) % 2 = 0 AND y = (j + 4 - k) // 2 GROUP BY 1, 2, 3)",
            f"u{k - 1} AS (SELECT stack_id, y, j AS x, sum(l * lo + h * hi) AS a FROM y{k}, f, range({n}) r(j) WHERE (j + 4 - k) % 2 = 0 AND x = (j + 4 - k) // 2 GROUP BY 1, 2, 3)",
        ]
    return f"WITH {', '.join(parts)} SELECT stack_id, y::INT AS y, x::INT AS x, trunc(least(255, greatest(0, round(a, 6))))::INT AS v FROM u0"


@query(_edf_sql(1, 2))
def e_edf_db3(spark, sf):
    from ..operators.wavelet import edf_fuse

    return edf_fuse(fx.px8(spark, sf), "db3", 1, top_n=2)


@query(_edf_sql(3, 1))
def e_edf_three_levels(spark, sf):
    from ..operators.wavelet import edf_fuse

    return edf_fuse(fx.px8(spark, sf), "db3", 3)



@query(f"""
WITH t(k, w) AS (VALUES {", ".join(f"({k - 5}, {w!r}::DOUBLE)" for k, w in enumerate(P.taps(11)))}),
rx AS (SELECT p.frame_id, p.y, p.x, sum(q.v * w) AS v FROM px8 p, t, px8 q WHERE q.frame_id = p.frame_id AND q.y = p.y AND q.x = greatest(0, least(7, p.x + k)) GROUP BY 1, 2, 3),
ry AS (SELECT p.frame_id, p.y, p.x, sum(q.v * w) AS v FROM rx p, t, rx q WHERE q.frame_id = p.frame_id AND q.x = p.x AND q.y = greatest(0, least(7, p.y + k)) GROUP BY 1, 2, 3)
SELECT frame_id, y, x FROM px8 JOIN ry m USING (frame_id, y, x) WHERE px8.v <= floor(m.v + 0.5) - 2
""")
def t_adaptive_threshold(spark, sf):
    return segment.adaptive_threshold(fx.px8(spark, sf))


@query(f"""
WITH t(k, w) AS (VALUES {", ".join(f"({k - 3}, {w!r}::DOUBLE)" for k, w in enumerate(P.taps(7, 1.0)))}),
m0 AS (SELECT y, x, m / 255.0 AS v FROM mask8),
rx AS (SELECT p.y, p.x, sum(q.v * w) AS v FROM m0 p, t, m0 q WHERE q.y = p.y AND q.x = 7 - abs(((p.x + k + 14) % 14) - 7) GROUP BY 1, 2),
ry AS (SELECT p.y, p.x, sum(q.v * w) AS m FROM rx p, t, rx q WHERE q.x = p.x AND q.y = 7 - abs(((p.y + k + 14) % 14) - 7) GROUP BY 1, 2)
SELECT frame_id, y, x, CAST(trunc(round(v * m + 40 * (1 - m), 6)) AS INT) AS v FROM px8 JOIN ry USING (y, x)
""")
def j_feathered_mask(spark, sf):
    return P.apply_feathered_mask(fx.px8(spark, sf), fx.mask8(spark), X.parse_color("40"), 1.0).select(*PX, "v")


@query("SELECT frame_id, y, x FROM (SELECT frame_id, y, x FROM px8 WHERE v >= 150 UNION SELECT frame_id, y, x FROM px8 WHERE v <= 90)")
def o_mask_union(spark, sf):
    p = fx.px8(spark, sf)
    return p.filter("v >= 150").select(*PX).union(p.filter("v <= 90").select(*PX)).distinct()


@query("SELECT frame_id, y, x FROM px8 WHERE v >= 100 INTERSECT SELECT frame_id, y, x FROM px8 WHERE v <= 130")
def o_mask_intersection(spark, sf):
    p = fx.px8(spark, sf)
    return p.filter("v >= 100").select(*PX).intersect(p.filter("v <= 130").select(*PX))


@query("SELECT filename FROM nam WHERE filename LIKE '%.tif' UNION ALL SELECT filename FROM nam WHERE lower(filename) LIKE '%.tiff'")
def o_listings(spark, sf):
    n = fx.names_mixed(spark, sf).select("filename")
    return n.filter(F.col("filename").endswith(".tif")).unionByName(n.filter(F.lower("filename").endswith(".tiff")))


@query("""
WITH s AS (SELECT user_id % 4 AS session, (extract(day FROM ts) + extract(day FROM ts) // 6)::INT AS timepoint, (sum(round(value)::BIGINT) % 5 - 2)::BIGINT AS dy, (count(*) % 3 - 1)::BIGINT AS dx FROM events
  GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN timepoint - lag(timepoint) OVER w = 1 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY session ORDER BY timepoint)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY timepoint) AS island FROM n)
SELECT session, timepoint, island::BIGINT AS island, (sum(CASE WHEN new = 1 THEN 0 ELSE dy END) OVER w)::BIGINT AS sum_dy, (sum(CASE WHEN new = 1 THEN 0 ELSE dx END) OVER w)::BIGINT AS sum_dx
FROM i WINDOW w AS (PARTITION BY session, island ORDER BY timepoint)
""")
def w_chained_drift(spark, sf):
    day = F.dayofmonth("ts")  # each sixth number is left out of the timepoints, no event is
    e = fx.table(spark, sf, "events").withColumns({"session": F.col("user_id") % 4, "timepoint": (day + F.floor(day / 6)).cast("int")})
    steps = e.groupBy("session", "timepoint").agg((F.sum(F.round("value").cast("long")) % 5 - 2).alias("dy"), (F.count("*") % 3 - 1).alias("dx"))
    return register.chain(steps).select("session", "timepoint", "island", "sum_dy", "sum_dx")


@query("""
WITH s AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR]) AS window_start, value FROM events)
SELECT event_type, window_start, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / 100, 2) AS total FROM s GROUP BY 1, 2
""")
def r_sliding_sums(spark, sf):
    from ..streaming.live import tumbling_sums

    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling_sums(e, "3 hours", slide="1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT stack_id, z, y, x, lead(v) OVER (PARTITION BY stack_id, y, x ORDER BY z) - v AS it,
    (lead(v) OVER (PARTITION BY frame_id, y ORDER BY x) - lag(v) OVER (PARTITION BY frame_id, y ORDER BY x)) / 2.0 AS ix,
    (lead(v) OVER (PARTITION BY frame_id, x ORDER BY y) - lag(v) OVER (PARTITION BY frame_id, x ORDER BY y)) / 2.0 AS iy FROM px8),
b AS (SELECT stack_id, z, y // 4 AS ty, x // 4 AS tx, sum(ix * ix)::DOUBLE AS a, sum(ix * iy)::DOUBLE AS b, sum(iy * iy)::DOUBLE AS c, sum(ix * it)::DOUBLE AS e, sum(iy * it)::DOUBLE AS f
  FROM g WHERE ix IS NOT NULL AND iy IS NOT NULL AND it IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT stack_id, z, ty::INT AS block_y, tx::INT AS block_x, round(CASE WHEN a * c - b * b > 1e-6 THEN sqrt(pow((b * f - c * e) / (a * c - b * b), 2) + pow((b * e - a * f) / (a * c - b * b), 2)) ELSE 0 END, 5) AS speed FROM b
""")
def z_block_motion(spark, sf):
    return pulse.block_motion(fx.px8(spark, sf), 4).withColumn("speed", r("speed", 5))


@query("""
WITH g AS (SELECT stack_id, z, y, x, lead(v) OVER (PARTITION BY stack_id, y, x ORDER BY z) - v AS it,
    (lead(v) OVER (PARTITION BY frame_id, y ORDER BY x) - lag(v) OVER (PARTITION BY frame_id, y ORDER BY x)) / 2.0 AS ix,
    (lead(v) OVER (PARTITION BY frame_id, x ORDER BY y) - lag(v) OVER (PARTITION BY frame_id, x ORDER BY y)) / 2.0 AS iy FROM px8),
b AS (SELECT stack_id, z, y // 4 AS ty, x // 4 AS tx, sum(ix * ix)::DOUBLE AS a, sum(ix * iy)::DOUBLE AS b, sum(iy * iy)::DOUBLE AS c, sum(ix * it)::DOUBLE AS e, sum(iy * it)::DOUBLE AS f
  FROM g WHERE ix IS NOT NULL AND iy IS NOT NULL AND it IS NOT NULL GROUP BY 1, 2, 3, 4),
s AS (SELECT stack_id, z, ty, tx, CASE WHEN a * c - b * b > 1e-6 THEN sqrt(pow((b * f - c * e) / (a * c - b * b), 2) + pow((b * e - a * f) / (a * c - b * b), 2)) ELSE 0 END AS speed FROM b)
SELECT p.stack_id, roi, p.z, round(avg(speed), 5) AS motion FROM px8 p JOIN s ON s.stack_id = p.stack_id AND s.z = p.z AND s.ty = p.y // 4 AND s.tx = p.x // 4
JOIN rois8 ON p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1 GROUP BY 1, 2, 3
""")
def z_block_motion_by_roi(spark, sf):
    return pulse.block_motion_by_roi(fx.px8(spark, sf), fx.rois8(spark), 4).withColumn("motion", r("motion", 5))


_E5 = ", ".join(f"({dy}, {dx})" for dy, dx in segment.ELLIPSE5)


def _grown(name: str, source: str) -> str:
    return f"{name} AS (SELECT DISTINCT g.frame_id, g.y, g.x FROM px8 g, e5, {source} b WHERE b.frame_id = g.frame_id AND b.y = g.y + dy AND b.x = g.x + dx)"


def _worn(name: str, source: str) -> str:
    return f"""{name} AS (SELECT g.frame_id, g.y, g.x FROM px8 g JOIN e5 ON g.y + dy BETWEEN 0 AND 7 AND g.x + dx BETWEEN 0 AND 7
  LEFT JOIN {source} b ON b.frame_id = g.frame_id AND b.y = g.y + dy AND b.x = g.x + dx GROUP BY 1, 2, 3 HAVING count(b.y) = count(*))"""


_REGION = ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in ("label", "area_pixels", "bx", "by", "width", "height", "cx", "cy", "border", "polygon_area"))


@query(f"""
WITH RECURSIVE
st AS (SELECT frame_id, y, x, v, min(v) OVER (PARTITION BY frame_id) AS lo, max(v) OVER (PARTITION BY frame_id) AS hi FROM px8),
s8 AS (SELECT frame_id, y, x, CASE WHEN hi > lo THEN CAST(trunc((v - lo) * 255.0 / (hi - lo)) AS INT) ELSE 128 END AS v FROM st), {_even("s8")},
tp(d, w) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
bx AS (SELECT p.frame_id, p.y, p.x, sum(q.v * w) AS v FROM ev p, tp, ev q WHERE q.frame_id = p.frame_id AND q.y = p.y AND q.x = 7 - abs(((p.x + d + 14) % 14) - 7) GROUP BY 1, 2, 3),
sb AS (SELECT p.frame_id, p.y, p.x, floor(sum(q.v * w) / 256.0 + 0.5)::INT AS v FROM bx p, tp, bx q WHERE q.frame_id = p.frame_id AND q.x = p.x AND q.y = 7 - abs(((p.y + d + 14) % 14) - 7) GROUP BY 1, 2, 3),
hs AS (SELECT frame_id, v, count(*) AS n FROM sb GROUP BY 1, 2),
ot AS (SELECT frame_id, v, sum(n) OVER w / 64.0 AS o, sum(v * n) OVER w / 64.0 AS m, sum(v * n) OVER (PARTITION BY frame_id) / 64.0 AS t FROM hs WINDOW w AS (PARTITION BY frame_id ORDER BY v)),
th AS (SELECT frame_id, greatest(arg_max(v, row(round(CASE WHEN o < 1 THEN pow(t * o - m, 2) / (o * (1 - o)) ELSE 0 END, 9), -v)) - 3, 0)::INT AS threshold FROM ot GROUP BY 1),
dark AS (SELECT frame_id, y, x FROM sb JOIN th USING (frame_id) WHERE v <= threshold), e5(dy, dx) AS (VALUES {_E5}),
{_worn("o1", "dark")}, {_grown("o2", "o1")}, {_grown("o3", "o2")}, {_worn("solid", "o3")},
{_EIGHT.removeprefix("RECURSIVE").replace("reg8", "solid")},
nn AS (SELECT frame_id, label, count(*) AS n FROM cc GROUP BY 1, 2), best AS (SELECT frame_id, arg_max(label, row(n, -label)) AS label, max(n) AS n FROM nn GROUP BY 1),
rg AS (SELECT frame_id, label, y, x FROM cc JOIN best USING (frame_id, label) WHERE n >= 6),
bo AS (SELECT frame_id, count(*) AS border FROM rg c WHERE (SELECT count(*) FROM rg q WHERE q.frame_id = c.frame_id AND abs(q.y - c.y) + abs(q.x - c.x) = 1) < 4 GROUP BY 1),
ms AS (SELECT frame_id, label, count(*) AS area_pixels, min(x) AS bx, min(y) AS by, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, trunc(avg(x))::INT AS cx, trunc(avg(y))::INT AS cy, border,
  round((max(x) - min(x) + 1) / (max(y) - min(y) + 1), 6) AS aspect_ratio, count(*) - border / 2 - 1 AS polygon_area FROM rg JOIN bo USING (frame_id) GROUP BY frame_id, label, border),
ds AS (SELECT frame_id, sum(255 - v)::DOUBLE AS total_darkness, avg(255 - v) AS average_darkness, min(255 - v)::DOUBLE AS min_darkness, max(255 - v)::DOUBLE AS max_darkness, avg(v) AS raw_mean,
  min(v)::DOUBLE AS raw_min, max(v)::DOUBLE AS raw_max FROM px8 JOIN rg USING (frame_id, y, x) GROUP BY 1)
SELECT f.frame_id, ds.frame_id IS NOT NULL AS contour_found, coalesce(total_darkness, 0) AS total_darkness, round(coalesce(average_darkness, 0), 6) AS average_darkness, coalesce(min_darkness, 0) AS min_darkness,
  coalesce(max_darkness, 0) AS max_darkness, round(coalesce(raw_mean, 0), 6) AS raw_mean, coalesce(raw_min, 0) AS raw_min, coalesce(raw_max, 0) AS raw_max, coalesce(aspect_ratio, 0) AS aspect_ratio, {_REGION}
FROM (SELECT DISTINCT frame_id FROM px8) f LEFT JOIN ds USING (frame_id) LEFT JOIN ms USING (frame_id)
""")
def v_track_regions(spark, sf):
    from .workflows import track_regions

    return track_regions(fx.px8(spark, sf), 8, 8, 3, 6, 2).withColumns({c: r(c) for c in ("average_darkness", "raw_mean", "aspect_ratio")})


@query("""
WITH s(dy, dx) AS (SELECT a.i, b.i FROM range(-1, 2) a(i), range(-1, 2) b(i)),
c AS (SELECT f.frame_id, dy, dx, round(corr(f.v::DOUBLE, g.v::DOUBLE), 9) AS c FROM px8 f, s, px8 g WHERE g.stack_id = f.stack_id AND g.z = 0 AND g.y = f.y - dy AND g.x = f.x - dx GROUP BY 1, 2, 3),
m AS (SELECT frame_id, arg_max(dy, k)::INT AS dy, arg_max(dx, k)::INT AS dx FROM (SELECT *, row(c, -(abs(dy) + abs(dx)), -dy, -dx) AS k FROM c) GROUP BY 1),
al AS (SELECT a.frame_id, a.y, a.x, coalesce(b.v, 0) AS v FROM px8 a JOIN m USING (frame_id) LEFT JOIN px8 b ON b.frame_id = a.frame_id AND b.y = a.y + dy AND b.x = a.x + dx),
cr AS (SELECT frame_id, y - 1 AS y, x - 1 AS x, v FROM al WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6),
t(d, w) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
rx AS (SELECT p.frame_id, p.y, p.x, sum(q.v * w) AS v FROM cr p, t, cr q WHERE q.frame_id = p.frame_id AND q.y = p.y AND q.x = 5 - abs(((p.x + d + 10) % 10) - 5) GROUP BY 1, 2, 3),
bl AS (SELECT p.frame_id, p.y, p.x, sum(q.v * w) / 256.0 AS v FROM rx p, t, rx q WHERE q.frame_id = p.frame_id AND q.x = p.x AND q.y = 5 - abs(((p.y + d + 10) % 10) - 5) GROUP BY 1, 2, 3),
r AS (SELECT frame_id, max(floor(v + 0.5))::DOUBLE / 255.0::DOUBLE AS ratio FROM bl GROUP BY 1)
SELECT frame_id, y::INT AS y, x::INT AS x, least(255, round_even(v / ratio, 0))::INT AS g FROM cr JOIN r USING (frame_id)
""")
def v_aligned_and_cropped(spark, sf):
    from .workflows import aligned_and_cropped

    return aligned_and_cropped(fx.px8(spark, sf), 1).select(*PX, "rgb.g")


@query()
def v_pulsatility_report(spark, sf):
    from .workflows import pulsatility_report

    return pulsatility_report(fx.px8(spark, sf), fx.rois8(spark), 10.0, stride=2, size=(8, 8), max_width=4)[0]


@query("""
WITH h AS (SELECT stack_id, z // 2 AS z, y // 2 AS y, x // 2 AS x, round_even(avg(v), 0) AS v FROM px8 WHERE z % 2 = 0 AND z < 60 GROUP BY 1, 2, 3, 4),
d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY stack_id, y, x ORDER BY z)) AS diff FROM h)
SELECT stack_id || '/' || roi AS series_id, (z - 1)::INT AS idx, round(avg(diff), 6)::DOUBLE AS value FROM d JOIN rois8 ON y >= y0 // 2 AND y < y1 // 2 AND x >= x0 // 2 AND x < x1 // 2 WHERE diff IS NOT NULL GROUP BY stack_id, roi, z
""")
def v_motion_series(spark, sf):
    from .workflows import motion_series

    s, _ = motion_series(fx.px8(spark, sf), fx.rois8(spark), 10.0, stride=2, max_frames=30, size=(8, 8), max_width=4)
    return s.select("series_id", F.col("idx").cast("int").alias("idx"), r("value").alias("value"))


@query(f"SELECT stack_id AS frame_id, y, x, 0 AS r, v AS g, 0 AS b FROM ({_edf_sql(3, 1)})")
def v_stills_of_slices(spark, sf):
    """Slices named `{{stack}}_{{slice}}.png` to a still of each stack, fused by depth of field with the default levels."""
    from .workflows import stack_stills

    named = fx.px8(spark, sf).withColumn("name", F.concat(F.col("stack_id").cast("string"), F.lit("_"), (F.col("z") - 5).cast("string"), F.lit(".png"))).drop("stack_id", "z")
    key = K.key_xy(F.col("name"))
    slices = named.withColumns({"stack_id": key["x"], "z": key["y"]}).filter("stack_id IS NOT NULL")
    return stack_stills(slices, projection="edf").select("frame_id", "y", "x", "rgb.*")


@query()
def v_core_outer(spark, sf):
    from .workflows import core_outer

    return core_outer(fx.px8(spark, sf), 8, 8, 2, 3, 3, 1)


@query("""
WITH b AS (SELECT frame_id, stack_id AS session, z // 2 AS t, z % 2 AS k, y, x, v FROM px8), s(dy, dx) AS (SELECT a.i, b.i FROM range(-1, 2) a(i), range(-1, 2) b(i)),
c AS (SELECT f.frame_id, f.session, f.t, f.k, dy, dx, round(corr(f.v::DOUBLE, g.v::DOUBLE), 9) AS c FROM b f, s, b g WHERE g.session = f.session AND g.k = 0 AND g.t = f.t + f.k - 1 AND g.y = f.y - dy AND g.x = f.x - dx GROUP BY ALL),
m AS (SELECT frame_id, arg_max(dy, q) AS dy, arg_max(dx, q) AS dx FROM (SELECT *, row(c, -(abs(dy) + abs(dx)), -dy, -dx) AS q FROM c) GROUP BY 1),
f AS (SELECT DISTINCT frame_id, session, t, k FROM b),
p AS (SELECT session, t, sum(coalesce(dy, 0)) OVER w AS y, sum(coalesce(dx, 0)) OVER w AS x FROM f LEFT JOIN m USING (frame_id) WHERE k = 0 WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, t::INT AS timepoint, k::INT AS z, frame_id, 1::BIGINT AS island, (p.y + CASE WHEN k = 0 THEN 0 ELSE dy END)::BIGINT AS sum_dy, (p.x + CASE WHEN k = 0 THEN 0 ELSE dx END)::BIGINT AS sum_dx
FROM f LEFT JOIN m USING (frame_id) JOIN p USING (session, t)
""")
def v_aligned_session(spark, sf):
    z = F.col("z")
    p = fx.px8(spark, sf).select(F.col("stack_id").alias("session"), F.floor(z / 2).cast("int").alias("timepoint"), (z % 2).alias("z"), *PX, "v")
    return register.align_session(p, 0, 1)


@query("""
SELECT series_id, printf('timepoints %d (%d - %d), area mean=%.1f std=%.1f, darkness mean=%.2f std=%.2f', count(*), min(timepoint), max(timepoint), avg(area_pixels), stddev_samp(area_pixels),
  avg(average_darkness), stddev_samp(average_darkness)) AS line FROM trk WHERE contour_found GROUP BY 1
""")
def x_summary_lines(spark, sf):
    return series.summary_lines(fx.ev_tracks(spark, sf))
