"""Chains of operators from frames to curves, stills and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import pixels as P
from ..operators import pulse, register, segment, series
from ..operators import wavelet as wavelet_fusion
from ..operators.durable import written


def fluorescence_curve(pixels: DataFrame, window: int, level: float = 0.95, brightfield: bool = False) -> DataFrame:
    """Summed intensity of each frame as percent of the first `window`, smoothed with a confidence band: series_id, idx, value, pct, ma, ci."""
    sums = P.sum_brightness(pixels, brightfield)
    keys = pixels.select("frame_id", F.col("stack_id").alias("series_id"), F.col("z").alias("idx")).distinct()
    s = keys.join(sums, "frame_id").withColumn("value", F.col("sum_optical_density" if brightfield else "sum_brightness"))
    pct = series.percent_of_initial(s, window)
    band = series.confidence_band(pct.withColumns({"raw": F.col("value"), "value": F.col("pct")}), window, level)
    return band.select("series_id", "idx", F.col("raw").alias("value"), "pct", "ma", "ci")


def fused_stacks(pixels: DataFrame, method: str = "average", wavelet: str = "db3", levels: int = 3, top_n: int = 1, invert: bool = False) -> DataFrame:
    """One frame a stack, with frame_id = stack_id: depth of field (`edf`), a mean (`average`) or another projection."""
    if method == "edf":
        depth = pixels.groupBy("stack_id").agg(F.max("bit_depth").alias("bit_depth"))
        fused = wavelet_fusion.edf_fuse(pixels, wavelet, levels, top_n, invert).join(depth, "stack_id")
    else:
        fused = P.fuse_project(pixels, "mean" if method == "average" else method)
    return fused.withColumn("frame_id", F.col("stack_id"))


def stack_stills(pixels: DataFrame, factor: float = 1.0, projection: str = "average", channel: str = "green", gamma: float = 1.0, **edf: object) -> DataFrame:
    """A colored still for each stack."""
    return P.grey_to_color(P.scale_brightness(fused_stacks(pixels, projection, **edf), factor), channel, gamma)


def focal_stack_sequence(
    pixels: DataFrame, height: int, width: int, method: str = "edf", brightness: float = 1.0, clip_limit: float = 2.0, tiles: int = 8,
    channel: str = "green", gamma: float = 1.0, scale_um: float | None = None, pixel_size_um: float | None = None, bar_height: int = 3,
    bar_margin: int = 5, normalize: str = "global", **edf: object,
) -> DataFrame:
    """The frames of an animation, one a stack (timepoint): fused, brightened, locally equalized, normalized to 8 bits, colored and with a white
    scale bar where both sizes are given: frame_id, y, x, v, rgb. An input without stacks raises."""
    if pixels.isEmpty():
        raise ValueError("no focal stacks")
    fused = fused_stacks(pixels, method, **edf)
    lit = P.scale_brightness(fused, brightness) if brightness != 1.0 else fused
    bits = fused.agg(F.max("bit_depth")).head()[0]
    even = segment.clahe(lit, height, width, clip_limit, tiles, 65536 if bits == 16 else 256).withColumns({"bit_depth": F.lit(bits), "sequence": F.lit(0)})
    out = P.grey_to_color(P.normalize_frames(even, normalize, by="sequence"), channel, gamma).drop("sequence")
    if scale_um is None or pixel_size_um is None:
        return out
    marked = P.overlay_scale_bar(out.withColumn("_v", F.col("v")).withColumn("v", F.lit(0)), scale_um, pixel_size_um, bar_margin, bar_height, 1)
    white = F.struct(*(F.lit(255).alias(c) for c in "rgb"))
    return marked.withColumn("rgb", F.when(F.col("v") == 1, white).otherwise(F.col("rgb"))).withColumn("v", F.col("_v")).drop("_v")


def aligned_and_cropped(pixels: DataFrame, max_shift: int, channel: str = "green") -> DataFrame:
    """Register to the first frame, crop the greatest shift on each side, brighten by the blurred maximum, color."""
    crop = P.crop(register.align_stack(pixels, max_shift), max_shift, max_shift, max_shift, max_shift)
    ratio = P.find_max_brightness(crop).select("frame_id", "ratio")
    lit = crop.join(ratio, "frame_id").withColumn("v", F.least(F.lit(255.0), F.rint(F.col("v") / F.col("ratio"))).cast("int")).drop("ratio")
    return P.grey_to_color(lit, channel)


def track_regions(pixels: DataFrame, height: int, width: int, adjustment: int = 0, min_area: int = 1000, tiles: int = 8) -> DataFrame:
    """The largest dark region of every frame with its measures; zeros and contour_found = false where there is none."""
    p8 = P.to_8bit_scaled(pixels)
    even = segment.clahe(p8, height, width, 2.0, tiles)
    soft = P.gaussian_blur(even, 5).withColumn("v", F.floor(F.col("v") + 0.5).cast("int"))
    dark = segment.below(soft, segment.otsu(soft, adjustment))
    solid = written(segment.close_(segment.open_(dark, segment.ELLIPSE5, height, width), segment.ELLIPSE5, height, width), "solid")
    region = written(segment.largest_component(segment.connected_components(solid), min_area), "region")
    stats = segment.darkness_stats(pixels, region)
    return stats.join(segment.region_measures(region), "frame_id", "left").na.fill(0)


def growth_tables(tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(growth rates, summary, correlation) of tracks."""
    return series.growth_rate(tracks), series.growth_summary(tracks), series.area_darkness_corr(tracks)


def motion_series(
    pixels: DataFrame, rois: DataFrame, fps: float, method: str = "diff", block: int = 16, stride: int = 1, max_frames: int | None = None,
    size: tuple[int, int] | None = None, max_width: int | None = None,
) -> tuple[DataFrame, float]:
    """(series_id, idx, value: motion by stack and region; frames a second): frame differences, or `flow`, speeds of blocks.

    Every stride-th frame counts, at most max_frames of them. With the frames' size (height, width) and a max_width they are first
    averaged down to that width, to whole values, and the regions with them. Speeds are in pixels of the frames that are compared.
    """
    if method not in ("flow", "diff"):
        raise ValueError(f"unknown method {method!r}")
    frames = P.decimate(pixels.select("frame_id", "stack_id", F.col("z").alias("frame_idx")).distinct(), stride, max_frames, F.lit(float(fps)))
    place = Window.partitionBy("stack_id").orderBy("frame_idx")
    frames = frames.select("frame_id", "stack_id", (F.row_number().over(place) - 1).alias("z"))
    scale = 1.0
    if size is not None and max_width is not None:
        small, scale = P.downscale_to(pixels.join(frames.select("frame_id"), "frame_id", "left_semi"), *size, max_width)
        pixels = small.withColumn("v", F.rint(F.round("v", 6)).cast("int"))
        rois = rois.select("roi", *(F.rint(F.col(c) * scale).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))
    kept = pixels.select("frame_id", "y", "x", "v").join(frames, "frame_id")
    motion = P.motion_diff(kept, rois) if method == "diff" else pulse.block_motion_by_roi(kept, rois, block)
    return motion.select(F.concat_ws("/", "stack_id", "roi").alias("series_id"), (F.col("z") - 1).alias("idx"), F.col("motion").alias("value")), fps / stride


def pulsatility_report(pixels: DataFrame, rois: DataFrame, fps: float, min_bpm: float = 30.0, max_bpm: float = 300.0, **motion: object) -> tuple[DataFrame, DataFrame]:
    """Motion by region (`motion_series`), then the pulse analysis of every region: (summary, waveform)."""
    s, rate = motion_series(pixels, rois, fps, **motion)
    return pulse.analyze_pulsatility(s, rate, min_bpm, max_bpm)


def core_outer(pixels: DataFrame, height: int, width: int, tiles: int = 8, core_min: int = 1000, outer_min: int = 5000, radius: int = 10) -> DataFrame:
    """Core (bright centre) and outer region of every frame with their statistics; frames without a core have no row."""
    flat = P.minmax_normalize(pixels)
    soft, wide = (P.gaussian_blur(flat, k, s).withColumn("v", F.floor(F.col("v") + 0.5).cast("int")) for k, s in ((3, 0.0), (9, 2.0)))
    even = segment.clahe(soft, height, width, 2.0, tiles)
    bright = segment.percentile_masks(wide).filter("core").select("frame_id", "y", "x")
    core = written(segment.remove_small(bright, core_min), "core")
    core = segment.close_(segment.fill_holes(core, height, width), segment.disk(radius), height, width)
    core = written(segment.hull_fallback(segment.largest_component(segment.connected_components(written(core, "closed")), 1)).select("frame_id", "y", "x"), "core")
    ring = segment.percentile_masks(even).filter("outer").select("frame_id", "y", "x")
    outer = written(segment.remove_small(ring, outer_min).unionByName(core).distinct(), "ring")
    outer = written(segment.fill_holes(outer, height, width), "filled")
    outer = segment.containing_component(segment.connected_components(outer), core).select("frame_id", "y", "x").join(core, ["frame_id", "y", "x"], "left_anti")
    marks = core.withColumns({"core": F.lit(True), "outer": F.lit(False)}).unionByName(outer.withColumns({"core": F.lit(False), "outer": F.lit(True)}))
    masks = segment.grid(core, height, width).join(marks, ["frame_id", "y", "x"], "left").na.fill(False, ["core", "outer"])
    return segment.core_outer_stats(pixels, masks)
