"""Pixel operators on `pixels`: frame_id, stack_id, z, y, x, v, bit_depth.

Integer results truncate toward zero, as the formats they come from do; sizes of frames are read from
the pixels where they are not given. Kernels, offsets, masks and ROIs are small dimension tables.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["frame_id"]


def explode_frames(frames: DataFrame) -> DataFrame:
    """frames (data: row-major array, width) to one row a pixel."""
    keep = [c for c in ("frame_id", "stack_id", "z", "bit_depth") if c in frames.columns]
    return frames.select(*keep, "width", F.posexplode("data").alias("i", "v")).select(
        *keep, F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "v"
    )


def implode_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels back to frames: frame_id, height, width, data."""
    cells = F.sort_array(F.collect_list(F.struct("y", "x", "v")))
    return pixels.groupBy(*FRAME).agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.transform(cells, lambda c: c["v"]).alias("data")
    )


def full_scale(bit_depth: Column) -> Column:
    return F.when(bit_depth == 16, 65535).otherwise(255)


def truncated(value: Column, top: Column | int) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(top) if isinstance(top, int) else top).cast("int")


def crop(pixels: DataFrame, left: int = 0, top: int = 0, right: int = 0, bottom: int = 0) -> DataFrame:
    if min(left, top, right, bottom) < 0:
        raise ValueError("crop amounts must not be negative")
    w = Window.partitionBy(*FRAME)
    sized = pixels.withColumns({"_h": F.max("y").over(w) + 1, "_w": F.max("x").over(w) + 1})
    inside = (F.col("y") >= top) & (F.col("y") < F.col("_h") - bottom) & (F.col("x") >= left) & (F.col("x") < F.col("_w") - right)
    return sized.filter(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - left}).drop("_h", "_w")


def scale_brightness(pixels: DataFrame, factor: float) -> DataFrame:
    """8 bits: rounded half to even and saturated; 16 bits: truncated and clipped."""
    v = F.col("v") * F.lit(factor)
    eight = F.least(F.lit(255.0), F.rint(F.abs(v))).cast("int")
    return pixels.withColumn("v", F.when(F.col("bit_depth") == 16, truncated(v, 65535)).otherwise(eight))


def scale_colors(pixels: DataFrame, top: int = 255, bottom: int = 0) -> DataFrame:
    """[bottom, top] to 0..65535; frames brighter than 255 are first brought to 255."""
    if not 0 <= bottom < top:
        raise ValueError("require 0 <= bottom < top")
    most = F.max("v").over(Window.partitionBy(*FRAME))
    v = F.when(most > 255, F.col("v") * 255.0 / most).otherwise(F.col("v").cast("double"))
    return pixels.withColumns({"v": truncated((v - bottom) * 65535.0 / (top - bottom), 65535), "bit_depth": F.lit(16)})


def grey_to_color(pixels: DataFrame, channel: str = "red", gamma: float = 1.0) -> DataFrame:
    """rgb struct of 8 bits with the gray value in one channel, gamma applied in the frame's own depth."""
    if channel not in ("red", "green", "blue"):
        raise ValueError(f"unknown channel {channel!r}")
    top = full_scale(F.col("bit_depth"))
    lit = F.col("v") if gamma == 1.0 else (F.pow(F.col("v") / top, F.lit(gamma)) * top).cast("int")
    eight = F.when(F.col("bit_depth") == 16, (lit * 255.0 / 65535.0).cast("int")).otherwise(lit.cast("int"))
    rgb = F.struct(*((eight if channel == name else F.lit(0)).alias(name[0]) for name in ("red", "green", "blue")))
    return pixels.withColumn("rgb", rgb)


def to_bit_depth(pixels: DataFrame, target: int) -> DataFrame:
    v = F.col("v")
    out = F.when(F.col("bit_depth") == target, v).otherwise(v * 257 if target == 16 else F.floor(v / 257))
    return pixels.withColumns({"v": out.cast("int"), "bit_depth": F.lit(target)})


def bundle_depth(pixels: DataFrame, bit_depth: int | None = None) -> DataFrame:
    """All slices of a stack in the depth of its first slice, or the given one."""
    first = F.first("bit_depth").over(Window.partitionBy("stack_id").orderBy("z"))
    target = F.lit(bit_depth) if bit_depth else first
    moved = pixels.withColumn("_t", target)
    v = F.when(F.col("_t") == F.col("bit_depth"), F.col("v")).when(F.col("_t") == 16, F.col("v") * 257).otherwise(F.floor(F.col("v") / 257))
    return moved.withColumns({"v": v.cast("int"), "bit_depth": F.col("_t")}).drop("_t")


def _range(by: list[str]) -> tuple[Column, Column]:
    w = Window.partitionBy(*by)
    return F.min("v").over(w), F.max("v").over(w)


def to_8bit_scaled(pixels: DataFrame) -> DataFrame:
    """Frames deeper than 8 bits (or brighter than 255) by 256, then stretched to 0..255; flat frames become 128."""
    w = Window.partitionBy(*FRAME)
    deep = (F.col("bit_depth") == 16) | (F.max("v").over(w) > 255)
    first = pixels.withColumn("v", F.when(deep, F.floor(F.col("v") / 256)).otherwise(F.col("v")).cast("int"))
    lo, hi = _range(FRAME)
    out = F.when(hi > lo, ((F.col("v") - lo) * 255.0 / (hi - lo)).cast("int")).otherwise(128)
    return first.withColumns({"v": out, "bit_depth": F.lit(8)})


def normalize_frames(pixels: DataFrame, mode: str = "global", by: str = "stack_id") -> DataFrame:
    """8 bits: `global` over a sequence's frames of more than 8 bits, `per-frame`, or `none` (clipped)."""
    if mode not in ("global", "per-frame", "none"):
        raise ValueError(f"unknown mode {mode!r}")
    deep, v = F.col("bit_depth") != 8, F.col("v")
    if mode == "none":
        out = truncated(v, 255)
    else:
        w = Window.partitionBy(*(FRAME if mode == "per-frame" else [by]))
        lo, hi = (f(F.when(deep, v)).over(w) for f in (F.min, F.max))
        out = F.when(hi > lo, ((v - lo) * 255.0 / (hi - lo)).cast("int")).otherwise(0)
    return pixels.withColumns({"v": F.when(deep, out).otherwise(v).cast("int"), "bit_depth": F.lit(8)})


def minmax_normalize(pixels: DataFrame) -> DataFrame:
    lo, hi = _range(FRAME)
    return pixels.withColumn("v", F.when(hi > lo, F.rint((F.col("v") - lo) * 255.0 / (hi - lo)).cast("int")).otherwise(0))


def optical_density(pixels: DataFrame, max_value: float | None = None) -> DataFrame:
    """The greatest value less v; by depth, or the frame's own maximum where the depth is null."""
    top = F.lit(max_value) if max_value is not None else F.when(F.col("bit_depth").isNotNull(), full_scale(F.col("bit_depth"))).otherwise(
        F.max("v").over(Window.partitionBy(*FRAME))
    )
    return pixels.withColumn("v", top - F.col("v"))


def subtract_background(pixels: DataFrame, background: float | None) -> DataFrame:
    return pixels.withColumn("v", F.greatest(F.col("v") - F.lit(background), F.lit(0))) if background else pixels


def detect_bit_depth(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*FRAME).agg(F.when(F.max("v") > 255, 16).otherwise(8).alias("bit_depth"))


def decimate(frames: DataFrame, stride: int = 1, max_frames: int | None = None, fps: Column | None = None, least: int = 3, by: str = "stack_id") -> DataFrame:
    """Every stride-th frame of each stack in order of frame_idx, at most max_frames of them, with the rate that results (30 where none
    is known). A stack that is left with under `least` frames raises."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("frame_idx")) - 1
    kept = frames.withColumn("_k", place).filter(F.col("_k") % stride == 0)
    if max_frames is not None:
        kept = kept.filter(F.col("_k") < stride * max_frames)
    rate = fps if fps is not None else F.col("fps")
    known = F.when(rate > 0, rate).otherwise(30.0) / stride
    few = F.count("*").over(Window.partitionBy(by)) < least
    return kept.withColumn("fps", F.when(few, F.raise_error(F.lit("too few frames")).cast("double")).otherwise(known)).drop("_k")


def overlay_scale_bar(pixels: DataFrame, scale_um: float, px: float, margin: int = 20, bar_height: int = 8, value: int = 255) -> DataFrame:
    """A bar of scale_um in the lower left corner, corners included; raises where it does not fit."""
    if scale_um <= 0 or px <= 0:
        raise ValueError("scale and pixel size must be positive")
    bar = round(scale_um / px)
    w = Window.partitionBy(*FRAME)
    height, width = F.max("y").over(w) + 1, F.max("x").over(w) + 1
    top = height - margin - bar_height
    on = F.col("y").between(top, top + bar_height) & F.col("x").between(margin, margin + bar)
    fits = F.when(width < bar + 2 * margin, F.raise_error(F.lit("scale bar too long")).cast("boolean")).otherwise(on)
    return pixels.withColumn("v", F.when(fits, value).otherwise(F.col("v")))


def gray_of(color: tuple[float, float, float], bit_depth: Column) -> Column:
    r, g, b = color
    gray = float(r) if r == g == b else 0.299 * r + 0.587 * g + 0.114 * b
    return F.when((bit_depth == 16) & F.lit(gray <= 255), gray * 257.0).when((bit_depth != 16) & F.lit(gray > 255), gray / 257.0).otherwise(gray)


def _unit_mask(mask: DataFrame) -> DataFrame:
    """m within 0..1: over 255 where the mask exceeds 1."""
    top = mask.agg(F.max("m")).head()[0] or 0
    return mask.select("y", "x", (F.col("m") / F.lit(255.0 if top > 1 else 1.0)).alias("m"))


def apply_mask(pixels: DataFrame, mask: DataFrame, color: tuple[float, float, float]) -> DataFrame:
    """Where the mask is under one half, v becomes the color's gray, and `rgb` (a struct of r, g, b and perhaps alpha a), if there is one,
    the color, opaque. A pixel without mask raises."""
    m = F.coalesce("m", F.raise_error(F.lit("mask shape differs")).cast("double"))
    out = pixels.join(_unit_mask(mask), ["y", "x"], "left")
    if "rgb" in pixels.columns:
        names = pixels.schema["rgb"].dataType.names
        top = full_scale(F.col("bit_depth")) if "bit_depth" in pixels.columns else F.lit(255)
        painted = F.struct(*((F.lit(int(dict(zip("rgb", color, strict=True))[c])) if c in "rgb" else top).cast("int").alias(c) for c in names))
        out = out.withColumn("rgb", F.when(m < 0.5, painted).otherwise(F.struct(*(F.col("rgb")[c].cast("int").alias(c) for c in names))))
    if "v" in pixels.columns:
        out = out.withColumn("v", F.when(m < 0.5, gray_of(color, F.col("bit_depth")).cast("int")).otherwise(F.col("v")))
    return out.drop("m")


def apply_feathered_mask(pixels: DataFrame, mask: DataFrame, color: tuple[float, float, float], sigma: float) -> DataFrame:
    """Blend by a Gaussian-blurred mask."""
    soft = gaussian_blur(_unit_mask(mask).select(F.lit(0).alias("frame_id"), "y", "x", F.col("m").alias("v")), 2 * math.ceil(3 * sigma) + 1, sigma)
    blend = F.col("v") * F.col("m") + gray_of(color, F.col("bit_depth")) * (1 - F.col("m"))
    joined = pixels.join(soft.select("y", "x", F.col("v").alias("m")), ["y", "x"], "left")
    return joined.withColumn("v", truncated(F.round(blend, 6), full_scale(F.col("bit_depth")).cast("double"))).drop("m")


def sum_brightness(pixels: DataFrame, brightfield: bool = False, mask: DataFrame | None = None, background: float | None = None) -> DataFrame:
    """Sum of each frame over the mask (m > 127), inverted first in brightfield, less the background."""
    name = "sum_optical_density" if brightfield else "sum_brightness"
    p = subtract_background(optical_density(pixels) if brightfield else pixels, background)
    if mask is None:
        return p.groupBy(*FRAME).agg(F.sum("v").cast("double").alias(name))
    inside = p.join(mask.filter("m > 127").select("y", "x"), ["y", "x"], "left_semi")
    out = inside.groupBy(*FRAME).agg(F.sum("v").cast("double").alias(name), F.count("*").alias("masked_area"))
    return pixels.select(*FRAME).distinct().join(out, FRAME, "left").na.fill({name: 0.0, "masked_area": 0})


def region_sum(pixels: DataFrame, region: DataFrame) -> DataFrame:
    """Sum over each frame's region (frame_id, y, x); a frame without region is summed whole with masked_area 0."""
    marked = pixels.join(region.select("frame_id", "y", "x", F.lit(1).alias("_in")), ["frame_id", "y", "x"], "left")
    n = F.count("_in")
    total = F.when(n > 0, F.sum(F.when(F.col("_in") == 1, F.col("v")))).otherwise(F.sum("v"))
    return marked.groupBy(*FRAME).agg(total.cast("double").alias("sum_brightness"), n.alias("masked_area"))


def merge_timestamps(series: DataFrame, times: DataFrame) -> DataFrame:
    """actual_time by index, the empty string where there is none."""
    t = times.select(F.col("N").alias("index"), "actual_time")
    return series.join(t, "index", "left").withColumn("actual_time", F.coalesce("actual_time", F.lit("")))


def _around(pixels: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Pixels with the eight neighbours' values, coordinates clamped at the border, from lag and lead along rows and columns, after one exchange."""
    row, col = Window.partitionBy("frame_id", "y").orderBy("x"), Window.partitionBy("frame_id", "x").orderBy("y")
    v = F.col("v")
    p = pixels.repartition("frame_id").withColumns({"_l": F.coalesce(F.lag("v").over(row), v), "_r": F.coalesce(F.lead("v").over(row), v)})
    names = []
    for c in ("v", "_l", "_r"):
        for d, f in (("u", F.lag), ("d", F.lead)):
            p = p.withColumn(f"_{d}{c}", F.coalesce(f(c).over(col), F.col(c)))
            names.append(f"_{d}{c}")
    return p, [F.col(c) for c in ("_l", "_r", *names)]


def lone_pixels(pixels: DataFrame, threshold: float = 0.2) -> DataFrame:
    """`lone`: strictly brighter than each neighbour by the threshold; at borders the pixel is its own neighbour."""
    p, around = _around(pixels)
    lone = reduce(lambda a, b: a & b, (F.col("v") > n * (1 + threshold) for n in around))
    return p.select(*pixels.columns, lone.alias("lone"))


def persistent_lone_pixels(pixels: DataFrame, threshold: float = 0.2, min_fraction: float = 0.2, min_count: int | None = None) -> DataFrame:
    """y, x of each stack flagged in int(n * min_fraction) frames or more: where that is 0, every pixel, unless min_count is given."""
    hits = lone_pixels(pixels, threshold).groupBy("stack_id", "y", "x").agg(F.count_if("lone").alias("hits"), F.count("*").alias("n"))
    least = F.lit(min_count) if min_count is not None else F.floor(F.col("n") * min_fraction)
    return hits.filter(F.col("hits") >= least).select("stack_id", "y", "x")


def repair_pixels(pixels: DataFrame, flags: DataFrame) -> DataFrame:
    """Flagged pixels (stack_id, y, x) take the truncated mean of their eight neighbours."""
    p, around = _around(pixels)
    mean = (reduce(lambda a, b: a + b, around) / 8).cast("int")
    out = p.join(flags.select("stack_id", "y", "x", F.lit(True).alias("_f")), ["stack_id", "y", "x"], "left")
    return out.withColumn("v", F.when(F.col("_f"), mean).otherwise(F.col("v"))).select(*pixels.columns)


def taps(ksize: int, sigma: float = 0.0) -> list[float]:
    """Gaussian weights; sigma 0: the fixed small kernels up to 7 taps, else sigma from the size."""
    small = {1: [1], 3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [2, 7, 14, 18, 14, 7, 2]}
    if sigma <= 0 and ksize in small:
        return [x / sum(small[ksize]) for x in small[ksize]]
    sigma = sigma if sigma > 0 else 0.3 * ((ksize - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((k - ksize // 2) ** 2) / (2 * sigma * sigma)) for k in range(ksize)]
    return [x / sum(raw) for x in raw]


def _along(pixels: DataFrame, axis: str, weights: list[float], border: str) -> DataFrame:
    """One axis of a separable kernel, over the array of each line of a frame."""
    other, half = ("x" if axis == "y" else "y"), len(weights) // 2
    line = pixels.groupBy("frame_id", other).agg(F.sort_array(F.collect_list(F.struct(axis, "v"))).alias("line"))
    size = F.size("line")

    def value(i: Column, d: int) -> Column:
        at = i + d
        if border == "reflect":
            last = size - 1
            at = F.when(last == 0, F.lit(0)).otherwise(last - F.abs(F.pmod(at, F.greatest(2 * last, F.lit(1))) - last))
        else:
            at = F.least(F.greatest(at, F.lit(0)), size - 1)
        return F.get(F.col("line"), at)["v"]

    blurred = F.transform(
        "line",
        lambda c, i: F.struct(c[axis].alias(axis), reduce(lambda a, b: a + b, (value(i, k - half) * F.lit(w) for k, w in enumerate(weights))).alias("v")),
    )
    return line.select("frame_id", other, F.inline(blurred))


def gaussian_blur(pixels: DataFrame, ksize: int, sigma: float = 0.0, border: str = "reflect") -> DataFrame:
    """frame_id, y, x, v (double): separable blur with reflected (or clamped) borders. Lines of a frame are the unit of work."""
    w = taps(ksize, sigma)
    whole = pixels.select("frame_id", "y", "x", "v").repartition("frame_id")  # one exchange for both axes
    return _along(_along(whole, "x", w, border), "y", w, border).select("frame_id", "y", "x", "v")


def find_max_brightness(pixels: DataFrame, blur_kernel: int = 5, bit_depth: int = 8) -> DataFrame:
    """max_value after the blur (rounded, as integer frames are), abs_max of the depth, and their ratio."""
    p = pixels if blur_kernel < 3 else gaussian_blur(pixels, blur_kernel | 1).withColumn("v", F.floor(F.col("v") + 0.5))
    top = 65535.0 if bit_depth == 16 else 255.0
    return p.groupBy(*FRAME).agg(F.max("v").cast("double").alias("max_value")).withColumns({"abs_max": F.lit(top), "ratio": F.col("max_value") / top})


def parse_rois(specs: list[str], width: int, height: int, scale: float = 1.0, units: str = "pixel", limit: int = 5) -> list[tuple[str, int, int, int, int]]:
    """(name, x0, y0, x1, y1) of `[name=]x,y,w,h`, clipped to the frame: pixels, times `scale`, or fractions of it. More than `limit` raise."""
    if units not in ("pixel", "fraction"):
        raise ValueError(f"unknown units {units!r}")
    if len(specs) > limit:
        raise ValueError(f"at most {limit} regions")
    out = []
    for k, spec in enumerate(specs, 1):
        name, _, body = spec.rpartition("=")
        v = [float(p) for p in body.replace(";", ",").split(",")]
        if len(v) != 4:
            raise ValueError(f"not a region: {spec!r}")
        if min(v[2:]) <= 0:
            raise ValueError(f"region without area: {spec!r}")
        x, y, w, h = (a * b for a, b in zip(v, (width, height) * 2, strict=True)) if units == "fraction" else (a * scale for a in v)
        x0, y0 = max(0, round(x)), max(0, round(y))
        x1, y1 = min(width, round(x + w)), min(height, round(y + h))
        if x1 <= x0 or y1 <= y0:
            raise ValueError(f"region outside the frame: {spec!r}")
        out.append((name.strip() or f"roi{k}", x0, y0, x1, y1))
    return out


def assign_rois(pixels: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels with the name of each rectangle (at most five and the full field; more raise) that holds them."""
    if rois.limit(7).count() > 6:
        raise ValueError("at most five regions and the full field")
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return pixels.join(F.broadcast(rois), inside).drop("x0", "y0", "x1", "y1")


def label_rois(labels: DataFrame, limit: int = 5, by: list[str] | None = None) -> DataFrame:
    """roi1.. by falling area of painted labels (y, x, label > 0), with bounding boxes; the `limit` largest of each `by` (a frame's key)."""
    by = by or []
    boxes = labels.filter("label > 0").groupBy(*by, "label").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
    )
    top = boxes if by else boxes.orderBy(F.desc("area"), "label").limit(limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("area"), "label"))
    ranked = top.withColumn("_k", rank).filter(F.col("_k") <= limit)
    return ranked.select(*by, F.concat(F.lit("roi"), "_k").alias("roi"), "label", "area", "x0", "y0", "x1", "y1")


def resize_labels(labels: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """labels (y, x, label, and what else a row holds) of a height by width image on another size; every pixel takes the one at its scaled place."""

    def targets(c: str, size: int, to: int) -> Column:
        first = F.ceil(F.col(c) * to / size).cast("int")
        last = F.ceil((F.col(c) + 1) * to / size).cast("int") - 1
        return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))

    rest = [c for c in labels.columns if c not in ("y", "x")]
    return labels.select(*rest, "x", targets("y", height, to_height).alias("y")).select(*rest, "y", targets("x", width, to_width).alias("x"))


def downscale_to(pixels: DataFrame, height: int, width: int, to_width: int) -> tuple[DataFrame, float]:
    """(frame_id, y, x, v: area averages at `to_width`, its height rounded; the scale). Narrower frames stay, at scale 1."""
    if to_width >= width:
        return pixels.select("frame_id", "y", "x", F.col("v").cast("double").alias("v")), 1.0
    to_height = max(1, round(height * to_width / width))

    def parts(c: str, size: int, to: int) -> Column:
        """Targets of a row or column with the share of it that they take."""
        at = F.col(c) * F.lit(to / size)
        end = F.least((F.col(c) + 1) * F.lit(to / size), F.lit(float(to)))
        first = F.floor(at).cast("int")
        last = F.greatest(F.ceil(end - 1e-9).cast("int") - 1, first)
        return F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("t"), (F.least(end, t + 1.0) - F.greatest(at, t * F.lit(1.0))).alias("w")))

    rows = pixels.select("frame_id", "x", "v", F.explode(parts("y", height, to_height)).alias("r"))
    cells = rows.select("frame_id", "v", "r", F.explode(parts("x", width, to_width)).alias("c"))
    w = F.col("r.w") * F.col("c.w")
    return cells.groupBy("frame_id", F.col("r.t").alias("y"), F.col("c.t").alias("x")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v")), to_width / width


def downscale(pixels: DataFrame, factor: int) -> DataFrame:
    """Area average over factor by factor pixels."""
    y, x = (F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x"))
    return pixels.groupBy("frame_id", y, x).agg(F.avg("v").alias("v"))


def frame_diff(pixels: DataFrame, order: str = "z", by: str = "stack_id") -> DataFrame:
    """|v - v of the frame before|, by pixel; the first frame has none."""
    before = F.lag("v").over(Window.partitionBy(by, "y", "x").orderBy(order))
    return pixels.withColumn("diff", F.abs(F.col("v") - before)).filter("diff IS NOT NULL")


def amplitude_map(motion: DataFrame, by: str = "stack_id", value: str = "diff") -> DataFrame:
    return motion.groupBy(by, "y", "x").agg(F.stddev_pop(value).alias("amplitude"))


def reference_frame(pixels: DataFrame, by: str = "stack_id") -> DataFrame:
    return pixels.groupBy(by, "y", "x").agg(F.median("v").alias("v"))


def motion_by_roi(local: DataFrame, rois: DataFrame, order: str = "z", by: str = "stack_id", value: str = "diff") -> DataFrame:
    """Mean of a local motion (by, order, y, x, value) in each rectangle and frame; 0 in one without a pixel."""
    found = assign_rois(local, rois).groupBy(by, "roi", order).agg(F.avg(value).alias("motion"))
    names = [r["roi"] for r in rois.select("roi").collect()]  # six at most: assign_rois has counted them
    every = local.select(by, order).distinct().withColumn("roi", F.explode(F.array(*map(F.lit, names)))) if names else found.select(by, order, "roi")
    return every.join(found, [by, "roi", order], "left").select(by, "roi", order, F.coalesce("motion", F.lit(0.0)).alias("motion"))


def motion_diff(pixels: DataFrame, rois: DataFrame, order: str = "z", by: str = "stack_id") -> DataFrame:
    """Mean absolute frame difference by ROI and frame."""
    return motion_by_roi(frame_diff(pixels, order, by), rois, order, by)


PROJECTIONS = ("mean", "max", "median", "std", "percentile")


def fuse_project(pixels: DataFrame, projection: str = "mean", percentile: float = 90.0, brightfield: bool = False) -> DataFrame:
    """One frame a stack: stack_id, y, x, v."""
    if projection not in PROJECTIONS:
        raise ValueError(f"projection must be one of {PROJECTIONS}")
    agg = {
        "mean": F.avg("v"), "max": F.max("v").cast("double"), "median": F.median("v"), "std": F.stddev_pop("v"),
        "percentile": F.percentile("v", F.lit(percentile / 100)),
    }[projection]
    out = pixels.groupBy("stack_id", "y", "x").agg(agg.alias("v"), F.first("bit_depth").alias("bit_depth"))
    top = full_scale(F.col("bit_depth"))
    if brightfield:
        lo, hi = _range(["stack_id"])
        out = out.withColumn("v", F.when(hi > lo, (F.col("v") - lo) / (hi - lo) * top).otherwise(F.col("v")))
    return out.withColumn("v", truncated(F.col("v"), top.cast("double")))


def top_n_mean(pixels: DataFrame, n: int, invert: bool = False) -> DataFrame:
    """Mean of the n brightest (or darkest) slices by pixel; ties by z."""
    rank = F.row_number().over(Window.partitionBy("stack_id", "y", "x").orderBy(F.col("v") if invert else F.desc("v"), "z"))
    return pixels.withColumn("_k", rank).filter(F.col("_k") <= n).groupBy("stack_id", "y", "x").agg(F.avg("v").alias("v"))


def histogram(pixels: DataFrame, by: list[str]) -> DataFrame:
    """n by value, and the running count."""
    counts = pixels.groupBy(*by, "v").agg(F.count("*").alias("n"))
    return counts.withColumn("cdf", F.sum("n").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))


def bundle_stacks(frames: DataFrame) -> DataFrame:
    """stack_id and its frames' ids in order of z."""
    return frames.groupBy("stack_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("z", "frame_id"))), lambda s: s["frame_id"]).alias("frame_ids"))
