"""Thresholds, morphology, components and region measures.

Binary images are the set pixels alone: `regions` frame_id, y, x. Height and width are given where the
background matters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import written
from .groups import group_numbers, sorted_groups, whole_groups
from .pixels import gaussian_blur, histogram

Offsets = list[tuple[int, int]]
# The 5 by 5 ellipse, by half-widths of its rows.
ELLIPSE5 = [(dy, dx) for dy, half in zip(range(-2, 3), (0, 2, 2, 2, 0)) for dx in range(-half, half + 1)]
SQUARE3 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def disk(r: int) -> Offsets:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def otsu(pixels: DataFrame, adjustment: int = 0) -> DataFrame:
    """frame_id, threshold: the value of greatest between-class variance, the lowest on ties, less the adjustment, at least 0."""
    h = histogram(pixels, ["frame_id"])
    w = Window.partitionBy("frame_id")
    running = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"m": F.sum(F.col("v") * F.col("n")).over(running), "n_all": F.sum("n").over(w), "m_all": F.sum(F.col("v") * F.col("n")).over(w)})
    omega, mu, total = F.col("cdf") / F.col("n_all"), F.col("m") / F.col("n_all"), F.col("m_all") / F.col("n_all")
    var = F.when(F.col("cdf") < F.col("n_all"), F.pow(total * omega - mu, F.lit(2)) / (omega * (1 - omega))).otherwise(0.0)
    best = F.max_by("v", F.struct(F.round(var, 9), -F.col("v")))
    return h.groupBy("frame_id").agg(F.greatest(best - adjustment, F.lit(0)).cast("int").alias("threshold"))


def below(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Set pixels: v <= the frame's threshold."""
    return pixels.join(thresholds, "frame_id").filter(F.col("v") <= F.col("threshold")).select("frame_id", "y", "x")


def manual_threshold(pixels: DataFrame, t: float) -> DataFrame:
    return pixels.filter(F.col("v") <= t).select("frame_id", "y", "x")


def adaptive_threshold(pixels: DataFrame, ksize: int = 11, c: float = 2) -> DataFrame:
    """v <= the Gaussian mean around it less c; borders repeat."""
    mean = gaussian_blur(pixels, ksize, border="clamp").withColumn("mean", F.floor(F.col("v") + 0.5)).drop("v")
    return pixels.join(mean, ["frame_id", "y", "x"]).filter(F.col("v") <= F.col("mean") - c).select("frame_id", "y", "x")


def percentile_masks(pixels: DataFrame, core: float = 90, outer_lo: float = 40, outer_hi: float = 80) -> DataFrame:
    """Pixels with `core` (over its percentile) and `outer` (strictly between two)."""
    p = pixels.groupBy("frame_id").agg(F.percentile("v", F.lit([core / 100, outer_lo / 100, outer_hi / 100])).alias("_p"))
    at = lambda k: F.get("_p", F.lit(k))
    both = pixels.join(p, "frame_id")
    return both.select("frame_id", "y", "x", (F.col("v") > at(0)).alias("core"), ((F.col("v") > at(1)) & (F.col("v") < at(2))).alias("outer"))


def _runs(region: DataFrame) -> DataFrame:
    """frame_id, y, a, b: the maximal runs of set pixels of each line."""
    p = region.select("frame_id", "y", "x").repartition("frame_id")  # one exchange for all that follows by line
    placed = p.withColumn("_g", F.col("x") - F.row_number().over(Window.partitionBy("frame_id", "y").orderBy("x")))
    return placed.groupBy("frame_id", "y", "_g").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("_g")


def _set_pixels(runs: DataFrame) -> DataFrame:
    return runs.select("frame_id", "y", F.explode(F.sequence("a", "b")).alias("x"))


def _rows_of(offsets: Offsets) -> list[tuple[int, int, int]]:
    """(dy, least dx, greatest dx) for each unbroken stretch of a row of offsets."""
    out: list[tuple[int, int, int]] = []
    for dy, dx in sorted(set(offsets)):
        if out and out[-1][0] == dy and out[-1][2] == dx - 1:
            out[-1] = (dy, out[-1][1], dx)
        else:
            out.append((dy, dx, dx))
    return out


def _widened(runs: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    """Runs of the pixels that some offset leads from to a set one: each run once for each row of offsets, those that meet merged."""
    rows = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for dy, lo, hi in _rows_of(offsets))))
    moved = runs.withColumn("o", rows).select(
        "frame_id", (F.col("y") - F.col("o.dy")).alias("y"), F.greatest(F.col("a") - F.col("o.hi"), F.lit(0)).alias("a"),
        F.least(F.col("b") - F.col("o.lo"), F.lit(width - 1)).alias("b"),
    ).filter(F.col("y").between(0, height - 1) & (F.col("a") <= F.col("b")))
    line = Window.partitionBy("frame_id", "y").orderBy("a", "b")
    before = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    parted = moved.repartition("frame_id").withColumn("_new", F.coalesce((F.col("a") > before + 1).cast("int"), F.lit(1)))
    parted = parted.withColumn("_k", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy("frame_id", "y", "_k").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_k")


def _unset(runs: DataFrame, height: int, width: int) -> DataFrame:
    """Runs of the pixels between those of `runs`, in all lines of their frames."""
    lines = runs.select("frame_id").distinct().select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    ends = lines.select("frame_id", "y", F.lit(width).alias("a"), F.lit(width).alias("b"))
    last = F.lag("b").over(Window.partitionBy("frame_id", "y").orderBy("a"))
    gaps = runs.select("frame_id", "y", "a", "b").unionByName(ends).select("frame_id", "y", (F.coalesce(last, F.lit(-1)) + 1).alias("a"), (F.col("a") - 1).alias("b"))
    return gaps.filter("a <= b")


def _narrowed(runs: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    """Runs of the pixels whose offsets inside the frame all lead to set ones: what no widened unset run reaches. A frame that
    is set all over has no unset run and stays."""
    bare = written(_unset(runs, height, width), "unset")
    wide = _widened(bare, offsets, height, width)
    every = runs.select("frame_id").distinct()
    whole = every.join(bare, "frame_id", "left_anti").select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"), F.lit(0).alias("a"), F.lit(width - 1).alias("b"))
    return _unset(wide, height, width).unionByName(whole)


def dilate(region: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    """Pixels that some offset leads to from a set one; outside the frame counts as unset. The work is on runs of lines, one copy a row of offsets."""
    return _set_pixels(_widened(_runs(region), offsets, height, width))


def erode(region: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    """Pixels whose offsets inside the frame all lead to set ones."""
    return _set_pixels(_narrowed(_runs(region), offsets, height, width))


def _chain(region: DataFrame, steps: list, offsets: Offsets, height: int, width: int) -> DataFrame:
    runs = _runs(region)
    for step in steps:
        runs = written(step(runs, offsets, height, width), "runs")
    return _set_pixels(runs)


def open_(region: DataFrame, offsets: Offsets, height: int, width: int, k: int = 1) -> DataFrame:
    return _chain(region, [_narrowed] * k + [_widened] * k, offsets, height, width)


def close_(region: DataFrame, offsets: Offsets, height: int, width: int, k: int = 1) -> DataFrame:
    return _chain(region, [_widened] * k + [_narrowed] * k, offsets, height, width)


def _roots(edges: DataFrame) -> DataFrame:
    """(frame_id, node, root) for edges (frame_id, a, b), by alternating large and small stars until nothing changes."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("frame_id", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = near.join(least.hint("merge"), ["frame_id", "a"])
        if large:
            out = moved.filter("b > a").select("frame_id", F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select("frame_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        return out.filter("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("frame_id", "a", "b"))).head())

    edges = written(edges.filter("a != b").distinct(), "edges")
    now = state(edges)
    while True:
        edges = written(star(star(edges, True), False), "stars")
        now, before = state(edges), now
        if now == before:
            return edges.select("frame_id", F.col("a").alias("node"), F.col("b").alias("root"))


#: Runs of a frame up to which it is labelled in one task; frames of more go by stars over all tasks.
FRAME_RUNS = 500_000


def _labelled(reach: int):  # noqa: ANN202
    """Runs (frame_id, node, y, a, b) of whole frames, sorted by line and place, with their component's least node."""

    def labels(line: list[int], a: list[int], b: list[int], node: list[int]) -> list[int]:
        root = list(range(len(node)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        above = 0  # the first run of the line above that may still touch
        for k in range(len(node)):
            while above < k and (line[above] < line[k] - 1 or line[above] == line[k] - 1 and b[above] + reach < a[k]):
                above += 1
            i = above
            while i < k and line[i] == line[k] - 1 and a[i] <= b[k] + reach:
                p, q = top(i), top(k)
                root[max(p, q)] = min(p, q)  # runs are in order of their first pixel, so the least index is the least node
                i += 1
        return [node[top(k)] for k in range(len(node))]

    def run(batches):  # noqa: ANN001, ANN202
        for t in whole_groups(batches, ["frame_id"]):
            y, a, b, node = (t[c].to_numpy() for c in ("y", "a", "b", "node"))
            line = y.astype(np.int64) + group_numbers(t, ["frame_id"]).astype(np.int64) * (int(y.max()) - int(y.min()) + 2)  # no line of a frame is next to one of another
            found = labels(line.tolist(), a.tolist(), b.tolist(), node.tolist())
            yield from t.drop_columns(["node"]).append_column("label", pa.array(found, pa.int64())).to_batches()

    return run


def labelled_runs(runs: DataFrame, connectivity: int = 8) -> DataFrame:
    """frame_id, y, a, b, label of runs (frame_id, y, a, b): the row-major place of the first pixel of the run's component.

    No component leaves its frame, so a frame of up to FRAME_RUNS runs is labelled in one task; in larger ones runs of neighbouring rows
    that touch are the edges of a graph.
    """
    line = 1 << 24  # wider than any frame
    runs = written(runs.select("frame_id", "y", "a", "b", (F.col("y").cast("long") * line + F.col("a")).alias("node")), "runs")
    reach = 1 if connectivity == 8 else 0
    large = written(runs.groupBy("frame_id").count().filter(F.col("count") > FRAME_RUNS).select("frame_id"), "large")
    none = large.isEmpty()
    small = runs if none else runs.join(large, "frame_id", "left_anti")
    schema = runs.drop("node").schema.add("label", "long")
    labels = sorted_groups(small.select("frame_id", "y", "a", "b", "node"), ["frame_id"], ["y", "a"]).mapInArrow(_labelled(reach), schema)
    if not none:
        some = runs.join(large, "frame_id", "left_semi")
        below = some.select("frame_id", (F.col("y") - 1).alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("node2"))
        touch = some.join(below.hint("merge"), ["frame_id", "y"]).filter((F.col("a2") <= F.col("b") + reach) & (F.col("b2") >= F.col("a") - reach))
        roots = _roots(touch.select("frame_id", F.col("node").alias("a"), F.col("node2").alias("b")))
        of_large = some.join(roots.hint("merge"), ["frame_id", "node"], "left").select("frame_id", "y", "a", "b", F.coalesce("root", "node").alias("label"))
        labels = labels.unionByName(of_large)
    return labels


def connected_runs(region: DataFrame, connectivity: int = 8) -> DataFrame:
    """frame_id, y, a, b, label: the runs of `connected_components` as a table, which measures, perimeters and hulls take in place of its pixels."""
    return written(labelled_runs(_runs(region), connectivity), "components")


def connected_components(region: DataFrame, connectivity: int = 8) -> DataFrame:
    """frame_id, y, x, label: the row-major place of the component's first pixel."""
    found = labelled_runs(_runs(region), connectivity)
    return found.select("frame_id", "y", F.explode(F.sequence("a", "b")).alias("x"), "label")


def remove_small(region: DataFrame, k: int, connectivity: int = 4) -> DataFrame:
    c = connected_components(region, connectivity)
    big = c.groupBy("frame_id", "label").count().filter(F.col("count") >= k)
    return c.join(big, ["frame_id", "label"], "left_semi").select("frame_id", "y", "x")


def grid(frames: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of every frame_id of `frames`."""
    return frames.select("frame_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )


def fill_holes(region: DataFrame, height: int, width: int) -> DataFrame:
    """With the 4-connected background parts that do not reach the frame's edge. The background is the runs between those of the region."""
    runs = _runs(region)
    back = written(labelled_runs(_unset(runs, height, width), 4), "background")
    edge = F.max(F.col("y").isin(0, height - 1) | (F.col("a") == 0) | (F.col("b") == width - 1))
    holes = back.groupBy("frame_id", "label").agg(edge.alias("e")).filter(~F.col("e"))
    return _set_pixels(runs.unionByName(back.join(holes, ["frame_id", "label"], "left_semi").select("frame_id", "y", "a", "b")))


def largest_component(components: DataFrame, min_area: int = 1000) -> DataFrame:
    """The largest component's pixels, the first label on ties; none under min_area."""
    sizes = components.groupBy("frame_id", "label").agg(F.count("*").alias("n"))
    best = sizes.groupBy("frame_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("n"))
    return components.join(best.filter(F.col("n") >= min_area).select("frame_id", "label"), ["frame_id", "label"], "left_semi")


def containing_component(components: DataFrame, core: DataFrame) -> DataFrame:
    """The component at the truncated centroid of each frame's core."""
    at = core.groupBy("frame_id").agg(F.avg("y").cast("int").alias("y"), F.avg("x").cast("int").alias("x"))
    hit = components.join(at, ["frame_id", "y", "x"]).select("frame_id", "label")
    return components.join(hit, ["frame_id", "label"], "left_semi")


def component_runs(components: DataFrame) -> DataFrame:
    """frame_id, label, y, a, b: the maximal runs of each component's lines, as a table; components that are such runs stay as they are."""
    if {"a", "b"} <= set(components.columns):
        return components.select("frame_id", "label", "y", "a", "b")
    p = components.select("frame_id", "label", "y", "x").repartition("frame_id")
    placed = p.withColumn("_g", F.col("x") - F.row_number().over(Window.partitionBy("frame_id", "label", "y").orderBy("x")))
    return written(placed.groupBy("frame_id", "label", "y", "_g").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("_g"), "component_runs")


def boundary_runs(runs: DataFrame, corners: bool = False) -> DataFrame:
    """Runs of the pixels with a 4-neighbour (with `corners` an 8-neighbour) outside their component: a run less what lies between runs above and below it.

    Tables of runs take some two bytes a row on disk, which says little of what a broadcast would hold; joins of them are told to merge.
    """
    keys, reach = ["frame_id", "label", "y"], int(corners)

    def beside(step: int, lo: str, hi: str) -> DataFrame:
        """The parts of each run that a run of the next line on one side covers."""
        other = runs.select("frame_id", "label", (F.col("y") + step).alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        met = runs.join(other.hint("merge"), keys)
        return met.select(*keys, "a", "b", F.greatest("a", F.col("a2") + reach).alias(lo), F.least("b", F.col("b2") - reach).alias(hi)).filter(F.col(lo) <= F.col(hi))

    both = beside(1, "lo1", "hi1").join(beside(-1, "lo2", "hi2").drop("b").hint("merge"), [*keys, "a"])
    inner = both.select(*keys, "a", "b", F.greatest("lo1", "lo2", F.col("a") + 1).alias("lo"), F.least("hi1", "hi2", F.col("b") - 1).alias("hi")).filter("lo <= hi")
    ends = runs.select(*keys, "a", "b", (F.col("b") + 1).alias("lo"), (F.col("b") + 1).alias("hi"))
    last = F.lag("hi").over(Window.partitionBy(*keys, "a").orderBy("lo"))
    return inner.unionByName(ends).select(*keys, (F.coalesce(last, F.col("a") - 1) + 1).alias("_a"), (F.col("lo") - 1).alias("b")).filter("_a <= b").withColumnRenamed("_a", "a")


def boundary(components: DataFrame) -> DataFrame:
    """Pixels with a 4-neighbour outside their component."""
    edge = boundary_runs(component_runs(components))
    return edge.select("frame_id", "y", F.explode(F.sequence("a", "b")).alias("x"), "label")


def region_measures(components: DataFrame) -> DataFrame:
    """Area (pixels), bounding box, aspect ratio, truncated centroid and polygon area by Pick's formula."""
    runs = component_runs(components)
    n = F.col("b") - F.col("a") + 1
    size = F.sum(n.cast("long"))
    b = boundary_runs(runs).groupBy("frame_id", "label").agg(size.alias("border"))
    m = runs.groupBy("frame_id", "label").agg(
        size.alias("area_pixels"), F.min("a").alias("bx"), F.min("y").alias("by"), (F.max("b") - F.min("a") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        (F.sum((F.col("a") + F.col("b")).cast("long") * n) / 2 / size).cast("int").alias("cx"), (F.sum(F.col("y").cast("long") * n) / size).cast("int").alias("cy"),
    )
    m = m.join(b.hint("merge"), ["frame_id", "label"])
    return m.withColumns({"aspect_ratio": F.col("width") / F.col("height"), "polygon_area": F.col("area_pixels") - F.col("border") / 2 - 1})


def with_physical_units(regions: DataFrame, px: Column) -> DataFrame:
    """area_um2: 0 where the pixel size is unknown or the area 0."""
    return regions.withColumn("area_um2", F.when((px > 0) & (F.col("area_pixels") > 0), F.col("area_pixels") * px * px).otherwise(0.0))


def darkness_stats(pixels: DataFrame, region: DataFrame) -> DataFrame:
    """Of 255 - v and of v over each frame's region, for every frame; zeros where it has none."""
    inside = pixels.join(region.select("frame_id", "y", "x"), ["frame_id", "y", "x"], "left_semi").withColumn("d", 255 - F.col("v"))
    stats = inside.groupBy("frame_id").agg(
        F.sum("d").cast("double").alias("total_darkness"), F.avg("d").alias("average_darkness"), F.min("d").cast("double").alias("min_darkness"),
        F.max("d").cast("double").alias("max_darkness"), F.avg("v").alias("raw_mean"), F.min("v").cast("double").alias("raw_min"), F.max("v").cast("double").alias("raw_max"),
    )
    return pixels.select("frame_id").distinct().join(stats.withColumn("contour_found", F.lit(True)), "frame_id", "left").na.fill(0.0).na.fill(False)


def core_outer_stats(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Areas, intensity sums and fractions of `core` and `outer` pixels of masks(frame_id, y, x, core, outer)."""
    p = pixels.join(masks, ["frame_id", "y", "x"])
    part = lambda c: F.sum(F.when(F.col(c), F.col("v")).otherwise(0))
    out = p.groupBy("frame_id").agg(
        part("core").alias("core_sum"), part("outer").alias("outer_sum"), F.sum("v").alias("total_sum"), F.count_if("core").alias("core_area"),
        F.count_if("outer").alias("outer_area"), F.count("*").alias("total_pixels"),
    )
    whole = F.when(F.col("total_sum") == 0, 1).otherwise(F.col("total_sum"))
    return out.withColumns({f"{n}_area_fraction": F.col(f"{n}_area") / F.col("total_pixels") for n in ("core", "outer")}).withColumns(
        {f"{n}_intensity_fraction": F.col(f"{n}_sum") / whole for n in ("core", "outer")}
    )


def clahe(pixels: DataFrame, height: int, width: int, clip_limit: float = 2.0, tiles: int = 8, bins: int = 256, channel: str | None = None) -> DataFrame:
    """frame_id, y, x, v: equalized by tile with clipped histograms, look-up tables blended bilinearly.

    Tables hold the values that occur in a tile, whatever `bins` (up to 2**20) is. A task has the lines between two rows of tile
    centres with the tables of both rows. Sizes that are no multiples of `tiles` are mirrored on the right and at the bottom for the histograms. With a channel (red, green
    or blue) that field of `rgb` is equalized, and the result has frame_id, y, x, rgb.
    """
    if channel is not None:
        if "rgb" not in pixels.columns:
            raise ValueError("a channel needs an rgb column")
        c = {"red": "r", "green": "g", "blue": "b"}[channel]
        even = clahe(pixels.withColumn("v", F.col("rgb")[c]), height, width, clip_limit, tiles, bins)
        both = pixels.select("frame_id", "y", "x", "rgb").join(even, ["frame_id", "y", "x"])
        return both.select("frame_id", "y", "x", F.struct(*(F.col("v" if n == c else f"rgb.{n}").cast("int").alias(n) for n in "rgb")).alias("rgb"))
    whole = height % tiles == 0 and width % tiles == 0
    full_h, full_w = (height, width) if whole else (height + tiles - height % tiles, width + tiles - width % tiles)
    th, tw = full_h // tiles, full_w // tiles
    area = th * tw
    clip = max(1, int(clip_limit * area / bins))

    def mirrored(c: str, size: int, full: int) -> Column:
        """The place itself and, near the far edge, its mirror image beyond it."""
        twin = 2 * (size - 1) - F.col(c)
        return F.explode(F.array_compact(F.array(F.col(c), F.when((twin >= size) & (twin < full), twin))))

    placed = pixels.select("frame_id", "y", "x", "v").repartition("frame_id")
    padded = placed if whole else placed.select("frame_id", "v", "x", mirrored("y", height, full_h).alias("y")).select("frame_id", "v", "y", mirrored("x", width, full_w).alias("x"))
    tile = lambda c, size: F.floor(F.col(c) / size).cast("int")
    counts = padded.groupBy("frame_id", tile("y", th).alias("ty"), tile("x", tw).alias("tx"), "v").agg(F.count("*").alias("n"))
    # Between two rows of tile centres lies a band of lines, which meets the tables of both rows, the outer bands one of them twice.
    roles = F.array_compact(
        F.array(
            F.struct(F.col("ty").alias("band"), F.lit(1).alias("side")), F.struct((F.col("ty") + 1).alias("band"), F.lit(0).alias("side")),
            F.when(F.col("ty") == 0, F.struct(F.lit(0).alias("band"), F.lit(0).alias("side"))), F.when(F.col("ty") == tiles - 1, F.struct(F.lit(tiles).alias("band"), F.lit(1).alias("side"))),
        )
    )
    none = F.lit(None).cast("int")
    tables = counts.withColumn("o", F.explode(roles)).select("frame_id", "o.band", "o.side", "tx", F.col("v").cast("int").alias("v"), F.col("n").cast("long").alias("n"), none.alias("y"), none.alias("x"))
    lines = placed.select(
        "frame_id", F.least(F.floor(F.col("y") / th - 0.5) + 1, F.lit(tiles)).cast("int").alias("band"), F.lit(2).alias("side"), F.lit(0).alias("tx"), F.col("v").cast("int").alias("v"),
        F.lit(0).cast("long").alias("n"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
    )
    kind = pixels.schema["frame_id"].dataType.simpleString()
    dealt = sorted_groups(tables.unionByName(lines), ["frame_id", "band"], ["side", "tx", "v"])
    return dealt.mapInArrow(_equalized(th, tw, tiles, bins, clip), f"frame_id {kind}, y int, x int, v int")


def _equalized(th: int, tw: int, tiles: int, bins: int, clip: int):  # noqa: ANN202
    """Pixels (side 2) by the tables of the tiles above (side 0) and below (side 1) them: counts of the values that occur, in order."""

    def levels(keys: np.ndarray, running: np.ndarray, excess: np.ndarray, code: np.ndarray, v: np.ndarray) -> np.ndarray:
        """What each tile makes of each value: the clipped count of values up to it, by binary search, and its share of what was clipped."""
        at = np.searchsorted(keys, code << 20 | v, "right") - 1
        own = (at >= 0) & (keys[at] >> 20 == code)
        batch, rest = np.divmod(excess[code], bins)
        step = np.maximum(bins // np.maximum(rest, 1), 1)
        extra = np.where(rest > 0, np.minimum(v // step + 1, rest), 0)
        return np.minimum(np.rint((np.where(own, running[at], 0) + batch * (v + 1) + extra) * (bins - 1) / (th * tw)), bins - 1.0)

    def run(batches):  # noqa: ANN001, ANN202
        for t in whole_groups(batches, ["frame_id", "band"]):
            group, side, tx, v, n = group_numbers(t, ["frame_id", "band"]), *(t[c].to_numpy() for c in ("side", "tx", "v", "n"))
            at = side < 2
            code = (group[at] * 2 + side[at]) * tiles + tx[at]
            keys = code.astype(np.int64) << 20 | v[at]
            clipped = np.minimum(n[at], clip)
            total = np.cumsum(clipped)
            heads = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))[: len(code)]
            running = total - np.repeat((total - clipped)[heads], np.diff(np.concatenate((heads, [len(code)]))))
            excess = np.zeros((int(group[-1]) + 1) * 2 * tiles, np.int64)
            np.add.at(excess, code, np.maximum(n[at] - clip, 0))
            px = t.filter(pa.array(~at))
            y, x, w, g = px["y"].to_numpy(), px["x"].to_numpy(), px["v"].to_numpy().astype(np.int64), group[~at].astype(np.int64)
            fy, fx = y / th - 0.5, x / tw - 0.5
            ya, xa = fy - np.floor(fy), fx - np.floor(fx)
            left, right = (np.clip(np.floor(fx) + k, 0, tiles - 1).astype(np.int64) for k in (0, 1))
            row = lambda s: sum(levels(keys, running, excess, (g * 2 + s) * tiles + c, w) * share for c, share in ((left, 1 - xa), (right, xa)))  # noqa: B023, E731
            out = np.rint(np.round(row(0) * (1 - ya) + row(1) * ya, 6)).astype(np.int32)
            yield from pa.table({"frame_id": px["frame_id"], "y": px["y"], "x": px["x"], "v": pa.array(out)}).to_batches()

    return run


def _surroundings(runs: DataFrame) -> DataFrame:
    """Background runs (frame_id, y, a, b, label) of each frame's bounding box and a ring of one pixel around it, by 4-connected part."""
    box = runs.groupBy("frame_id").agg(F.min("a").alias("x0"), F.max("b").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    lines = box.select("frame_id", F.explode(F.sequence(F.col("y0") - 1, F.col("y1") + 1)).alias("y"), F.explode(F.array(F.col("x0") - 2, F.col("x1") + 2)).alias("a"))
    both = runs.select("frame_id", "y", "a", "b").unionByName(lines.withColumn("b", F.col("a")))
    last = F.lag("b").over(Window.partitionBy("frame_id", "y").orderBy("a"))  # none before the left end of a line
    gaps = both.select("frame_id", "y", (last + 1).alias("_a"), (F.col("a") - 1).alias("b")).filter("_a <= b").withColumnRenamed("_a", "a")
    return labelled_runs(gaps, 4)


def perimeter(components: DataFrame) -> DataFrame:
    """frame_id, label, perimeter: the length of the outer contour of 8-connected components, 1 for a straight step, root 2 for a diagonal one.

    Steps are told by the pixels of 2 by 2 squares: two side by side, the contour passes between them and the empty two; three, it
    cuts the corner before the empty one; two across, it passes on the side of each empty one. Only empty pixels of the background part
    that surrounds the component count, not those of its holes.
    """
    runs = component_runs(components)
    back = written(_surroundings(runs), "background")
    edge = boundary_runs(runs, corners=True).select("frame_id", "label", "y", F.explode(F.sequence("a", "b")).alias("x"))
    corner = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 << (2 * dy + dx)).alias("bit")) for dy in (0, 1) for dx in (0, 1))))
    squares = edge.withColumn("o", corner).groupBy("frame_id", "label", (F.col("y") - F.col("o.dy")).alias("qy"), (F.col("x") - F.col("o.dx")).alias("qx")).agg(F.sum("o.bit").alias("set"))
    # For each pattern of set pixels (bit 2 dy + dx): places of empty pixels to ask for, and the step that each stands for.
    straight, diagonal = 1.0, 2**0.5
    patterns = [(3, 1, 0, straight), (12, 0, 0, straight), (5, 0, 1, straight), (10, 0, 0, straight)]
    patterns += [(15 - (1 << (2 * dy + dx)), dy, dx, diagonal) for dy in (0, 1) for dx in (0, 1)]
    patterns += [(6, 0, 0, diagonal), (6, 1, 1, diagonal), (9, 0, 1, diagonal), (9, 1, 0, diagonal)]
    table = F.create_map(
        *(
            x
            for bits in sorted({p[0] for p in patterns})
            for x in (F.lit(bits).cast("long"), F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(length).alias("length")) for b, dy, dx, length in patterns if b == bits)))
        )
    )
    steps = squares.withColumn("p", F.explode(F.element_at(table, F.col("set")))).select(
        "frame_id", "label", (F.col("qy") + F.col("p.dy")).alias("y"), (F.col("qx") + F.col("p.dx")).alias("x"), "p.length"
    )
    # The pixel above a component's first one belongs to what surrounds it.
    first = runs.select("frame_id", "label", "y", "a").groupBy("frame_id", "label").agg(F.min(F.struct("y", "a")).alias("f"))
    asked = steps.unionByName(first.select("frame_id", "label", (F.col("f.y") - 1).alias("y"), F.col("f.a").alias("x"), F.lit(None).cast("double").alias("length")))
    part = back.select("frame_id", "y", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("label").alias("part"))
    found = asked.join(part.hint("merge"), ["frame_id", "y"]).filter(F.col("x").between(F.col("_a"), F.col("_b")))
    lengths = found.groupBy("frame_id", "label", "part").agg(F.count_if(F.col("length") == straight).alias("s"), F.count_if(F.col("length") > straight).alias("d"), F.count_if(F.col("length").isNull()).alias("outer"))
    return lengths.filter("outer > 0").select("frame_id", "label", (F.col("s") + F.lit(diagonal) * F.col("d")).alias("perimeter"))


def with_circularity(regions: DataFrame, perimeters: DataFrame, px: Column) -> DataFrame:
    """perimeter, perimeter_um and 4 pi A / P**2 by the polygon area; 0 without perimeter."""
    joined = regions.join(perimeters.hint("merge"), ["frame_id", "label"])
    round_ = F.when(F.col("perimeter") > 0, 4 * F.pi() * F.col("polygon_area") / F.pow("perimeter", F.lit(2))).otherwise(0.0)
    return joined.withColumns({"perimeter_um": F.when(px > 0, F.col("perimeter") * px).otherwise(0.0), "circularity": round_})


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, by monotone chains."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(order: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def polygon_area(corners: list[tuple[int, int]]) -> float:
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(corners, corners[1:] + corners[:1], strict=True))) / 2


#: Lines whose ends make one partial hull.
HULL_LINES = 512


def _hulls_of(t: pa.Table, keys: list[str]) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """First row and hull's corners of each group of points."""
    group, points = group_numbers(t, keys), list(zip(t["y"].to_pylist(), t["x"].to_pylist(), strict=True))
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist()
    return starts, [hull(points[a:b]) for a, b in zip(starts, [*starts[1:], len(points)], strict=True)]


def _corners(keys: list[str]):  # noqa: ANN202
    """Points to the corners of each group's hull."""

    def run(batches):  # noqa: ANN001, ANN202
        for t in whole_groups(batches, keys):
            starts, found = _hulls_of(t, keys)
            heads = t.select(["frame_id", "label", "part"]).take(pa.array([a for a, f in zip(starts, found, strict=True) for _ in f], pa.int64()))
            y, x = (pa.array([p[k] for f in found for p in f], pa.int32()) for k in (0, 1))
            yield from heads.append_column("y", y).append_column("x", x).to_batches()

    return run


def _areas(keys: list[str]):  # noqa: ANN202
    """Points to the area of each group's hull."""

    def run(batches):  # noqa: ANN001, ANN202
        for t in whole_groups(batches, keys):
            starts, found = _hulls_of(t, keys)
            yield from t.select(keys).take(pa.array(starts, pa.int64())).append_column("hull_area", pa.array([float(polygon_area(f)) for f in found], pa.float64())).to_batches()

    return run


def _hull_schema(components: DataFrame) -> str:
    return f"frame_id {components.schema['frame_id'].dataType.simpleString()}, label long, part int, y int, x int"


def _partial_hulls(components: DataFrame) -> DataFrame:
    """Corners of the hulls of blocks of lines, a component's together and sorted: a hull's corners are those of its parts."""
    lo, hi = ("a", "b") if {"a", "b"} <= set(components.columns) else ("x", "x")
    ends = components.groupBy("frame_id", "label", "y").agg(F.min(lo).alias("a"), F.max(hi).alias("b"))
    points = ends.select("frame_id", "label", F.floor(F.col("y") / HULL_LINES).cast("int").alias("part"), "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))
    whole = points.select("frame_id", "label", "part", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    keys = ["frame_id", "label", "part"]
    return sorted_groups(sorted_groups(whole, keys).mapInArrow(_corners(keys), _hull_schema(components)), keys[:2])


def hulls(components: DataFrame) -> DataFrame:
    """frame_id, label, y, x of the corners of each component's convex hull."""
    return _partial_hulls(components).mapInArrow(_corners(["frame_id", "label"]), _hull_schema(components)).drop("part")


def convexity(components: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """frame_id, label, polygon_area, hull_area (of pixel centres), convexity; 1 where the hull has no area. With `regions`, all of their columns."""
    sizes = region_measures(components).select("frame_id", "label", "polygon_area") if regions is None else regions
    kind = components.schema["frame_id"].dataType.simpleString()
    areas = _partial_hulls(components).mapInArrow(_areas(["frame_id", "label"]), f"frame_id {kind}, label long, hull_area double")
    ratio = F.when(F.col("hull_area") > 0, F.col("polygon_area") / F.col("hull_area")).otherwise(1.0)
    return sizes.join(areas.hint("merge"), ["frame_id", "label"]).withColumn("convexity", ratio)


def hull_fallback(components: DataFrame, least: float = 0.75, growth: float = 0.3) -> DataFrame:
    """Components under `least` convexity whose hull adds less than `growth` are replaced by it: frame_id, y, x, label."""
    loose = convexity(components).filter((F.col("convexity") < least) & (F.col("hull_area") < (1 + growth) * F.col("polygon_area")))
    corners_of = hulls(components.join(loose, ["frame_id", "label"], "left_semi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = hull(list(zip(pdf.y.tolist(), pdf.x.tolist(), strict=True)))
        rows = []
        for y in range(int(pdf.y.min()), int(pdf.y.max()) + 1):
            xs = []
            for (y0, x0), (y1, x1) in zip(corners, corners[1:] + corners[:1], strict=True):
                if min(y0, y1) <= y <= max(y0, y1):
                    xs += [x0, x1] if y0 == y1 else [x0 + (x1 - x0) * (y - y0) / (y1 - y0)]
            rows.append((y, int(-(-min(xs) // 1)), int(max(xs) // 1)))
        out = pd.DataFrame(rows, columns=["y", "a", "b"])
        return out.assign(frame_id=pdf.frame_id.iloc[0], label=pdf.label.iloc[0])[["frame_id", "label", "y", "a", "b"]]

    kind = components.schema["frame_id"].dataType.simpleString()
    filled = corners_of.groupBy("frame_id", "label").applyInPandas(run, f"frame_id {kind}, label long, y int, a int, b int")
    cells = filled.select("frame_id", "y", F.explode(F.sequence("a", "b")).alias("x"), "label")
    rest = components.join(loose, ["frame_id", "label"], "left_anti").select("frame_id", "y", "x", "label")
    return rest.unionByName(cells)
