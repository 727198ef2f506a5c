"""Registration by shifts: the shift of greatest correlation with a reference, whole pixels or refined by parabolas.

Frames and references meet in bands of lines. For every shift a band has six sums over the pixels that both sides have: how many, of
either side's values, of their squares and of products. Products are a circular correlation by FFT; where a band has no gaps
the other sums are differences of a summed-area table, else correlations with the masks. Sums of bands add up to those of the frame,
so a frame of any height is spread over tasks, and neither frames nor references are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a band.
BAND = 128
#: Share of the mean square under which the variance of values that are not whole numbers is rounding.
FLAT = 1e-12


class Tile:
    """Values and mask of the pixels from line `top` on, of a list of (y, x, v)."""

    def __init__(self, cells: pa.Array):
        y, x, v = (np.asarray(cells.field(c)) for c in ("y", "x", "v"))
        self.top = int(y.min())
        shape = (int(y.max()) - self.top + 1, int(x.max()) + 1)
        self.v, self.mask = np.zeros(shape), np.zeros(shape)
        self.v[y - self.top, x], self.mask[y - self.top, x] = v, 1.0
        self.full = bool(self.mask.all())
        self.whole = bool((self.v == np.rint(self.v)).all())
        self.held: dict[tuple, np.ndarray] = {}

    def transform(self, of: str, shape: tuple[int, int]) -> np.ndarray:
        """The spectrum of the values, their squares or the mask; made once."""
        if (of, shape) not in self.held:
            self.held[of, shape] = np.fft.rfft2({"v": self.v, "vv": self.v * self.v, "m": self.mask}[of], shape)
        return self.held[of, shape]

    def table(self, squared: bool) -> np.ndarray:
        """Sums over all rectangles that begin at the corner."""
        if ("table", squared) not in self.held:
            out = np.zeros((self.v.shape[0] + 1, self.v.shape[1] + 1))
            out[1:, 1:] = (self.v * self.v if squared else self.v).cumsum(0).cumsum(1)
            self.held["table", squared] = out
        return self.held["table", squared]


def _rectangles(table: np.ndarray, ya: np.ndarray, yb: np.ndarray, xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """Sums over lines ya to yb (excluded) and columns xa to xb, for all pairs of a line range and a column range."""
    yb, xb = np.maximum(ya, yb), np.maximum(xa, xb)
    return table[np.ix_(yb, xb)] - table[np.ix_(ya, xb)] - table[np.ix_(yb, xa)] + table[np.ix_(ya, xa)]


def band_sums(f: Tile, r: Tile, most: int) -> np.ndarray:
    """Six arrays by dy and dx from -most to most: pixels on both sides, sums of f, r, f f, r r and f r, where f(y, x) meets r(y - dy, x - dx)."""
    shape = (f.v.shape[0] + r.v.shape[0] - 1, f.v.shape[1] + r.v.shape[1] - 1)
    d = np.arange(-most, most + 1)
    at_y, at_x = d - f.top + r.top, d  # shifts of the tiles' own lines
    meets = lambda at, axis: (at > -r.v.shape[axis]) & (at < f.v.shape[axis])
    inside = np.outer(meets(at_y, 0), meets(at_x, 1))  # others would be shifts by a whole turn less

    def product(a: str, b: str) -> np.ndarray:
        every = np.fft.irfft2(f.transform(a, shape) * np.conj(r.transform(b, shape)), shape)
        out = every[np.ix_(at_y % shape[0], at_x % shape[1])] * inside
        return np.rint(out) if f.whole and r.whole else out

    if f.full and r.full:
        (h, w), (rh, rw) = f.v.shape, r.v.shape
        ya, yb, xa, xb = np.clip(at_y, 0, h), np.clip(rh + at_y, 0, h), np.clip(at_x, 0, w), np.clip(rw + at_x, 0, w)
        own = [_rectangles(f.table(k), ya, yb, xa, xb) for k in (False, True)]
        ya, yb, xa, xb = np.clip(-at_y, 0, rh), np.clip(h - at_y, 0, rh), np.clip(-at_x, 0, rw), np.clip(w - at_x, 0, rw)
        other = [_rectangles(r.table(k), ya, yb, xa, xb) for k in (False, True)]
        n = np.outer(np.maximum(yb - ya, 0), np.maximum(xb - xa, 0)).astype(float)
    else:
        n = np.rint(product("m", "m"))
        own, other = [product(k, "m") for k in ("v", "vv")], [product("m", k) for k in ("v", "vv")]
    return np.stack([n, own[0], other[0], own[1], other[1], product("v", "v")])


def best_shift(sums: np.ndarray, whole: bool, subpixel: bool) -> tuple[float, float, float | None]:
    """dy, dx and the correlation, rounded to 9 digits: of equal ones the smallest shift, then the lower dy and dx."""
    n, f, r, ff, rr, fr = sums
    most = n.shape[0] // 2
    vf, vr = n * ff - f * f, n * rr - r * r
    least = 0.0 if whole else FLAT
    known = (n > 0) & (vf > least * n * ff) & (vr > least * n * rr)
    if not known.any():
        return 0.0, 0.0, None
    corr = np.full(n.shape, -np.inf)
    corr[known] = np.round((n * fr - f * r)[known] / (np.sqrt(vf[known]) * np.sqrt(vr[known])), 9)
    dy, dx = np.meshgrid(np.arange(-most, most + 1), np.arange(-most, most + 1), indexing="ij")
    k = np.lexsort((dx.ravel(), dy.ravel(), (np.abs(dy) + np.abs(dx)).ravel(), -corr.ravel()))[0]
    at = np.unravel_index(k, n.shape)

    def refined(axis: int) -> float:
        """The top of the parabola through the best shift and its neighbours."""
        place = at[axis] - most
        if not 0 < at[axis] < 2 * most:
            return float(place)
        before, after = (corr[tuple(at[i] + (step if i == axis else 0) for i in range(2))] for step in (-1, 1))
        bend = before - 2 * corr[at] + after
        return place + (before - after) / (2 * bend) if np.isfinite(bend) and bend < 0 else float(place)

    if subpixel:
        return refined(0), refined(1), float(corr[at])
    return float(dy[at]), float(dx[at]), float(corr[at])


def _summed(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                name = (batch["_key"][k].as_py(), batch["band"][k].as_py())
                if name != of:  # rows of one band of one reference follow one another
                    held, of = Tile(batch["ref"][k].values), name
                f = Tile(batch["cells"][k].values)
                out.append((band_sums(f, held, most).astype("<f8").tobytes(), f.whole and held.whole))
            sums, whole = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch["frame_id"], pa.array(sums, pa.binary()), pa.array(whole, pa.bool_())], ["frame_id", "sums", "whole"])

    return run


def estimate_shift(pixels: DataFrame, reference: DataFrame, max_shift: int, key: str = "stack_id", subpixel: bool = False) -> DataFrame:
    """frame_id, dy, dx, corr: where each frame lies relative to its key's reference (key, y, x, v).

    Of equal correlations the smallest shift wins, then the lower dy and dx; a flat frame has null corr and shift 0. With
    `subpixel` dy and dx are doubles, refined by parabolas. Pixels that are missing on either side do not count.
    """
    cells = F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v")))
    band = lambda y: F.floor(y / BAND).cast("int")
    frames = pixels.groupBy("frame_id", F.col(key).alias("_key"), band(F.col("y")).alias("band")).agg(cells.alias("cells"))
    near = F.explode(F.sequence(band(F.col("y") - max_shift), band(F.col("y") + max_shift))).alias("band")
    references = reference.select(F.col(key).alias("_key"), "y", "x", "v", near).groupBy("_key", "band").agg(cells.alias("ref"))
    kind = pixels.schema["frame_id"].dataType.simpleString()
    met = frames.join(references, ["_key", "band"]).select("_key", "band", "frame_id", "cells", "ref")
    sums = met.mapInArrow(_summed(max_shift), f"frame_id {kind}, sums binary, whole boolean")

    def chosen(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<f8") for x in t["sums"])
        dy, dx, corr = best_shift(total.reshape(6, 2 * max_shift + 1, -1), all(t["whole"].to_pylist()), subpixel)
        return pa.table({"frame_id": t["frame_id"].slice(0, 1), "dy": [dy], "dx": [dx], "corr": pa.array([corr], pa.float64())})

    out = sums.groupBy("frame_id").applyInArrow(chosen, f"frame_id {kind}, dy double, dx double, corr double")
    return out if subpixel else out.select("frame_id", F.col("dy").cast("int").alias("dy"), F.col("dx").cast("int").alias("dx"), "corr")


def apply_shift(pixels: DataFrame, shifts: DataFrame) -> DataFrame:
    """Each frame on the reference's grid; what comes from outside is 0. Fractions of a pixel are blended bilinearly and truncated."""
    full = pixels.select("frame_id", "stack_id", "z", "y", "x", "bit_depth")
    s = shifts.select("frame_id", "dy", "dx")
    if all(s.schema[c].dataType.simpleString() in ("int", "bigint") for c in ("dy", "dx")):
        moved = pixels.join(s, "frame_id").select("frame_id", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), "v")
        return full.join(moved, ["frame_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))

    def parts(c: str, d: str) -> Column:
        """Targets of a source line: the place below and above its shifted one, with weights."""
        at = F.col(c) - F.col(d)
        low = F.floor(at)
        both = F.array(F.struct(low.cast("int").alias("t"), (1 - (at - low)).alias("w")), F.struct((low + 1).cast("int").alias("t"), (at - low).alias("w")))
        return F.explode(F.filter(both, lambda p: p["w"] > 0))

    rows = pixels.join(s, "frame_id").select("frame_id", "v", "x", "dx", parts("y", "dy").alias("a"))
    cells = rows.select("frame_id", "v", "a", parts("x", "dx").alias("b"))
    moved = cells.groupBy("frame_id", F.col("a.t").alias("y"), F.col("b.t").alias("x")).agg(F.sum(F.col("v") * F.col("a.w") * F.col("b.w")).alias("v"))
    return full.join(moved, ["frame_id", "y", "x"], "left").withColumn("v", F.coalesce(F.floor(F.round("v", 6)).cast("int"), F.lit(0)))


def align_stack(pixels: DataFrame, max_shift: int, z: Column | None = None, subpixel: bool = False) -> DataFrame:
    """Every frame of a stack to its first one (or the one at `z`); frames without a correlation stay."""
    first = F.min("z").over(Window.partitionBy("stack_id")) if z is None else z
    reference = pixels.withColumn("_f", first).filter(F.col("z") == F.col("_f")).select("stack_id", "y", "x", "v")
    return apply_shift(pixels, estimate_shift(pixels, reference, max_shift, subpixel=subpixel))


def chain(steps: DataFrame, by: str = "session", order: str = "timepoint") -> DataFrame:
    """Running sums of dy and dx over runs of consecutive timepoints; a gap starts anew with 0."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) != 1).cast("int"), F.lit(1))
    s = steps.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(by, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"sum_{c}": F.sum(F.when(F.col("_new") == 1, 0).otherwise(F.col(c))).over(run) for c in ("dy", "dx")}
    return s.withColumns(sums).drop("_new")


def align_session(
    pixels: DataFrame, base_z: int, max_shift: int, reference: DataFrame | None = None, temporal: bool = True, subpixel: bool = False
) -> DataFrame:
    """Shifts of every frame of a session: session, timepoint, z, frame_id, island, sum_dy, sum_dx; ready for `apply_shift` as dy, dx.

    pixels: session, timepoint, z, y, x, v, frame_id. `temporal`: each base frame is compared with the one before, and translations
    add up over consecutive timepoints. With a `reference` (y, x, v) the first of a run, or without `temporal` every base frame, is
    compared with it. The other slices of a timepoint are compared with its base frame and move with it.
    """
    name = F.concat_ws("/", F.col("session").cast("string"), F.col("timepoint").cast("string"))
    base = pixels.filter(F.col("z") == base_z).withColumn("_k", name)
    zero = F.lit(0.0 if subpixel else 0)
    frames = base.select("session", "timepoint", "frame_id").distinct()
    if temporal:
        before = base.select(F.concat_ws("/", F.col("session").cast("string"), (F.col("timepoint") + 1).cast("string")).alias("_k"), "y", "x", "v")
        steps = estimate_shift(base, before, max_shift, "_k", subpixel)
        placed = chain(frames.join(steps, "frame_id", "left").na.fill(0, ["dy", "dx"])).select("session", "timepoint", "frame_id", "island", "sum_dy", "sum_dx")
    else:
        placed = frames.select("session", "timepoint", "frame_id", F.lit(0).alias("island"), zero.alias("sum_dy"), zero.alias("sum_dx"))
    if reference is not None:
        fixed = reference.select(F.lit(0).alias("_r"), "y", "x", "v")
        first = F.min("timepoint").over(Window.partitionBy("session", "island")) if temporal else F.col("timepoint")
        heads = placed.withColumn("_f", first).filter("timepoint = _f").select("session", "island", "timepoint", "frame_id")
        to_fixed = estimate_shift(base.join(heads.select("frame_id"), "frame_id", "left_semi").withColumn("_r", F.lit(0)), fixed, max_shift, "_r", subpixel)
        on = ["session", "island"] if temporal else ["session", "timepoint"]
        start = heads.join(to_fixed, "frame_id").select(*on, F.col("dy").alias("_dy"), F.col("dx").alias("_dx"))
        placed = placed.join(start, on, "left").withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.coalesce(f"_{c}", zero) for c in ("dy", "dx")}).drop("_dy", "_dx")
    others = pixels.filter(F.col("z") != base_z).withColumn("_k", name)
    slices = estimate_shift(others, base.select("_k", "y", "x", "v"), max_shift, "_k", subpixel)
    rest = others.select("session", "timepoint", "z", "frame_id").distinct().join(slices.drop("corr"), "frame_id", "left")
    at = placed.select("session", "timepoint", "island", "sum_dy", "sum_dx")
    rest = rest.join(at, ["session", "timepoint"]).withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.coalesce(c, zero) for c in ("dy", "dx")})
    columns = ["session", "timepoint", "z", "frame_id", "island", "sum_dy", "sum_dx"]
    return placed.withColumn("z", F.lit(base_z)).select(*columns).unionByName(rest.select(*columns))
