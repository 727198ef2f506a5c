"""Extended depth of field by wavelets: at every level and place the slices with the strongest coefficients are averaged.

A slice is transformed at once, all levels over its array. Of all slices of a stack a task keeps the best few for each
coefficient, an aggregate of bounded size that merges with those of other tasks; it goes out in chunks of coefficients,
so a stack of any number of slices is fused by all tasks and no place's slices are ranked by a sort. The inverse transform has one fused frame a stack.
Half-sample symmetric borders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import group_numbers, sorted_groups, whole_groups

_S = 1 / math.sqrt(2)
# Low-pass decomposition filters.
LOW = {
    "haar": [_S, _S],
    "db3": [0.035226291882100656, -0.08544127388224149, -0.13501102001039084, 0.4598775021193313, 0.8068915093133388, 0.3326705529509569],
}


def filters(wavelet: str) -> tuple[list[float], list[float]]:
    """Low and high pass; the high one is the low one reversed with signs in turn."""
    lo = LOW[wavelet]
    return lo, [(-1) ** (k + 1) * x for k, x in enumerate(reversed(lo))]

#: Coefficients of a chunk.
CHUNK = 1 << 15


def down(x: np.ndarray, f: list[float]) -> np.ndarray:
    """The last axis filtered by `f` and halved."""
    n, size = x.shape[-1], len(f)
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(size - 2, size - 1)], mode="symmetric")
    count = (n + size - 1) // 2
    # Coefficient i has tap k at sample 2 i + 1 - k.
    return sum(f[k] * padded[..., size - 1 - k : size - 1 - k + 2 * count - 1 : 2] for k in range(size))


def up(c: np.ndarray, f: list[float]) -> np.ndarray:
    """The transpose of `down`: twice the length less the filter's overlap."""
    n, size = c.shape[-1], len(f)
    out = np.empty((*c.shape[:-1], 2 * n - size + 2))
    for p in (0, 1):
        m = out[..., p::2].shape[-1]
        out[..., p::2] = sum(f[k] * c[..., (k + p - 1) // 2 : (k + p - 1) // 2 + m] for k in range(1 - p, size, 2))
    return out


def _rows(x: np.ndarray, g, f: list[float]) -> np.ndarray:  # noqa: ANN001
    return g(x.T, f).T


def shapes(height: int, width: int, size: int, levels: int) -> list[tuple[int, int]]:
    out = []
    for _ in range(levels):
        height, width = (height + size - 1) // 2, (width + size - 1) // 2
        out.append((height, width))
    return out


def coefficients(image: np.ndarray, wavelet: str, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Strengths, and values (h, v, d) of all levels' details, then of the approximation (a, 0, 0), as one line."""
    lo, hi = filters(wavelet)
    strength, values, a = [], [], image
    for _ in range(levels):
        low, high = down(a, lo), down(a, hi)
        a, h, v, d = _rows(low, down, lo), _rows(low, down, hi), _rows(high, down, lo), _rows(high, down, hi)
        strength.append(np.sqrt(h * h + v * v).ravel())
        values.append(np.stack([h.ravel(), v.ravel(), d.ravel()]))
    strength.append(np.abs(a).ravel())
    values.append(np.stack([a.ravel(), np.zeros(a.size), np.zeros(a.size)]))
    return np.round(np.concatenate(strength), 9), np.concatenate(values, axis=1)


def image_of(values: np.ndarray, height: int, width: int, wavelet: str, levels: int) -> np.ndarray:
    """The image of one line of coefficients."""
    lo, hi = filters(wavelet)
    parts, at = [], 0
    for h, w in shapes(height, width, len(lo), levels):
        parts.append(values[:, at : at + h * w].reshape(3, h, w))
        at += h * w
    a = values[0, at:].reshape(parts[-1].shape[1:])
    for h, v, d in reversed(parts):
        a = a[: h.shape[0], : h.shape[1]]  # an odd length leaves one sample too many
        a = up(_rows(a, up, lo) + _rows(h, up, hi), lo) + up(_rows(v, up, lo) + _rows(d, up, hi), hi)
    return a[:height, :width]


class Best:
    """For each coefficient the `n` slices of greatest (or, inverted, least) strength, the lower z on ties."""

    def __init__(self, n: int, invert: bool):
        self.n, self.sign, self.key = n, 1.0 if invert else -1.0, None

    def merge(self, key: np.ndarray, z: np.ndarray, values: np.ndarray) -> None:
        """key and z (k, coefficients), values (k, 3, coefficients) of other slices."""
        if self.key is not None:
            key, z, values = np.concatenate((self.key, key)), np.concatenate((self.z, z)), np.concatenate((self.values, values))
        if len(key) > self.n:
            order = np.lexsort((z, key), axis=0)[: self.n]
            key, z, values = np.take_along_axis(key, order, 0), np.take_along_axis(z, order, 0), np.take_along_axis(values, order[:, None], 0)
        self.key, self.z, self.values = key, z, values

    def add(self, strength: np.ndarray, z: int, values: np.ndarray) -> None:
        self.merge(self.sign * strength[None], np.full((1, len(strength)), z, np.int64), values[None])


def _partial(wavelet: str, levels: int, n: int, invert: bool):  # noqa: ANN202
    """Slices, sorted by stack, to the best of each stack's coefficients so far, in chunks."""

    def chunks(stack: pa.Array, best: Best, size: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
        for k in range(0, best.key.shape[1], CHUNK):
            part = [np.ascontiguousarray(x[..., k : k + CHUNK]).tobytes() for x in (best.key, best.z, best.values)]
            columns = [pa.array([x], t) for x, t in zip((k // CHUNK, len(best.key), *size, *part), (*[pa.int32()] * 5, *[pa.binary()] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays([stack, *columns], ["stack_id", "chunk", "slices", "height", "width", "depth", "key", "z", "vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, best, size = None, None, None
        for t in whole_groups(batches, ["stack_id", "z"]):
            group = group_numbers(t, ["stack_id", "z"])
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist()
            y, x, v, z, height, width, depth = (t[c].to_numpy() for c in ("y", "x", "v", "z", "_h", "_w", "bit_depth"))
            for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
                own = t["stack_id"].slice(a, 1).combine_chunks()
                if stack is None or not own.equals(stack):
                    if best:
                        yield from chunks(stack, best, size)
                    stack, best, size = own, Best(n, invert), (int(height[a]), int(width[a]), int(depth[a]))
                image = np.zeros(size[:2])
                image[y[a:b], x[a:b]] = v[a:b]
                best.add(*(lambda s, c: (s, int(z[a]), c))(*coefficients(image, wavelet, levels)))  # noqa: B023
        if best:
            yield from chunks(stack, best, size)

    return run


def best_coefficients(pixels: DataFrame, wavelet: str, levels: int, top_n: int, invert: bool) -> DataFrame:
    """stack_id, chunk, height, width, depth, fused (binary: the chosen slices' mean), lo_z, hi_z of those chosen for the approximation (null in chunks without)."""
    size = pixels.groupBy("stack_id").agg((F.max("y") + 1).cast("int").alias("_h"), (F.max("x") + 1).cast("int").alias("_w"), F.max("bit_depth").cast("int").alias("bit_depth"))
    cells = pixels.select("stack_id", F.col("z").cast("long").alias("z"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    kind = pixels.schema["stack_id"].dataType.simpleString()
    dealt = sorted_groups(cells.join(size, "stack_id"), ["stack_id", "z"])
    partial = dealt.mapInArrow(
        _partial(wavelet, levels, top_n, invert), f"stack_id {kind}, chunk int, slices int, height int, width int, depth int, key binary, z binary, vals binary"
    )

    def fused(t: pa.Table) -> pa.Table:
        # A task that saw fewer slices of the stack than it keeps has fewer entries; together there are as many as there are slices, at most top_n.
        best = Best(top_n, False)
        for n, key, z, values in zip(*(t[c].to_pylist() for c in ("slices", "key", "z", "vals")), strict=True):
            best.merge(np.frombuffer(key).reshape(n, -1), np.frombuffer(z, np.int64).reshape(n, -1), np.frombuffer(values).reshape(n, 3, -1))
        h, w, k = (t[c][0].as_py() for c in ("height", "width", "chunk"))
        details = sum(a * b for a, b in shapes(h, w, len(LOW[wavelet]), levels))
        rest = best.z[:, max(0, details - k * CHUNK) :]
        first = t.slice(0, 1)
        out = {c: first[c] for c in ("stack_id", "chunk", "height", "width", "depth")}
        ends = [int(rest.min()), int(rest.max())] if rest.size else [None, None]
        return pa.table({**out, "fused": pa.array([best.values.mean(axis=0).tobytes()], pa.binary()), "lo_z": pa.array(ends[:1], pa.int64()), "hi_z": pa.array(ends[1:], pa.int64())})

    return partial.groupBy("stack_id", "chunk").applyInArrow(fused, f"stack_id {kind}, chunk int, height int, width int, depth int, fused binary, lo_z long, hi_z long")


def edf_fuse(pixels: DataFrame, wavelet: str = "db3", levels: int = 3, top_n: int = 1, invert: bool = False) -> DataFrame:
    """One sharp frame a stack: stack_id, y, x, v, clipped and truncated to the stack's depth. Missing pixels count as 0."""
    if wavelet not in LOW:
        raise ValueError(f"wavelet must be one of {sorted(LOW)}")
    kind = pixels.schema["stack_id"].dataType.simpleString()

    def inverse(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        h, w, depth = (t[c][0].as_py() for c in ("height", "width", "depth"))
        values = np.concatenate([np.frombuffer(x, np.float64).reshape(3, -1) for x in t["fused"].to_pylist()], axis=1)
        v = np.clip(np.round(image_of(values, h, w, wavelet, levels), 6), 0.0, 65535.0 if depth == 16 else 255.0).astype(np.int32)
        stack = t["stack_id"].combine_chunks().take(pa.array(np.zeros(v.size, np.int64)))
        return pa.table({"stack_id": stack, "y": np.repeat(np.arange(h, dtype=np.int32), w), "x": np.tile(np.arange(w, dtype=np.int32), h), "v": v.ravel()})

    return best_coefficients(pixels, wavelet, levels, top_n, invert).groupBy("stack_id").applyInArrow(inverse, f"stack_id {kind}, y int, x int, v int")


def edf_z_range(pixels: DataFrame, wavelet: str = "db3", levels: int = 3, top_n: int = 1, invert: bool = False) -> DataFrame:
    """stack_id, min_z, max_z: places in the stack, from 0, of the first and the last slice that the fusion's approximation takes."""
    place = F.dense_rank().over(Window.partitionBy("stack_id").orderBy("z")) - 1
    slices = pixels.select("stack_id", F.col("z").cast("long").alias("z")).distinct().select("stack_id", "z", place.alias("k"))
    ends = best_coefficients(pixels, wavelet, levels, top_n, invert).groupBy("stack_id").agg(F.min("lo_z").alias("lo"), F.max("hi_z").alias("hi"))
    used = slices.join(ends, "stack_id").filter((F.col("z") == F.col("lo")) | (F.col("z") == F.col("hi")))
    return used.groupBy("stack_id").agg(F.min("k").alias("min_z"), F.max("k").alias("max_z"))
