"""Recursive steps over series of any length: series are cut into blocks of samples, and what a block does to the state that
enters it is small and merges with that of its neighbours.

A linear filter maps the state at a block's start to that at its end by an affine map: a power of one matrix, which the number of samples
tells, and the state that the block's samples make of nothing. These maps are composed over a series' blocks, after which
all blocks are filtered at once. Peaks and their distances and prominences are settled inside blocks as far as a block's samples
decide them; only what a border leaves open goes on, to the summaries of the series' other blocks.

Blocks are rows: series_id, block, idx (array), and arrays of values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import written

#: Samples of a block: a range of idx.
BLOCK = 1 << 16
#: Samples that the ends are extended by, oddly.
ENDS = 15


def cut(series: DataFrame, values: list[str], extra: list[Column] = [], size: int | None = None) -> DataFrame:  # noqa: B006
    """Blocks of `series` (series_id, idx, values as doubles) in the order of idx, with the columns `extra`, which are one value a series."""
    block = F.floor(F.col("idx") / (size or BLOCK)).cast("long").alias("block")
    cells = F.sort_array(F.collect_list(F.struct("idx", *(F.col(v).cast("double").alias(v) for v in values))))
    packed = series.groupBy("series_id", block).agg(cells.alias("_c"), *(F.first(e).alias(f"_e{k}") for k, e in enumerate(extra)))
    names = [series.select(e).columns[0] for e in extra]
    fields = [F.col(f"_c.{v}").alias(v) for v in ("idx", *values)]
    return written(packed.select("series_id", "block", *fields, *(F.col(f"_e{k}").alias(n) for k, n in enumerate(names))), "blocks")


def uncut(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """The samples of blocks again: series_id and the elements of `columns`."""
    return blocks.select("series_id", F.inline(F.arrays_zip(*columns)))


def _array(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    return np.asarray(batch[column][k].values)


def _rows(blocks: DataFrame, f: Callable, schema: str) -> DataFrame:
    """`f(batch, k)` gives a dict for each block; `schema` without the series and the block, which stay."""
    kind = blocks.schema["series_id"].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = f(batch, k)
                yield pa.RecordBatch.from_arrays([batch["series_id"].slice(k, 1), batch["block"].slice(k, 1), *(pa.array([got[n]], t) for n, t in zip(names, types, strict=True))], ["series_id", "block", *names])

    return blocks.mapInArrow(run, f"series_id {kind}, block long, {schema}")


def _scanned(summaries: DataFrame, f: Callable, schema: str) -> DataFrame:
    """`f(columns of a series' blocks in order)` gives lists for each block: the one step that sees a whole series, as one small row a block."""
    kind = summaries.schema["series_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        got = f({c: t[c].to_pylist() for c in t.column_names if c != "series_id"})
        return pa.table({"series_id": t["series_id"], "block": t["block"], **got})

    return written(summaries.groupBy("series_id").applyInArrow(run, f"series_id {kind}, block long, {schema}"), "scan")


def step_matrix(a: np.ndarray) -> np.ndarray:
    """What a sample of 0 makes of the state (direct form II, transposed)."""
    n = len(a) - 1
    m = np.zeros((n, n))
    m[:, 0] = -a[1:]
    m[np.arange(n - 1), np.arange(1, n)] = 1.0
    return m


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter's output for samples x from state z, and its last state: stretches of about the root of len(x) samples side by side."""
    n = len(x)
    if not n:
        return np.empty(0), z
    size = max(1, math.isqrt(n))
    rows = -(-n // size)
    padded = np.zeros(rows * size)
    padded[:n] = x
    wide = padded.reshape(rows, size)

    def along(state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        for k in range(size):
            v = wide[:, k]
            y = b[0] * v + state[:, 0]
            state = np.concatenate((state[:, 1:], np.zeros((rows, 1))), axis=1) + np.outer(v, b[1:]) - np.outer(y, a[1:])
            if out is not None:
                out[:, k] = y
        return state

    made = along(np.zeros((rows, len(a) - 1)))
    power = np.linalg.matrix_power(step_matrix(a), size)
    starts = np.empty((rows, len(a) - 1))
    for k in range(rows):
        starts[k] = z
        z = power @ z + made[k]
    out = np.empty((rows, size))
    along(starts, out)
    last = n - (rows - 1) * size  # the last stretch may be padded: its state is taken at its last sample
    z = starts[-1]
    for v in wide[-1, :last].tolist():
        y = b[0] * v + z[0]
        z = np.append(z[1:], 0.0) + b[1:] * v - a[1:] * y
    return out.ravel()[:n], z


def start_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which an input of ones gives a steady output."""
    return np.linalg.solve(np.eye(len(a) - 1) - step_matrix(a), b[1:] - a[1:] * b[0])


def filter_both_ways(blocks: DataFrame, value: str, design: Callable[[float], tuple[np.ndarray, np.ndarray] | None], by: str, out: str) -> DataFrame:
    """`blocks` with `out`: `value` filtered forward and backward, the ends extended oddly by ENDS samples.

    `design(by)` gives (b, a) for the series' value of `by`, or None where there is no filter: then, and in series of ENDS samples
    or fewer, `out` is the value less the series' mean.
    """
    zero = np.zeros(4)

    def forward_summary(batch: pa.RecordBatch, k: int) -> dict:
        x, ba = _array(batch, value, k), design(batch[by][k].as_py())
        state = filtered(*ba, x, zero)[1] if ba else zero
        return {"n": len(x), "total": float(x.sum()), "head": x[: ENDS + 1].tolist(), "tail": x[-ENDS - 1 :].tolist(), "state": state.tolist(), by: batch[by][k].as_py()}

    def forward_scan(t: dict) -> dict:
        ba, n = design(t[by][0]), sum(t["n"])
        nothing = {"plain": [True] * len(t["n"]), "mean": [sum(t["total"]) / n] * len(t["n"]), "start": [zero.tolist()] * len(t["n"]), "end": [zero.tolist()] * len(t["n"])}
        if not ba or n <= ENDS:
            return _typed(nothing)
        b, a = ba
        head, tail = _first(t["head"]), _first([x[::-1] for x in t["tail"][::-1]])[::-1]
        left, right = 2 * head[0] - head[:0:-1], 2 * tail[-1] - tail[-2::-1]
        z = filtered(b, a, left, start_state(b, a) * left[0])[1]
        starts = []
        for m, state in zip(t["n"], t["state"], strict=True):
            starts.append(z.tolist())
            z = np.linalg.matrix_power(step_matrix(a), m) @ z + np.array(state)
        y = filtered(b, a, right, z)[0]
        back = filtered(b, a, y[::-1], start_state(b, a) * y[-1])[1]
        return _typed({**nothing, "plain": [False] * len(starts), "start": starts, "end": [back.tolist()] * len(starts)})

    def _first(parts: list) -> np.ndarray:
        """The series' first samples: of a short block all, then its neighbour's."""
        got: list = []
        for p in parts:
            got += list(p)
            if len(got) > ENDS:
                break
        return np.array(got[: ENDS + 1])

    def _typed(d: dict) -> dict:
        kinds = {"plain": pa.bool_(), "mean": pa.float64(), "start": pa.list_(pa.float64()), "end": pa.list_(pa.float64())}
        return {c: pa.array(v, kinds[c]) for c, v in d.items()}

    def forward(batch: pa.RecordBatch, k: int) -> dict:
        x = _array(batch, value, k)
        if batch["plain"][k].as_py():
            return {"y": (x - batch["mean"][k].as_py()).tolist(), "state": zero.tolist()}
        b, a = design(batch[by][k].as_py())
        y = filtered(b, a, x, _array(batch, "start", k))[0]
        return {"y": y.tolist(), "state": filtered(b, a, y[::-1], zero)[1].tolist()}

    def backward_scan(t: dict) -> dict:
        if t["plain"][0]:
            return {"start": pa.array([zero.tolist()] * len(t["plain"]), pa.list_(pa.float64()))}
        a, z, starts = design(t[by][0])[1], np.array(t["end"][0]), []
        for m, state in zip(t["n"][::-1], t["state"][::-1], strict=True):
            starts.append(z.tolist())
            z = np.linalg.matrix_power(step_matrix(a), m) @ z + np.array(state)
        return {"start": pa.array(starts[::-1], pa.list_(pa.float64()))}

    def backward(batch: pa.RecordBatch, k: int) -> dict:
        y = _array(batch, "y", k)
        if not batch["plain"][k].as_py():
            b, a = design(batch[by][k].as_py())
            y = filtered(b, a, y[::-1], _array(batch, "start", k))[0][::-1]
        return {out: y.tolist()}

    on = ["series_id", "block"]
    first = _rows(blocks, forward_summary, f"n long, total double, head array<double>, tail array<double>, state array<double>, {by} double")
    scan = _scanned(first, forward_scan, "plain boolean, mean double, start array<double>, end array<double>")
    ahead = written(_rows(blocks.select(*on, value, by).join(scan, on), forward, "y array<double>, state array<double>"), "forward")
    both = ahead.join(scan.select(*on, "plain", "end"), on).join(blocks.select(*on, by, F.size(value).cast("long").alias("n")), on)
    back = _scanned(both.select(*on, "n", "state", "plain", "end", by), backward_scan, "start array<double>")
    done = _rows(both.select(*on, "y", "plain", by).join(back, on), backward, f"{out} array<double>")
    return written(blocks.join(done, on), "filtered")


def spread(blocks: DataFrame, value: str) -> DataFrame:
    """series_id, block, before (samples in earlier blocks), n, mean and std of the whole series."""

    def own(batch: pa.RecordBatch, k: int) -> dict:
        x = _array(batch, value, k)
        return {"size": len(x), "own": float(x.mean()), "square": float(((x - x.mean()) ** 2).sum())}

    def merged(t: dict) -> dict:
        n, mean, square, before = 0, 0.0, 0.0, []
        for m, own, sq in zip(t["size"], t["own"], t["square"], strict=True):
            before.append(n)
            gap, n = own - mean, n + m
            mean += gap * m / n
            square += sq + gap * gap * m * (n - m) / n
        k = len(before)
        return {"before": pa.array(before, pa.int64()), "n": pa.array([n] * k, pa.int64()), "mean": pa.array([mean] * k, pa.float64()), "std": pa.array([math.sqrt(square / n)] * k, pa.float64())}

    return _scanned(_rows(blocks.select("series_id", "block", value), own, "size long, own double, square double"), merged, "before long, n long, mean double, std double")


#: Points of one transform.
POINTS = 1 << 16


def transform_size(n: int) -> int:
    """Four times the samples at least, a power of two, 256 at least."""
    return 1 << math.ceil(math.log2(max(4 * n, 256)))


def spectrum(blocks: DataFrame, value: str, fps: float, max_hz: float | None = None, points: int | None = None) -> DataFrame:
    """series_id, k, freq, power of the series less its mean, Hann-windowed and padded with zeros to `transform_size`.

    A transform of more than `points` points goes in two steps: samples of one remainder by their place are transformed together,
    turned, and dealt anew by frequency for the transforms across remainders. No task has more than `points` points of a series.
    """
    points = points or POINTS
    kind = blocks.schema["series_id"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, n, before, mean = _array(batch, value, k), *(batch[c][k].as_py() for c in ("n", "before", "mean"))
                place = before + np.arange(len(x))
                window = np.ones(1) if n == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * place / (n - 1))
                v, parts = (x - mean) * window, max(1, transform_size(n) // points)
                rest = range(min(parts, len(x)))
                first = [int(place[r] % parts) for r in rest]
                columns = [pa.array(first, pa.int64()), pa.array([n] * len(first), pa.int64()), pa.array([int(place[r] // parts) for r in rest], pa.int64()), pa.array([v[r::parts] for r in rest], pa.list_(pa.float64()))]
                series = batch["series_id"].take(pa.array([k] * len(first), pa.int64()))
                yield pa.RecordBatch.from_arrays([series, *columns], ["series_id", "part", "n", "at", "v"])

    def first(t: pa.Table) -> pa.Table:
        n, part = t["n"][0].as_py(), t["part"][0].as_py()
        size = transform_size(n)
        parts = max(1, size // points)
        x = np.zeros(size // parts)
        for at, v in zip(t["at"].to_pylist(), t["v"], strict=True):
            v = np.asarray(v.values)
            x[at : at + len(v)] = v
        y = np.fft.fft(x) * np.exp(-2j * np.pi * part * np.arange(len(x)) / size)
        step = max(1, points // parts)
        cuts = range(0, len(y), step)
        series = t["series_id"].combine_chunks().take(pa.array(np.zeros(len(cuts), np.int64)))
        return pa.table({"series_id": series, "stretch": pa.array([k // step for k in cuts], pa.int64()), "part": pa.array([part] * len(cuts), pa.int64()), "n": pa.array([n] * len(cuts), pa.int64()), "y": pa.array([y[k : k + step].tobytes() for k in cuts], pa.binary())})

    def second(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        n, stretch = t["n"][0].as_py(), t["stretch"][0].as_py()
        size = transform_size(n)
        parts = max(1, size // points)
        held = np.frombuffer(b"".join(t["y"].to_pylist()), complex).reshape(t.num_rows, -1)
        rows = np.zeros((parts, held.shape[1]), complex)
        rows[t["part"].to_numpy()] = held  # a short series has no samples of some remainders
        every = np.fft.fft(rows, axis=0)
        low = stretch * max(1, points // parts) + np.arange(rows.shape[1])
        k = (low[None, :] + (size // parts) * np.arange(parts)[:, None]).ravel()
        top = size // 2 if max_hz is None else min(size // 2, math.ceil(size * max_hz / fps))
        keep = np.flatnonzero(k <= top)
        power = np.abs(every.ravel()[keep]) ** 2
        series = t["series_id"].combine_chunks().take(pa.array(np.zeros(len(keep), np.int64)))
        return pa.table({"series_id": series, "k": pa.array(k[keep], pa.int32()), "freq": pa.array(k[keep] * fps / size, pa.float64()), "power": pa.array(power, pa.float64())})

    known = blocks.select("series_id", "block", value).join(spread(blocks, value), ["series_id", "block"])
    parts = known.mapInArrow(dealt, f"series_id {kind}, part long, n long, at long, v array<double>")
    turned = parts.groupBy("series_id", "part").applyInArrow(first, f"series_id {kind}, stretch long, part long, n long, y binary")
    return turned.groupBy("series_id", "stretch").applyInArrow(second, f"series_id {kind}, k int, freq double, power double")


# --- peaks

def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of equal values."""
    a = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return a, np.concatenate((a[1:], [len(x)])) - 1


def maxima(blocks: DataFrame, value: str) -> DataFrame:
    """series_id, block, at (array<long>): places in the block of the series' inner local maxima; a plateau counts at its middle, whatever blocks it spans.

    Places count samples, so that a plateau over missing idx is none longer.
    """
    on = ["series_id", "block"]

    def own(batch: pa.RecordBatch, k: int) -> dict:
        x = _array(batch, value, k)
        a, b = runs_of(x)
        v = x[a]
        inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
        ends = [float(v[0]), float(v[-1]), float(v[1]) if len(v) > 1 else math.nan, float(v[-2]) if len(v) > 1 else math.nan]
        return {"at": ((a[inner] + b[inner]) // 2).tolist(), "n": len(x), "runs": len(a), "ends": ends, "lens": [int(b[0] - a[0] + 1), int(b[-1] - a[-1] + 1)]}

    def borders(t: dict) -> dict:
        """Runs at borders, merged: [value, first place, last place] in the whole series, with a stand-in for the runs between."""
        line, base = [], 0
        for n, runs, ends, lens in zip(t["n"], t["runs"], t["ends"], t["lens"], strict=True):
            parts = [(ends[0], base, base + lens[0] - 1)]
            if runs > 1:
                if runs > 2:
                    parts += [(ends[2], None, None), (ends[3], None, None)]
                parts.append((ends[1], base + n - lens[1], base + n - 1))
            for p in parts:
                if line and line[-1][0] == p[0] and p[1] is not None and line[-1][2] is not None and line[-1][2] == p[1] - 1:
                    line[-1] = (p[0], line[-1][1], p[2])
                else:
                    line.append(p)
            base += n
        tops = [(p[1] + p[2]) // 2 for o, p, q in zip(line, line[1:], line[2:], strict=False) if p[1] is not None and o[0] < p[0] > q[0]]
        out, base = [], 0
        for n in t["n"]:
            out.append([m - base for m in tops if base <= m < base + n])
            base += n
        return {"more": pa.array(out, pa.list_(pa.int64()))}

    found = written(_rows(blocks.select(*on, value), own, "at array<long>, n long, runs long, ends array<double>, lens array<long>"), "maxima")
    more = _scanned(found.drop("at"), borders, "more array<long>")
    return written(found.join(more, on).select(*on, F.array_sort(F.concat("at", "more")).alias("at")), "maxima")


def settled(place: np.ndarray, height: np.ndarray, distance: int, low: float = -math.inf, high: float = math.inf, state: np.ndarray | None = None) -> np.ndarray:
    """1 kept, -1 dropped, 0 open, for peaks in order of place: the tallest first (the later of equal ones), each drops what is closer than `distance`.

    Peaks that others outside [low, high] may drop stay open, and so does what depends on them.
    """
    state = np.zeros(len(place), np.int8) if state is None else state
    for k in np.lexsort((np.arange(len(place)), height))[::-1].tolist():
        if state[k]:
            continue
        near = np.arange(np.searchsorted(place, place[k] - distance, "right"), np.searchsorted(place, place[k] + distance, "left"))
        above = near[(height[near] > height[k]) | ((height[near] == height[k]) & (near > k))]
        if (state[above] == 1).any():
            state[k] = -1
        elif (state[above] == 0).any() or place[k] - distance < low or place[k] + distance > high:
            continue
        else:
            state[k] = 1
    return state


def apart(blocks: DataFrame, peaks: DataFrame, value: str, distance: str) -> DataFrame:
    """`peaks` (series_id, block, at) less those that a taller kept one within fewer than `distance` samples drops.

    A block decides what its samples can; what peaks beyond its borders could change goes to one step a series, with the kept ones near it.
    """
    on = ["series_id", "block"]

    def own(batch: pa.RecordBatch, k: int) -> dict:
        x, at, d = _array(batch, value, k), _array(batch, "at", k), int(batch[distance][k].as_py())
        state = settled(at, x[at], d, -1, len(x))
        undecided = at[state == 0]
        near = np.searchsorted(undecided, at + d, "left") > np.searchsorted(undecided, at - d, "right")
        edge = (at < d) | (at > len(x) - 1 - d)  # may decide a neighbour's
        send = np.flatnonzero((state == 0) | ((state == 1) & (near | edge)))
        return {"kept": at[state == 1].tolist(), "places": at[send].tolist(), "heights": x[at[send]].tolist(), "states": state[send].astype(int).tolist(), "n": len(x), distance: d}

    def rest(t: dict) -> dict:
        base = np.cumsum([0, *t["n"]])
        place = np.concatenate([np.array(p, np.int64) + b for p, b in zip(t["places"], base, strict=False)])
        height, state = np.concatenate([np.array(h, float) for h in t["heights"]]), np.concatenate([np.array(s, np.int8) for s in t["states"]])
        undecided = state == 0
        state = settled(place, height, int(t[distance][0]), state=state)
        out = [place[undecided & (state == 1) & (place >= a) & (place < b)] - a for a, b in zip(base, base[1:], strict=False)]
        return {"more": pa.array([o.tolist() for o in out], pa.list_(pa.int64()))}

    here = peaks.join(blocks.select(*on, value, distance), on)
    found = written(_rows(here, own, f"kept array<long>, places array<long>, heights array<double>, states array<long>, n long, {distance} long"), "apart")
    more = _scanned(found.drop("kept"), rest, "more array<long>")
    return written(found.join(more, on).select(*on, F.array_sort(F.concat("kept", "more")).alias("at")), "apart")


def sides(x: np.ndarray, at: np.ndarray, height: np.ndarray, least: float) -> np.ndarray:
    """Going on from place `at` (excluded): 1 where a sample lower by `least` comes before a higher one, -1 the other way round, 0 where neither comes."""
    out = np.zeros(len(at), np.int8)
    for k, (p, h) in enumerate(zip(at.tolist(), height.tolist(), strict=True)):
        size = 64
        while p + 1 < len(x) and not out[k]:
            part = x[p + 1 : p + 1 + size]
            hit = np.flatnonzero((part > h) | (h - part >= least))
            if len(hit):
                out[k] = -1 if part[hit[0]] > h else 1
            p, size = p + size, size * 2
    return out


def prominent(blocks: DataFrame, peaks: DataFrame, value: str, least: str) -> DataFrame:
    """`peaks` whose prominence is `least` or more: on both sides a sample lower by that much comes before a higher one.

    A side that its block leaves open is looked for by the extremes of the series' other blocks, and then inside the one block that they name.
    """
    on = ["series_id", "block"]

    def own(batch: pa.RecordBatch, k: int) -> dict:
        x, at, m = _array(batch, value, k), _array(batch, "at", k), batch[least][k].as_py()
        right, left = sides(x, at, x[at], m), sides(x[::-1], len(x) - 1 - at, x[at], m)
        alive = (right >= 0) & (left >= 0)
        sure = alive & (right > 0) & (left > 0)
        due = alive & ~sure
        # Peaks at a series' end need no lower sample there: `base` is then the peak's own height, and only least <= 0 would do.
        return {"kept": at[sure].tolist(), "due": at[due].tolist(), "heights": x[at[due]].tolist(), "rights": right[due].astype(int).tolist(), "lefts": left[due].astype(int).tolist(), "top": float(x.max()), "low": float(x.min()), least: m}

    def named(t: dict) -> dict:
        """For each open side the block that decides it, or -1 if the block's extremes do or none is left."""
        blocks_, tops, lows, m = t["block"], t["top"], t["low"], t[least][0]
        rights, lefts = [], []
        for k, heights in enumerate(t["heights"]):
            r, s = [], []
            for h, right, left in zip(heights, t["rights"][k], t["lefts"][k], strict=True):
                for out, done, order in ((r, right, range(k + 1, len(tops))), (s, left, range(k - 1, -1, -1))):
                    answer = -1 if done else -2  # -1: a lower sample comes first; -2: none does
                    if not done:
                        for j in order:
                            higher, lower = tops[j] > h, h - lows[j] >= m
                            if higher or lower:
                                answer = blocks_[j] if higher and lower else -1 if lower else -2
                                break
                    out.append(answer)
            rights.append(r)
            lefts.append(s)
        return {"rights": pa.array(rights, pa.list_(pa.int64())), "lefts": pa.array(lefts, pa.list_(pa.int64()))}

    here = peaks.join(blocks.select(*on, value, least), on)
    found = written(_rows(here, own, f"kept array<long>, due array<long>, heights array<double>, rights array<long>, lefts array<long>, top double, low double, {least} double"), "prominent")
    every = _rows(blocks.select(*on, value), lambda b, k: {"top": float(_array(b, value, k).max()), "low": float(_array(b, value, k).min())}, "top double, low double")
    named_ = _scanned(every.join(found.select(*on, "due", "heights", "rights", "lefts", least), on), named, "rights array<long>, lefts array<long>")
    zipped = F.inline(F.arrays_zip("due", "heights", "rights", "lefts"))
    open_ = found.select(*on, "due", "heights").join(named_, on).select(*on, zipped).filter("rights != -2 AND lefts != -2")
    asked = written(open_.select(*on, "due", "heights", F.posexplode(F.array("rights", "lefts")).alias("side", "target")), "sides")

    def look(batch: pa.RecordBatch, k: int) -> dict:
        x, m = _array(batch, value, k), batch[least][k].as_py()
        h = _array(batch, "heights", k)
        ahead, back = (sides(v, np.full(len(h), -1), h, m) for v in (x, x[::-1]))
        good = np.where(_array(batch, "sides", k) == 0, ahead, back) > 0
        return {"peak_block": _array(batch, "blocks", k).tolist(), "due": _array(batch, "dues", k).tolist(), "good": good.tolist()}

    inside = asked.filter("target >= 0").groupBy("series_id", F.col("target").alias("block")).agg(
        *(F.collect_list(c).alias(n) for c, n in ((F.col("heights"), "heights"), (F.col("side"), "sides"), (F.col("block"), "blocks"), (F.col("due"), "dues")))
    )
    looked = _rows(inside.join(blocks.select(*on, value, least), on), look, "peak_block array<long>, due array<long>, good array<boolean>")
    answers = looked.select("series_id", F.inline(F.arrays_zip("peak_block", "due", "good"))).select("series_id", F.col("peak_block").alias("block"), "due", "good")
    answers = answers.unionByName(asked.filter("target = -1").select(*on, "due", F.lit(True).alias("good")))
    good = answers.groupBy(*on, "due").agg(F.count_if("good").alias("n")).filter("n = 2").groupBy(*on).agg(F.collect_list("due").alias("more"))
    return found.join(good, on, "left").select(*on, F.array_sort(F.concat("kept", F.coalesce("more", F.array().cast("array<bigint>")))).alias("at"))


def flagged(blocks: DataFrame, names: dict[str, str]) -> DataFrame:
    """series_id, block and, for each column of places, an array of its `n` samples' flags under the new name."""

    def own(batch: pa.RecordBatch, k: int) -> dict:
        out = {}
        for places, name in names.items():
            flags = np.zeros(batch["n"][k].as_py(), bool)
            flags[_array(batch, places, k)] = True
            out[name] = flags.tolist()
        return out

    return _rows(blocks, own, ", ".join(f"{n} array<boolean>" for n in names.values()))
