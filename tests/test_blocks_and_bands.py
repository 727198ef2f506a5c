"""Operators whose work is cut into bands and blocks, against plain versions that see everything at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelframe.operators import register, segment
from pixelframe.operators.groups import group_numbers, whole_groups


def pixels_of(spark, frames, **more):
    """frames: {frame_id: array}, NaN where a pixel is missing."""
    rows = [(f, int(y), int(x), int(a[y, x])) for f, a in frames.items() for y, x in zip(*np.nonzero(~np.isnan(a)), strict=True)]
    df = spark.createDataFrame(rows, "frame_id long, y int, x int, v int")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def plain_shift(f, r, most):
    best = None
    for dy in range(-most, most + 1):
        for dx in range(-most, most + 1):
            a, b = [], []
            for y in range(f.shape[0]):
                for x in range(f.shape[1]):
                    if 0 <= y - dy < r.shape[0] and 0 <= x - dx < r.shape[1] and not np.isnan(f[y, x]) and not np.isnan(r[y - dy, x - dx]):
                        a.append(f[y, x])
                        b.append(r[y - dy, x - dx])
            if len(a) and np.std(a) > 0 and np.std(b) > 0:
                c = round(float(np.corrcoef(a, b)[0, 1]), 9)
                key = (c, -abs(dy) - abs(dx), -dy, -dx)
                if best is None or key > best[0]:
                    best = key, (dy, dx, c)
    return best[1] if best else (0, 0, None)


@pytest.mark.parametrize("band", [128, 4])
def test_shifts_equal_a_search_of_all(spark, band, monkeypatch):
    monkeypatch.setattr(register, "BAND", band)
    r = np.random.default_rng(2)
    ref = r.integers(0, 60000, (13, 11)).astype(float)
    frames = {1: np.roll(ref, (2, -1), (0, 1)), 2: ref[:9, 2:], 3: r.integers(0, 9, (5, 17)).astype(float), 4: np.full((13, 11), 60000.0), 5: ref.copy()}
    frames[5][3:6, 2:9] = np.nan
    p = pixels_of(spark, frames, stack_id=1)
    reference = pixels_of(spark, {0: ref}, stack_id=1).select("stack_id", "y", "x", "v")
    got = {x["frame_id"]: (x["dy"], x["dx"], x["corr"]) for x in register.estimate_shift(p, reference, 3).collect()}
    for k, f in frames.items():
        dy, dx, c = plain_shift(f, ref, 3)
        assert got[k][:2] == (dy, dx) and got[k][2] == (c if c is None else pytest.approx(c, abs=2e-9)), k
    assert register.estimate_shift(p.limit(0), reference, 3).count() == 0


def test_sums_of_bands_equal_those_of_masks():
    import pyarrow as pa

    r = np.random.default_rng(7)
    cells = lambda h, w, top: pa.array([{"y": int(y + top), "x": int(x), "v": float(r.integers(0, 256))} for y in range(h) for x in range(w)])
    f, g = register.Tile(cells(6, 9, 8)), register.Tile(cells(11, 7, 5))
    fast = register.band_sums(f, g, 12)
    f.full = False
    assert np.array_equal(fast, register.band_sums(f, g, 12))


@pytest.mark.parametrize("bins", [256, 65536])
def test_equalization_equals_dense_tables(spark, bins):
    r = np.random.default_rng(3)
    frame = (r.normal(0.4, 0.15, (32, 24)).clip(0, 1) * (bins - 1)).astype(int)
    got = segment.clahe(pixels_of(spark, {1: frame.astype(float)}), 32, 24, 3.0, 4, bins).collect()
    th, tw, clip = 8, 6, max(1, int(3.0 * 48 / bins))
    luts = np.empty((4, 4, bins))
    for i in range(4):
        for j in range(4):
            h = np.bincount(frame[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=bins)
            batch, rest = divmod(int(np.maximum(h - clip, 0).sum()), bins)
            h = np.minimum(h, clip) + batch
            h[: rest * max(bins // max(rest, 1), 1) : max(bins // max(rest, 1), 1)] += 1 if rest else 0
            luts[i, j] = np.minimum(np.rint(np.cumsum(h) * (bins - 1) / 48), bins - 1)
    for x in got:
        fy, fx = x["y"] / th - 0.5, x["x"] / tw - 0.5
        ys, xs = ([min(max(int(np.floor(k)) + d, 0), 3) for d in (0, 1)] for k in (fy, fx))
        a, b, v = fy - np.floor(fy), fx - np.floor(fx), frame[x["y"], x["x"]]
        want = sum(luts[ys[i], xs[j], v] * (a if i else 1 - a) * (b if j else 1 - b) for i in range(2) for j in range(2))
        assert abs(x["v"] - want) <= 0.5 + 1e-6
    assert len(got) == frame.size and len({x["v"] for x in got}) > 100


def test_groups_stay_whole():
    import pyarrow as pa

    r = np.random.default_rng(1)
    keys = np.sort(r.integers(0, 40, 500))
    t = pa.table({"k": pa.array([None if k == 0 else int(k) for k in keys]), "v": r.normal(size=500)})
    cuts = np.sort(r.integers(0, 500, 30))
    batches = [b for a, z in zip([0, *cuts], [*cuts, 500], strict=True) for b in t.slice(a, z - a).combine_chunks().to_batches() or [t.slice(0, 0).to_batches()[0] if t.slice(0, 0).to_batches() else None] if b is not None]
    for size in (1, 400, 10**9):
        out = list(whole_groups(iter(batches), ["k"], size))
        assert [x for p in out for x in p["v"].to_pylist()] == t["v"].to_pylist()
        seen = [set(p["k"].to_pylist()) for p in out]
        assert all(not (a & b) for k, a in enumerate(seen) for b in seen[k + 1 :])
        assert all(group_numbers(p, ["k"])[-1] + 1 == len(s) for p, s in zip(out, seen, strict=True))


@pytest.mark.parametrize(("name", "levels", "top_n", "invert"), [("haar", 2, 1, False), ("db3", 3, 2, False), ("db3", 1, 3, True)])
def test_fusion_of_partials_equals_a_sort(spark, name, levels, top_n, invert, monkeypatch):
    """Slices over several tasks and chunks, one more slice than is kept and one less, ties between equal slices."""
    from pixelframe.operators import wavelet

    monkeypatch.setattr(wavelet, "CHUNK", 50)
    r = np.random.default_rng(9)
    stacks = {s: r.integers(0, 256, (n, 13, 18)).astype(float) for s, n in ((1, 5), (2, top_n), (3, 1))}
    stacks[1][3] = stacks[1][1]
    p = None
    for s, a in stacks.items():
        for z, image in enumerate(a):
            one = pixels_of(spark, {s * 10 + z: image}, stack_id=s, z=z * 7, bit_depth=8)
            p = one if p is None else p.unionByName(one)
    got = {(x["stack_id"], x["y"], x["x"]): x["v"] for x in wavelet.edf_fuse(p.repartition(5), name, levels, top_n, invert).collect()}
    for s, a in stacks.items():
        both = [wavelet.coefficients(image, name, levels) for image in a]
        strength, values = np.stack([b[0] for b in both]), np.stack([b[1] for b in both])
        order = np.argsort(strength if invert else -strength, axis=0, kind="stable")[:top_n]
        mean = np.take_along_axis(values, order[:, None], 0).mean(axis=0)
        want = np.clip(np.round(wavelet.image_of(mean, 13, 18, name, levels), 6), 0, 255).astype(int)
        assert all(got[s, y, x] == want[y, x] for y in range(13) for x in range(18))
        assert np.allclose(wavelet.image_of(both[0][1], 13, 18, name, levels), a[0])
    ends = {x["stack_id"]: (x["min_z"], x["max_z"]) for x in wavelet.edf_z_range(p, name, levels, 9).collect()}
    assert ends == {s: (0, len(a) - 1) for s, a in stacks.items()}
    assert wavelet.edf_fuse(p.limit(0), name, levels).count() == 0


TURNS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def contour_length(points):
    """A walk around the outer contour, keeping the outside on the left."""
    start = min(points)
    at, heading, total, first = start, 6, 0.0, None
    while True:
        for k in range(8):
            turn = (heading + k) % 8
            step = (at[0] + TURNS[turn][0], at[1] + TURNS[turn][1])
            if step in points:
                break
        else:
            return 0.0
        if first is None:
            first = (at, turn)
        elif (at, turn) == first:
            return total
        total += 1.0 if turn % 2 == 0 else 2**0.5
        at, heading = step, (turn + 5) % 8 if turn % 2 else (turn + 6) % 8


def flooded(free, start, steps):
    seen, todo = {start}, [start]
    while todo:
        y, x = todo.pop()
        for dy, dx in steps:
            p = (y + dy, x + dx)
            if p in free and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.fixture(scope="module")
def shapes(spark):
    """Random frames, rings in rings, a line, one pixel, a frame set all over."""
    r = np.random.default_rng(4)
    frames = {k: (r.random((12, 14)) < 0.35 + 0.06 * k).astype(float) for k in range(8)}
    rings = np.zeros((12, 14))
    for k in range(0, 6, 2):
        rings[k : 12 - k, k : 14 - k] = 1
        rings[k + 1 : 11 - k, k + 1 : 13 - k] = 0
    frames |= {20: rings, 21: np.eye(12, 14), 22: np.pad([[1.0]], ((3, 8), (4, 9))), 23: np.ones((12, 14))}
    region = None
    for k, a in frames.items():
        one = pixels_of(spark, {k: np.where(a > 0, 1.0, np.nan)}).drop("v")
        region = one if region is None else region.unionByName(one)
    return frames, region.cache()


def test_perimeters_equal_a_walk(spark, shapes):
    frames, region = shapes
    c = segment.connected_components(region)
    points = {}
    for x in c.collect():
        points.setdefault((x["frame_id"], x["label"]), set()).add((x["y"], x["x"]))
    got = {(x["frame_id"], x["label"]): x["perimeter"] for x in segment.perimeter(c).collect()}
    assert got.keys() == points.keys()
    for key, p in points.items():
        assert got[key] == pytest.approx(contour_length(p)), key
    edges = {}
    for x in segment.boundary(c).collect():
        edges.setdefault((x["frame_id"], x["label"]), set()).add((x["y"], x["x"]))
    for key, p in points.items():
        assert edges[key] == {q for q in p if not all((q[0] + dy, q[1] + dx) in p for dy, dx in TURNS[::2])}
    for x in segment.region_measures(c).collect():
        p = points[x["frame_id"], x["label"]]
        ys, xs = zip(*p, strict=True)
        assert (x["area_pixels"], x["bx"], x["by"], x["width"], x["height"]) == (len(p), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
        assert (x["cx"], x["cy"]) == (int(np.mean(xs)), int(np.mean(ys))) and x["polygon_area"] == len(p) - len(edges[x["frame_id"], x["label"]]) / 2 - 1


def test_holes_are_filled_by_runs(spark, shapes):
    frames, region = shapes
    got = {}
    for x in segment.fill_holes(region, 12, 14).collect():
        got.setdefault(x["frame_id"], []).append((x["y"], x["x"]))
    for k, a in frames.items():
        free = {(y, x) for y in range(-1, 13) for x in range(-1, 15) if not (0 <= y < 12 and 0 <= x < 14 and a[y, x])}
        outside = flooded(free, (-1, -1), TURNS[::2])
        want = [(y, x) for y in range(12) for x in range(14) if (y, x) not in outside]
        assert sorted(got[k]) == want


@pytest.mark.parametrize("lines", [512, 2])
def test_hulls_of_blocks_merge(spark, shapes, lines, monkeypatch):
    monkeypatch.setattr(segment, "HULL_LINES", lines)
    c = segment.connected_components(shapes[1])
    points = {}
    for x in c.collect():
        points.setdefault((x["frame_id"], x["label"]), []).append((x["y"], x["x"]))
    got = {(x["frame_id"], x["label"]): x["hull_area"] for x in segment.convexity(c).collect()}
    assert got == {k: pytest.approx(segment.polygon_area(segment.hull(p))) for k, p in points.items()}


def test_runs_take_the_place_of_pixels(spark, shapes):
    c, runs = segment.connected_components(shapes[1]), segment.connected_runs(shapes[1])
    rows = lambda df: sorted(map(tuple, df.collect()))
    for f in (segment.region_measures, segment.perimeter, segment.hulls, segment.convexity, segment.boundary):
        assert rows(f(runs)) == rows(f(c))
    sizes = segment.region_measures(runs)
    whole = segment.convexity(runs, sizes)
    assert whole.columns == [*sizes.columns, "hull_area", "convexity"]
    assert rows(whole.select("frame_id", "label", "polygon_area", "hull_area", "convexity")) == rows(segment.convexity(c))


def test_contours_and_hulls_broadcast_no_table_of_runs(spark, monkeypatch):
    """Such tables are small on disk and large in memory: by their files' size Spark broadcast them, which filled the driver's heap."""
    plans, written = [], segment.written

    def run(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])

    def spied(df, label):
        run(df)
        return written(df, label)

    monkeypatch.setattr(segment, "written", spied)
    run(entry.queries()["m_contours_and_hulls"](spark, "/root/testdata/sf0.001"))
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]
