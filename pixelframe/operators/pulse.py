"""Pulse-rate analysis of motion series: detrending, spectra, band-pass, pulses and their summary.

Series are rows (series_id, idx, value). Spectra, band-pass and the choice of pulses work on blocks of samples (`blocks`), so that one
series of any length is spread over tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .durable import written


def _series():
    return Window.partitionBy("series_id")


def _order():
    return _series().orderBy("idx")


def with_times(series: DataFrame, fps: float) -> DataFrame:
    return series.withColumn("time_s", (F.col("idx") + 0.5) / fps)


def detrend(series: DataFrame, fps: float, lo_hz: float) -> DataFrame:
    """`baseline` (moving average with reflected ends, odd window of 1.5 slowest periods) and `detrended`."""
    win = max(1, round(1.5 * fps / lo_hz))
    half = (win + 1 - win % 2) // 2
    n = F.max("idx").over(_series())
    sized = series.withColumn("_n", n)
    idx, last = F.col("idx"), F.col("_n")
    mirrored = sized.withColumn(
        "_at", F.explode(F.array_compact(F.array(idx, F.when(idx.between(1, half), -idx), F.when((idx < last) & (idx >= last - half), 2 * last - idx))))
    )
    frame = _series().orderBy("_at").rowsBetween(-half, half)
    out = mirrored.withColumn("baseline", F.avg("value").over(frame)).filter(F.col("_at") == idx)
    return out.withColumn("detrended", F.col("value") - F.col("baseline")).drop("_at", "_n")


def power_spectrum(series: DataFrame, fps: float, value: str = "detrended", max_hz: float | None = None) -> DataFrame:
    """series_id, k, freq, power: Hann-windowed, zero-padded to four times the length (256 at least), up to max_hz."""
    return blocks.spectrum(blocks.cut(series.select("series_id", "idx", value), [value]), value, fps, max_hz)


def dominant_frequency(spectrum: DataFrame, fps: float, lo: float, hi: float) -> DataFrame:
    """f0 (lowest of the strongest in the band; 0 if the band is empty) and snr (power within 15 % of f0 over the band's)."""
    hi = min(hi, fps / 2 * 0.98)
    inside = F.col("freq").between(lo, hi)
    best = F.max_by("freq", F.when(inside, F.struct("power", -F.col("freq")))).over(_series())
    s = spectrum.withColumn("f0", F.when(F.max(inside).over(_series()), best).otherwise(0.0))
    near = F.col("freq").between(F.col("f0") * 0.85, F.col("f0") * 1.15)
    total = F.sum(F.when(inside, F.col("power")))
    snr = F.when(total > 0, F.sum(F.when(near, F.col("power"))) / total).otherwise(0.0)
    return s.groupBy("series_id").agg(F.first("f0").alias("f0"), F.coalesce(snr, F.lit(0.0)).alias("snr"))


def butterworth(lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order band-pass (b, a) for edges as fractions of the Nyquist rate, by the bilinear transform."""
    w = 4 * np.tan(np.pi * np.array([lo, hi]) / 2)
    bw, w0 = w[1] - w[0], math.sqrt(w[0] * w[1])
    p = np.exp(1j * np.pi * np.array([3, 5]) / 4) * bw / 2
    root = np.sqrt(p * p - w0 * w0)
    s = np.concatenate((p + root, p - root))
    gain = (bw * bw * 16 / np.prod(4 - s)).real
    return gain * np.poly([1, 1, -1, -1]), np.poly((4 + s) / (4 - s)).real


def band_filter(fps: float, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray] | None:
    """The band-pass of edges in Hz, or None where they leave no band."""
    lo, hi = max(1e-4, lo / (fps / 2)), min(0.999, hi / (fps / 2))
    return butterworth(lo, hi) if hi > lo else None


def bandpass(series: DataFrame, fps: float, lo: float, hi: float, value: str = "value") -> DataFrame:
    """series_id, idx, wave: `value` between lo and hi Hz, forward and backward, the ends extended oddly by 15 samples.

    The value less its mean where there is no band or a series has 15 samples or fewer.
    """
    parts = blocks.cut(series.select("series_id", "idx", value, F.lit(0.0).alias("by")), [value], [F.col("by")])
    done = blocks.filter_both_ways(parts, value, lambda _: band_filter(fps, lo, hi), "by", "wave")
    return blocks.uncut(done, ["idx", "wave"])


def pulses(series: DataFrame, distance: int, least: float | None = None, value: str = "value", size: int | None = None) -> DataFrame:
    """series_id, idx of the local maxima that are `distance` samples apart, the tallest first, and `least` prominent."""
    extra = [F.col("distance"), F.col("least")]
    parts = blocks.cut(series.select("series_id", "idx", value, F.lit(distance).cast("long").alias("distance"), F.lit(least).cast("double").alias("least")), [value], extra, size)
    return _indices(parts, _chosen(parts, value, least is not None))


def _chosen(parts: DataFrame, value: str, tall: bool) -> DataFrame:
    found = blocks.apart(parts, blocks.maxima(parts, value), value, "distance")
    return blocks.prominent(parts, found, value, "least") if tall else found


def _indices(parts: DataFrame, found: DataFrame) -> DataFrame:
    return found.join(parts.select("series_id", "block", "idx"), ["series_id", "block"]).select(
        "series_id", F.explode(F.transform("at", lambda k: F.get("idx", k.cast("int")))).alias("idx")
    )


def waves(detrended: DataFrame, f0: DataFrame, fps: float, band: tuple[float, float]) -> DataFrame:
    """series_id, idx, value, baseline, detrended, wave, is_peak, is_trough. f0 of 0 stands for the band's middle."""
    f = F.when(F.col("f0") != 0, F.col("f0")).otherwise(sum(band) / 2).alias("f")
    rows = detrended.select("series_id", "idx", "value", "baseline", "detrended").join(f0.select("series_id", f), "series_id")
    parts = blocks.cut(rows, ["value", "baseline", "detrended"], [F.col("f")])
    parts = blocks.filter_both_ways(parts, "detrended", lambda f: band_filter(fps, 0.7 * f, min(1.6 * f, fps / 2 * 0.95)), "f", "wave")
    std = blocks.spread(parts, "wave").select("series_id", "block", (0.5 * F.col("std")).alias("least"))
    distance = F.greatest(F.lit(1.0), F.rint(fps / F.col("f") * 0.6)).cast("long")
    parts = written(parts.join(std, ["series_id", "block"]).withColumns({"distance": distance, "dip": F.transform("wave", lambda x: -x)}), "waves")
    on = ["series_id", "block"]
    peaks = _chosen(parts, "wave", True).withColumnRenamed("at", "up")
    troughs = _chosen(parts, "dip", False).withColumnRenamed("at", "down")
    flags = blocks.flagged(parts.select(*on, F.size("idx").cast("long").alias("n")).join(peaks, on).join(troughs, on), {"up": "is_peak", "down": "is_trough"})
    columns = ["idx", "value", "baseline", "detrended", "wave", "is_peak", "is_trough"]
    return blocks.uncut(parts.join(flags, on), columns).select("series_id", *columns)


def local_maxima(series: DataFrame, value: str = "value") -> DataFrame:
    """series_id, idx of inner local maxima, plateaus at their middle, by gaps and islands."""
    v = F.col(value)
    new = F.coalesce((v != F.lag(value).over(_order())).cast("int"), F.lit(1))
    runs = series.withColumn("_new", new).withColumn("_g", F.sum("_new").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    islands = runs.groupBy("series_id", "_g").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.first(value).alias("v"))
    g = _series().orderBy("_g")
    islands = islands.withColumns({"_p": F.lag("v").over(g), "_q": F.lead("v").over(g)})
    return islands.filter((F.col("_p") < F.col("v")) & (F.col("_q") < F.col("v"))).select("series_id", F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("idx"))


def pulse_intervals(peaks: DataFrame, fps: float) -> DataFrame:
    return peaks.withColumn("interval_s", (F.col("idx") - F.lag("idx").over(_order())) / fps).filter("interval_s IS NOT NULL")


def pulse_rate(peaks: DataFrame, fps: float) -> DataFrame:
    """n_pulses, bpm and the intervals' coefficient of variation; NaN with under two peaks."""
    gaps = peaks.withColumn("interval_s", (F.col("idx") - F.lag("idx").over(_order())) / fps)
    mean, nan = F.avg("interval_s"), F.lit(float("nan"))
    return gaps.groupBy("series_id").agg(
        F.count("*").alias("n_pulses"), F.coalesce(60 / mean, nan).alias("bpm"), F.coalesce(F.stddev_pop("interval_s") / mean, nan).alias("cv")
    )


def nearest_asof(peaks: DataFrame, troughs: DataFrame) -> DataFrame:
    """Each peak's nearest trough by idx, the earlier on ties: series_id, idx, trough."""
    both = peaks.select("series_id", "idx", F.lit(1).alias("_p")).unionByName(troughs.select("series_id", "idx", F.lit(0).alias("_p")))
    at = F.when(F.col("_p") == 0, F.col("idx"))
    order = _series().orderBy("idx", "_p")
    before = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(F.col("_b").isNull() | (F.col("_a") - F.col("idx") < F.col("idx") - F.col("_b")), F.col("_a")).otherwise(F.col("_b"))
    return both.withColumns({"_b": before, "_a": after}).filter("_p = 1").select("series_id", "idx", near.alias("trough"))


def pulsatility_index(detrended: DataFrame) -> DataFrame:
    """(P95 - P5) / mean of the drift-free speed; 0 where the mean is not positive."""
    mean = F.avg("value")
    spread = F.percentile("detrended", F.lit(0.95)) - F.percentile("detrended", F.lit(0.05))
    return detrended.groupBy("series_id").agg(F.when(mean > 0, spread / mean).otherwise(0.0).alias("pulsatility_index"))


def amplitudes(wave: DataFrame) -> DataFrame:
    """rms of the wave, and p2p: the median over peaks of |raw at peak - raw at the nearest trough|; null with under two peaks."""
    rms = wave.groupBy("series_id").agg(F.sqrt(F.avg(F.col("wave") * F.col("wave"))).alias("rms"), F.count_if("is_peak").alias("_n"))
    near = nearest_asof(wave.filter("is_peak"), wave.filter("is_trough"))
    raw = wave.select("series_id", "idx", "value")
    pairs = near.join(raw, ["series_id", "idx"]).join(raw.select("series_id", F.col("idx").alias("trough"), F.col("value").alias("_low")), ["series_id", "trough"])
    p2p = pairs.groupBy("series_id").agg(F.median(F.abs(F.col("value") - F.col("_low"))).alias("_p2p"))
    return rms.join(p2p, "series_id", "left").select("series_id", "rms", F.when(F.col("_n") >= 2, F.col("_p2p")).alias("p2p"))


def analyze_pulsatility(series: DataFrame, fps: float, min_bpm: float = 30.0, max_bpm: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """(summary with a row a series, waveform with a row a sample)."""
    band = (min_bpm / 60, max_bpm / 60)
    flat = detrend(series, fps, band[0])
    f0 = dominant_frequency(power_spectrum(flat, fps, max_hz=1.15 * band[1] + 1), fps, *band)
    wave = waves(flat, f0, fps, band)
    peaks = wave.filter("is_peak").select("series_id", "idx")
    summary = f0.withColumn("bpm_spectral", F.when(F.col("f0") > 0, F.col("f0")).otherwise(sum(band) / 2) * 60)
    for part in (pulse_rate(peaks, fps), pulsatility_index(flat), amplitudes(wave)):
        summary = summary.join(part, "series_id", "left")
    return summary.fillna(0, ["n_pulses"]), with_times(wave, fps)


def roi_waveforms_wide(waveform: DataFrame, rois: list[str]) -> DataFrame:
    return waveform.groupBy("idx", "time_s").pivot("series_id", rois).agg(F.first("wave").alias("wave"), F.first("value").alias("motion"))


def block_motion(pixels: DataFrame, block: int = 16, by: str = "stack_id", order: str = "z") -> DataFrame:
    """speed (pixels a frame) by block and frame: least squares over spatial and temporal differences; 0 where they leave it open.

    Inner pixels only: each needs its four neighbours and its next frame.
    """
    row, col = Window.partitionBy(by, order, "y").orderBy("x"), Window.partitionBy(by, order, "x").orderBy("y")
    time = Window.partitionBy(by, "y", "x").orderBy(order)
    p = pixels.withColumns({"_t": F.lead("v").over(time) - F.col("v")}).withColumns({"_x": (F.lead("v").over(row) - F.lag("v").over(row)) / 2})
    p = p.withColumn("_y", (F.lead("v").over(col) - F.lag("v").over(col)) / 2).filter("_t IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL")
    cell = [F.floor(F.col(c) / block).cast("int").alias(f"block_{c}") for c in ("y", "x")]
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    s = p.groupBy(by, order, *cell).agg(
        product("_x", "_x").alias("a"), product("_x", "_y").alias("b"), product("_y", "_y").alias("c"), product("_x", "_t").alias("e"), product("_y", "_t").alias("f")
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    u, v = (F.col("b") * F.col("f") - F.col("c") * F.col("e")) / det, (F.col("b") * F.col("e") - F.col("a") * F.col("f")) / det
    return s.select(by, order, "block_y", "block_x", F.when(det > 1e-6, F.sqrt(u * u + v * v)).otherwise(0.0).alias("speed"))


def block_motion_by_roi(pixels: DataFrame, rois: DataFrame, block: int = 16, by: str = "stack_id", order: str = "z") -> DataFrame:
    """Mean block speed in each rectangle and frame: every pixel of a block moves as the block does."""
    from .pixels import motion_by_roi

    speeds = block_motion(pixels, block, by, order)
    cell = [F.floor(F.col(c) / block).cast("int").alias(f"block_{c}") for c in ("y", "x")]
    local = pixels.select(by, order, "y", "x", *cell).join(speeds, [by, order, "block_y", "block_x"])
    return motion_by_roi(local, rois, order, by, "speed")
