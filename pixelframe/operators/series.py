"""Series operators: smoothing with confidence bands, time axes and growth of tracked regions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation


def _by(series: str = "series_id", order: str = "idx"):
    return Window.partitionBy(series).orderBy(order)


def _half(window: int):
    return _by().rowsBetween(-(window // 2), window // 2)


def moving_average(series: DataFrame, window: int) -> DataFrame:
    """`ma`: centred mean over window // 2 points to each side, cut at the ends; null unless 2 <= window <= length."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    return series.withColumn("ma", F.when((n >= window) & F.lit(window >= 2), F.avg("value").over(_half(window))))


def _t_cdf(t: float, df: int) -> float:
    """Student's distribution for integer df, by its finite series."""
    a = math.atan(t / math.sqrt(df))
    c, s = math.cos(a), math.sin(a)
    if df % 2:
        term = total = c if df > 1 else 0.0
        for k in range(3, df - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        return 0.5 + (a + s * total) / math.pi
    term = total = 1.0
    for k in range(2, df, 2):
        term *= c * c * (k - 1) / k
        total += term
    return 0.5 + s * total / 2


def t_quantile(p: float, df: int) -> float:
    """By bisection, for p over one half."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def confidence_band(series: DataFrame, window: int, level: float = 0.95) -> DataFrame:
    """`ma` and `ci`: crit * s / sqrt(n) of the window, Student's quantile under 30 points, else the normal one; 0 for one point."""
    p = 1 - (1 - level) / 2
    crit = F.lit([t_quantile(p, df) for df in range(1, 29)])
    w = _half(window)
    n, s = F.count("value").over(w), F.stddev_samp("value").over(w)
    factor = F.when(n < 30, F.get(crit, (n - 2).cast("int"))).otherwise(NormalDist().inv_cdf(p))
    return moving_average(series, window).withColumn("ci", F.when(n > 1, factor * s / F.sqrt(n)).otherwise(0.0))


def percent_of_initial(series: DataFrame, window: int) -> DataFrame:
    """`pct` of the mean of the first `window` values (the first value for 0); the raw value where that mean is 0."""
    ranked = series.withColumn("_k", F.row_number().over(_by()))
    base = F.avg(F.when(F.col("_k") <= max(window, 1), F.col("value"))).over(Window.partitionBy("series_id"))
    return ranked.withColumn("pct", F.when(base == 0, F.col("value").cast("double")).otherwise(F.col("value") / base * 100)).drop("_k")


def relative_minutes(series: DataFrame, interval_min: float | None = None) -> DataFrame:
    """`minutes` from the first valid stamp, or idx * interval; null without interval and with under two stamps. Rows without stamp go."""
    if interval_min is not None:
        return series.withColumn("minutes", F.col("idx") * F.lit(float(interval_min)))
    w = Window.partitionBy("series_id")
    first = F.first("ts", ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    stamps = F.count("ts").over(w)
    minutes = F.when(stamps >= 2, (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 6e7)
    return series.withColumns({"minutes": minutes, "_n": stamps}).filter((F.col("_n") < 2) | F.col("ts").isNotNull()).drop("_n")


def days_limit(series: DataFrame, days: float) -> DataFrame:
    return series.filter(F.col("minutes") <= days * 1440)


def auto_time_unit(series: DataFrame) -> DataFrame:
    """`unit` by each series' greatest minute (over 2880 days, over 240 hours, else minutes; index without times) and `t` in it."""
    most = F.max("minutes").over(Window.partitionBy("series_id"))
    unit = F.when(most.isNull(), "index").when(most > 2880, "days").when(most > 240, "hours").otherwise("minutes")
    t = F.when(F.col("unit") == "index", F.col("idx").cast("double")).when(F.col("unit") == "days", F.col("minutes") / 1440).when(
        F.col("unit") == "hours", F.col("minutes") / 60
    ).otherwise(F.col("minutes"))
    return series.withColumn("unit", unit).withColumn("t", t)


def extract_times(files: DataFrame, offset: float = 0.0, by: str | None = None) -> DataFrame:
    """files(N, filename, mtime): the first name of each N, and its time from the first N, shifted by `offset` seconds."""
    from ..functions.scalars import format_elapsed

    keys = [by] if by else []
    first = files.groupBy(*keys, "N").agg(F.min(F.struct("filename", "mtime")).alias("f")).select(*keys, "N", "f.filename", "f.mtime")
    micros = F.unix_micros(F.col("mtime").cast("timestamp"))
    if by:
        first = first.join(first.groupBy(by).agg(F.min_by(micros, "N").alias("_start")), by)
    else:
        first = first.withColumn("_start", F.lit(first.agg(F.min_by(micros, "N")).head()[0]).cast("long"))
    elapsed, seconds = (micros - F.col("_start")) / 1e6, micros / 1e6
    return first.select(
        *keys, "N", "filename", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("actual_time"), format_elapsed(elapsed + offset).alias("elapsed_time"),
        F.round(elapsed + offset, 3).alias("elapsed_seconds"), F.round(elapsed, 3).alias("raw_elapsed_seconds"), F.lit(float(offset)).alias("time_offset"), seconds.alias("raw_timestamp"),
    )


def load_tracks(tracks: DataFrame) -> DataFrame:
    """Detected rows only; missing columns raise. (An empty result is the caller's to check: `require_rows`.)"""
    missing = {"timepoint", "area_pixels", "contour_found"} - set(tracks.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return tracks.filter("contour_found")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def growth_rate(tracks: DataFrame, area: str = "area_pixels") -> DataFrame:
    """Percent from one detection to the next; none after an area of 0 or at the same timepoint."""
    w = Window.partitionBy("series_id").orderBy("timepoint")
    before, tp = F.lag(area).over(w), F.lag("timepoint").over(w)
    out = load_tracks(tracks).withColumns({"_a": before, "_t": tp}).filter((F.col("_a") != 0) & (F.col("_t") != F.col("timepoint")))
    return out.select("series_id", "timepoint", ((F.col(area) - F.col("_a")) / F.col("_a") * 100).alias("growth_pct"))


def growth_summary(tracks: DataFrame) -> DataFrame:
    return load_tracks(tracks).groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("timepoint").alias("first_tp"), F.max("timepoint").alias("last_tp"), F.avg("area_pixels").alias("area_mean"),
        F.stddev_samp("area_pixels").alias("area_std"), F.avg("average_darkness").alias("darkness_mean"), F.stddev_samp("average_darkness").alias("darkness_std"),
    )


def area_darkness_corr(tracks: DataFrame) -> DataFrame:
    return load_tracks(tracks).groupBy("series_id").agg(correlation(F.col("area_pixels"), F.col("average_darkness")).alias("corr"))


def summary_lines(tracks: DataFrame) -> DataFrame:
    """The summary as one text line a series."""
    s = growth_summary(tracks)
    return s.select("series_id", F.format_string("timepoints %d (%d - %d), area mean=%.1f std=%.1f, darkness mean=%.2f std=%.2f", "n", "first_tp", "last_tp", "area_mean", "area_std", "darkness_mean", "darkness_std").alias("line"))
