"""Keys and names held in file names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _group(name: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def _number(name: Column, pattern: str, group: int = 1) -> Column:
    return _group(name, pattern, group).try_cast("int")


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def key_timepoint_raw(name: Column) -> Column:
    """N of `{N}_zs...`; null for other names."""
    return _number(name, r"^(\d+)_zs.*")


def key_xy(name: Column) -> Column:
    """struct x, y of `{x}_{y}.png`, y signed; null fields for other names."""
    pattern = r"^(\d+)_(-?\d+)\.png$"
    return F.struct(_number(name, pattern).alias("x"), _number(name, pattern, 2).alias("y"))


def key_index(name: Column) -> Column:
    """N of the last `_N_` in the name of a TIFF file."""
    return _number(name, r"(?i).*_(\d+)_.*\.tiff?$")


# Patterns of a timepoint, tried in this order on the stem.
TIMEPOINT_PATTERNS = (r"_(\d+)$", r"(?i)t(\d+)", r"(?i)timepoint[_\s]*(\d+)", r"(?i)tp(\d+)", r"(\d+)_", r"(\d+)")


def key_timepoint(name: Column) -> Column:
    """The first of TIMEPOINT_PATTERNS that fits the stem, else 0."""
    s = stem(name)
    return F.coalesce(*(_number(s, p) for p in TIMEPOINT_PATTERNS), F.lit(0))


def key_prefix(name: Column) -> Column:
    """Text before the first `_`, else the stem."""
    return F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).otherwise(stem(name))


def key_stack(name: Column) -> Column:
    return _number(name, r"(?i)stack_(\d+)\.tiff?$")


def key_by_pattern(name: Column, pattern: str) -> Column:
    """First group of a pattern anywhere in the name; null where it does not fit, 0 if the pattern has no group."""
    if not re.compile(pattern).groups:
        return F.when(name.rlike(pattern), F.lit(0))
    return _number(name, pattern)


def files_by_pattern(files: DataFrame, pattern: str, name_col: str = "filename") -> DataFrame:
    """The files whose name the pattern fits, with its number as `key`; the others are left out."""
    return files.withColumn("key", key_by_pattern(F.col(name_col), pattern)).filter("key IS NOT NULL")


def subset_z(frames: DataFrame, lo: int, hi: int, step: int, name_col: str = "filename") -> DataFrame:
    """Files `..._zs+{i}.png` with i from lo to hi by step."""
    z = _number(F.col(name_col), r"_zs\+(\d+)\.png$")
    return frames.filter(z.between(lo, hi) & ((z - lo) % step == 0))


def offset_timepoints(frames: DataFrame, offset: int, name_col: str = "filename") -> DataFrame:
    """`{N}_zs...` renamed to `{N + offset}_zs...`; other names stay."""
    n = key_timepoint_raw(F.col(name_col))
    moved = F.concat((n + offset).cast("string"), F.regexp_extract(F.col(name_col), r"^\d+(_zs.*)", 1))
    return frames.withColumn(name_col, F.coalesce(moved, F.col(name_col)))


def output_name(name: Column, op: str, projection: str = "mean", brightfield: bool = False) -> Column:
    """Name of an operation's output: edf, fuse, png, ome or contour."""
    s = stem(name)
    if op == "edf":
        return F.concat(s, F.lit("_edf.tif"))
    if op == "fuse":
        tag = "superimposed" if projection == "mean" else projection
        return F.concat(s, F.lit(f"{'_brightfield' if brightfield else ''}_{tag}"), F.substring(name, F.length(s) + 1, F.length(name)))
    if op == "png":
        return F.concat(s, F.lit(".png"))
    if op == "ome":
        return F.concat(F.regexp_replace(s, r"(?i)\.ome$", ""), F.lit(".ome.tif"))
    if op == "contour":
        return F.concat(s, F.lit("_contour"), F.substring(name, F.length(s) + 1, F.length(name)))
    raise ValueError(f"unknown operation {op!r}")
