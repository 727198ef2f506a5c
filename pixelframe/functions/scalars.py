"""Calibration, colors, times and small formulas as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length units in micrometers.
UNITS = {"µm": 1.0, "um": 1.0, "micron": 1.0, "microns": 1.0, "micrometer": 1.0, "nm": 1e-3, "mm": 1e3, "cm": 1e4, "m": 1e6}
# Named colors.
COLORS = {
    "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "black": (0, 0, 0), "white": (255, 255, 255),
    "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255), "orange": (255, 165, 0), "purple": (128, 0, 128),
    "pink": (255, 192, 203), "gray": (128, 128, 128), "grey": (128, 128, 128), "lightgray": (211, 211, 211),
    "lightgrey": (211, 211, 211), "darkgray": (64, 64, 64), "darkgrey": (64, 64, 64), "white16": (65535, 65535, 65535),
    "lightgray16": (49151, 49151, 49151), "gray16": (32767, 32767, 32767), "darkgray16": (16383, 16383, 16383), "black16": (0, 0, 0),
}
# Time formats, tried in this order. Times without a date are of 1900-01-01.
TIME_FORMATS = (
    "yyyy-M-d H:m:s", "yyyy-M-d H:m:s.SSSSSS", "M/d/yyyy H:m:s", "M/d/yyyy H:m", "yyyy-M-d", "M/d/yyyy", "H:m:s", "H:m",
)


def ome_pixel_size_um(xml: Column) -> Column:
    """First PhysicalSizeX in micrometers: unit by PhysicalSizeXUnit, micrometers if missing or unknown; null unless positive."""
    size = F.regexp_extract(xml, r'PhysicalSizeX="([^"]*)"', 1).try_cast("double")
    unit = F.translate(F.regexp_extract(xml, r'PhysicalSizeXUnit="([^"]*)"', 1), "μ", "µ")
    factors = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    um = size * F.coalesce(F.element_at(factors, unit), F.lit(1.0))
    return F.when(um > 0, um)


def resolution_to_um(unit: Column, x: Column, y: Column) -> Column:
    """Micrometers a pixel from resolution tags: the unit over the mean of the positive ones; unit 2 (also null) inch, 3 centimeter."""
    length = F.when(F.coalesce(unit, F.lit(2)) == 2, 25400.0).when(unit == 3, 10000.0)
    good = F.filter(F.array(x.cast("double"), y.cast("double")), lambda r: r > 0)
    mean = F.aggregate(good, F.lit(0.0), lambda a, r: a + r) / F.size(good)
    return F.when(F.size(good) > 0, length / mean)


def um_to_resolution(px: Column) -> Column:
    """Pixels a centimeter, in thousandths."""
    return F.when(px > 0, F.rint(F.lit(1e7) / px) / 1000)


def pixel_size(explicit: Column, ome: Column, tag: Column, required: bool = False) -> Column:
    """Explicit, then OME, then tags. `required`: raises if there is none."""
    found = F.coalesce(explicit, ome, tag)
    return F.coalesce(found, F.raise_error(F.lit("no pixel size")).cast("double")) if required else found


def luminance(rgb: Column) -> Column:
    return 0.299 * rgb["r"] + 0.587 * rgb["g"] + 0.114 * rgb["b"]


def parse_color(text: str) -> tuple[float, float, float]:
    """A color name, `#rgb`, `#rrggbb`, `R,G,B` or one number, 0 to 65535; anything else raises."""
    s = text.strip().lower()
    if s in COLORS:
        return COLORS[s]
    if m := re.fullmatch(r"#?([0-9a-f]{3}|[0-9a-f]{6})", s) if s.startswith("#") else None:
        h = m[1] if len(m[1]) == 6 else "".join(2 * c for c in m[1])
        return tuple(int(h[k : k + 2], 16) for k in (0, 2, 4))
    parts = s.split(",")
    if len(parts) in (1, 3) and all(re.fullmatch(r"\s*\d+(\.\d+)?\s*", p) for p in parts):
        values = [float(p) for p in parts]
        if all(0 <= v <= 65535 for v in values):
            return tuple(values if len(values) == 3 else values * 3)
    raise ValueError(f"not a color: {text!r}")


def color_of(text: Column) -> Column:
    """parse_color on a column: struct r, g, b (double); null where it would raise."""
    s = F.lower(F.trim(text))
    names = F.create_map(*(F.lit(x) for k, v in COLORS.items() for x in (k, "{},{},{}".format(*v))))
    short = F.regexp_replace(s, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    hexes = [F.conv(F.substring(short, 2 * k + 2, 2), 16, 10) for k in range(3)]
    listed = F.coalesce(
        F.element_at(names, s),
        F.when(short.rlike("^#[0-9a-f]{6}$"), F.concat_ws(",", *hexes)),
        F.when(s.rlike(r"^\d+(\.\d+)?$"), F.concat_ws(",", s, s, s)),
        F.when(s.rlike(r"^\s*\d+(\.\d+)?\s*(,\s*\d+(\.\d+)?\s*){2}$"), s),
    )
    parts = F.transform(F.split(listed, ","), lambda p: F.trim(p).cast("double"))
    rgb = F.struct(*(F.get(parts, F.lit(k)).alias(c) for k, c in enumerate("rgb")))
    return F.when(F.forall(parts, lambda p: p <= 65535), rgb)


def parse_time_offset(text: Column) -> Column:
    """Signed seconds of a number, [+-]MM:SS or [+-]HH:MM:SS[.sss]; null for anything else."""
    s = F.trim(text)
    sign = F.when(s.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(s, r"^[+-]", "")
    parts = F.split(body, ":")
    last = F.element_at(parts, -1).try_cast("double")
    first, second = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return sign * F.when(F.size(parts) == 1, last).when(F.size(parts) == 2, first * 60 + last).when(
        F.size(parts) == 3, first * 3600 + second * 60 + last
    )


def format_elapsed(seconds: Column) -> Column:
    """HH:MM:SS.sss with floor division, so negative times count from the hour below."""
    h = F.floor(seconds / 3600).cast("int")
    rest = seconds - F.floor(seconds / 3600) * 3600
    m = F.floor(rest / 60).cast("int")
    return F.format_string("%02d:%02d:%06.3f", h, m, rest - m * 60)


def parse_timestamp(text: Column) -> Column:
    """The first of TIME_FORMATS that fits, then epoch seconds; null otherwise."""
    dated = lambda f: (text, f) if "y" in f else (F.concat(F.lit("1900-1-1 "), text), f"yyyy-M-d {f}")
    tries = [F.try_to_timestamp(t, F.lit(f)) for t, f in map(dated, TIME_FORMATS)]
    return F.coalesce(*tries, F.timestamp_seconds(text.try_cast("double")))


def hann(i: Column, n: Column) -> Column:
    """Weight of sample i of n."""
    return F.when(n > 1, 0.5 - 0.5 * F.cos(2 * F.pi() * i / (n - 1))).otherwise(1.0)


def scale_bar_px(scale_um: Column, px: Column) -> Column:
    """Bar length in pixels."""
    return F.rint(scale_um / px).cast("int")


def scale_bar_label(scale_um: Column) -> Column:
    """`5 um`, `0.25 um`: six significant digits without trailing zeros, from 0.0001 to 999999."""
    text = F.format_string("%.0f", scale_um.cast("double"))
    for exponent in range(4, -5, -1):
        text = F.when(scale_um >= 10.0 ** (exponent + 1), text).otherwise(F.regexp_replace(F.format_string(f"%.{5 - exponent}f", scale_um.cast("double")), r"\.?0+$", ""))
    return F.concat(text, F.lit(" um"))


def parse_roi(spec: Column) -> Column:
    """struct name, v (array<double>) of `[name=]x,y,w,h`; `;` may part the numbers. A null name is left to the caller."""
    has = F.contains(spec, F.lit("="))
    name = F.when(has, F.trim(F.substring_index(spec, "=", 1)))
    body = F.when(has, F.regexp_replace(spec, "^[^=]*=", "")).otherwise(spec)
    return F.struct(name.alias("name"), F.transform(F.split(F.translate(body, ";", ","), ","), lambda p: F.trim(p).try_cast("double")).alias("v"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; null where one side is constant."""
    x, y = a.cast("double"), b.cast("double")
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))
