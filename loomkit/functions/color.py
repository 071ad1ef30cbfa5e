"""Colour and number conversions as column expressions; nulls give null. Casts to whole numbers truncate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Saturation and value factors of the seven shades, for a light and a dark theme.
SHADES = ("primary", "dark1", "dark2", "dark3", "light1", "light2", "light3")
LIGHT = ((1, 1), (1, 0.75), (1.05, 0.5), (1.1, 0.4), (1, 1.05), (0.75, 1.05), (0.65, 1.05))
DARK = ((1, 1), (1, 0.9), (0.977, 0.82), (0.95, 0.7), (0.92, 1), (0.78, 1), (0.65, 1))


def parse_hex_color(text: Column, default: str) -> Column:
    """struct<r, g, b, a> of RRGGBB or AARRGGBB, with or without #; of anything else the default's."""
    good = F.when(text.rlike(r"^#?(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})\z"), F.ltrim(F.replace(text, F.lit("#"), F.lit(""))))
    h = F.coalesce(good, F.lit(default.lstrip("#")))
    h = F.lpad(h, 8, "F")
    part = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("int")
    return F.struct(part(3).alias("r"), part(5).alias("g"), part(7).alias("b"), part(1).alias("a"))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v>; of equal greatest parts the first of r, g, b decides the hue; gray has hue 0."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = lambda x, y, base: F.pmod(60 * ((x - y) / d) + base, F.lit(360.0))
    h = F.when(d == 0, 0.0).when(top == r, hue(g, b, 360)).when(top == g, hue(b, r, 120)).otherwise(hue(r, g, 240))
    return F.struct(h.alias("h"), F.when(top == 0, 0.0).otherwise(d / top).alias("s"), top.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column, whole: bool = False) -> Column:
    """struct<r, g, b>, truncated, or rounded if ``whole``."""
    sector = F.floor(h / 60.0)
    f, k = h / 60.0 - sector, F.pmod(sector, F.lit(6))
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)

    def pick(*parts: Column) -> Column:
        out = F.when(k == 0, parts[0])
        for n in range(1, 6):
            out = out.when(k == n, parts[n])
        return (F.round(out * 255) if whole else out * 255).cast("int")

    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


def adjust_brightness(hsv: Column) -> Column:
    """struct<h, s, v> with bright values taken down."""
    v = hsv.v
    factor = F.when(v > 0.9, 0.8).when(v > 0.8, 0.9).when(v > 0.7, 0.95).otherwise(1.0)
    return F.struct(hsv.h.alias("h"), hsv.s.alias("s"), (v * factor).alias("v"))


def colorfulness(r: Column, g: Column, b: Column) -> Column:
    yellow = F.abs(0.5 * (r + g) - b)
    return 0.3 * F.sqrt((r - g) * (r - g) + yellow * yellow)


def theme_shades(h: Column, s: Column, v: Column, dark: bool = False) -> Column:
    """array<struct<shade, s, v>>: the seven shades of a colour; a dark theme starts from s * 0.84 and v = 1."""
    if dark:
        s, v = s * 0.84, F.lit(1.0)
    one = F.lit(1.0)
    return F.array(*[
        F.struct(F.lit(n).alias("shade"), F.least(s * a, one).alias("s"), F.least(v * c, one).alias("v")) for n, (a, c) in zip(SHADES, DARK if dark else LIGHT, strict=True)])


def shade_colors(text: Column, default: str, dark: bool = False) -> Column:
    """array<struct<shade, r, g, b>>: the seven shades of a hexadecimal colour, whole numbers."""
    rgb = parse_hex_color(text, default)
    hsv = F.transform(F.array(rgb), lambda c: rgb_to_hsv(c.r, c.g, c.b))

    def shades(c: Column) -> Column:
        def one(x: Column) -> Column:
            out = hsv_to_rgb(c.h, x.s, x.v, whole=True)
            return F.struct(x.shade.alias("shade"), out.r.alias("r"), out.g.alias("g"), out.b.alias("b"))

        return F.transform(theme_shades(c.h, c.s, c.v, dark), one)

    return F.flatten(F.transform(hsv, shades))


def alpha_from_percent(p: Column) -> Column:
    return (p / 100.0 * 255).cast("int")


def percent_from_alpha(a: Column) -> Column:
    return (a / 255.0 * 100).cast("int")


def alpha_blend(base: Column, over: Column, alpha: Column) -> Column:
    """One channel of source-over on an opaque base; alpha 0 to 255."""
    return (over * alpha / 255.0 + base * (255 - alpha) / 255.0).cast("int")


def blend_layers(base: Column, *layers: Column) -> Column:
    """struct<r, g, b>: layers (struct<r, g, b, a>) over an opaque base, the first at the bottom."""
    out = {c: base[c] for c in "rgb"}
    for x in layers:
        out = {c: alpha_blend(out[c], x[c], x["a"]) for c in "rgb"}
    return F.struct(*[out[c].alias(c) for c in "rgb"])


def value_to_position(value: Column, low: Column, high: Column, length: Column) -> Column:
    return ((value - low) / F.greatest(high - low, F.lit(1)) * length).cast("int")


def position_to_value(pos: Column, low: Column, high: Column, length: Column, handle: Column) -> Column:
    return ((pos - handle / 2.0) / F.greatest(length, F.lit(1)) * (high - low) + low).cast("int")


def progress_text(value: Column, low: Column, high: Column, fmt: Column) -> Column:
    """%m is the total, %v the value, %p the whole per cent; '' if there is no range."""
    total = high - low
    text = F.replace(fmt, F.lit("%m"), total.cast("string"))
    text = F.replace(text, F.lit("%v"), value.cast("string"))
    return F.when(high <= low, "").otherwise(F.replace(text, F.lit("%p"), ((value - low) * 100 / total).cast("int").cast("string")))


def fit_within(w: Column, h: Column, most_w: Column, most_h: Column) -> Column:
    """struct<w, h>, never larger than it was."""
    ratio = F.least(most_w / w, most_h / h, F.lit(1.0))
    return F.struct((w * ratio).cast("int").alias("w"), (h * ratio).cast("int").alias("h"))


def scale_to_side(w: Column, h: Column, side: int, axis: str = "height") -> Column:
    """struct<w, h> of the same shape with ``side`` as its height (or width), at least 1 by 1; sizes under 1 count as 1."""
    w, h, one = F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1)), F.lit(1)
    if axis == "height":
        return F.struct(F.greatest((w * side / h).cast("int"), one).alias("w"), F.lit(side).alias("h"))
    return F.struct(F.lit(side).alias("w"), F.greatest((h * side / w).cast("int"), one).alias("h"))


def center_crop_box(w: Column, h: Column, d: int) -> Column:
    """struct<w, h, x, y>: the size that covers a d x d box, and where the centred box starts."""
    ratio = F.greatest(d / w, d / h)
    cw, ch = (w * ratio).cast("int"), (h * ratio).cast("int")
    return F.struct(cw.alias("w"), ch.alias("h"), ((cw - d) / 2.0).cast("int").alias("x"), ((ch - d) / 2.0).cast("int").alias("y"))
