"""Image jobs: one row is one image (image_id, width, height, channels, data), row-major RGB; no job shuffles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "image_id string, width int, height int, channels int, data binary, error string"
DEFAULT_COLOR = (24, 24, 24)


def pixels(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)


def _each(images: DataFrame, job, rows: bool = False) -> DataFrame:
    """``job`` on each image, and on its row with ``rows``; an image that can't be worked on keeps its row, without data and with the error."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    a = job(pixels(r), r) if rows else job(pixels(r))
                    out.append((r.image_id, a.shape[1], a.shape[0], a.shape[2], a.astype(np.uint8).tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((r.image_id, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "channels", "data", "error"]).astype({c: "Int32" for c in ("width", "height", "channels")})

    return images.mapInPandas(run, SCHEMA)


def whole(a: np.ndarray) -> np.ndarray:
    """Whole numbers, halves to even; what the order of additions changes in the last places does not count."""
    return np.rint(np.round(a, 9))


@lru_cache(maxsize=64)
def axis_taps(n: int, m: int, kernel: str = "triangle") -> tuple[np.ndarray, np.ndarray]:
    """(m, k) each: the pixels of ``n`` that add to each of ``m`` in their place, and how much, pixel centres aligned. Where pixels become fewer the kernel is as much wider, so that every pixel counts."""
    scale, reach = max(n / m, 1.0), 3 if kernel == "lanczos" else 1
    center = (np.arange(m) + 0.5) * n / m
    at = np.floor(center - reach * scale).astype(int)[:, None] + np.arange(int(np.ceil(2 * reach * scale)) + 2)
    far = np.abs(at + 0.5 - center[:, None]) / scale
    w = np.where(far < 3, np.sinc(far) * np.sinc(far / 3), 0.0) if kernel == "lanczos" else np.maximum(1 - far, 0.0)
    w[(at < 0) | (at >= n)] = 0
    return at.clip(0, n - 1), w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, w: int, h: int, kernel: str = "triangle") -> np.ndarray:
    """Each axis by itself; whole numbers from 0 to 255 at the end."""
    out = a.astype(float)
    for axis, size in ((0, h), (1, w)):
        at, weight = axis_taps(out.shape[axis], size, kernel)
        shape = (-1, 1, 1) if axis == 0 else (1, -1, 1)
        out = sum(np.take(out, at[:, k], axis) * weight[:, k].reshape(shape) for k in range(at.shape[1]) if weight[:, k].any())
    return np.clip(whole(out), 0, 255)


def _dense(at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The taps of ``axis_taps`` that count, in the same order, in as few columns as hold them."""
    order = np.argsort(weight == 0, axis=1, kind="stable")[:, : int((weight != 0).sum(1).max())]
    return np.take_along_axis(at, order, 1), np.take_along_axis(weight, order, 1)


@lru_cache(maxsize=16)
def _every_taps(height: int, width: int, step: int, w: int, h: int) -> list:
    """For each tap along a row: its weights, and the pixels and weights along columns that add to it, of every ``step``-th pixel of (w, h)."""
    y, x = np.divmod(np.arange(0, w * h, step), w)
    (down, down_weight), (along, along_weight) = ([v[i] for v in _dense(*axis_taps(n, m))] for n, m, i in ((height, h, y), (width, w, x)))
    return [(along_weight[:, k, None], [(down[:, j] * width + along[:, k], down_weight[:, j, None]) for j in range(down.shape[1])]) for k in range(along.shape[1])]


def every(a: np.ndarray, step: int, size: tuple[int, int] | None = None) -> np.ndarray:
    """(pixels, channels): every ``step``-th pixel of the image, or of what ``resize`` to ``size`` would give, of which no others are worked out."""
    flat = a.reshape(-1, a.shape[2])
    if size is None:
        return flat[::step]
    flat = flat.astype(float)
    out = sum(sum(flat.take(at, 0) * w for at, w in column) * weight for weight, column in _every_taps(*a.shape[:2], step, *size))
    return np.clip(whole(out), 0, 255)


def fitted(width: int, height: int, w: int, h: int) -> tuple[int, int]:
    """The size that fits into (w, h) in the same proportion; what fits already stays."""
    k = min(w / width, h / height, 1)
    return max(1, int(width * k)), max(1, int(height * k))


def blur(a: np.ndarray, radius: float = 18, bright: float = 1.0, most: tuple[int, int] | None = None) -> np.ndarray:
    """Gaussian blur of the first three channels (four sigmas, edges mirrored), whole numbers after each axis; alpha stays."""
    if most and (size := fitted(a.shape[1], a.shape[0], *most)) != (a.shape[1], a.shape[0]):
        a = resize(a, *size)
    if a.shape[2] == 1:
        a = np.repeat(a, 3, 2)
    n = int(4 * radius + 0.5)
    taps = np.exp(-0.5 * (np.arange(-n, n + 1) / radius) ** 2)
    taps /= taps.sum()
    out = a[:, :, :3].astype(float)
    for axis in (0, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (n, n)
        wide = np.pad(out, pad, mode="symmetric")
        out = whole(sum(t * np.take(wide, range(k, k + out.shape[axis]), axis) for k, t in enumerate(taps)))
    return np.concatenate([np.clip(np.trunc(out * bright), 0, 255), a[:, :, 3:]], 2)


def cover(a: np.ndarray, d: int) -> np.ndarray:
    k = max(d / a.shape[1], d / a.shape[0])
    w, h = max(d, int(a.shape[1] * k)), max(d, int(a.shape[0] * k))
    a = resize(a, w, h)
    x, y = (w - d) // 2, (h - d) // 2
    return a[y : y + d, x : x + d]


def over(a: np.ndarray, color: tuple[int, int, int, int]) -> np.ndarray:
    k = color[3] / 255
    return np.trunc(a[:, :, :3] * (1 - k) + np.array(color[:3]) * k)


def gaussian_blur(images: DataFrame, radius: float = 18, bright: float = 1.0, most: tuple[int, int] | None = None) -> DataFrame:
    return _each(images, lambda a: blur(a, radius, bright, most))


def resize_image(images: DataFrame, w: int, h: int, fit: bool = False, kernel: str = "triangle") -> DataFrame:
    """Images of exactly that size, or with ``fit`` of the largest size within it that keeps their proportion, and no larger than they are."""
    return _each(images, lambda a: resize(a, *(fitted(a.shape[1], a.shape[0], w, h) if fit else (w, h)), kernel))


def cover_crop(images: DataFrame, d: int) -> DataFrame:
    return _each(images, lambda a: cover(a, d))


def acrylic_composite(images: DataFrame, luminosity=(255, 255, 255, 10), tint=(242, 242, 242, 150), radius: float = 6, noise: np.ndarray | None = None, opacity: float = 0.03) -> DataFrame:
    """Blur, then luminosity, then tint, then ``noise`` (h, w, 3), repeated over the image, at ``opacity``."""
    def job(a):
        out = over(over(blur(a, radius), luminosity), tint)
        if noise is None:
            return out
        tiled = np.tile(noise, (-(-out.shape[0] // noise.shape[0]), -(-out.shape[1] // noise.shape[1]), 1))
        return np.trunc(out * (1 - opacity) + tiled[: out.shape[0], : out.shape[1]] * opacity)

    return _each(images, job)


def mark_geometry(width: Column, height: Column, mark_width: Column, mark_height: Column, anchor: Column, zoom: Column, rotation: Column) -> Column:
    """struct<w, h, box_w, box_h, x, y>: the mark's size after ``zoom`` percent, the box that holds it turned, and where the box stands at one of nine anchors, 0 top left to 8 bottom right."""
    w, h = (F.greatest((x * zoom / 100).cast("int"), F.lit(1)) for x in (mark_width, mark_height))
    c, s = F.abs(F.cos(F.radians(rotation))), F.abs(F.sin(F.radians(rotation)))
    box = lambda x, y: F.greatest(F.floor(F.round(x * c + y * s, 6) + 0.5).cast("int"), F.lit(1))
    box_w, box_h = box(w, h), box(h, w)
    at = lambda room, place: F.floor(room * place / 2).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), box_w.alias("box_w"), box_h.alias("box_h"), at(width - box_w, F.pmod(anchor, F.lit(3))).alias("x"), at(height - box_h, F.floor(anchor / 3)).alias("y"))


def turned(m: np.ndarray, degrees: float, box_w: int, box_h: int) -> tuple[np.ndarray, np.ndarray]:
    """``m`` (h, w, 3 or 4) turned clockwise about its centre into a box: how much of each pixel the mark covers, and its colours times that.

    Each pixel of the box is looked up where it comes from, between four pixels of the mark by
    their distance; what lies beyond the mark covers nothing.
    """
    h, w = m.shape[:2]
    alpha = m[:, :, 3] / 255 if m.shape[2] == 4 else np.ones((h, w))
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[:box_h, :box_w]
    y, x = y - (box_h - 1) / 2, x - (box_w - 1) / 2
    from_x, from_y = np.round(c * x + s * y + (w - 1) / 2, 6), np.round(c * y - s * x + (h - 1) / 2, 6)
    x0, y0 = np.floor(from_x).astype(int), np.floor(from_y).astype(int)
    cover, colors = np.zeros((box_h, box_w)), np.zeros((box_h, box_w, 3))
    for dy in (0, 1):
        for dx in (0, 1):
            at_x, at_y = x0 + dx, y0 + dy
            inside = (at_x >= 0) & (at_x < w) & (at_y >= 0) & (at_y < h)
            at_x, at_y = at_x.clip(0, w - 1), at_y.clip(0, h - 1)
            part = np.where(inside, np.abs(1 - dx - (from_x - x0)) * np.abs(1 - dy - (from_y - y0)) * alpha[at_y, at_x], 0.0)
            cover += part
            colors += part[:, :, None] * m[at_y, at_x, :3]
    return cover, colors


def stamp(a: np.ndarray, m: np.ndarray, g, opacity: float, rotation: float) -> np.ndarray:
    """``m`` over ``a`` by the geometry ``g``, at ``opacity`` percent; what stands out is cut."""
    m = np.repeat(m, 3, 2) if m.shape[2] == 1 else m
    m = m.astype(float) if (m.shape[1], m.shape[0]) == (g["w"], g["h"]) else resize(m, g["w"], g["h"])
    cover, colors = turned(m, rotation, g["box_w"], g["box_h"])
    out = a[:, :, :3].astype(float) if a.shape[2] > 1 else np.repeat(a, 3, 2).astype(float)
    top, left = max(g["y"], 0), max(g["x"], 0)
    bottom, right = min(g["y"] + g["box_h"], a.shape[0]), min(g["x"] + g["box_w"], a.shape[1])
    if top < bottom and left < right:
        shown = slice(top - g["y"], bottom - g["y"]), slice(left - g["x"], right - g["x"])
        k = opacity / 100
        part = out[top:bottom, left:right]
        part[:] = np.trunc(part * (1 - cover[shown][:, :, None] * k) + colors[shown] * k)
    return np.concatenate([out, a[:, :, 3:]], 2)


def watermark_rows(images: DataFrame, marks: DataFrame) -> DataFrame:
    """Each image with a mark over it as its own row says: ``images`` also have mark_id, anchor (0 top left to 8 bottom right), opacity (percent), zoom (percent) and rotation (degrees clockwise).

    ``marks``: mark_id, width, height, channels, data; a fourth channel says how much of the mark covers what is below. They are joined,
    and Spark sends them to all tasks if they are small. An image without its mark, or with a null setting, has an error.
    """
    m = marks.select(F.col("mark_id").alias("_mark"), F.struct("width", "height", "channels", "data").alias("m"))
    g = mark_geometry(F.col("width"), F.col("height"), F.col("m.width"), F.col("m.height"), F.col("anchor"), F.col("zoom"), F.col("rotation"))
    rows = images.join(m, F.col("mark_id") == F.col("_mark"), "left").select(
        "image_id", "width", "height", "channels", "data", F.col("opacity").cast("double").alias("opacity"), F.col("rotation").cast("double").alias("rotation"),
        F.col("m.width").alias("m_width"), F.col("m.height").alias("m_height"), F.col("m.channels").alias("m_channels"), F.col("m.data").alias("m_data"), *[g[x].alias(x) for x in ("w", "h", "box_w", "box_h", "x", "y")])

    def job(a, r):
        if r.m_data is None or any(np.isnan(float(v)) for v in (r.w, r.h, r.x, r.y, r.opacity, r.rotation)):
            raise ValueError("no mark or no setting")
        mark = np.frombuffer(r.m_data, np.uint8).reshape(int(r.m_height), int(r.m_width), int(r.m_channels))
        return stamp(a, mark, {k: int(getattr(r, k)) for k in ("w", "h", "box_w", "box_h", "x", "y")}, r.opacity, r.rotation)

    return _each(rows, job, rows=True)


def watermark_overlay(images: DataFrame, mark: np.ndarray, anchor: int = 8, opacity: float = 20, zoom: float = 100, rotation: float = 0) -> DataFrame:
    """One ``mark`` (h, w, 3 or 4) over all images in the same way."""
    spark = images.sparkSession
    marks = spark.createDataFrame([(0, mark.shape[1], mark.shape[0], mark.shape[2], mark.astype(np.uint8).tobytes())], "mark_id int, width int, height int, channels int, data binary")
    settings = {"mark_id": 0, "anchor": anchor, "opacity": opacity, "zoom": zoom, "rotation": rotation}
    return watermark_rows(images.withColumns({k: F.lit(v) for k, v in settings.items()}), marks)


def palette(a: np.ndarray, n: int = 10) -> list[tuple[int, int, int]]:
    """At most ``n`` colours by median cut over a histogram of five bits a channel (Heckbert 1982, Bloomberg 2008), of every ninth pixel.

    A box of colours is cut across its longest side where half of its pixels lie on either side.
    Until three quarters of the colours are found the box with the most pixels is cut, then the one with the largest
    product of pixels and volume, and so small but different colours get their share. The largest products come first.
    """
    a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a[:, :, :3]
    px = every(a, 9, (400, 400) if max(a.shape[:2]) > 400 else None).astype(np.int64)
    code = (px[:, 0] >> 3 << 10) + (px[:, 1] >> 3 << 5) + (px[:, 2] >> 3)
    held = np.bincount(code, minlength=1 << 15)
    codes = np.flatnonzero(held)
    bins, counts = codes[:, None] // (1024, 32, 1) % 32, held[codes]
    sums = np.stack([np.bincount(code, px[:, c], 1 << 15)[codes] for c in range(3)], 1)

    def boxed(box):
        """A box of colours, the lengths of its sides, its pixels and their product with its volume."""
        sides, n = np.ptp(bins[box], 0), int(counts[box].sum())
        return box, sides, n, n * int(np.prod(sides + 1))

    def cut(box, sides):
        at = bins[box, int(sides.argmax())]
        held = np.cumsum(np.bincount(at, counts[box]))
        # The cut lies behind the plane that reaches one half, but before the last plane.
        low = at <= min(np.searchsorted(held, held[-1] / 2), len(held) - 2)
        return boxed(box[low]), boxed(box[~low])

    boxes = [boxed(np.arange(len(bins)))]
    for goal, weight in ((-(-3 * n // 4), 2), (n, 3)):
        while len(boxes) < goal:
            several = [k for k, b in enumerate(boxes) if len(b[0]) > 1]
            if not several:
                break
            k = max(several, key=lambda i: boxes[i][weight])  # noqa: B023
            boxes[k : k + 1] = cut(*boxes[k][:2])
    boxes.sort(key=lambda b: -b[3])
    return [tuple(int(x) for x in sums[b].sum(0) // total) for b, _, total, _ in boxes]


def hsv(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    """Hue in degrees, saturation and value; of equal greatest parts the first one decides the hue, and gray has none."""
    parts = [x / 255 for x in rgb]
    top, span = max(parts), max(parts) - min(parts)
    k = parts.index(top)
    h = (60 * ((parts[(k + 1) % 3] - parts[(k + 2) % 3]) / span) + (360, 120, 240)[k]) % 360 if span else 0.0
    return h, span / top if top else 0.0, top


def from_hsv(h: float, s: float, v: float) -> tuple[int, int, int]:
    """Truncated parts of 255."""
    f, k = h / 60 % 1, int(h // 60) % 6
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    return tuple(int(x * 255) for x in ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))[k])


def choose(colors: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Bright colours are taken down, hues under 0.02 degrees go while more than two are left, and of the first five the most colourful wins."""
    adjusted = []
    for rgb in colors:
        h, s, v = hsv(rgb)
        adjusted.append(from_hsv(h, s, v * (0.8 if v > 0.9 else 0.9 if v > 0.8 else 0.95 if v > 0.7 else 1)))
    left = list(adjusted)
    for rgb in adjusted:
        if hsv(rgb)[0] < 0.02:
            left.remove(rgb)
            if len(left) <= 2:
                break
    rank = lambda c: round(0.3 * float(np.hypot(c[0] - c[1], 0.5 * (c[0] + c[1]) - c[2])), 9)
    return max(left[:5], key=rank, default=DEFAULT_COLOR)


def dominant_color(images: DataFrame) -> DataFrame:
    """(image_id, r, g, b, error); an image that can't be read gives the default (24, 24, 24) and the error, and one that is a built-in resource, whose id begins with a colon, the default."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    built_in = r.image_id is not None and r.image_id.startswith(":")
                    rows.append((r.image_id, *(DEFAULT_COLOR if built_in else choose(palette(pixels(r)))), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.image_id, *DEFAULT_COLOR, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["image_id", "r", "g", "b", "error"])

    return images.mapInPandas(run, "image_id string, r int, g int, b int, error string")
