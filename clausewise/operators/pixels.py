"""Ink on scanned signatures, from pixels to masks and cut-outs. Decoding image files is a boundary: rows of RGBA bytes come in.

An image is put on white; ink is what is black or blue, or darker than its neighbourhood; specks go and gaps close by running minima and maxima. Images are worked off in strips with
a margin, as wide as all steps together can see, so memory does not grow with an image and strips change nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ink import measured

#: What counts as black and as blue ink (hue in half degrees, the rest from 0 to 255), the neighbourhood's width and how much darker ink is.
BLACK_SAT, BLACK_VALUE, BLUE_HUE, BLUE_SAT, BLUE_VALUE, AROUND, DARKER = 80, 120, (100, 140), 50, 180, 21, 10
#: Round shapes of three and five pixels, as the places that they cover.
ROUND3 = ((-1, 0), (0, -1), (0, 0), (0, 1), (1, 0))
ROUND5 = ((-2, 0), *((y, x) for y in (-1, 0, 1) for x in range(-2, 3)), (2, 0))
#: Pixels of a strip, and rows that the steps see beyond it.
STRIP, SEEN = 1 << 21, AROUND // 2 + 6
CUTOUT = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("rgba", T.BinaryType())])


def on_white(rgba):
    """Colours (rows, columns, 3) of an image (rows, columns, 4) on white."""
    alpha = rgba[..., 3:].astype(np.uint32)
    return ((rgba[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def hsv(rgb):
    """Hue in half degrees, saturation and value."""
    c = rgb.astype(np.float32)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    value, low = c.max(axis=-1), c.min(axis=-1)
    spread = value - low
    with np.errstate(invalid="ignore", divide="ignore"):
        hue = np.where(value == r, (g - b) / spread, np.where(value == g, 2 + (b - r) / spread, 4 + (r - g) / spread)) * 30
        sat = np.where(value > 0, 255 * spread / value, 0)
    hue = np.where(spread > 0, hue, 0)
    return np.rint(np.where(hue < 0, hue + 180, hue)).astype(np.int32), np.rint(sat).astype(np.int32), value.astype(np.int32)


def _bell(size: int):
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return (w / w.sum()).astype(np.float64)


def neighbourhood(gray, size: int = AROUND):
    """Weighted mean around each pixel, the nearer the heavier; the border goes on outside."""
    w, half = _bell(size), size // 2
    wide = np.pad(gray.astype(np.float64), half, mode="edge")
    rows = sum(w[i] * wide[i : i + gray.shape[0]] for i in range(size))
    return np.rint(sum(w[i] * rows[:, i : i + gray.shape[1]] for i in range(size)))


def _over(mask, shape, least: bool):
    """Running minimum or maximum over a shape; nothing outside the image counts."""
    half = max(abs(y) for y, _ in shape)
    wide = np.pad(mask, half, constant_values=least)
    h, w = mask.shape
    parts = [wide[half + y : half + y + h, half + x : half + x + w] for y, x in shape]
    return np.logical_and.reduce(parts) if least else np.logical_or.reduce(parts)


def opened(mask, shape=ROUND3):
    return _over(_over(mask, shape, True), shape, False)


def closed(mask, shape=ROUND5):
    return _over(_over(mask, shape, False), shape, True)


def ink_of(rgba):
    """The ink of an image (rows, columns, 4) as a boolean mask."""
    if not rgba.size:
        return np.zeros(rgba.shape[:2], dtype=bool)
    rgb = on_white(rgba)
    hue, sat, value = hsv(rgb)
    gray = np.rint(rgb @ np.array([0.299, 0.587, 0.114]))
    ink = (sat < BLACK_SAT) & (value < BLACK_VALUE)
    ink |= (hue >= BLUE_HUE[0]) & (hue <= BLUE_HUE[1]) & (sat > BLUE_SAT) & (value < BLUE_VALUE)
    ink |= gray <= neighbourhood(gray) - DARKER
    return closed(opened(ink))


def ink_in_strips(rgba, strip: int = STRIP):
    """``ink_of``, strip by strip."""
    h, w = rgba.shape[:2]
    step = max(1, strip // max(1, w))
    out = np.zeros((h, w), dtype=bool)
    for lo in range(0, h, step):
        first, last = max(0, lo - SEEN), min(h, lo + step + SEEN)
        out[lo : lo + step] = ink_of(rgba[first:last])[lo - first : lo - first + step]
    return out


def _image(raw, w, h):
    """Pixels of an image; missing bytes are transparent."""
    return np.frombuffer(bytes(raw or b"").ljust(4 * w * h, b"\0")[: 4 * w * h], np.uint8).reshape(h, w, 4)


@F.pandas_udf(T.BinaryType())
def mask(rgba: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """One byte a pixel, 1 for ink; null for null."""
    return pd.Series([None if raw is None else ink_in_strips(_image(raw, w, h)).astype(np.uint8).tobytes() for raw, w, h in zip(rgba, width, height, strict=True)], dtype=object)


def soft(ink):
    """Alpha of a mask: 255 for ink, blurred over three pixels; the border is mirrored."""
    wide = np.pad(ink.astype(np.int64) * 255, 1, mode="reflect" if min(ink.shape) > 1 else "edge")
    rows = wide[:-2] + 2 * wide[1:-1] + wide[2:]
    return ((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:] + 8) // 16).astype(np.uint8)


@F.pandas_udf(CUTOUT)
def cutout(rgba: pd.Series, width: pd.Series, height: pd.Series, ink: pd.Series, box: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for raw, w, h, own, x, y, bw, bh in zip(rgba, width, height, ink, box["x"], box["y"], box["w"], box["h"], strict=True):
        if raw is None or not w * h:
            rows.append((0, 0, b""))
            continue
        place = slice(y, y + bh), slice(x, x + bw)
        out = _image(raw, w, h)[place].copy()
        out[..., 3] = soft(np.frombuffer(own, np.uint8).reshape(h, w)[place] != 0)
        rows.append((bw, bh, out.tobytes()))
    return pd.DataFrame(rows, columns=CUTOUT.names)


def signatures(images: DataFrame, ink: Column | None = None) -> DataFrame:
    """Adds ink, bbox, coverage, confidence, warnings and cutout (w, h, rgba with soft edges, in the image's own size) to images (width, height, rgba)."""
    rows = measured(images.withColumn("ink", mask("rgba", "width", "height") if ink is None else ink))
    return rows.withColumn("cutout", cutout("rgba", "width", "height", "ink", "bbox"))
