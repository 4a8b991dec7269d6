"""Ink masks against pixel-by-pixel definitions on random images, and strips against the whole."""

import colorsys
import math

import numpy as np
import pytest

from clausewise.operators import pixels as px


def picture(seed, h, w):
    """Paper with strokes of black, blue and red, a shadow, and transparent parts."""
    r = np.random.default_rng(seed)
    image = np.full((h, w, 4), 255, np.uint8)
    image[..., :3] = (200 + 40 * np.linspace(0, 1, w)[None, :, None] + r.integers(-6, 7, (h, w, 3))).clip(0, 255)
    for colour in ((20, 20, 25), (30, 40, 150), (200, 30, 30), (90, 95, 90)):
        for _ in range(4):
            y, x, n = r.integers(0, h), r.integers(0, w), r.integers(1, 9)
            image[y : y + r.integers(1, 4), x : x + n, :3] = colour
    image[r.random((h, w)) < 0.05, 3] = 0
    image[r.random((h, w)) < 0.05, 3] = 128
    return image


def plain(image):
    h, w = image.shape[:2]
    rgb = [[[(int(c) * int(p[3]) + 255 * (255 - int(p[3])) + 127) // 255 for c in p[:3]] for p in row] for row in image]
    gray = [[round(0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]) for p in row] for row in rgb]
    sigma = 0.3 * (10 - 1) + 0.8
    bell = [math.exp(-((i - 10) ** 2) / (2 * sigma**2)) for i in range(21)]
    bell = [b / sum(bell) for b in bell]
    at = lambda grid, y, x: grid[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    ink = set()
    for y in range(h):
        for x in range(w):
            hue, s, v = colorsys.rgb_to_hsv(*(c / 255 for c in rgb[y][x]))
            hue, s, v = round(hue * 180), round(s * 255), round(v * 255)
            mean = round(sum(bell[i] * sum(bell[j] * at(gray, y + i - 10, x + j - 10) for j in range(21)) for i in range(21)))
            if (s < 80 and v < 120) or (100 <= hue <= 140 and s > 50 and v < 180) or gray[y][x] <= mean - 10:
                ink.add((y, x))
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    every = [(y, x) for y in range(h) for x in range(w)]
    thin = lambda ink, shape: {(y, x) for y, x in every if all(not inside(y + a, x + b) or (y + a, x + b) in ink for a, b in shape)}
    fat = lambda ink, shape: {(y, x) for y, x in every if any((y + a, x + b) in ink for a, b in shape)}
    small, large = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)], [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) < 2 or b == 0]
    return thin(fat(fat(thin(ink, small), small), large), large)


@pytest.mark.parametrize("seed,h,w", [(1, 30, 40), (2, 17, 55), (3, 5, 5), (4, 1, 30), (5, 40, 1)])
def test_masks_are_the_stated_ones(seed, h, w):
    image = picture(seed, h, w)
    assert {(int(y), int(x)) for y, x in zip(*np.nonzero(px.ink_of(image)), strict=True)} == plain(image)


def test_strips_change_nothing():
    image = picture(9, 160, 70)
    whole = px.ink_of(image)
    assert whole.any() and not whole.all()
    for strip in (70, 70 * 7, 70 * 40, 10**6):
        assert (px.ink_in_strips(image, strip) == whole).all()


def test_signatures(spark):
    image = picture(3, 60, 90)
    rows = [(0, 90, 60, bytearray(image.tobytes())), (1, 4, 3, None), (2, 5, 5, bytearray(b"\xff" * 100)), (3, 0, 0, bytearray()), (4, 6, 6, bytearray(b"\0" * 10))]
    out = {r["id"]: r for r in px.signatures(spark.createDataFrame(rows, "id int, width int, height int, rgba binary")).collect()}
    whole = px.ink_of(image)
    assert bytes(out[0]["ink"]) == whole.astype(np.uint8).tobytes()
    y, x = np.nonzero(whole)
    box = out[0]["bbox"]
    assert (box["x"], box["y"]) == (max(0, x.min() - 12), max(0, y.min() - 12)) and 0 < out[0]["coverage"] <= 1
    cut = np.frombuffer(bytes(out[0]["cutout"]["rgba"]), np.uint8).reshape(out[0]["cutout"]["h"], out[0]["cutout"]["w"], 4)
    assert cut.shape[:2] == (box["h"], box["w"]) and (cut[..., :3] == image[box["y"] : box["y"] + box["h"], box["x"] : box["x"] + box["w"], :3]).all()
    inner = whole[box["y"] : box["y"] + box["h"], box["x"] : box["x"] + box["w"]]
    assert (cut[..., 3][inner] > 0).all() and cut[..., 3].max() == 255
    assert [out[i]["confidence"] for i in (1, 2, 3, 4)] == [0.0] * 4 and out[1]["ink"] is None and out[2]["warnings"] == ["no ink"]
    assert px.soft(np.eye(3, dtype=bool))[1, 1] == 96
