"""Page images as rows (doc_id, page_number, height, width, channels, pixels): measures, enhancement, lines and boxes of lines.

Pixels are bytes in rows, blue, green and red beside each other where there are three channels. Work on pixels is numpy
inside Arrow batches of pages; what follows from its numbers is relational (``operators.candidates``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values
NOISY, FLAT, SOFT = 1000.0, 6.0, 20.0  # variance of the Laplacian above, entropy below, mean gradient below
ALPHA, BETA = 1.2, 10.0
LINE = 40  # pixels of a ruled line, at least


def pixels(data: bytes, height: int, width: int, channels: int = 1) -> np.ndarray:
    flat = np.frombuffer(data, dtype=np.uint8)
    return flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels)


def _saturated(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else _saturated(image[..., :3] @ np.array([0.114, 0.587, 0.299]))


def _around(image: np.ndarray, n: int = 1) -> np.ndarray:
    """With n more rows and columns on every side, mirrored without the edge itself; an edge of one pixel is repeated."""
    modes = ["reflect" if s > n else "edge" for s in image.shape]
    rows = np.pad(image, ((n, n), (0, 0)), mode=modes[0])
    return np.pad(rows, ((0, 0), (n, n)), mode=modes[1])


def laplacian(image: np.ndarray) -> np.ndarray:
    a = _around(image.astype(float))
    return a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]


def gradient(image: np.ndarray) -> np.ndarray:
    """Length of the Sobel gradient."""
    a = _around(image.astype(float))
    down = a[:-2] + 2 * a[1:-1] + a[2:]
    right = a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
    return np.hypot(down[:, 2:] - down[:, :-2], right[2:] - right[:-2])


def entropy(image: np.ndarray) -> float:
    p = np.bincount(image.reshape(-1), minlength=256) / max(image.size, 1)
    return float(-(p * np.log2(p + 1e-10)).sum())


def scaled(image: np.ndarray, alpha: float = ALPHA, beta: float = BETA) -> np.ndarray:
    return _saturated(np.abs(image * alpha + beta))


def median(image: np.ndarray, size: int) -> np.ndarray:
    n = size // 2
    a = np.pad(image, n, mode="edge")
    views = np.lib.stride_tricks.sliding_window_view(a, (size, size))
    return np.median(views.reshape(*image.shape, -1), axis=-1).astype(np.uint8)


def otsu(image: np.ndarray) -> tuple[int, np.ndarray]:
    """The threshold that parts the grey levels best, the lowest among equals, and the image in black and white by it."""
    n = np.bincount(image.reshape(-1), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    level = int(np.nanargmax(np.where((below > 0) & (above > 0), between, -1)))
    return level, np.where(image > level, 255, 0).astype(np.uint8)


def equalised(image: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation by tiles, the tiles' curves blended between their centres."""
    height, width = (-(-s // tiles) * tiles for s in image.shape)
    padded = np.pad(image, ((0, height - image.shape[0]), (0, width - image.shape[1])), mode="symmetric")
    th, tw = height // tiles, width // tiles
    curves = np.empty((tiles, tiles, 256))
    most = max(1, int(limit * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].reshape(-1), minlength=256)
            spare = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + spare // 256
            if rest := spare % 256:
                n[:: max(256 // rest, 1)][:rest] += 1
            curves[i, j] = _saturated(np.cumsum(n) * (255 / (th * tw)))
    y, x = ((np.arange(s) + 0.5) / t - 0.5 for s, t in zip(image.shape, (th, tw)))
    (y0, x0), (fy, fx) = ((np.clip(np.floor(v), 0, tiles - 1).astype(int) for v in (y, x)), (np.clip(v, 0, tiles - 1) % 1 for v in (y, x)))
    y1, x1 = (np.minimum(v + 1, tiles - 1) for v in (y0, x0))
    at = lambda a, b: curves[a[:, None], b[None, :], image]
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return _saturated(top * (1 - fy[:, None]) + low * fy[:, None])


def sharpened(image: np.ndarray) -> np.ndarray:
    """Half as much again as the image, less half of its Gaussian blur of deviation 1."""
    k = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    k /= k.sum()
    a = _around(image.astype(float), 3)
    blurred = sum(w * a[i : i + image.shape[0]] for i, w in enumerate(k))
    blurred = sum(w * blurred[:, i : i + image.shape[1]] for i, w in enumerate(k))
    return _saturated(1.5 * image - 0.5 * _saturated(blurred))


def enhanced(image: np.ndarray) -> np.ndarray:
    """Brighter, and then, each where its measure asks for it: without noise, with more contrast, sharper. In grey."""
    out = scaled(gray(image))
    if laplacian(out).var() > NOISY:
        out = median(out, 5)
    if entropy(out) < FLAT:
        out = equalised(out)
    return sharpened(out) if gradient(out).mean() < SOFT else out


def prepared(image: np.ndarray, least: int = 300) -> np.ndarray:
    """For recognition: grey, without specks, black and white, and at least so many pixels high and wide."""
    _, out = otsu(median(gray(image), 3))
    factor = -(-least // max(1, min(out.shape)))
    return out.repeat(factor, axis=0).repeat(factor, axis=1) if factor > 1 else out


def _extreme(image: np.ndarray, size: int, axis: int, pick: Callable) -> np.ndarray:
    """The least or largest of the ``size`` values around each along an axis; beyond the edge there is none."""
    image = np.moveaxis(image, axis, 0)
    fill = 255 if pick is np.minimum else 0
    before, after = size // 2, size - 1 - size // 2
    a = np.concatenate([np.full((before, *image.shape[1:]), fill, np.uint8), image, np.full((after, *image.shape[1:]), fill, np.uint8)])
    have = 1
    while have < size:  # windows twice as long from two that overlap
        step = min(have, size - have)
        a = pick(a[: len(a) - step], a[step:])
        have += step
    return np.moveaxis(a, 0, axis)


def opened(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """What is bright over ``size`` pixels along an axis: 1 for lines across, 0 for lines down."""
    least = _extreme(image, size, axis, np.minimum)
    flipped = np.flip(least, axis)  # so that an even size is undone where it was done
    return np.flip(_extreme(flipped, size, axis, np.maximum), axis)


def ruled(image: np.ndarray, size: int = LINE) -> np.ndarray:
    """The mask of lines across and down, each at half strength."""
    return _saturated(0.5 * opened(image, size, 1) + 0.5 * opened(image, size, 0))


def line_density(mask: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    return float((mask[y : y + h, x : x + w] > 0).sum() / (w * h)) if w * h > 0 else 0.0


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, w, h and the number of pixels of everything that hangs together in the mask, corners included."""
    parent: list[int] = []
    found: list[list[int]] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask > 0):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here, k = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            own = len(parent)
            parent.append(own)
            found.append([a, y, b, y + 1, b - a])
            while k < len(above) and above[k][1] < a:
                k += 1
            for c, _, other in above[k:]:
                if c > b:
                    break
                i, j = sorted((root(own), root(other)))
                if i != j:
                    parent[j] = i
                    found[i] = [min(found[i][0], found[j][0]), min(found[i][1], found[j][1]), max(found[i][2], found[j][2]), max(found[i][3], found[j][3]), found[i][4] + found[j][4]]
            here.append((a, b, own))
        above = here
    return [(x0, y0, x1 - x0, y1 - y0, n) for k, (x0, y0, x1, y1, n) in enumerate(found) if parent[k] == k]


def refined(image: np.ndarray, x: int, y: int, w: int, h: int, dark: int = 200, least: int = 5) -> tuple[int, int, int, int]:
    """The box of the rows and columns of a box with more than ``least`` dark pixels; the box itself without any."""
    inside = image[y : y + h, x : x + w] < dark
    rows, columns = (np.flatnonzero(inside.sum(axis=a) > least) for a in (1, 0))
    if not len(rows) or not len(columns):
        return x, y, w, h
    return x + int(columns[0]), y + int(rows[0]), int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)


def _by_page(images: DataFrame, work: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, page, height, width, channels, data in zip(*(batch[c] for c in ("doc_id", "page_number", "height", "width", "channels", "pixels"))):
                rows += [(doc, page, *r) for r in work(pixels(data, height, width, channels))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", *names])

    return images.select("doc_id", "page_number", "height", "width", "channels", "pixels").mapInPandas(run, f"doc_id long, page_number int, {schema}")


def measures(images: DataFrame) -> DataFrame:
    """doc_id, page_number, entropy, laplacian_variance, gradient and what they ask for: noisy, flat, soft."""

    def work(image: np.ndarray) -> list[tuple]:
        g = gray(image)
        e, v, s = entropy(g), float(laplacian(g).var()), float(gradient(g).mean())
        return [(e, v, s, v > NOISY, e < FLAT, s < SOFT)]

    return _by_page(images, work, "entropy double, laplacian_variance double, gradient double, noisy boolean, flat boolean, soft boolean")


def enhance(images: DataFrame, how: Callable[[np.ndarray], np.ndarray] = enhanced) -> DataFrame:
    """Images in grey after ``enhanced`` or ``prepared``."""

    def work(image: np.ndarray) -> list[tuple]:
        out = how(image)
        return [(*out.shape, 1, out.tobytes())]

    return _by_page(images, work, "height int, width int, channels int, pixels binary")


def line_tables(images: DataFrame, size: int = LINE) -> DataFrame:
    """Boxes of ruled lines that hang together, for ``regions(..., "line_table")``: ord, x, y, w, h (refined), area, line_density."""

    def work(image: np.ndarray) -> list[tuple]:
        g = gray(image)
        mask = ruled(g, size)
        out = []
        for k, (x, y, w, h, _) in enumerate(boxes(mask)):
            out.append((k, *map(float, refined(g, x, y, w, h)), float((w - 1) * (h - 1)), line_density(mask, x, y, w, h)))
        return out

    return _by_page(images, work, "ord long, x double, y double, w double, h double, area double, line_density double")
