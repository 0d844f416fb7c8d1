"""Pixel kernels in numpy, and the Arrow functions that run them on columns of images.

An image is height x width x 3 bytes in blue, green, red order, or height x width in grey.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image.astype(np.float64)
    return np.rint(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299)


def otsu(values: np.ndarray) -> int:
    """The level that best separates two classes of 8-bit values: the first one with the largest variance between."""
    histogram = np.bincount(np.asarray(values, np.uint8).ravel(), minlength=256).astype(np.float64)
    total = histogram.sum()
    if not total:
        return 0
    weight, mass = np.cumsum(histogram), np.cumsum(histogram * np.arange(256))
    rest = total - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((weight > 0) & (rest > 0), weight * rest * (mass / weight - (mass[-1] - mass) / rest) ** 2, 0.0)
    return int(between.argmax())


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Mean over size x size neighbourhoods, edges mirrored, by an integral image."""
    pad = size // 2
    p = np.pad(image.astype(np.float64), pad, mode="reflect" if min(image.shape) > pad else "edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = image.shape
    return (s[size : size + h, size : size + w] - s[:h, size : size + w] - s[size : size + h, :w] + s[:h, :w]) / (size * size)


def adaptive_mask(image: np.ndarray, size: int = 15, offset: float = 10) -> np.ndarray:
    """Ink: pixels darker than their neighbourhood's mean by the offset."""
    return image < box_mean(image, size) - offset


def median_filter(image: np.ndarray, size: int) -> np.ndarray:
    pad = size // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="edge"), (size, size))
    return np.median(view, axis=(2, 3))


def _spread(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Each place with its neighbours along an axis: size in all, the middle one (or the one behind it) included."""
    if axis:
        return np.ascontiguousarray(_spread(np.ascontiguousarray(mask.T), size, 0).T)
    n, reach = mask.shape[0], 1
    out = np.zeros((n + size - 1, mask.shape[1]), mask.dtype)
    out[size // 2 : size // 2 + n] = mask
    while reach < size:  # each row holds the next ones up to its reach
        step = min(reach, size - reach)
        out = out[: len(out) - step] | out[step:]
        reach += step
    return out


def dilate(mask: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return _spread(_spread(mask, rows, 0), columns, 1)


def erode(mask: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return ~dilate(~mask, rows, columns)


def close(mask: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return erode(dilate(mask, rows, columns), rows, columns)


def opened(mask: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return dilate(erode(mask, rows, columns), rows, columns)


def components(mask: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """Labels from 1 of 8-connected ink, in reading order, and (x, y, w, h, area) of each.

    Rows are cut into runs of ink; runs that touch in the next row are joined by passing the least
    number on until nothing changes.
    """
    height, width = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    if not len(y):
        return np.zeros(mask.shape, np.int32), []
    line = width + 2
    low = np.searchsorted(y * line + end, (y + 1) * line + start, "left")
    high = np.searchsorted(y * line + start, (y + 1) * line + end, "right")
    many = np.maximum(0, high - low)
    a = np.repeat(np.arange(len(y)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    label = np.arange(len(y))
    while True:
        least = np.minimum(label[a], label[b])
        passed = label.copy()
        for runs in (a, b):
            np.minimum.at(passed, runs, least)
            np.minimum.at(passed, label[runs], least)
        passed = passed[passed]
        if (passed == label).all():
            break
        label = passed
    _, label = np.unique(label, return_inverse=True)
    n, sizes = int(label.max()) + 1, end - start
    x0, y0, x1, y1, area = np.full(n, width), np.full(n, height), np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(x0, label, start)
    np.minimum.at(y0, label, y)
    np.maximum.at(x1, label, end)
    np.maximum.at(y1, label, y + 1)
    np.add.at(area, label, sizes)
    labels = np.zeros(height * width, np.int32)
    labels[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - y * width - start, sizes)] = np.repeat(label + 1, sizes)
    return labels.reshape(mask.shape), list(zip(x0.tolist(), y0.tolist(), (x1 - x0).tolist(), (y1 - y0).tolist(), area.tolist(), strict=True))


#: Corners of the windows that show each pixel its neighbours, from north on clockwise.
_RING = ((0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0))


def _borders() -> list[np.ndarray]:
    """For each of the two turns, by the bits of the ring: whether a border pixel goes."""
    ring = (np.arange(256)[:, None] >> np.arange(8)) & 1 == 1
    count, steps = ring.sum(axis=1), (~ring & np.roll(ring, -1, axis=1)).sum(axis=1)
    north, east, south, west = (ring[:, i] for i in (0, 2, 4, 6))
    sides = ~(north & east & south) & ~(east & south & west), ~(north & east & west) & ~(north & south & west)
    return [((count >= 2) & (count <= 6) & (steps == 1) & side).astype(np.uint8) for side in sides]


_BORDERS = _borders()


def thinned(mask: np.ndarray) -> np.ndarray:
    """Lines of one pixel: border pixels go, from two sides in turn, as long as nothing comes apart (Zhang and Suen)."""
    out = np.pad(mask, 1).astype(np.uint8)
    inner = out[1:-1, 1:-1]
    while True:
        gone = False
        for goes in _BORDERS:
            ring = np.zeros(inner.shape, np.uint8)
            for i, (y, x) in enumerate(_RING):
                ring |= out[y : y + inner.shape[0], x : x + inner.shape[1]] << i
            drop = inner & goes[ring]
            gone |= bool(drop.any())
            inner ^= drop
        if not gone:
            return inner.astype(bool)


def smooth(image: np.ndarray, size: int) -> np.ndarray:
    """Two box means: close to a Gaussian of the size."""
    size = max(1, min(size, 2 * (min(image.shape) // 2) - 1)) | 1
    return box_mean(box_mean(image, size), size)


def gradient(gray: np.ndarray) -> np.ndarray:
    """Steepness of grey values over three pixels."""
    p = np.pad(gray.astype(np.float64), 1, mode="edge")
    x = (p[:-2, 2:] - p[:-2, :-2]) + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + (p[2:, 2:] - p[2:, :-2])
    y = (p[2:, :-2] - p[:-2, :-2]) + 2 * (p[2:, 1:-1] - p[:-2, 1:-1]) + (p[2:, 2:] - p[:-2, 2:])
    return np.hypot(x, y)


def local_contrast(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation tile by tile, each histogram clipped, levels blended between tile centres."""
    h, w = gray.shape
    tiles = max(1, min(tiles, h // 4, w // 4))
    g = np.clip(np.rint(gray), 0, 255).astype(int)
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    levels = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            histogram = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * part.size / 256)
            over = np.maximum(histogram - most, 0).sum()
            levels[i, j] = np.cumsum(np.minimum(histogram, most) + over / 256) * 255 / max(1, part.size)

    def places(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(np.interp(np.arange(n) + 0.5, (edges[:-1] + edges[1:]) / 2, np.arange(tiles)), 0, tiles - 1)
        low = np.minimum(at.astype(int), tiles - 1)
        return low, np.minimum(low + 1, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(ys, h), places(xs, w)
    out = np.empty(gray.shape)
    blocks = lambda low, high: np.flatnonzero(np.r_[True, (np.diff(low) != 0) | (np.diff(high) != 0), True])
    down, across = blocks(y0, y1), blocks(x0, x1)
    for top, bottom in zip(down[:-1], down[1:], strict=True):
        f = fy[top:bottom, None]
        for left, right in zip(across[:-1], across[1:], strict=True):
            part, e = g[top:bottom, left:right], fx[left:right]
            at = lambda a, b: levels[a[top], b[left]].take(part)  # noqa: B023, E731
            out[top:bottom, left:right] = (at(y0, x0) * (1 - e) + at(y0, x1) * e) * (1 - f) + (at(y1, x0) * (1 - e) + at(y1, x1) * e) * f
    return out


def outline(mask: np.ndarray) -> np.ndarray:
    """Convex hull of a mask's pixels as points (x, y), by the ends of its rows."""
    ys = np.flatnonzero(mask.any(axis=1))
    if not len(ys):
        return np.zeros((0, 2))
    left, right = mask[ys].argmax(axis=1), mask.shape[1] - 1 - mask[ys][:, ::-1].argmax(axis=1)
    points = sorted({*zip(left.tolist(), ys.tolist(), strict=True), *zip(right.tolist(), ys.tolist(), strict=True)})
    chains = []
    for run in (points, points[::-1]):
        chain: list[tuple[int, int]] = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains += chain[:-1] if len(chain) > 1 else chain
    return np.array(chains, float)


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def roundness(mask: np.ndarray) -> float:
    """4 pi area / perimeter^2 of a mask's convex hull: 1 for a disc, 0 for a line or nothing."""
    hull = outline(mask)
    length = float(np.hypot(*(np.roll(hull, -1, axis=0) - hull).T).sum())
    return 4 * np.pi * polygon_area(hull) / length**2 if length else 0.0


def four_corners(hull: np.ndarray, most_added: float = 0.08) -> np.ndarray | None:
    """The quadrilateral around a convex outline; none if that is much larger.

    Sides are left out one by one, the one first whose neighbours meet with the least area added.
    """
    if len(hull) < 4:
        return None
    points, whole = [tuple(p) for p in hull.tolist()], polygon_area(hull)
    while len(points) > 4:
        n, best = len(points), None
        for i in range(n):
            (ax, ay), (bx, by), (cx, cy), (dx, dy) = points[i - 1], points[i], points[(i + 1) % n], points[(i + 2) % n]
            ux, uy, vx, vy = bx - ax, by - ay, cx - dx, cy - dy
            det = ux * vy - uy * vx
            if abs(det) < 1e-9:
                continue
            t, s = ((dx - ax) * vy - (dy - ay) * vx) / det, ((dx - ax) * uy - (dy - ay) * ux) / det
            if t < 1 or s < 1:
                continue
            x, y = ax + t * ux, ay + t * uy
            added = abs((cx - bx) * (y - by) - (cy - by) * (x - bx))
            if best is None or added < best[0]:
                best = added, i, (x, y)
        if best is None:
            return None
        points[best[1]] = best[2]
        points.pop((best[1] + 1) % n)
    quad = np.array(points)
    return in_order(quad) if whole and polygon_area(quad) <= (1 + most_added) * whole else None


def tightest_rectangle(hull: np.ndarray) -> np.ndarray:
    """The rectangle of least area around an outline; one of its sides lies on a side of the outline."""
    best = None
    for edge in np.roll(hull, -1, axis=0) - hull:
        length = np.hypot(*edge)
        if not length:
            continue
        turn = np.array([[edge[0], edge[1]], [-edge[1], edge[0]]]) / length
        p = hull @ turn.T
        low, high = p.min(axis=0), p.max(axis=0)
        area = float(np.prod(high - low))
        if best is None or area < best[0] - 1e-9:
            corners = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]])
            best = area, corners @ turn
    return in_order(best[1]) if best else np.repeat(hull[:1], 4, axis=0)


def in_order(quad: np.ndarray) -> np.ndarray:
    """Corners as top left, top right, bottom right, bottom left."""
    total, difference = quad.sum(axis=1), quad[:, 0] - quad[:, 1]
    return quad[[total.argmin(), difference.argmax(), total.argmax(), difference.argmin()]].astype(float)


def is_rectangular(quad: np.ndarray, most: float = 0.35) -> bool:
    """Whether no corner's cosine is beyond the limit, and all corners differ."""
    if len({tuple(p) for p in quad.tolist()}) < 4:
        return False
    a, c = np.roll(quad, 1, axis=0) - quad, np.roll(quad, -1, axis=0) - quad
    size = np.hypot(*a.T) * np.hypot(*c.T)
    return bool((np.abs((a * c).sum(axis=1)) < most * size + 1e-9).all())


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Morphological skeleton: what each opening by a 3 x 3 cross takes away, as the mask is worn down."""
    out, left = np.zeros_like(mask), mask.copy()
    while left.any():
        worn = ~_grow(np.pad(~left, 1, constant_values=True))[1:-1, 1:-1]
        out |= left & ~_grow(worn)
        left = worn
    return out


def _grow(m: np.ndarray) -> np.ndarray:
    p = np.pad(m, 1)
    return m | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation of two patches of one shape; 0 for flat ones."""
    a, b = a.astype(np.float64) - a.mean(), b.astype(np.float64) - b.mean()
    size = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / size) if size > 0 else 0.0


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The projective map that takes four points to four points."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, float), np.asarray(target, float).ravel()), 1).reshape(3, 3)


def warp(image: np.ndarray, quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quad (top left, top right, bottom right, bottom left) as an upright image, by nearest pixels."""
    corners = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    inverse = homography(corners, np.asarray(quad, float))
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    p = inverse @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u = np.clip(np.rint(p[0] / p[2]).astype(int), 0, image.shape[1] - 1)
    v = np.clip(np.rint(p[1] / p[2]).astype(int), 0, image.shape[0] - 1)
    return image[v, u].reshape(height, width, *image.shape[2:])


def rotate(image: np.ndarray, degrees: float, whole: bool = False) -> np.ndarray:
    """Rotation about the centre, size kept and edges repeated.

    A ``whole`` image gets a larger one that holds all of it, around it the median colour of its edges (what
    lies at an edge would be drawn out into a streak there).
    """
    h, w = image.shape[:2]
    t = np.deg2rad(degrees)
    c, s = abs(np.cos(t)), abs(np.sin(t))
    rows, columns = (int(np.ceil(c * h + s * w)), int(np.ceil(c * w + s * h))) if whole else (h, w)
    dx, dy = np.arange(columns)[None, :] - (columns - 1) / 2, np.arange(rows)[:, None] - (rows - 1) / 2
    u = np.rint(np.cos(t) * dx - np.sin(t) * dy + (w - 1) / 2).astype(int)
    v = np.rint(np.sin(t) * dx + np.cos(t) * dy + (h - 1) / 2).astype(int)
    out = image[np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)]
    if whole:
        out[(u < 0) | (u >= w) | (v < 0) | (v >= h)] = np.median(np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]]), axis=0)
    return out


def _turned_rows(mask: np.ndarray, degrees: float) -> np.ndarray:
    """Row sums of rotate(mask, degrees); only the part where ink may come to lie is made, if none touches the edges."""
    h, w = mask.shape
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(ys) or ys[0] == 0 or xs[0] == 0 or ys[-1] == h - 1 or xs[-1] == w - 1:
        return rotate(mask, degrees).sum(axis=1)
    t = np.deg2rad(degrees)
    x, y = np.array([xs[0], xs[-1]] * 2) - (w - 1) / 2, np.repeat([ys[0], ys[-1]], 2) - (h - 1) / 2
    u, v = np.cos(t) * x + np.sin(t) * y + (w - 1) / 2, np.cos(t) * y - np.sin(t) * x + (h - 1) / 2
    left, right = (int(np.clip(n, 0, w)) for n in (u.min() - 2, u.max() + 3))
    top, bottom = (int(np.clip(n, 0, h)) for n in (v.min() - 2, v.max() + 3))
    dx, dy = np.arange(left, right)[None, :] - (w - 1) / 2, np.arange(top, bottom)[:, None] - (h - 1) / 2
    u = np.clip(np.rint(np.cos(t) * dx - np.sin(t) * dy + (w - 1) / 2).astype(int), 0, w - 1)
    v = np.clip(np.rint(np.sin(t) * dx + np.cos(t) * dy + (h - 1) / 2).astype(int), 0, h - 1)
    out = np.zeros(h, np.int64)
    out[top:bottom] = mask[v, u].sum(axis=1)
    return out


def skew(mask: np.ndarray, most: float = 10.0, step: float = 0.5) -> float:
    """The turn, within limits, that makes row sums of ink most uneven (upright lines).

    First the ink alone is turned, to the rows that it lies in then; the whole mask only by the best of those
    turns and the ones beside it, if these come near (half of its unevenness or more).
    """
    turns = np.arange(-most, most + step / 2, step)
    y, x = np.nonzero(mask)
    x, y, reach = x - (mask.shape[1] - 1) / 2, y - (mask.shape[0] - 1) / 2, sum(mask.shape)

    def rows(turn: float) -> np.ndarray:
        t = np.deg2rad(turn)
        return np.bincount((np.cos(t) * y - np.sin(t) * x + (reach + 0.5)).astype(np.int64), minlength=2 * reach + 2)

    uneven = lambda sums: float(np.square(np.diff(sums.astype(float))).sum())
    rough = np.array([uneven(rows(t)) for t in turns])
    first = min(np.flatnonzero(rough == rough.max()), key=lambda i: abs(turns[i]))
    near = turns[(np.abs(np.arange(len(turns)) - first) <= 1) & (rough >= 0.5 * rough[first])] if len(x) else turns[[first]]
    sharp = [uneven(_turned_rows(mask, t)) for t in near] if len(near) > 1 else [0.0]
    best = max(sharp)
    return float(min((t for t, s in zip(near, sharp, strict=True) if s == best), key=abs))


def crop_ink(mask: np.ndarray, pad: float = 0.06) -> np.ndarray:
    """The ink's box with a margin, inside the image; the whole image if there is no ink."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return mask
    py, px = int(pad * mask.shape[0]), int(pad * mask.shape[1])
    return mask[max(0, ys.min() - py) : ys.max() + 1 + py, max(0, xs.min() - px) : xs.max() + 1 + px]


def shrunk(mask: np.ndarray, h: int, w: int, nearest: bool = False) -> np.ndarray:
    """A mask at another, no larger size: shares of ink, or the ink at each place's middle."""
    rows, columns = mask.shape
    if nearest:
        return mask[((np.arange(h) + 0.5) * rows / h).astype(int)][:, ((np.arange(w) + 0.5) * columns / w).astype(int)].astype(float)
    total = np.pad(mask.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, x0 = (np.arange(h) * rows / h).astype(int), (np.arange(w) * columns / w).astype(int)
    y1, x1 = np.maximum(y0 + 1, (np.arange(1, h + 1) * rows / h).astype(int)), np.maximum(x0 + 1, (np.arange(1, w + 1) * columns / w).astype(int))
    part = lambda y, x: total[y[:, None], x[None, :]]
    return (part(y1, x1) - part(y0, x1) - part(y1, x0) + part(y0, x0)) / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def to_tensor(mask: np.ndarray, side: int = 28, inner: int = 20, grow: int = 0, nearest: bool = False, blur: bool = False) -> np.ndarray:
    """Ink on a side x side field in [0, 1], never enlarged, its centroid moved to the middle by at most 2.

    ``grow`` widens the strokes first, ``nearest`` takes single pixels instead of shares, ``blur`` softens the result.
    """
    if grow:
        mask = dilate(np.pad(mask, grow), 2 * grow + 1, 2 * grow + 1)
    scale = min(1.0, inner / max(1, *mask.shape))
    h, w = max(1, round(mask.shape[0] * scale)), max(1, round(mask.shape[1] * scale))
    small = shrunk(mask, h, w, nearest)
    out = np.zeros((side, side))
    top, left = (side - h) // 2, (side - w) // 2
    out[top : top + h, left : left + w] = small[:side, :side]
    if blur:
        out = box_mean(out, 3) * 0.5 + out * 0.5
    if out.sum():
        y, x = np.mgrid[:side, :side]
        dy = int(np.clip(np.rint((side - 1) / 2 - (out * y).sum() / out.sum()), -2, 2))
        dx = int(np.clip(np.rint((side - 1) / 2 - (out * x).sum() / out.sum()), -2, 2))
        out = np.roll(out, (dy, dx), axis=(0, 1))
    return np.clip(out, 0.0, 1.0)


def _mask_of(values, side: int, least: float) -> np.ndarray:
    return np.asarray(values, np.float64).reshape(side, side) > least


def tile_components(values: Column, side: int, least: float = 0.0) -> Column:
    """Components of square tiles: array of (x, y, w, h, area)."""
    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("x", "y", "w", "h", "area")]))

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: [dict(zip(("x", "y", "w", "h", "area"), c, strict=True)) for c in components(_mask_of(v, side, least))[1]])

    return run(values)


def tile_otsu(values: Column) -> Column:
    """Otsu's level of a tile scaled to its own 8-bit range."""

    @F.pandas_udf(T.LongType())
    def run(column: pd.Series) -> pd.Series:
        def level(v):
            a = np.asarray(v, np.float64)
            span = a.max() - a.min()
            return otsu(np.rint((a - a.min()) / span * 255) if span > 0 else np.zeros(len(a)))

        return column.map(level)

    return run(values)


def tile_ncc(values: Column, template: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ncc(np.asarray(x), np.asarray(y)) for x, y in zip(a, b, strict=True)])

    return run(values, template)


def onnx_classes(path: str):
    """A column function that runs an ONNX classifier on arrays, the model opened once for each worker."""
    sessions: dict[str, object] = {}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            if path not in sessions:
                import onnxruntime

                sessions[path] = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
            session = sessions[path]
            data = np.stack([np.asarray(v, np.float32) for v in column]) if len(column) else np.zeros((0, 1), np.float32)
            out = session.run(None, {session.get_inputs()[0].name: data})[0] if len(column) else data
            yield pd.Series(list(out.astype(np.float64)))

    return run
