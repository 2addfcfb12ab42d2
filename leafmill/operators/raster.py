"""Paths to coverage: flattening, strokes, dashes and anti-aliased scanline fills, on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

Point = tuple[float, float]


class Path:
    """Sub-paths of points with curves already flattened in device space."""

    def __init__(self):
        self.subs: list[tuple[list[Point], bool]] = []
        self.now: list[Point] = []

    def move(self, x: float, y: float) -> None:
        self.end()
        self.now = [(x, y)] if math.isfinite(x) and math.isfinite(y) else []

    def line(self, x: float, y: float) -> None:
        if math.isfinite(x) and math.isfinite(y):
            self.now.append((x, y))

    def curve(self, p1: Point, p2: Point, p3: Point) -> None:
        """A cubic, cut so that it stays within a tenth of a pixel."""
        if not self.now or not all(map(math.isfinite, (*p1, *p2, *p3))):
            return
        p0 = self.now[-1]
        bend = max(abs(p0[k] - 2 * p1[k] + p2[k]) for k in (0, 1)) + max(abs(p1[k] - 2 * p2[k] + p3[k]) for k in (0, 1))
        n = max(1, min(64, math.ceil(math.sqrt(bend * 0.75 / 0.1))))
        t = np.arange(1, n + 1) / n
        u = 1 - t
        xy = [u**3 * p0[k] + 3 * u * u * t * p1[k] + 3 * u * t * t * p2[k] + t**3 * p3[k] for k in (0, 1)]
        self.now += list(zip(xy[0].tolist(), xy[1].tolist()))

    def close(self) -> None:
        if self.now:
            first = self.now[0]
            self.subs.append((self.now, True))
            self.now = [first]

    def end(self) -> None:
        if len(self.now) > 1:
            self.subs.append((self.now, False))
        self.now = []

    def polylines(self) -> list[tuple[list[Point], bool]]:
        return self.subs + ([(self.now, False)] if len(self.now) > 1 else [])


def coverage(polygons: list[list[Point]], width: int, height: int, even_odd: bool = False, scans: int = 4) -> np.ndarray:
    """uint8 coverage (height, width): `scans` lines a pixel, exact along x."""
    edges = []
    for poly in polygons:
        p = np.asarray(poly, float)
        if len(p) < 2:
            continue
        q = np.roll(p, -1, axis=0)
        keep = p[:, 1] != q[:, 1]
        if keep.any():
            edges.append(np.concatenate([p[keep], q[keep]], axis=1))
    out = np.zeros((height, width), np.float32)
    if not edges:
        return out.astype(np.uint8)
    e = np.concatenate(edges)
    up = e[:, 1] > e[:, 3]
    sign = np.where(up, -1, 1)
    e[up] = e[up][:, [2, 3, 0, 1]]
    lo = max(0, math.floor(e[:, 1].min()))
    hi = min(height, math.ceil(e[:, 3].max()))
    for row in range(lo, hi):
        near = (e[:, 1] < row + 1) & (e[:, 3] > row)
        if not near.any():
            continue
        own, turn = e[near], sign[near]
        for k in range(scans):
            y = row + (k + 0.5) / scans
            cut = (own[:, 1] <= y) & (own[:, 3] > y)
            if not cut.any():
                continue
            c = own[cut]
            x = c[:, 0] + (y - c[:, 1]) * (c[:, 2] - c[:, 0]) / (c[:, 3] - c[:, 1])
            order = np.argsort(x, kind="stable")
            x = np.clip(x[order], 0, width)
            wind = np.cumsum(turn[cut][order])
            inside = (np.arange(1, len(x) + 1) % 2 == 1) if even_odd else wind != 0
            for i in np.flatnonzero(inside[:-1]):
                _span(out[row], x[i], x[i + 1])
    return np.minimum(out * (255 / scans) + 0.5, 255).astype(np.uint8)


def _span(line: np.ndarray, a: float, b: float) -> None:
    if b <= a:
        return
    i, j = int(a), int(b)
    if i == j:
        line[i] += b - a
        return
    line[i] += i + 1 - a
    line[i + 1 : j] += 1
    if j < len(line):
        line[j] += b - j


def dashed(points: list[Point], closed: bool, pattern: list[float], phase: float) -> list[list[Point]]:
    """The painted pieces of a polyline; odd patterns run on into their second round."""
    lengths = [max(0.0, v) for v in pattern]
    total = sum(lengths)
    if not lengths or total <= 0 or not math.isfinite(total):
        return [points + points[:1] if closed else points]
    lengths = lengths * 2 if len(lengths) % 2 else lengths
    left = math.fmod(max(0.0, phase), sum(lengths))
    k = 0
    while left >= lengths[k]:
        left -= lengths[k]
        k = (k + 1) % len(lengths)
    left = lengths[k] - left
    out: list[list[Point]] = []
    now = [points[0]] if k % 2 == 0 else []
    path = points + points[:1] if closed else points
    for (x0, y0), (x1, y1) in zip(path, path[1:]):
        size = math.hypot(x1 - x0, y1 - y0)
        at = 0.0
        while size - at > left:
            at += left
            p = (x0 + (x1 - x0) * at / size, y0 + (y1 - y0) * at / size)
            if k % 2 == 0:
                out.append([*now, p])
                now = []
            else:
                now = [p]
            k = (k + 1) % len(lengths)
            left = lengths[k]
            if len(out) > 100_000:
                return out
        left -= size - at
        if k % 2 == 0:
            now.append((x1, y1))
    if len(now) > 1:
        out.append(now)
    return out


def _disc(x: float, y: float, r: float) -> list[Point]:
    n = max(8, min(64, int(r * 4)))
    return [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]


def stroke(points: list[Point], closed: bool, width: float, cap: int = 0, join: int = 0, miter: float = 10.0) -> list[list[Point]]:
    """Polygons whose nonzero union is the stroke: one for each segment, join and cap, all of one turn."""
    r, pts = width / 2, [points[0]]
    for p in points[1:]:
        if math.hypot(p[0] - pts[-1][0], p[1] - pts[-1][1]) > 1e-9:
            pts.append(p)
    if closed and len(pts) > 1 and math.hypot(pts[0][0] - pts[-1][0], pts[0][1] - pts[-1][1]) <= 1e-9:
        pts.pop()
    if len(pts) == 1:
        x, y = pts[0]
        return [_disc(x, y, r)] if cap == 1 else [[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]] if cap == 2 else []
    ring = pts + pts[:1] if closed else pts
    out, normals = [], []
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(ring, ring[1:])):
        size = math.hypot(x1 - x0, y1 - y0)
        ux, uy = (x1 - x0) / size, (y1 - y0) / size
        if cap == 2 and not closed:
            if i == 0:
                x0, y0 = x0 - ux * r, y0 - uy * r
            if i == len(ring) - 2:
                x1, y1 = x1 + ux * r, y1 + uy * r
        nx, ny = -uy * r, ux * r
        normals.append((nx, ny))
        out.append([(x0 + nx, y0 + ny), (x0 - nx, y0 - ny), (x1 - nx, y1 - ny), (x1 + nx, y1 + ny)])
    corners = range(len(normals)) if closed else range(1, len(normals))
    for i in corners:
        x, y = ring[i]
        (ax, ay), (bx, by) = normals[i - 1], normals[i]
        turn = ax * by - ay * bx
        if join == 1:
            out.append(_disc(x, y, r))
            continue
        if abs(turn) < 1e-12:
            continue
        s = -1 if turn > 0 else 1
        a, b = (x + s * ax, y + s * ay), (x + s * bx, y + s * by)
        poly = [(x, y), a, b]
        dot = (ax * bx + ay * by) / (r * r)
        half = math.sqrt(max(0.0, (1 + dot) / 2))
        if join == 0 and half > 1e-9 and 1 / half <= miter:
            mx, my = ax + bx, ay + by
            k = s / (half * half * 2)
            poly = [(x, y), a, (x + mx * k, y + my * k), b]
        out.append(poly)
    if cap == 1 and not closed:
        out += [_disc(*pts[0], r), _disc(*pts[-1], r)]
    return [p if _area(p) >= 0 else p[::-1] for p in out]


def _area(p: list[Point]) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1]))


def blend_rgb(back: np.ndarray, src: np.ndarray, mode: str) -> np.ndarray:
    """Blend modes on float32 arrays (..., 3) of 0 .. 1."""
    one, two, half = np.float32(1), np.float32(2), np.float32(0.5)

    def hard(b, s):
        t = two * s - one
        return np.where(s <= half, b * (two * s), b + t - b * t)

    def lum(c):
        return c @ np.array([0.3, 0.59, 0.11], np.float32)

    def set_lum(c, light):
        c = c + (light - lum(c))[..., None]
        mid = lum(c)[..., None]
        low, high = c.min(-1, keepdims=True), c.max(-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(low < 0, np.where(mid - low > 1e-9, mid + (c - mid) * mid / (mid - low), mid), c)
            return np.where(high > 1, np.where(high - mid > 1e-9, mid + (c - mid) * (one - mid) / (high - mid), mid), c)

    def set_sat(c, s):
        low, high = c.min(-1, keepdims=True), c.max(-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(high > low, (c - low) * s[..., None] / (high - low), 0).astype(np.float32)

    sat = lambda c: c.max(-1) - c.min(-1)
    b, s = back, src
    with np.errstate(divide="ignore", invalid="ignore"):
        made = {
            "Multiply": lambda: b * s, "Screen": lambda: b + s - b * s, "Overlay": lambda: hard(s, b), "Darken": lambda: np.minimum(b, s),
            "Lighten": lambda: np.maximum(b, s), "ColorDodge": lambda: np.where(s >= one, one, np.minimum(b / (one - s), one)),
            "ColorBurn": lambda: np.where(s <= 0, 0, one - np.minimum((one - b) / s, one)), "HardLight": lambda: hard(b, s),
            "SoftLight": lambda: np.where(s <= half, b - (one - two * s) * b * (one - b), b + (two * s - one) * (np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b)) - b)),
            "Difference": lambda: np.abs(b - s), "Exclusion": lambda: b + s - two * b * s,
            "Hue": lambda: set_lum(set_sat(s, sat(b)), lum(b)), "Saturation": lambda: set_lum(set_sat(b, sat(s)), lum(b)),
            "Color": lambda: set_lum(s, lum(b)), "Luminosity": lambda: set_lum(b, lum(s)),
        }.get(mode, lambda: s)()
    return np.clip(made, 0, 1).astype(np.float32)
