"""Array kernels for what Catalyst can't express: WKB, clipping to cells, hulls. Called on Arrow batches only."""

from __future__ import annotations

import struct

import numpy as np

from ecorisk.functions.spatial import AXIS, CELL, E2, ECC

POLYGON, MULTIPOLYGON = 3, 6


class GeometryError(ValueError):
    """A geometry that can't be read."""


def project(points: np.ndarray) -> np.ndarray:
    """Degrees to equal-area metres; NaN where a coordinate isn't finite."""
    lon, lat = points[:, 0], np.clip(points[:, 1], -90, 90)
    s = np.sin(np.radians(lat))
    with np.errstate(invalid="ignore", divide="ignore"):
        q = (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
        out = np.stack([AXIS * np.radians(lon), AXIS * q / 2], axis=1)
    out[~np.isfinite(points).all(axis=1)] = np.nan
    return out


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise GeometryError("truncated WKB")
        self.at += n
        return self.data[self.at - n : self.at]

    def header(self) -> tuple[str, int, int]:
        """(byte order, base type, coordinates per point) of the geometry that starts here; a stated SRID is skipped."""
        mark = self.take(1)[0]
        if mark not in (0, 1):
            raise GeometryError(f"bad byte order {mark}")
        order = "<" if mark else ">"
        (code,) = struct.unpack(order + "I", self.take(4))
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            self.take(4)
        code &= 0x1FFFFFFF
        dims += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
        return order, code % 1000 if code < 4000 else code, dims

    def count(self, order: str, least: int) -> int:
        """A count whose items, of `least` bytes each, fit in what is left."""
        (n,) = struct.unpack(order + "I", self.take(4))
        if n * least > len(self.data) - self.at:
            raise GeometryError("truncated WKB")
        return n

    def rings(self, order: str, dims: int) -> list[np.ndarray]:
        out = []
        for _ in range(self.count(order, 4)):
            n = self.count(order, 8 * dims)
            out.append(np.frombuffer(self.take(8 * dims * n), order + "f8").reshape(n, dims)[:, :2].astype(float))
        return out


def read_wkb(data: bytes) -> list[list[np.ndarray]]:
    """Polygons (rings of points, the exterior first) of a WKB Polygon or MultiPolygon: OGC, ISO or extended, Z and M dropped."""
    r = _Reader(bytes(data))
    order, kind, dims = r.header()
    if kind == POLYGON:
        return [r.rings(order, dims)]
    if kind != MULTIPOLYGON:
        raise GeometryError(f"geometry type {kind} has no area")
    out = []
    for _ in range(r.count(order, 9)):
        own, part, part_dims = r.header()
        if part != POLYGON:
            raise GeometryError(f"geometry type {part} within a MultiPolygon")
        out.append(r.rings(own, part_dims))
    return out


def write_wkb(polygons: list[list]) -> bytes:
    """Little-endian MultiPolygon."""
    parts = []
    for rings in polygons:
        body = b"".join(struct.pack("<I", len(ring)) + np.asarray(ring, "<f8").reshape(-1, 2).tobytes() for ring in rings)
        parts.append(struct.pack("<BII", 1, POLYGON, len(rings)) + body)
    return struct.pack("<BII", 1, MULTIPOLYGON, len(parts)) + b"".join(parts)


def area(ring: np.ndarray) -> float:
    """Signed shoelace area."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


#: Eastings are rounded to this part of a metre (15 nm), so that sums of their differences are exact and rings close.
LATTICE = 2.0**26


def _split(edges: np.ndarray, owner: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x0, y0, x1, y1) cut where they cross the grid's lines across an axis, with their owners."""
    a, b = edges[:, axis], edges[:, axis + 2]
    first, last = np.floor(a / CELL), np.floor(b / CELL)
    n = np.abs(last - first).astype(np.int64)
    at = np.repeat(np.arange(len(edges)), n + 1)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    up = (last >= first)[at]
    line = np.where(up, first[at] + 1 + k, first[at] - k) * CELL  # where the k-th piece of an edge ends
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (line - a[at]) / (b - a)[at]
        other = 1 - axis
        meet = edges[at, other] + t * (edges[at, other + 2] - edges[at, other])
    if other == 0:
        meet = np.round(meet * LATTICE) / LATTICE
    out, ends = edges[at], k == n[at]
    out[:, axis + 2], out[:, other + 2] = np.where(ends, out[:, axis + 2], line), np.where(ends, out[:, other + 2], meet)
    later = np.flatnonzero(k > 0)
    out[later, :2] = out[later - 1, 2:]
    return out, owner[at]


def ring_extents(points: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ring, col, row, area) of all rings at once: the area that each ring encloses in each cell, as its turns count.

    points are projected and finite, ring their rings' numbers, ascending. Each edge is cut at the grid's lines; a piece
    adds the area below it to its own cell and its width to all cells below, so that a sum down each column of cells
    gives whole cells without visiting them one by one.
    """
    points = points.copy()
    points[:, 0] = np.round(points[:, 0] * LATTICE) / LATTICE
    new = np.flatnonzero(np.diff(ring, prepend=-1))
    after = np.arange(1, len(points) + 1)
    after[np.append(new[1:], len(points)) - 1] = new
    edges, owner = _split(*_split(np.concatenate([points, points[after]], axis=1), ring, 0), 1)
    width = edges[:, 2] - edges[:, 0]
    some = width != 0
    edges, owner, width = edges[some], owner[some], width[some]
    if not len(edges):
        return owner, owner, owner, width
    middle = (edges[:, :2] + edges[:, 2:]) / 2
    col, row = (np.floor(middle[:, k] / CELL).astype(np.int64) for k in (0, 1))
    order = np.lexsort((-row, col, owner))
    owner, col, row, width, high = owner[order], col[order], row[order], -width[order], middle[order, 1]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(col, prepend=col[0]) != 0) | (np.diff(row, prepend=row[0]) != 0))
    below = np.add.reduceat(width * (high - row * CELL), first)
    whole = np.cumsum(np.add.reduceat(width, first))  # of a column's pieces the widths cancel out, so that none leaks on
    owner, col, row = owner[first], col[first], row[first]
    area_ = below + CELL * np.concatenate([[0.0], whole[:-1]])
    gap = np.zeros(len(row), np.int64)
    gap[:-1] = np.where((owner[1:] == owner[:-1]) & (col[1:] == col[:-1]) & (whole[:-1] != 0), row[:-1] - row[1:] - 1, 0)
    inside = np.repeat(np.arange(len(row)), gap)
    step = np.arange(len(inside)) - np.repeat(np.cumsum(gap) - gap, gap)
    owner, col, row = (np.concatenate([x, y]) for x, y in ((owner, owner[inside]), (col, col[inside]), (row, row[inside] - 1 - step)))
    return owner, col, row, np.abs(np.concatenate([area_, CELL * whole[inside]]))


def cells_of(points: np.ndarray, ring: np.ndarray, polygon: np.ndarray, outer: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, col, row, area): net area (exteriors less holes) of each polygon in each cell where that is positive, summed by group.

    points belong to rings by number; polygon and outer are by ring, group is by polygon.
    """
    finite = np.isfinite(points).all(axis=1)
    owner, col, row, a = ring_extents(points[finite], ring[finite])
    owner, col, row, a = _summed(polygon[owner], col, row, np.where(outer[owner], a, -a))
    some = a > 0
    return _summed(group[owner[some]], col[some], row[some], a[some])


def _summed(owner: np.ndarray, col: np.ndarray, row: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(owner):
        return owner, col, row, a
    order = np.lexsort((row, col, owner))
    owner, col, row, a = owner[order], col[order], row[order], a[order]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(col, prepend=col[0]) != 0) | (np.diff(row, prepend=row[0]) != 0))
    return owner[first], col[first], row[first], np.add.reduceat(a, first)


def cell_extents(rings: list[np.ndarray]) -> dict[tuple[int, int], float]:
    """Net area of one projected polygon (exterior less holes) in each cell where that is positive."""
    sizes = [len(r) for r in rings]
    _, col, row, a = cells_of(np.concatenate([np.empty((0, 2)), *rings]), np.repeat(np.arange(len(rings)), sizes), np.zeros(len(rings), np.int64), np.arange(len(rings)) == 0, np.zeros(1, np.int64))
    return dict(zip(zip(col.tolist(), row.tolist(), strict=True), a.tolist(), strict=True))


def hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull without collinear points. Of points on one line the two ends stay, so that hulls of
    parts can be merged in any order."""
    points = points[np.isfinite(points).all(axis=1)]
    if len(points) > 64:
        points = points[~_well_inside(points)]
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(some):
        out: list = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(points.tolist()), half(points[::-1].tolist())
    return np.array(lower[:-1] + upper[:-1])


def _well_inside(points: np.ndarray) -> np.ndarray:
    """Which points lie within the octagon of the extreme points in eight directions, and so can't be corners of the hull."""
    x, y = points[:, 0], points[:, 1]
    ends = points[[v.argmin() for v in (x, x + y, y, y - x, -x, -x - y, -y, x - y)]]  # counter-clockwise from the west
    inside = np.ones(len(points), bool)
    for p, q in zip(ends, np.roll(ends, -1, axis=0), strict=True):
        if (p != q).any():
            inside &= (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) > 0
    return inside & bool((ends != ends[0]).any())
