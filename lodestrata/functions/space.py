"""Intersection in space: points, lines and planar polygons with heights (0 where there are none)."""

from __future__ import annotations

import math

from lodestrata.functions import wkt
from lodestrata.functions.predicates import EPS, OUT, _in_polygon

Point = tuple[float, float, float]


def _sub(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def _dot(a: Point, b: Point) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


class _Face:
    """A planar polygon: its plane, and its rings in the two axes in which it is widest."""

    def __init__(self, rings: list[list[Point]]):
        self.rings = rings
        n = (0.0, 0.0, 0.0)
        for a, b in zip(rings[0], rings[0][1:], strict=False):
            c = _cross(a, b)
            n = (n[0] + c[0], n[1] + c[1], n[2] + c[2])
        size = math.sqrt(_dot(n, n)) or 1.0
        self.normal = (n[0] / size, n[1] / size, n[2] / size)
        self.axes = sorted(range(3), key=lambda k: abs(self.normal[k]))[:2]
        self.flat = [[self.project(p) for p in r] for r in rings]
        self.edges = [(a, b) for r in rings for a, b in zip(r, r[1:], strict=False)]

    def project(self, p: Point) -> tuple[float, float]:
        return p[self.axes[0]], p[self.axes[1]]

    def height(self, p: Point) -> float:
        return _dot(self.normal, _sub(p, self.rings[0][0]))

    def has(self, p: Point) -> bool:
        return abs(self.height(p)) <= EPS * max(1.0, *map(abs, p)) and _in_polygon(self.project(p), self.flat) != OUT


def _segments_meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether the nearest points of two segments (or points) are one."""
    u, v, w = _sub(b, a), _sub(d, c), _sub(a, c)
    uu, uv, vv, uw, vw = _dot(u, u), _dot(u, v), _dot(v, v), _dot(u, w), _dot(v, w)
    den = uu * vv - uv * uv
    clamp = lambda x: min(1.0, max(0.0, x))
    s = clamp((uv * vw - vv * uw) / den) if den > 1e-15 * max(1.0, uu * vv) else 0.0
    t = clamp((uv * s + vw) / vv) if vv else 0.0
    s = clamp((uv * t - uw) / uu) if uu else 0.0
    p = tuple(w[k] + s * u[k] - t * v[k] for k in range(3))
    return math.sqrt(_dot(p, p)) <= EPS * max(1.0, *(abs(x) for q in (a, b, c, d) for x in q))


def _segment_meets_face(a: Point, b: Point, f: _Face) -> bool:
    if f.has(a) or f.has(b):
        return True
    ha, hb = f.height(a), f.height(b)
    if (ha > 0) != (hb > 0) and ha != hb:
        t = ha / (ha - hb)
        if f.has(tuple(a[k] + t * (b[k] - a[k]) for k in range(3))):
            return True
    return any(_segments_meet(a, b, c, d) for c, d in f.edges)


def _parts(g: wkt.Geometry) -> tuple[list[tuple[Point, Point]], list[_Face]]:
    """Segments (a point is one of no length) and faces."""
    kind, v = g
    if not v:
        return [], []
    high = lambda c: (float(c[0]), float(c[1]), float(c[2]) if len(c) > 2 else 0.0)
    line = lambda x: [(high(p), high(q)) for p, q in zip(x, x[1:], strict=False)]
    face = lambda x: _Face([[high(p) for p in r] for r in x])
    match kind:
        case "Point":
            return [(high(v), high(v))], []
        case "MultiPoint":
            return [(high(p), high(p)) for p in v], []
        case "LineString":
            return line(v), []
        case "MultiLineString":
            return [s for x in v for s in line(x)], []
        case "Polygon":
            return [], [face(v)]
        case "MultiPolygon":
            return [], [face(x) for x in v]
    found = [_parts(p) for p in v]
    return [s for p, _ in found for s in p], [f for _, p in found for f in p]


def intersects(a: wkt.Geometry, b: wkt.Geometry) -> bool:
    """Whether two geometries share a point in space."""
    (lines, faces), (others, walls) = _parts(a), _parts(b)
    return (
        any(_segments_meet(*s, *t) for s in lines for t in others)
        or any(_segment_meets_face(*s, f) for s in lines for f in walls)
        or any(_segment_meets_face(*s, f) for s in others for f in faces)
        or any(_segment_meets_face(*s, w) for f in faces for w in walls for s in f.edges)
        or any(_segment_meets_face(*s, f) for f in faces for w in walls for s in w.edges)
    )
