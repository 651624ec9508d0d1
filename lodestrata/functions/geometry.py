"""Geometry columns: WKT text, with Arrow UDFs for what Spark's own functions cannot express."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import crs as C
from lodestrata.functions import predicates, wkt


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])


@F.pandas_udf(_BOX)
def bbox(geometry: pd.Series) -> pd.DataFrame:
    """Box of each geometry; nulls for null and empty ones."""
    rows = [(wkt.bbox(wkt.parse(g)) if g else None) or (None,) * 4 for g in geometry]
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")


_BOX_3D = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")])


@F.pandas_udf(_BOX_3D)
def bbox_3d(geometry: pd.Series) -> pd.DataFrame:
    """Box of each geometry with heights (0 where there are none); nulls for null and empty ones."""
    rows = [(wkt.bbox_3d(wkt.parse(g)) if g else None) or (None,) * 6 for g in geometry]
    return pd.DataFrame(rows, columns=_BOX_3D.names, dtype="float64")


def spatial(op: str, geometry: Column, literal: wkt.Geometry) -> Column:
    """A predicate between a WKT column and one literal geometry."""
    text = wkt.to_wkt(literal)

    @F.pandas_udf("boolean")
    def test(g: pd.Series) -> pd.Series:
        other = wkt.parse(text)
        return pd.Series([None if x is None else predicates.evaluate(op, wkt.parsed(x), other) for x in g], dtype="boolean")

    return test(geometry)


def spatial_columns(op: str, a: Column, b: Column) -> Column:
    """A predicate between two WKT columns."""

    @F.pandas_udf("boolean")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else predicates.evaluate(op, wkt.parsed(p), wkt.parsed(q)) for p, q in zip(x, y, strict=True)], dtype="boolean")

    return test(a, b)


def point_in_box(op: str, x: Column, y: Column, box: tuple[float, float, float, float]) -> Column | None:
    """A predicate between a point in columns and an axis-parallel rectangle, without Python; None if it has no such form."""
    w, s, e, n = box
    closed = (x >= w) & (x <= e) & (y >= s) & (y <= n)
    inside = (x > w) & (x < e) & (y > s) & (y < n)
    match op:
        case "s_intersects":
            return closed
        case "s_disjoint":
            return ~closed
        case "s_within":
            return inside
        case "s_touches":
            return closed & ~inside
        case "s_overlaps" | "s_crosses" | "s_equals" | "s_contains":
            return closed & F.lit(False)
    return None


def point_in_polygon(op: str, x: Column, y: Column, polygon: list[list[list[float]]]) -> Column | None:
    """A predicate between a point in columns and a polygon: the crossing number as an expression."""
    crossings, on = F.lit(0), F.lit(False)
    for ring in polygon:
        for (ax, ay, *_), (bx, by, *_) in zip(ring, ring[1:], strict=False):
            ax, ay, bx, by = map(float, (ax, ay, bx, by))
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            size = max(abs(bx - ax), abs(by - ay), 1.0)
            on |= (F.abs(cross) <= predicates.EPS * size) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
            if ay != by:
                crossings += F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    inside = ~on & (crossings % 2 == 1)
    return {"s_intersects": on | inside, "s_disjoint": ~(on | inside), "s_within": inside, "s_touches": on}.get(op)


def rectangle(g: wkt.Geometry) -> tuple[float, float, float, float] | None:
    """The box of a polygon that is an axis-parallel rectangle."""
    kind, v = g
    if kind != "Polygon" or len(v) != 1 or len(v[0]) != 5:
        return None
    box = wkt.bbox(g)
    return box if {tuple(c[:2]) for c in v[0]} == {(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])} else None


# --- transformation of coordinates --------------------------------------------------------


def simplify(line: list, tolerance: float, least: int = 2) -> list:
    """Douglas-Peucker; ``least`` points stay at any rate (4 for a ring), found in two halves of a closed line."""
    if tolerance <= 0 or len(line) <= least:
        return line
    keep = {0, len(line) - 1}
    stack = [(0, len(line) - 1)]
    if line[0] == line[-1] and len(line) > 3:
        half = max(range(1, len(line) - 1), key=lambda i: math.dist(line[i][:2], line[0][:2]))
        keep.add(half)
        stack = [(0, half), (half, len(line) - 1)]
    away: list[tuple[float, int]] = []
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = line[a][:2], line[b][:2]
        dx, dy = bx - ax, by - ay
        n = math.hypot(dx, dy)
        best, at = -1.0, a
        for i in range(a + 1, b):
            px, py = line[i][0] - ax, line[i][1] - ay
            t = min(1.0, max(0.0, (px * dx + py * dy) / (n * n))) if n else 0.0
            d = math.hypot(px - t * dx, py - t * dy)
            if d > best:
                best, at = d, i
        away.append((best, at))
        if best > tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    for _, i in sorted(away, reverse=True):
        if len(keep) >= least:
            break
        keep.add(i)
    return [line[i] for i in sorted(keep)]


def signed_area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def force_ccw(g: wkt.Geometry) -> wkt.Geometry:
    """Outer rings counter-clockwise, holes clockwise."""
    kind, v = g
    turn = lambda p: [r if (signed_area(r) >= 0) == (i == 0) else r[::-1] for i, r in enumerate(p)]
    if kind == "GeometryCollection":
        return kind, [force_ccw(p) for p in v]
    return (kind, turn(v)) if kind == "Polygon" else (kind, [turn(p) for p in v]) if kind == "MultiPolygon" else g


def swap_xy(g: wkt.Geometry) -> wkt.Geometry:
    return wkt.map_coordinates(g, lambda line: [[c[1], c[0], *c[2:]] for c in line])


def reverse(g: wkt.Geometry) -> wkt.Geometry:
    return wkt.map_coordinates(g, lambda line: line[::-1])


def flat(g: wkt.Geometry) -> wkt.Geometry:
    return wkt.map_coordinates(g, lambda line: [c[:2] for c in line])


def normalise_offset(offset: float, source: C.Crs, target: C.Crs) -> float:
    """A tolerance in the target's unit, given in the source's (111333 metres to a degree)."""
    a, b = C.unit(source), C.unit(target)
    return offset if a == b else offset / 111333 if b == "degree" else offset * 111333


def process(g: wkt.Geometry, source: C.Crs, target: C.Crs, offset: float = 0, precision: tuple[int, ...] = (), ccw: bool = True) -> wkt.Geometry:
    """Simplify, transform, orient and round, in this order."""
    if offset > 0:
        ring = 4 if "Polygon" in g[0] else 2
        g = wkt.map_coordinates(g, lambda line: simplify(line, offset, ring))
    if source != target:
        g = wkt.map_coordinates(g, lambda line: [C.transform(c, source, target) for c in line])
    if ccw:
        g = force_ccw(g)
    if precision:
        g = wkt.map_coordinates(g, lambda line: [[round(v, precision[min(i, len(precision) - 1)]) for i, v in enumerate(c)] for c in line])
    return g


def processed(geometry: Column, source: C.Crs, target: C.Crs, offset: float = 0, precision: tuple[int, ...] = (), ccw: bool = True) -> Column:
    """:func:`process` over a WKT column; null where the target has no such coordinate (a pole in Web Mercator)."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else wkt.to_wkt(process(wkt.parse(x), source, target, offset, precision, ccw))
        except (ValueError, OverflowError):
            return None

    @F.pandas_udf("string")
    def run(g: pd.Series) -> pd.Series:
        return g.map(one)

    return run(geometry)


def geojson(geometry: Column) -> Column:
    """GeoJSON text of a WKT column."""

    @F.pandas_udf("string")
    def run(g: pd.Series) -> pd.Series:
        import json

        return g.map(lambda x: None if x is None else json.dumps(wkt.to_geojson(wkt.parse(x))))

    return run(geometry)


def register(spark) -> None:
    """The predicates as SQL functions ``s_intersects(wkt, wkt)`` and so on."""
    from lodestrata.cql.ast import SPATIAL

    for op in SPATIAL:

        def test(x: pd.Series, y: pd.Series, op=op) -> pd.Series:
            return pd.Series([None if p is None or q is None else predicates.evaluate(op, wkt.parsed(p), wkt.parsed(q)) for p, q in zip(x, y, strict=True)], dtype="boolean")

        spark.udf.register(op, F.pandas_udf(lambda x, y, t=test: t(x, y), "boolean", F.PandasUDFType.SCALAR))
