"""Vector tiles: grid arithmetic in columns, geometry and encoding in grouped Arrow batches."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import crs as C
from lodestrata.functions import geometry as G
from lodestrata.functions import predicates, wkt

EXTENT, BUFFER, TILE_PIXELS = 4096, 8, 256
#: Features of one tile at most.
LIMIT = 100_000


@dataclass(frozen=True)
class Grid:
    """A tile matrix set: box, number of tiles of level 0 in x and y, and CRS; row 0 is the northernmost."""

    name: str
    crs: C.Crs
    box: tuple[float, float, float, float]
    width0: int = 1
    height0: int = 1
    max_level: int = 24
    #: Tiles of each level per tile of level 0, in one direction, where levels do not double.
    factors: tuple[int, ...] = ()

    def size(self, level: int) -> tuple[int, int]:
        f = self.factors[level] if self.factors else 1 << level
        return self.width0 * f, self.height0 * f

    def tile_box(self, level: int, row: int, col: int) -> tuple[float, float, float, float]:
        cols, rows = self.size(level)
        w, h = (self.box[2] - self.box[0]) / cols, (self.box[3] - self.box[1]) / rows
        return self.box[0] + col * w, self.box[3] - (row + 1) * h, self.box[0] + (col + 1) * w, self.box[3] - row * h

    def row_col(self, level: int, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of a coordinate in the grid's CRS, clamped to the grid."""
        cols, rows = self.size(level)
        clamp = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("int")
        return (
            clamp((F.lit(float(self.box[3])) - y) * rows / (self.box[3] - self.box[1]), rows),
            clamp((x - F.lit(float(self.box[0]))) * cols / (self.box[2] - self.box[0]), cols),
        )

    def limits(self, level: int, box: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
        """Least and greatest row, least and greatest column of the tiles that a box touches."""
        cols, rows = self.size(level)
        at = lambda v, n: min(max(math.floor(v), 0), n - 1)
        fx, fy = cols / (self.box[2] - self.box[0]), rows / (self.box[3] - self.box[1])
        return at((self.box[3] - box[3]) * fy, rows), at((self.box[3] - box[1]) * fy, rows), at((box[0] - self.box[0]) * fx, cols), at((box[2] - self.box[0]) * fx, cols)

    def max_allowable_offset(self, level: int) -> float:
        return (self.box[2] - self.box[0]) / self.size(level)[0] / EXTENT


def of_cells(name: str, crs: C.Crs, cell: float, origin: tuple[float, float], width0: int, height0: int, max_level: int, factors: tuple[int, ...] = ()) -> Grid:
    """A grid from the size of level 0's cells and its upper left corner."""
    side = cell * TILE_PIXELS
    return Grid(name, crs, (origin[0], origin[1] - height0 * side, origin[0] + width0 * side, origin[1]), width0, height0, max_level, factors)


_M = math.pi * C.A
#: The built-in grids.
GRIDS = {
    g.name: g
    for g in (
        Grid("WebMercatorQuad", C.WEB_MERCATOR, (-_M, -_M, _M, _M)),
        Grid("WorldCRS84Quad", C.CRS84, (-180, -90, 180, 90), 2, 1),
        Grid("WorldMercatorWGS84Quad", C.Crs(3395), (-_M, -_M, _M, _M)),
        of_cells("AdV_25832", C.Crs(25832), 4891.96981025127, (-46133.17, 6301219.54), 1, 1, 14),
        of_cells("AdV_25833", C.Crs(25833), 4891.96981025127, (-464849.38, 6310160.14), 1, 1, 14),
        of_cells("EU_25832", C.Crs(25832), 4891.96981025127, (-3803165.98427, 8805908.08285), 6, 5, 14),
        of_cells("gdi_de_25832", C.Crs(25832), 2800.0, (-46133.17, 6301219.54), 2, 2, 15, (*(f * 10**k for k in range(5) for f in (1, 2, 4)), 10**5)),
    )
}


def xyz_row(row: Column, level: int, grid: Grid) -> Column:
    """The row counted from the south (TMS), or back."""
    return F.lit(grid.size(level)[1] - 1) - row


def tile_points(df: DataFrame, grid: Grid, levels: range, x: str = "x", y: str = "y") -> DataFrame:
    """level, row, col and the columns of ``df``: one row for each point and level, without a join."""
    out = df.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    row = col = F.lit(None).cast("int")
    for level in levels:
        r, c = grid.row_col(level, F.col(x), F.col(y))
        row, col = F.when(F.col("level") == level, r).otherwise(row), F.when(F.col("level") == level, c).otherwise(col)
    return out.withColumn("row", row).withColumn("col", col)


def tile_boxes(df: DataFrame, grid: Grid, level: int, xmin: str, ymin: str, xmax: str, ymax: str) -> DataFrame:
    """One row for each feature and tile that its box touches: the equi-join key of a spatial join with tiles."""
    r1, c0 = grid.row_col(level, F.col(xmin), F.col(ymin))
    r0, c1 = grid.row_col(level, F.col(xmax), F.col(ymax))
    return df.withColumn("row", F.explode(F.sequence(r0, r1))).withColumn("col", F.explode(F.sequence(c0, c1))).withColumn("level", F.lit(level))


def refine(tiled: DataFrame, grid: Grid, geometry: str = "geometry") -> DataFrame:
    """Of the rows that :func:`tile_boxes` makes, those whose geometry meets the tile and not only its box."""

    @F.pandas_udf("boolean")
    def meets(level: pd.Series, row: pd.Series, col: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(meeting(grid, level.to_numpy(), row.to_numpy(), col.to_numpy(), g), dtype="boolean")

    return tiled.filter(meets("level", "row", "col", geometry))


#: Within this part of a coordinate's size of a tile's edge, the exact predicate decides.
NEAR = 1e-6
#: Pairs of a tile and a segment in memory at once, or those of one row.
PAIRS = 1 << 18


def _segments(g: wkt.Geometry) -> tuple[list, list, bool]:
    """Ends of the segments (a point is one without length), polygons, and whether a ring is open."""
    points, lines, polygons = predicates._parts(g)
    rings = [r for p in polygons for r in p]
    out = [(*p, *p) for p in points]
    out += [(*a, *b) for x in (*lines, *rings) for a, b in zip(x, x[1:], strict=False)]
    return out, polygons, any(not r or r[0] != r[-1] for r in rings)


def meeting(grid: Grid, level: np.ndarray, row: np.ndarray, col: np.ndarray, texts: pd.Series) -> np.ndarray:
    """Whether each geometry meets its tile; a null or empty one meets none.

    A segment with an end in the tile, or one through its inside, meets it; one that an axis or its own normal parts
    from the tile does not. That is decided for whole arrays; only what comes close to an edge takes the exact predicate.
    """
    out = np.zeros(len(texts), bool)
    codes, distinct = pd.factorize(np.asarray(texts, dtype=object))
    shapes = [G.flat(wkt.parsed(t)) for t in distinct]
    cut = [_segments(g) for g in shapes]
    counts = np.array([len(c[0]) for c in cut], np.int64)
    segments = np.array([x for c in cut for x in c[0]], np.float64).reshape(-1, 4)
    starts = np.cumsum(counts) - counts
    kept = np.flatnonzero(codes >= 0)
    kept = kept[counts[codes[kept]] > 0] if len(kept) else kept
    if not len(kept):
        return out
    boxes = np.empty((len(texts), 4))
    for z in np.unique(level):
        at = level == z
        boxes[at] = np.column_stack(grid.tile_box(int(z), row[at].astype(np.int64), col[at].astype(np.int64)))
    part = np.cumsum(counts[codes[kept]]) // PAIRS
    for rows in np.split(kept, np.flatnonzero(np.diff(part)) + 1):
        n = counts[codes[rows]]
        r = np.repeat(np.arange(len(rows)), n)
        ax, ay, bx, by = segments[np.repeat(starts[codes[rows]] - (np.cumsum(n) - n), n) + np.arange(len(r))].T
        w, s, e, north = boxes[rows[r]].T
        with np.errstate(invalid="ignore", over="ignore"):
            d = NEAR * np.maximum.reduce([np.ones(len(r)), *map(np.abs, (w, s, e, north, ax, ay, bx, by))])
            x0, x1, y0, y1 = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
            nx, ny, hx, hy = ay - by, bx - ax, (e - w) / 2, (north - s) / 2
            away = np.abs(nx * ((w + e) / 2 - ax) + ny * ((s + north) / 2 - ay))
            reach, margin = np.abs(nx) * hx + np.abs(ny) * hy, d * np.hypot(nx, ny)
            near = ~((x1 < w - d) | (x0 > e + d) | (y1 < s - d) | (y0 > north + d) | (away > reach + margin))
            meet = (ax >= w) & (ax <= e) & (ay >= s) & (ay <= north) | (bx >= w) & (bx <= e) & (by >= s) & (by <= north)
            small = reach - d * (np.abs(nx) + np.abs(ny))
            meet |= (hx > d) & (hy > d) & (x1 >= w + d) & (x0 <= e - d) & (y1 >= s + d) & (y0 <= north - d) & (away <= small)
        sure, close = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        sure[r[meet]], close[r[near]] = True, True
        out[rows[sure]] = True
        for i, is_close in zip(rows[~sure], close[~sure], strict=True):
            shape, (_, polygons, is_open) = shapes[codes[i]], cut[codes[i]]
            if is_open or is_close:
                w, s, e, north = map(float, boxes[i])
                out[i] = predicates.evaluate("s_intersects", shape, ("Polygon", [[[w, s], [e, s], [e, north], [w, north], [w, s]]]))
            else:  # no edge is close: the tile lies in a polygon or outside of all
                out[i] = any(predicates._in_polygon(tuple(map(float, boxes[i][:2])), p) != predicates.OUT for p in polygons)
    return out


# --- geometry of one tile ------------------------------------------------------------------


def to_tile(g: wkt.Geometry, box: tuple[float, float, float, float], extent: int = EXTENT) -> wkt.Geometry:
    """Integer tile coordinates, y downwards; repeated points go."""
    fx, fy = extent / (box[2] - box[0]), extent / (box[3] - box[1])

    def line(v: list) -> list:
        out: list = []
        for c in v:
            p = [round((c[0] - box[0]) * fx), round((box[3] - c[1]) * fy)]
            if not out or out[-1] != p:
                out.append(p)
        return out

    return wkt.map_coordinates(g, line)


def clip_ring(ring: list, lo: float, hi: float) -> list:
    """A closed ring cut to the square from lo to hi, edge by edge."""
    for axis, bound, sign in ((0, lo, 1), (0, hi, -1), (1, lo, 1), (1, hi, -1)):
        out: list = []
        for a, b in zip(ring, ring[1:], strict=False):
            ina, inb = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = [round(a[0] + t * (b[0] - a[0])), round(a[1] + t * (b[1] - a[1]))]
            if ina:
                out.append(a)
                if not inb:
                    out.append(cut)
            elif inb:
                out.append(cut)
        ring = [*out, out[0]] if out else []
        if not ring:
            break
    return ring


def clip_line(line: list, lo: float, hi: float) -> list[list]:
    """The parts of a line inside the square."""
    parts: list[list] = []
    for a, b in zip(line, line[1:], strict=False):
        t0, t1 = 0.0, 1.0
        for axis in (0, 1):
            d = b[axis] - a[axis]
            for bound, sign in ((lo, -1), (hi, 1)):
                p, q = sign * d, sign * (bound - a[axis])
                if p == 0 and q < 0:
                    t0 = 2.0
                elif p < 0:
                    t0 = max(t0, q / p)
                elif p > 0:
                    t1 = min(t1, q / p)
        if t0 <= t1:
            s, e = ([round(a[k] + t * (b[k] - a[k])) for k in (0, 1)] for t in (t0, t1))
            if parts and parts[-1][-1] == s:
                parts[-1].append(e)
            else:
                parts.append([s, e])
    return [p for p in parts if len(p) > 1 and (len(p) > 2 or p[0] != p[1])]


def tile_geometry(g: wkt.Geometry, box: tuple[float, float, float, float], extent: int = EXTENT, buffer: int = BUFFER * EXTENT // TILE_PIXELS) -> wkt.Geometry | None:
    """Affine transformation, removal of small parts, simplification, clipping; None if nothing is left."""
    kind, v = to_tile(g, box, extent)
    lo, hi = -buffer, extent + buffer
    if kind in ("Point", "MultiPoint"):
        inside = [p for p in ([v] if kind == "Point" else v) if lo <= p[0] <= hi and lo <= p[1] <= hi]
        return ("MultiPoint", inside) if inside else None
    if kind in ("LineString", "MultiLineString"):
        lines = [c for x in ([v] if kind == "LineString" else v) if len(x) > 1 for c in clip_line(G.simplify(x, 1.0), lo, hi)]
        return ("MultiLineString", lines) if lines else None
    polygons = []
    for p in [v] if kind == "Polygon" else v:
        rings = []
        for i, r in enumerate(p):
            if len(r) > 3 and r[0] != r[-1]:
                r = [*r, r[0]]
            r = clip_ring(G.simplify(r, 1.0, 4), lo, hi) if len(r) > 3 else []
            if len(r) > 3 and abs(G.signed_area(r)) >= 1:
                rings.append(r)
            elif i == 0:
                break
        if rings:
            polygons.append(rings)
    return ("MultiPolygon", polygons) if polygons else None


# --- encoding --------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) + body if kind == 2 else body)


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _commands(g: wkt.Geometry) -> tuple[int, list[int]]:
    """Geometry type and command integers of the tile format."""
    kind, v = g
    out: list[int] = []
    at = [0, 0]

    def move(points: list, command: int) -> None:
        out.append(command | len(points) << 3)
        for p in points:
            out.extend((_zigzag(p[0] - at[0]), _zigzag(p[1] - at[1])))
            at[:] = p[:2]

    if kind == "MultiPoint":
        move(v, 1)
        return 1, out
    if kind == "MultiLineString":
        for line in v:
            move(line[:1], 1)
            move(line[1:], 2)
        return 2, out
    for polygon in v:
        for i, r in enumerate(polygon):
            r = r if (G.signed_area(r) > 0) == (i == 0) else r[::-1]  # y runs downwards: positive is clockwise on the map
            move(r[:1], 1)
            move(r[1:-1], 2)
            out.append(15)
    return 3, out


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _field(7, 0, _varint(int(v)))
    if isinstance(v, int):
        return _field(4, 0, _varint(v)) if v >= 0 else _field(6, 0, _varint(_zigzag(v)))
    if isinstance(v, float):
        return _field(3, 1, struct.pack("<d", v))
    return _field(1, 2, str(v).encode())


def encode_layer(name: str, features: list[tuple[int | None, wkt.Geometry, dict]], extent: int = EXTENT) -> bytes:
    """One layer of a vector tile; a tile is the layers one after another."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = b""
    for fid, g, properties in features:
        kind, commands = _commands(g)
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault(_value(v), len(values))) for k, v in properties.items() if v is not None)
        f = (_field(1, 0, _varint(fid)) if fid is not None and fid >= 0 else b"") + (_field(2, 2, tags) if tags else b"") + _field(3, 0, _varint(kind)) + _field(4, 2, b"".join(map(_varint, commands)))
        body += _field(2, 2, f)
    inner = _field(15, 0, _varint(2)) + _field(1, 2, name.encode()) + body + b"".join(_field(3, 2, k.encode()) for k in keys) + b"".join(_field(4, 2, v) for v in values) + _field(5, 0, _varint(extent))
    return _field(3, 2, inner)


def merge_features(features: list[tuple[int | None, wkt.Geometry, dict]], group_by: tuple[str, ...]) -> list[tuple[int | None, wkt.Geometry, dict]]:
    """Features of equal ``group_by`` values as one: lines joined end to end, polygons dissolved; equal properties stay."""
    groups: dict[tuple, list] = {}
    for f in features:
        groups.setdefault((f[1][0], *(f[2].get(k) for k in group_by)), []).append(f)
    out = []
    for (kind, *_), members in groups.items():
        if len(members) == 1:
            out.append(members[0])
            continue
        parts = [x for m in members for x in m[1][1]]
        if kind == "MultiLineString":
            parts = join_lines(parts)
        elif kind == "MultiPolygon":
            parts = dissolve(parts)
        same = {k: v for k, v in members[0][2].items() if all(m[2].get(k) == v for m in members)}
        out.append((None, (kind, parts), same))
    return out


def dissolve(polygons: list[list]) -> list[list]:
    """Polygons that share edges as one: edges that two of them run along, in opposite directions, go, and what is left is chained anew.

    Polygons that overlap without sharing edges stay beside each other. Rings that are not closed by what is left are kept as they were.
    """
    edges: dict[tuple, list[tuple]] = {}
    count = 0
    for p in polygons:
        for i, r in enumerate(p):
            r = r if (G.signed_area(r) > 0) == (i == 0) else r[::-1]  # outer rings one way round, holes the other
            for a, b in zip(r, r[1:], strict=False):
                a, b = tuple(a[:2]), tuple(b[:2])
                if a in edges.get(b, ()):
                    edges[b].remove(a)
                    count += 1
                else:
                    edges.setdefault(a, []).append(b)
    if not count:
        return polygons
    rings = []
    for start in list(edges):
        path, place = [start], {start: 0}
        while edges.get(path[-1]):
            nxt = edges[path[-1]].pop()
            if nxt in place:  # a ring is closed; one that touches itself is cut at its corner
                k = place[nxt]
                rings.append([list(q) for q in (*path[k:], nxt)])
                for q in path[k + 1 :]:
                    del place[q]
                del path[k + 1 :]
            else:
                place[nxt] = len(path)
                path.append(nxt)
        if len(path) > 1:
            return polygons
    outer = [[r] for r in rings if G.signed_area(r) > 0]
    for hole in (r for r in rings if G.signed_area(r) < 0):
        for p in outer:
            if predicates._in_ring(tuple(predicates._interior_point([hole])), [tuple(c) for c in p[0]]) != predicates.OUT:
                p.append(hole)
                break
    return outer


def join_lines(lines: list[list]) -> list[list]:
    """Lines that share an end with exactly one other become one line."""
    lines = [list(x) for x in lines]
    while True:
        ends: dict[tuple, list[int]] = {}
        for i, x in enumerate(lines):
            for p in (x[0], x[-1]):
                ends.setdefault(tuple(p), []).append(i)
        pair = next(((a, b, p) for p, (a, b) in ((p, v) for p, v in ends.items() if len(v) == 2) if a != b), None)
        if pair is None:
            return lines
        a, b, p = pair
        x = lines[a] if tuple(lines[a][-1]) == p else lines[a][::-1]
        y = lines[b] if tuple(lines[b][0]) == p else lines[b][::-1]
        lines = [v for i, v in enumerate(lines) if i not in (a, b)] + [x + y[1:]]


def encode_tiles(features: DataFrame, grid: Grid, layer: str, geometry: str = "geometry", fid: str | None = None, properties: tuple[str, ...] = (), group_by: tuple[str, ...] = (), limit: int = LIMIT, merge: bool | None = None) -> DataFrame:
    """level, row, col, layer, n_features, data from rows with level, row, col and WKT in the grid's CRS.

    A tile is one group of ``limit`` features at most, those of the least id; the others never reach its task.
    """
    merge = bool(group_by) if merge is None else merge
    rank = F.row_number().over(Window.partitionBy("level", "row", "col").orderBy(fid or geometry))
    features = features.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")

    def encode(key, pdf: pd.DataFrame) -> pd.DataFrame:
        level, row, col = map(int, key)
        box = grid.tile_box(level, row, col)
        pdf = pdf.sort_values([fid or geometry])
        found = []
        for r in pdf.to_dict("records"):
            g = tile_geometry(wkt.parse(r[geometry]), box) if r[geometry] else None
            if g:
                plain = {k: (None if pd.isna(r[k]) else r[k].item() if hasattr(r[k], "item") else r[k]) for k in properties}
                found.append((int(r[fid]) if fid else None, g, plain))
        found = merge_features(found, group_by) if merge else found
        return pd.DataFrame([{"level": level, "row": row, "col": col, "layer": layer, "n_features": len(found), "data": encode_layer(layer, found) if found else b""}])

    return features.groupBy("level", "row", "col").applyInPandas(encode, "level int, row int, col int, layer string, n_features long, data binary")


def combine_layers(tiles: DataFrame) -> DataFrame:
    """One tile of all layers: their messages one after another, by name."""
    return tiles.groupBy("level", "row", "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "data"))), lambda x: x["data"]).alias("parts")).select("level", "row", "col", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("data"))


def coverage(grid: Grid, levels: range, box: tuple[float, float, float, float], spark, max_tiles: int = 4096) -> DataFrame:
    """level, row, col, partition of all tiles that a box touches, for seeding."""
    out = None
    side = int(math.sqrt(max_tiles))
    for level in levels:
        r0, r1, c0, c1 = grid.limits(level, box)
        one = spark.range(r0, r1 + 1).select(F.lit(level).alias("level"), F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(c0), F.lit(c1))))
        part = F.lit(str(level)) if (1 << level) <= side else F.concat_ws("_", F.lit(str(level)), F.floor(F.col("row") / side).cast("string"), F.floor(F.col("col") / side).cast("string"))
        one = one.withColumn("partition", part)
        out = one if out is None else out.unionAll(one)
    return out


def write_tiles(tiles: DataFrame, path: str, tileset: str) -> None:
    """A plain tile store: Parquet partitioned by tileset and level; a rewritten level replaces the old one at once."""
    tiles.withColumn("tileset", F.lit(tileset)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tileset", "level").parquet(path)


def write_mbtiles(tiles: DataFrame, path: str, name: str, grid: Grid = GRIDS["WebMercatorQuad"]) -> int:
    """A single-file MBTiles store of a bounded tileset, streamed to the driver; rows count from the south there."""
    import sqlite3

    n = 0
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata (name text, value text)")
        db.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob, PRIMARY KEY (zoom_level, tile_column, tile_row))")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [("name", name), ("format", "pbf")])
        for r in tiles.select("level", "row", "col", "data").toLocalIterator():
            db.execute("INSERT OR REPLACE INTO tiles VALUES (?, ?, ?, ?)", (r.level, r.col, grid.size(r.level)[1] - 1 - r.row, bytes(r.data)))
            n += 1
    return n
