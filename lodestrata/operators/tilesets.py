"""Tile sets: which features a level shows and how, seeding jobs over a box, and caches of what was made.

A tile set makes all tiles of a range of levels in one job: each level's features
are selected by its own rules, dealt to the tiles that their boxes touch, encoded
tile by tile and written. A cache is a folder of Parquet partitioned by level; a
dynamic one replaces the levels that it is given, an immutable one has numbered
versions of the whole set and shows the newest that is whole.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import crs as C
from lodestrata.functions import geometry as G
from lodestrata.operators import mutations
from lodestrata.operators.tiles import Grid, combine_layers, coverage, encode_tiles, tile_boxes
from lodestrata.plans.query import FeatureQuery, Provider


@dataclass(frozen=True)
class LevelRule:
    """What holds from one level to another: a CQL2 filter, and a transformation of what passes."""

    first: int
    last: int
    filter: str | None = None
    properties: tuple[str, ...] | None = None
    group_by: tuple[str, ...] = ()
    merge: bool = False

    def at(self, level: int) -> bool:
        return self.first <= level <= self.last


@dataclass(frozen=True)
class TileSet:
    """Tiles of one feature type. ``limit`` is the most features of a tile; the box clips what is tiled, in the grid's CRS."""

    layer: str
    type: str
    grid: Grid
    levels: range
    properties: tuple[str, ...] = ()
    rules: tuple[LevelRule, ...] = ()
    limit: int = 100_000
    box: tuple[float, float, float, float] | None = None

    def filters(self, level: int) -> tuple[str, ...]:
        return tuple(r.filter for r in self.rules if r.filter and r.at(level))

    def transformation(self, level: int) -> LevelRule:
        """Of the rules that hold, the last one's transformation."""
        own = [r for r in self.rules if r.at(level) and (r.properties is not None or r.group_by or r.merge)]
        return own[-1] if own else LevelRule(level, level)


def max_offset(grid: Grid, level: int, native: C.Crs) -> float:
    """The tolerance of a level's geometries, in the unit of the features' own reference system."""
    return G.normalise_offset(grid.max_allowable_offset(level), grid.crs, native)


def features(p: Provider, s: TileSet, level: int) -> DataFrame:
    """level, row, col, id, geometry (in the grid's CRS) and the properties of one level: one row for each feature and tile that its box touches."""
    t = p.types[s.type]
    key, place = t.with_role("ID").name, t.with_role("PRIMARY_GEOMETRY").name
    own = s.transformation(level)
    shown = s.properties if own.properties is None else tuple(x for x in s.properties if x in own.properties)
    fields = tuple(dict.fromkeys((key, place, *shown, *own.group_by)))
    q = FeatureQuery(s.type, s.filters(level), fields=fields, crs=s.grid.crs, max_allowable_offset=0 if t.leaf(place).property.point else max_offset(s.grid, level, p.native_crs))
    df = p.query(q).filter(F.col(place).isNotNull()).withColumn("_box", G.bbox(place))
    if s.box:
        w, south, e, n = s.box
        df = df.filter((F.col("_box.xmin") <= e) & (F.col("_box.xmax") >= w) & (F.col("_box.ymin") <= n) & (F.col("_box.ymax") >= south))
        # Of a large feature only the tiles inside the box are named.
        within = F.struct(*(f(F.col(f"_box.{k}"), F.lit(float(v))).alias(k) for f, k, v in ((F.greatest, "xmin", w), (F.greatest, "ymin", south), (F.least, "xmax", e), (F.least, "ymax", n))))
        df = df.withColumn("_box", within)
    df = df.select(F.col(key).alias("_id"), F.col(place).alias("_geometry"), *(f for f in fields if f not in (key, place)), "_box.*")
    tiled = tile_boxes(df, s.grid, level, "xmin", "ymin", "xmax", "ymax")
    return tiled.drop("xmin", "ymin", "xmax", "ymax")


def tiles(p: Provider, s: TileSet, levels: range | None = None) -> DataFrame:
    """level, row, col, data of all tiles that show something."""
    out = None
    for level in levels or s.levels:
        own, df = s.transformation(level), features(p, s, level)
        shown = tuple(c for c in df.columns if c not in ("level", "row", "col", "_id", "_geometry"))
        one = encode_tiles(df, s.grid, s.layer, "_geometry", "_id", shown, own.group_by, limit=s.limit, merge=own.merge or bool(own.group_by))
        out = one if out is None else out.unionByName(one)
    return combine_layers(out.filter("n_features > 0"))


def seed(p: Provider, s: TileSet, path: str, immutable: bool = False, levels: range | None = None) -> DataFrame:
    """Make and write tiles; level, expected (tiles of the box) and written: one row for each level."""
    spark, levels = p.spark, levels or s.levels
    made = tiles(p, s, levels)
    if immutable:
        mutations.commit(made, path)
    else:
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level").parquet(path)
    box = s.box or s.grid.box
    expected = coverage(s.grid, levels, box, spark).groupBy("level").agg(F.count("*").alias("expected"))
    written = read(spark, path, immutable).filter(F.col("level").isin(*levels)).groupBy("level").agg(F.count("*").alias("written"))
    return expected.join(written, "level", "left").select("level", "expected", F.coalesce("written", F.lit(0)).cast("long").alias("written"))


def read(spark: SparkSession, path: str, immutable: bool = False) -> DataFrame:
    """The tiles of a cache."""
    return mutations.current(spark, path) if immutable else spark.read.parquet(path)


def tile(spark: SparkSession, caches: tuple[tuple[str, range, bool], ...], level: int, row: int, col: int) -> bytes:
    """One tile from the first cache (path, levels, immutable) that has it; an empty tile where none does."""
    for path, levels, immutable in caches:
        if level in levels:
            found = read(spark, path, immutable).filter((F.col("level") == level) & (F.col("row") == row) & (F.col("col") == col)).select("data").first()
            if found:
                return bytes(found.data)
    return b""


def invalidate(spark: SparkSession, path: str, changed: DataFrame, grid: Grid, levels: range, box: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax")) -> None:
    """Drop the tiles of a dynamic cache that the changed boxes touch, level by level."""
    kept, gone = read(spark, path), None
    for level in levels:
        one = tile_boxes(changed, grid, level, *box).select("level", "row", "col").distinct()
        gone = one if gone is None else gone.unionByName(one)
    rest = kept.join(gone, ["level", "row", "col"], "left_anti")
    # Written beside the cache first: a job cannot overwrite what it reads.
    aside = f"{path.rstrip('/')}.aside"
    rest.write.mode("overwrite").parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").partitionBy("level").parquet(path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)
    fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs_path, True)


def with_levels(s: TileSet, levels: range) -> TileSet:
    return replace(s, levels=levels)
