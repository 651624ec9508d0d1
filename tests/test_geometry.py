"""WKT, predicates, reference systems, simplification, tiles, source paths: hand-derived cases."""

import sqlite3

import pytest

from lodestrata.functions import crs as C
from lodestrata.functions import geometry as G
from lodestrata.functions import predicates, wkt
from lodestrata.operators import tiles
from lodestrata.schema import parse_path
from lodestrata.sources import readers

SQUARE = "POLYGON((0 0,4 0,4 4,0 4,0 0))"
HOLED = "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"
CASES = [
    ("s_intersects", SQUARE, "POLYGON((3 3,6 3,6 6,3 6,3 3))", True), ("s_overlaps", SQUARE, "POLYGON((3 3,6 3,6 6,3 6,3 3))", True),
    ("s_touches", SQUARE, "POLYGON((4 0,8 0,8 4,4 4,4 0))", True), ("s_overlaps", SQUARE, "POLYGON((4 0,8 0,8 4,4 4,4 0))", False),
    ("s_within", "POLYGON((1 1,2 1,2 2,1 2,1 1))", SQUARE, True), ("s_contains", SQUARE, "POLYGON((1 1,2 1,2 2,1 2,1 1))", True),
    ("s_contains", SQUARE, SQUARE, True), ("s_equals", SQUARE, "POLYGON((4 4,0 4,0 0,4 0,4 4))", True), ("s_equals", SQUARE, HOLED, False),
    ("s_disjoint", "POLYGON((4.5 4.5,5.5 4.5,5.5 5.5,4.5 5.5,4.5 4.5))", HOLED, True), ("s_within", "POINT(5 5)", HOLED, False), ("s_touches", "POINT(4 5)", HOLED, True),
    ("s_crosses", "LINESTRING(-1 2,5 2)", SQUARE, True), ("s_crosses", "LINESTRING(1 2,3 2)", SQUARE, False), ("s_within", "LINESTRING(1 2,3 2)", SQUARE, True),
    ("s_crosses", "LINESTRING(0 0,4 4)", "LINESTRING(0 4,4 0)", True), ("s_overlaps", "LINESTRING(0 0,4 0)", "LINESTRING(2 0,6 0)", True), ("s_touches", "LINESTRING(0 0,4 0)", "LINESTRING(4 0,4 4)", True),
    ("s_intersects", "MULTIPOINT(9 9,1 1)", SQUARE, True), ("s_crosses", "MULTIPOINT(9 9,1 1)", SQUARE, True), ("s_equals", "POINT(1 1)", "POINT(1 1)", True), ("s_touches", "POINT(1 1)", "POINT(1 1)", False),
    ("s_touches", "LINESTRING(0 0,4 0)", SQUARE, True), ("s_within", "LINESTRING(0 0,4 0)", SQUARE, False), ("s_disjoint", "LINESTRING(9 9,8 8)", SQUARE, True),
]


@pytest.mark.parametrize("op,a,b,want", CASES)
def test_predicates(op, a, b, want):
    assert predicates.evaluate(op, wkt.parse(a), wkt.parse(b)) is want
    turned = {"s_within": "s_contains", "s_contains": "s_within"}.get(op, op)
    assert predicates.evaluate(turned, wkt.parse(b), wkt.parse(a)) is want


def test_wkt():
    for text in (SQUARE, HOLED, "POINT(1 2)", "MULTIPOINT(1 2,3 4)", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "POINT EMPTY"):
        assert wkt.to_wkt(wkt.parse(text)) == text
    assert wkt.parse("POINT Z (1 2 3)") == ("Point", [1, 2, 3])
    assert wkt.parse("MULTIPOINT((1 2),(3 4))") == ("MultiPoint", [[1, 2], [3, 4]])


def test_reference_systems():
    assert C.transform([50.7164, 7.086], C.EPSG4326, C.WEB_MERCATOR) == pytest.approx([788809.9117611365, 6571280.658009369], abs=1e-6)
    assert C.transform([420735.071, 5392914.343, 131.96], C.Crs(5555), C.EPSG4326) == pytest.approx([48.68423644912392, 7.923077973066287], abs=1e-7)
    assert C.transform([48.684, 7.923, 131.96], C.Crs(4979), C.CRS84) == [7.923, 48.684]
    for target in (C.WEB_MERCATOR, C.Crs(25832), C.Crs(3395), C.Crs(4978)):
        assert C.transform(C.transform([8.5, 50.1], C.CRS84, target), target, C.CRS84)[:2] == pytest.approx([8.5, 50.1], abs=1e-8)
    assert C.transform_bbox((7, 50, 8, 51), C.CRS84, C.EPSG4326) == (50, 7, 51, 8)
    assert C.parse("http://www.opengis.net/def/crs/OGC/1.3/CRS84") == C.CRS84 and C.parse("EPSG:25832").code == 25832
    with pytest.raises(ValueError):
        C.transform([1, 2], C.CRS84, C.Crs(31467))


def test_simplify_and_order():
    assert G.simplify([[10, 10], [11, 11], [12, 9], [13, 10]], 1.0) == [[10, 10], [13, 10]]
    ring = [[0, 0], [5, 0.1], [10, 0], [10, 10], [0, 10], [0, 0]]
    assert len(G.simplify(ring, 1.0, 4)) == 5
    assert G.signed_area(G.force_ccw(("Polygon", [[[0, 0], [0, 1], [1, 1], [0, 0]]]))[1][0]) > 0
    assert G.swap_xy(wkt.parse("LINESTRING(1 2,3 4)")) == ("LineString", [[2, 1], [4, 3]])
    assert G.normalise_offset(111333, C.WEB_MERCATOR, C.CRS84) == 1


def test_tiles(tmp_path):
    g = tiles.GRIDS["WebMercatorQuad"]
    assert g.tile_box(1, 0, 0)[3] == pytest.approx(20037508.342789244)
    assert tiles.GRIDS["WorldCRS84Quad"].limits(3, (-10, -20, 60, 45)) == (2, 4, 7, 10)
    assert tiles.GRIDS["gdi_de_25832"].size(15) == (200000, 200000) and tiles.GRIDS["gdi_de_25832"].size(3) == (20, 20)
    assert tiles.tile_geometry(wkt.parse("POINT(500 500)"), (0, 0, 10, 10)) is None
    kind, rings = tiles.tile_geometry(wkt.parse("POLYGON((-100 -100,100 -100,100 100,-100 100,-100 -100))"), (0, 0, 10, 10))
    assert kind == "MultiPolygon" and wkt.bbox((kind, rings)) == (-128, -128, 4224, 4224)
    assert tiles.join_lines([[[0, 0], [1, 0]], [[2, 0], [1, 0]]]) == [[[0, 0], [1, 0], [2, 0]]]
    assert tiles.encode_layer("a", [(1, ("MultiPoint", [[25, 17]]), {"k": "v"})]) == bytes.fromhex("1a1f 7802 0a01 61 120d 0801 1202 0000 1801 2203 09 32 22 1a01 6b 2203 0a01 76 2880 20".replace(" ", ""))


def test_source_paths():
    p = parse_path("[o_orderkey=l_orderkey]lineitem{sortKey=l_linenumber}{filter=l_returnflag = 'R'}/[l_partkey=p_partkey]part/p_name")
    assert [(s.source, s.target, s.table) for s in p.steps] == [("o_orderkey", "l_orderkey", "lineitem"), ("l_partkey", "p_partkey", "part")]
    assert p.column == "p_name" and p.steps[0].flag("filter") == "l_returnflag = 'R'"
    assert parse_path("[JSON]props/a/b").json_path == ("a", "b")
    assert parse_path("[EXPRESSION]{sql=$T$.a + 1}").kind == "expression"
    with pytest.raises(ValueError):
        parse_path("/a/b/c")


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "id": "a", "type": "Feature", "properties": {"n": 1}}, {"type": "Feature", "id": "b", "geometry": null, "properties": {"n": null}}], "type": "FeatureCollection"}')
    assert [tuple(r) for r in readers.read_geojson(spark, str(tmp_path / "c.json")).collect()] == [("a", "POINT(1 2)", 1), ("b", None, None)]
    gml = '<c xmlns:gml="g" xmlns:b="b"><b:pand gml:id="x"><b:n>5</b:n><b:geom><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 4 0 4 4 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></b:geom></b:pand></c>'
    (tmp_path / "c.xml").write_text(gml)
    r = readers.read_gml(spark, str(tmp_path / "c.xml"), "b:pand", "_id string, n int", "geom").collect()
    assert [(x.n, x.geom) for x in r] == [(5, "POLYGON((0 0,4 0,4 4,0 0))")]
    assert readers.graphql_query("a", ["x", "y.z"], {"first": "1"}) == "{ a(first: 1) { x y { z } } }"
    body = spark.createDataFrame([('{"data": {"a": [{"x": 1}, {"x": 2}]}}',)], "body string")
    assert [q.x for q in readers.read_graphql(spark, body, "a", "x int").collect()] == [1, 2]
    assert "COUNT=5" in readers.wfs_query("b:pand", 5, 10)
    path = str(tmp_path / "t.mbtiles")
    n = tiles.write_mbtiles(spark.createDataFrame([(1, 0, 1, bytearray(b"x"))], "level int, row int, col int, data binary"), path, "t")
    with sqlite3.connect(path) as db:
        assert n == 1 and db.execute("SELECT tile_row FROM tiles").fetchall() == [(1,)]


def test_change_feed(spark, tmp_path):
    from lodestrata.streaming import changes

    lines = spark.createDataFrame([("INSERT,7,2020-01-01T00:00:00Z,,1,2,3,4",), ("DELETE,8,,,,,,",), ("what",)], "value string")
    rows = changes.parse_notifications(lines).collect()
    assert [(r.action, r.feature_id, r.xmin) for r in rows] == [("CREATE", "7", 1.0), ("DELETE", "8", None), (None, None, None)]
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "UPDATE", 1), (2, "DELETE", 2)], "id long, action string, at int").coalesce(1).write.parquet(source)
    stream = changes.read_changes(spark, source, "id long, action string, at int")
    q = changes.subscribe(stream, [lambda df, n: seen.append(df.count())], str(tmp_path / "ck"))
    assert q.awaitTermination(60) and seen == [2]
