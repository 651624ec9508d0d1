"""Sorting, paging, time zones, reference systems of filters, JSON below arrays, versions of tables, routes, tiles."""

import pytest
from pyspark.sql import functions as F

from lodestrata import catalog
from lodestrata.cql import CqlError, parse
from lodestrata.cql.ast import Bbox, Lit
from lodestrata.functions import crs as C
from lodestrata.operators import mutations, routing, tiles
from lodestrata.plans.filters import instant_literal, to_native
from lodestrata.plans.query import FeatureQuery

SF = "/root/testdata/sf0.001"


@pytest.fixture
def provider(spark):
    return catalog.provider(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "text,utc",
    [("1996-01-01T00:00:00-05:00", "1996-01-01 05:00:00"), ("1996-01-01T00:00:00+05:30", "1995-12-31 18:30:00"), ("1996-01-01T00:00:00Z", "1996-01-01 00:00:00"), ("1996-01-01T00:00:00.25-00:30", "1996-01-01 00:30:00.25")],
)
def test_offsets_of_timestamps(spark, text, utc):
    """An offset counts, whatever the session's zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert spark.range(1).select(instant_literal(Lit(text, "timestamp")).cast("string")).first()[0] == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_page_stays_in_order(spark, provider):
    """Also where the sort field is not among the result's, with and without a relation."""
    want = [r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12).collect()]
    for fields in (("key",), ("key", "items"), ("key", "price", "customer")):
        got = [r.key for r in provider.query(FeatureQuery("orders", sort_keys=("-price",), fields=fields, limit=12)).collect()]
        assert got == want
    assert provider.query(FeatureQuery("orders", sort_keys=("-price",), fields=("key", "items"), limit=12)).columns == ["key", "items"]


def test_sub_queries_keep_their_sort_keys(provider):
    parts = [FeatureQuery("nation", sort_keys=("-title",), fields=("title",), limit=4), FeatureQuery("customer", sort_keys=("balance", "-name"), fields=("name", "balance"))]
    rows = provider.multi(parts, limit=9, offset=2).collect()
    assert [r["_ordinal"] for r in rows] == [0, 0, *[1] * 7]
    titles, balances = [r.title for r in rows[:2]], [r.balance for r in rows[2:]]
    assert titles == sorted(titles, reverse=True) and balances == sorted(balances)
    every = [r.balance for r in provider.query(FeatureQuery("customer", sort_keys=("balance",), fields=("balance",))).collect()]
    assert balances == every[:7]
    assert set(provider.multi(parts, limit=3).columns) == {"title", "name", "balance", "_ordinal"}


def test_no_sort_and_no_needless_join(provider):
    """Without a page nothing is sorted; a filter's children are semi-joined before they are grouped; array predicates aggregate once."""
    assert "Sort" not in optimized(provider.query(FeatureQuery("orders", ("status = 'P'",), fields=("key",))))
    assert "LeftSemi" in optimized(provider.query(FeatureQuery("orders", ("status = 'P'",), fields=("key", "items"))))
    for op in ("A_CONTAINS", "A_EQUALS", "A_CONTAINEDBY"):
        text = optimized(provider.query(FeatureQuery("orders", (f"{op}(flags, ('A','R'))",), fields=("key",))))
        assert "Expand" not in text and "distinct" not in text.lower()


def test_a_page_is_chosen_once(provider):
    """Related properties join the page as it was written: no second scan, filter and top-k of the main table."""
    text = plan(provider.query(FeatureQuery("orders", ("price > 1000",), sort_keys=("-price",), fields=("key", "items", "flags", "customer"), limit=5)))
    assert "o_totalprice" in text and "orders.parquet" not in text and "page-" in text


def test_etags_follow_the_order(provider):
    tag = lambda **q: provider.etag(FeatureQuery("orders", fields=("key",), **q)).first().etag
    # The same features in another order: a page of all of them.
    up, down = tag(limit=10**6, sort_keys=("price",)), tag(limit=10**6, sort_keys=("-price",))
    assert up != down and up == tag(limit=10**6, sort_keys=("price",))
    assert tag() == tag() and tag() != tag(filters=("status = 'O'",)) and tag(sort_keys=("price",)) != tag(sort_keys=("-price",))


def test_strong_etag_covers_bytes(spark, provider):
    rows = lambda data: spark.createDataFrame(data, "n int, data string")
    one = provider.strong_etag(rows([(0, "a"), (1, "b")]), "data", "n").first().etag
    assert one == provider.strong_etag(rows([(1, "b"), (0, "a")]), "data", "n").first().etag
    assert one != provider.strong_etag(rows([(0, "b"), (1, "a")]), "data", "n").first().etag


def test_array_predicates_of_many_items(spark, provider):
    """More items than one long has bits."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s")).collect()
    many = ("A", "R", "N", *(f"x{i}" for i in range(100)))
    text = ",".join(f"'{x}'" for x in many)
    keys = lambda op, items: {r.key for r in provider.query(FeatureQuery("orders", (f"{op}(flags, ({items}))",), fields=("key",))).collect()}
    assert keys("A_CONTAINEDBY", text) == {r.l_orderkey for r in lines} and keys("A_CONTAINS", text) == set()
    assert keys("A_EQUALS", "'A','R','A'") == {r.l_orderkey for r in lines if set(r.s) == {"A", "R"}}


def test_filter_coordinates_move_to_the_native_system():
    box = to_native(parse("S_INTERSECTS(l, BBOX(0,0,1113194.9079327357,1118889.9748579597))"), C.WEB_MERCATOR, C.CRS84).args[1]
    assert box.values == pytest.approx((0, 0, 10, 10)) and box.crs == C.CRS84
    swapped = to_native(parse("S_INTERSECTS(l, POINT(52.5 13.4))"), C.EPSG4326, C.CRS84).args[1]
    assert swapped.coordinates == (13.4, 52.5)
    across = to_native(parse("S_INTERSECTS(l, BBOX(-10,170,10,-170))"), C.EPSG4326, C.CRS84).args[1]
    assert isinstance(across, Bbox) and across.values == (170, -10, -170, 10)
    for text, crs in (("S_INTERSECTS(l, POINT(13.4 100))", C.CRS84), ("S_INTERSECTS(l, POINT(100 13.4))", C.EPSG4326), ("S_INTERSECTS(l, POINT(3e7 0))", C.WEB_MERCATOR), ("S_INTERSECTS(l, BBOX(0,9,1,8))", C.CRS84)):
        with pytest.raises(CqlError):
            to_native(parse(text), crs, C.CRS84)


def test_a_filter_outside_of_the_domain_is_refused(provider):
    with pytest.raises(CqlError):
        provider.query(FeatureQuery("customer", ("S_INTERSECTS(location, POINT(0 95))",)))


def test_diameters(spark):
    from math import radians

    from lodestrata.functions import geometry as G

    df = spark.createDataFrame([("LINESTRING(0 0,10 0)",), ("LINESTRING Z(0 0 0,0 0 500)",), (None,)], "g string")
    b = G.bbox_3d("g")
    r = df.select(C.diameter_3d(b.xmin, b.ymin, b.zmin, b.xmax, b.ymax, b.zmax)).collect()
    from math import sin

    assert r[0][0] == pytest.approx(2 * C.A * sin(radians(5))) and r[1][0] == pytest.approx(500) and r[2][0] is None


def test_versions_of_a_table(spark, tmp_path):
    """A version counts when it is whole; what a crash leaves half-written is never read."""
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        mutations.current(spark, path)
    for n in (1, 2, 3):
        mutations.commit(spark.range(n), path)
        assert mutations.current(spark, path).count() == n
    (tmp_path / "t" / "v-000000000009").mkdir()
    assert mutations.current(spark, path).count() == 3
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v-000000000002", "v-000000000003", "v-000000000009"]


def test_long_paths_are_not_dropped(spark):
    from lodestrata.schema.model import FeatureType

    t = FeatureType.of("t", "/a{sortKey=id}", {"name": "id", "type": "INTEGER", "source_path": "id", "role": "ID"}, {"name": "deep", "type": "VALUE_ARRAY", "source_path": "[id=a]b/[b=c]c/[c=d]d/v"})
    features = spark.createDataFrame([(1, ["x"])], "id int, deep array<string>")
    with pytest.raises(ValueError):
        mutations.insert({"a": spark.createDataFrame([], "id int")}, t, features)


def test_routes_of_many_hops(spark):
    """More steps than one job walks back, one that ends where it starts, and one that cannot be reached."""
    n = 2 * routing.HOPS + 3
    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(n)], "edge_id long, source long, target long, cost double")
    spark.sparkContext.setCheckpointDir("/tmp/lodestrata-test-checkpoints")
    rows = routing.route(edges, [0, n]).collect()
    assert [(r.seq, r.node, r.edge_id, r.cost) for r in rows] == [(i, i, i - 1 if i else None, float(i)) for i in range(n + 1)]
    assert routing.route(edges, [3, 1]).count() == 0 and [r.node for r in routing.route(edges, [2, 2]).collect()] == [2]


def test_mbtiles_rows_of_a_grid_that_is_not_square(spark, tmp_path):
    import sqlite3

    grid = tiles.GRIDS["EU_25832"]
    df = spark.createDataFrame([(0, 0, 0, bytearray(b"x")), (1, 9, 3, bytearray(b"y"))], "level int, row int, col int, data binary")
    path = str(tmp_path / "t.mbtiles")
    assert tiles.write_mbtiles(df, path, "t", grid) == 2
    with sqlite3.connect(path) as db:
        assert sorted(db.execute("SELECT zoom_level, tile_column, tile_row FROM tiles")) == [(0, 0, grid.size(0)[1] - 1), (1, 3, 0)]


def test_json_below_arrays(spark):
    from lodestrata.plans.filters import json_values

    df = spark.createDataFrame([('{"a":[{"b":[{"c":1},{"c":2}]},{"b":[{"c":3}]},{}],"x":{"y":[{"z":{"w":"p"}},{"z":null}]}}',), ("{}",), (None,)], "j string")
    r = df.select(json_values(F.col("j"), ("a[*]", "b[*]", "c"), "bigint").alias("c"), json_values(F.col("j"), ("x", "y[*]", "z", "w"), "string").alias("w")).collect()
    assert (r[0].c, r[0].w) == ([1, 2, 3], ["p"]) and r[1].c is None and r[2].w is None


def test_empty_optionals_go(spark):
    from lodestrata.functions.transformations import remove_empty

    df = spark.createDataFrame([((None, (None,)), [], [(None, "a"), (None, None)], (None,)), ((1, (2,)), ["x"], [], (3,))], "o struct<a:int,p:struct<q:int>>, l array<string>, s array<struct<a:int,b:string>>, kept struct<a:int>")
    rows = remove_empty(df, ("kept",)).collect()
    assert rows[0].o is None and rows[0].l is None and rows[0].kept.a is None and [x and x.b for x in rows[0].s] == ["a", None]
    assert rows[1].o.p.q == 2 and rows[1].s is None


def test_polygons_dissolve():
    square = lambda x, y: [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]
    area = lambda ps: sum(tiles.G.signed_area(r) for p in ps for r in p)
    two = tiles.dissolve([square(0, 0), square(1, 0)])
    assert len(two) == 1 and len(two[0]) == 1 and area(two) == 2
    ring = tiles.dissolve([square(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)])
    assert len(ring) == 1 and len(ring[0]) == 2 and area(ring) == 8
    apart = [square(0, 0), square(5, 5), [square(9, 9)[0][::-1]]]
    assert tiles.dissolve(apart) == apart
    corner = tiles.dissolve([square(0, 0), square(1, 1), square(1, 0)])
    assert area(corner) == 3


def test_a_tile_set_is_seeded(spark, provider, tmp_path):
    from lodestrata.operators import tilesets

    grid = tiles.GRIDS["WorldCRS84Quad"]
    s = tilesets.TileSet("shape", "shape", grid, range(0, 3), properties=("key",), box=(-90.0, -45.0, 90.0, 45.0), rules=(tilesets.LevelRule(0, 0, filter="balance > 0", merge=True, properties=()),), limit=5)
    for immutable in (False, True):
        path = str(tmp_path / f"cache{immutable}")
        rows = {r.level: r for r in tilesets.seed(provider, s, path, immutable).collect()}
        assert {k: r.expected for k, r in rows.items()} == {0: 2, 1: 2 * 3, 2: 3 * 5} and all(0 < r.written <= r.expected for r in rows.values())
        data = tilesets.tile(spark, (("nowhere", range(9, 10), False), (path, range(0, 3), immutable)), 0, 0, 0)
        assert b"shape" in data and b"key" not in data  # level 0 has no properties
        assert tilesets.tile(spark, ((path, range(0, 3), immutable),), 9, 0, 0) == b""
    before = tilesets.read(spark, str(tmp_path / "cacheFalse")).count()
    changed = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0)], "xmin double, ymin double, xmax double, ymax double")
    tilesets.invalidate(spark, str(tmp_path / "cacheFalse"), changed, grid, range(0, 3))
    left = tilesets.read(spark, str(tmp_path / "cacheFalse"))
    assert before - left.count() == 3 and not (tmp_path / "cacheFalse.aside").exists()


def test_tiles_are_limited_before_they_are_grouped(spark):
    df = spark.range(100).select(F.col("id"), F.lit(0).alias("level"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("POINT(1 1)").alias("geometry"))
    r = tiles.encode_tiles(df, tiles.GRIDS["WorldCRS84Quad"], "l", fid="id", limit=7).first()
    assert r.n_features == 7


def test_encoders_of_reduced_back_ends():
    from lodestrata.sources import encoders

    fes = encoders.wfs_filter(parse("name = 'a<b' AND NOT (kind LIKE 'x%') AND S_INTERSECTS(geom, BBOX(1,2,3,4))"))
    assert "<fes:PropertyIsEqualTo><fes:ValueReference>name</fes:ValueReference><fes:Literal>a&lt;b</fes:Literal></fes:PropertyIsEqualTo>" in fes
    assert "<fes:Not><fes:PropertyIsLike" in fes and "<gml:lowerCorner>1.0 2.0</gml:lowerCorner>" in fes and fes.startswith("<fes:Filter")
    assert "<fes:ResourceId rid=\"k.7\"/>" in encoders.wfs_filter(parse("_ID_ IN ('k.7')"))
    assert "<fes:During>" in encoders.wfs_filter(parse("T_DURING(ts, INTERVAL('2001-01-01T00:00:00Z','2002-01-01T00:00:00Z'))"))
    assert "<fes:PropertyIsNull>" in encoders.wfs_filter(parse("ts > TIMESTAMP('2001-01-01T00:00:00Z')"))
    for bad in ("price > 5", "_ID_ IN ('a','b')", "S_WITHIN(geom, BBOX(1,2,3,4))", "price BETWEEN 1 AND 2"):
        with pytest.raises(CqlError):
            encoders.wfs_filter(parse(bad))
    templates = {"id": 'id: "{{value}}"', "box": "bbox: [{{xmin}}, {{ymin}}, {{xmax}}, {{ymax}}]"}
    assert encoders.graphql_arguments(parse("_ID_ IN ('7') AND S_INTERSECTS(geom, BBOX(1,2,3,4))"), templates) == 'id: "7", bbox: [1.0, 2.0, 3.0, 4.0]'
    with pytest.raises(CqlError):
        encoders.graphql_arguments(parse("name = 'x'"), templates)


def test_curves_become_lines():
    from math import hypot

    from lodestrata.functions import wkt

    kind, half = wkt.parse("CIRCULARSTRING(1 0,0 1,-1 0)")
    assert kind == "LineString" and len(half) == 65 and all(abs(hypot(*c) - 1) < 1e-12 for c in half) and half[32] == pytest.approx([0, 1])
    _, circle = wkt.parse("CIRCULARSTRING(1 0,-1 0,1 0)")
    assert len(circle) == 129 and circle[0] == circle[-1]
    _, clockwise = wkt.parse("CIRCULARSTRING(-1 0,0 1,1 0)")
    assert all(c[1] >= -1e-12 for c in clockwise)
    kind, rings = wkt.parse("CURVEPOLYGON(COMPOUNDCURVE(CIRCULARSTRING(0 0,1 1,2 0),(2 0,2 -1,0 -1,0 0)))")
    assert kind == "Polygon" and rings[0][0] == rings[0][-1] == [0, 0] and tiles.G.signed_area(tiles.G.force_ccw((kind, rings))[1][0]) == pytest.approx(2 + 3.14159 / 2, abs=1e-3)
    assert wkt.parse("MULTISURFACE(((0 0,1 0,1 1,0 0)),CURVEPOLYGON((5 5,6 5,6 6,5 5)))")[0] == "MultiPolygon"
    assert wkt.parse("MULTICURVE((0 0,1 1),CIRCULARSTRING(0 0,1 1,2 0))")[0] == "MultiLineString" and wkt.parse("CIRCULARSTRING EMPTY") == ("LineString", [])


def test_hooks_and_statistics(provider):
    from dataclasses import replace

    from lodestrata.streaming.changes import StatisticsCache

    provider.before.append(lambda q: replace(q, limit=3))
    provider.after.append(lambda q, df: df.withColumn("by", F.lit(q.type)))
    rows = provider.query(FeatureQuery("orders", fields=("key",))).collect()
    assert len(rows) == 3 and {r.by for r in rows} == {"orders"}
    cache, calls = StatisticsCache(), []
    count = lambda: cache.get("orders", "count", lambda: calls.append(1) or provider.count("orders"))
    assert count() == count() and len(calls) == 1
    listen = cache.listener("orders")
    listen(provider.spark.range(0), 1)
    count()
    listen(provider.spark.range(1), 2)
    count()
    assert len(calls) == 2


def test_types_of_a_web_feature_service():
    from lodestrata.sources import services

    caps = '''<wfs:WFS_Capabilities xmlns:wfs="http://www.opengis.net/wfs/2.0" xmlns:ows="http://www.opengis.net/ows/1.1"><wfs:FeatureTypeList><wfs:FeatureType>
      <wfs:Name>shop:Order</wfs:Name><wfs:Title>Orders</wfs:Title><wfs:DefaultCRS>urn:ogc:def:crs:EPSG::25832</wfs:DefaultCRS>
      <ows:WGS84BoundingBox><ows:LowerCorner>5.5 47</ows:LowerCorner><ows:UpperCorner>15 55.25</ows:UpperCorner></ows:WGS84BoundingBox></wfs:FeatureType></wfs:FeatureTypeList></wfs:WFS_Capabilities>'''
    assert services.capabilities(caps) == [{"name": "shop:Order", "title": "Orders", "crs": "urn:ogc:def:crs:EPSG::25832", "box": (5.5, 47, 15, 55.25)}]
    xsd = '''<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:s="urn:shop">
      <xs:element name="Order" type="s:OrderType"/>
      <xs:complexType name="OrderType"><xs:complexContent><xs:extension base="gml:AbstractFeatureType"><xs:sequence>
        <xs:element name="id" type="xs:int"/><xs:element name="place" type="gml:PointPropertyType" minOccurs="0"/>
        <xs:element name="note" type="s:Note" minOccurs="0" maxOccurs="unbounded"/>
        <xs:element name="item" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="size" type="xs:double"/><xs:element name="day" type="xs:date"/></xs:sequence></xs:complexType></xs:element>
      </xs:sequence></xs:extension></xs:complexContent></xs:complexType>
      <xs:simpleType name="Note"><xs:restriction base="xs:string"/></xs:simpleType></xs:schema>'''
    t = services.xsd_types(xsd)["Order"]
    assert {x.name: x.property.type for x in t.leaves()} == {"id": "STRING", "_id_": "INTEGER", "place": "GEOMETRY", "note": "VALUE_ARRAY", "item.size": "FLOAT", "item.day": "DATE"}
    assert t.with_role("PRIMARY_GEOMETRY").name == "place" and {p.name: p.type for p in t.properties}["item"] == "OBJECT_ARRAY" and set(t.required_names()) >= {"_id_", "item"}


def test_graphql_is_a_data_source(spark):
    """Pages are partitions; nested objects and lists come as their types."""
    import json
    import re
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lodestrata.sources import services

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            query = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["query"]
            a, n = map(int, re.findall(r"\d+", query)[:2])
            rows = [{"id": i, "tags": ["x", str(i)], "at": {"x": i / 2}} for i in range(a, min(a + n, 25))]
            body = json.dumps({"data": {"shop": {"orders": rows}}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        services.register(spark)
        read = spark.read.format("graphql").schema("id bigint, tags array<string>, at struct<x: double>").options(url=f"http://127.0.0.1:{server.server_port}/", query="{ orders(offset: {{offset}}, limit: {{limit}}) { id } }", root="shop.orders", total="25", pagesize="10")
        rows = sorted(read.load().collect())
        assert [r.id for r in rows] == list(range(25)) and rows[7].tags == ["x", "7"] and rows[7].at.x == 3.5
    finally:
        server.shutdown()


def _varints(data):
    at, out = 0, []
    while at < len(data):
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        out.append(n)
    return out


def _messages(data):
    """Fields of a protocol buffer: (number, value) with bytes for nested ones."""
    at = 0
    while at < len(data):
        n = 0
        for shift in range(0, 70, 7):
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                break
        number, kind = n >> 3, n & 7
        if kind == 1:
            yield number, data[at : at + 8]
            at += 8
            continue
        size = 0
        for shift in range(0, 70, 7):
            b = data[at]
            at += 1
            size |= (b & 127) << shift
            if b < 128:
                break
        if kind == 0:
            yield number, size
        else:
            yield number, data[at : at + size]
            at += size


def test_tiles_decode_to_their_points(spark):
    """Every tile, read by a decoder of its own: ids, places and properties of the points that fall into it."""
    import struct

    grid = tiles.GRIDS["WorldCRS84Quad"]
    points = {r.c_custkey: r for r in catalog.tables(spark, SF)("customer_geo").collect()}
    seen = {0: set(), 1: set()}
    for t in catalog.queries()["mvt_bytes"](spark, SF).collect():
        box = grid.tile_box(t.level, t.row, t.col)
        (number, layer), = _messages(bytes(t.data))
        assert number == 3
        parts = list(_messages(layer))
        keys, values = [v.decode() for n, v in parts if n == 3], [dict(_messages(v)) for n, v in parts if n == 4]
        assert dict((n, v) for n, v in parts if n in (1, 5, 15)) == {1: b"customers", 5: 4096, 15: 2}
        for n, feature in parts:
            if n != 2:
                continue
            f = dict(_messages(feature))
            p, tags, (command, x, y) = points[f[1]], _varints(f[2]), _varints(f[4])
            x, y = (x >> 1) ^ -(x & 1), (y >> 1) ^ -(y & 1)
            assert command == 9 and f[3] == 1
            assert (x, y) == (round((p.lon - box[0]) / (box[2] - box[0]) * 4096), round((box[3] - p.lat) / (box[3] - box[1]) * 4096))
            own = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}
            assert own["c_mktsegment"][1].decode() == p.c_mktsegment and struct.unpack("<d", own["c_acctbal"][3])[0] == p.c_acctbal
            seen[t.level].add(f[1])
    assert seen[0] == seen[1] == set(points)


def test_simplified_lines_stay_within_the_tolerance(spark):
    """Against the lines themselves: ends stay, kept points are points of the line, dropped ones lie near what is left."""
    from math import dist

    from lodestrata.functions import wkt

    prices = spark.read.parquet(f"{SF}/orders.parquet").orderBy("o_custkey", "o_orderkey").collect()
    lines = {}
    for r in prices:
        lines.setdefault(r.o_custkey, []).append(r.o_totalprice)
    fewer = 0
    for r in catalog.queries()["g_simplify"](spark, SF).collect():
        kept = [tuple(c) for c in wkt.parse(r.line)[1]]
        xs = [int(c[0]) for c in kept]
        assert xs == sorted(set(xs)) and xs[0] == 0 and xs[-1] == len(lines[r.o_custkey]) - 1
        fewer += len(kept) < len(lines[r.o_custkey])
        for i, price in enumerate(lines[r.o_custkey]):
            y = round(price / 10000)
            near = []
            for (ax, ay), (bx, by) in zip(kept, kept[1:]):
                t = max(0, min(1, ((i - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                near.append(dist((i, y), (ax + t * (bx - ax), ay + t * (by - ay))))
            assert min(near) <= 1.5  # one of the tolerance, and half of the rounding's ties
    assert fewer


def test_intersection_in_space():
    from lodestrata.functions import predicates, wkt

    meet = lambda a, b: predicates.evaluate("s_intersects", wkt.parse(a), wkt.parse(b))
    roof = "POLYGON Z((0 0 5,4 0 5,4 4 5,0 4 5,0 0 5),(1 1 5,2 1 5,2 2 5,1 2 5,1 1 5))"
    for other, want in (
        ("POINT Z(3 3 5)", True), ("POINT Z(3 3 6)", False), ("POINT(3 3)", False), ("POINT Z(1.5 1.5 5)", False), ("LINESTRING Z(3 3 0,3 3 9)", True), ("LINESTRING Z(3 3 0,3 3 4)", False),
        ("LINESTRING Z(1.5 1.5 0,1.5 1.5 9)", False), ("LINESTRING Z(-1 3 5,9 3 5)", True), ("LINESTRING Z(1.2 1.2 5,1.8 1.8 5)", False), ("POLYGON Z((3 -1 0,3 5 0,3 5 9,3 -1 9,3 -1 0))", True),
        ("POLYGON Z((3 -1 0,3 5 0,3 5 4,3 -1 4,3 -1 0))", False), ("POLYGON Z((2.5 2.5 5,3 2.5 5,3 3 5,2.5 2.5 5))", True), ("MULTIPOINT Z((9 9 9),(0 0 5))", True), ("GEOMETRYCOLLECTION(POINT Z(4 4 5))", True),
    ):
        assert meet(roof, other) is want and meet(other, roof) is want, other
    assert meet("LINESTRING Z(0 0 0,2 2 2)", "LINESTRING Z(0 2 2,2 0 0)") and not meet("LINESTRING Z(0 0 0,2 2 0)", "LINESTRING Z(0 2 1,2 0 1)")


def test_features_of_lines_and_of_xml(spark, tmp_path):
    from lodestrata.sources import readers

    (tmp_path / "s.geojsonl").write_text('\x1e{"type": "Feature", "id": 1, "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": 5}}\n\n{"type": "Feature", "id": 2, "geometry": null, "properties": {"a": null}}\n')
    assert [tuple(r) for r in readers.read_geojson(spark, str(tmp_path / "s.geojsonl"), "a int", lines=True).collect()] == [("1", "POINT(1 2)", 5), ("2", None, None)]
    member = '<m><s:Order gml:id="o.{0}"><s:n>{0}</s:n>{1}</s:Order></m>'
    shapes = ("<s:geom><gml:Point><gml:pos>1 2</gml:pos></gml:Point></s:geom>", "", "<s:geom><gml:LineString><gml:posList>1 2 3 4</gml:posList></gml:LineString></s:geom>")
    (tmp_path / "c.xml").write_text('<c xmlns:gml="g" xmlns:s="s">' + "".join(member.format(i, g) for i, g in enumerate(shapes)) + "</c>")
    rows = readers.read_gml(spark, str(tmp_path / "c.xml"), "s:Order", "_id string, n int", "geom").collect()
    assert [tuple(r) for r in rows] == [("o.0", 0, "POINT(1 2)"), ("o.1", 1, None), ("o.2", 2, "LINESTRING(1 2,3 4)")]


def test_tables_of_a_database(spark):
    """Through JDBC, whole and in parts, with the comparison pushed down to the database."""
    from lodestrata.sources import readers

    url, driver = "jdbc:derby:memory:lodestrata;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).selectExpr("CAST(id AS INT) AS id", "concat('n', id % 7) AS name")
    rows.write.format("jdbc").options(url=url, dbtable="things", driver=driver).mode("overwrite").save()
    whole = readers.jdbc_tables(spark, url, driver=driver)("things")
    parts = readers.jdbc_tables(spark, url, partition=("id", 0, 100, 4), driver=driver)("things")
    assert whole.count() == parts.count() == 100
    assert parts.rdd.getNumPartitions() == 4
    few = whole.filter("id < 10")
    assert few.count() == 10 and "PushedFilters: [*IsNotNull(ID), *LessThan(ID,10)]" in plan(few).replace("id", "ID")
    assert readers.crawl(lambda n: whole, ["things"])["things"].leaf("id").property.type == "INTEGER"
