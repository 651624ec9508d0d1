"""Feature types over the driver's test tables, and one query with its SQL twin for each operator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import crs as C
from lodestrata.functions import geometry as G
from lodestrata.functions.transformations import flatten
from lodestrata.operators import mutations, routing, tiles, tilesets
from lodestrata.plans.query import FeatureQuery, Provider
from lodestrata.schema.model import FeatureType
from lodestrata.sources.readers import crawl, parquet_tables, validate
from lodestrata.streaming.changes import apply_changes

Query = Callable[[SparkSession, str], DataFrame]

ORDERS = FeatureType.of(
    "orders", "/orders{sortKey=o_orderkey}",
    {"name": "key", "type": "INTEGER", "source_path": "o_orderkey", "role": "ID"},
    {"name": "custkey", "type": "INTEGER", "source_path": "o_custkey"},
    {"name": "status", "source_path": "o_orderstatus"},
    {"name": "price", "type": "FLOAT", "source_path": "o_totalprice"},
    {"name": "date", "type": "DATETIME", "source_path": "o_orderdate", "role": "PRIMARY_INSTANT"},
    {"name": "priority", "source_path": "o_orderpriority"},
    {"name": "unfinished", "source_path": "[EXPRESSION]{sql=nullif(o_orderstatus, 'F')}"},
    {"name": "customer", "type": "OBJECT", "source_path": "[o_custkey=c_custkey]customer", "properties": [
        {"name": "name", "source_path": "c_name"}, {"name": "segment", "source_path": "c_mktsegment"}, {"name": "balance", "type": "FLOAT", "source_path": "c_acctbal"}]},
    {"name": "items", "type": "OBJECT_ARRAY", "source_path": "[o_orderkey=l_orderkey]lineitem{sortKey=l_linenumber}", "properties": [
        {"name": "line", "type": "INTEGER", "source_path": "l_linenumber"}, {"name": "quantity", "type": "FLOAT", "source_path": "l_quantity"},
        {"name": "flag", "source_path": "l_returnflag"}, {"name": "shipped", "type": "DATETIME", "source_path": "l_shipdate"}]},
    {"name": "flags", "type": "VALUE_ARRAY", "value_type": "STRING", "source_path": "[o_orderkey=l_orderkey]lineitem{sortKey=l_linenumber}/l_returnflag"},
    {"name": "parts", "type": "OBJECT_ARRAY", "source_path": "[o_orderkey=l_orderkey]lineitem/[l_partkey=p_partkey]part{sortKey=p_partkey}", "properties": [
        {"name": "brand", "source_path": "p_brand"}, {"name": "size", "type": "INTEGER", "source_path": "p_size"}]},
)

CUSTOMER = FeatureType.of(
    "customer", "/customer_geo{sortKey=c_custkey}",
    {"name": "key", "type": "INTEGER", "source_path": "c_custkey", "role": "ID"},
    {"name": "name", "source_path": "c_name"},
    {"name": "balance", "type": "FLOAT", "source_path": "c_acctbal"},
    {"name": "segment", "source_path": "c_mktsegment"},
    {"name": "location", "type": "GEOMETRY", "role": "PRIMARY_GEOMETRY", "point": ("lon", "lat")},
    {"name": "nation", "type": "FEATURE_REF", "source_path": "[c_nationkey=n_nationkey]nation/n_nationkey", "ref_type": "nation", "value_type": "INTEGER", "embed": True},
    {"name": "orders", "type": "OBJECT_ARRAY", "source_path": "[c_custkey=o_custkey]orders{sortKey=o_orderkey}", "properties": [
        {"name": "price", "type": "FLOAT", "source_path": "o_totalprice"}, {"name": "status", "source_path": "o_orderstatus"}]},
)

NATION = FeatureType.of(
    "nation", "/nation{sortKey=n_nationkey}",
    {"name": "key", "type": "INTEGER", "source_path": "n_nationkey", "role": "ID"},
    {"name": "title", "source_path": "n_name"},
)

EVENTS = FeatureType.of(
    "events", "/events{sortKey=event_id}",
    {"name": "id", "type": "INTEGER", "source_path": "event_id", "role": "ID"},
    {"name": "ts", "type": "DATETIME", "source_path": "ts", "role": "PRIMARY_INSTANT"},
    {"name": "kind", "source_path": "event_type"},
    {"name": "value", "type": "FLOAT", "source_path": "value"},
    {"name": "k", "type": "INTEGER", "source_path": "[JSON]props/k"},
    {"name": "tags", "type": "VALUE_ARRAY", "value_type": "INTEGER", "source_path": "[EXPRESSION]{sql=array(int(get_json_object(props, '$.k')), int(event_id % 7))}"},
)

PARTY = FeatureType(
    "party", "/customer_geo{sortKey=c_custkey}",
    FeatureType.of("x", "/x", {"name": "name", "source_path": "c_name"}, {"name": "balance", "type": "FLOAT", "source_path": "c_acctbal"}, {"name": "kind", "constant": "customer"}).properties,
    (FeatureType.of("party", "/supplier{sortKey=s_suppkey}", {"name": "name", "source_path": "s_name"}, {"name": "balance", "type": "FLOAT",
        "source_path": "s_acctbal"}, {"name": "kind", "constant": "supplier"}),),
)

SHAPE = FeatureType.of(
    "shape", "/customer_shape{sortKey=c_custkey}",
    {"name": "key", "type": "INTEGER", "source_path": "c_custkey", "role": "ID"},
    {"name": "line", "type": "GEOMETRY", "source_path": "line"},
    {"name": "square", "type": "GEOMETRY", "source_path": "square", "role": "PRIMARY_GEOMETRY"},
    {"name": "pole", "type": "GEOMETRY", "excluded_scopes": ["RETURNABLE"], "source_path": "[EXPRESSION]{sql=concat('LINESTRING Z(', lon, ' ', y, ' 0,', lon, ' ', y, ' ', c_acctbal / 100, ')')}"},
    {"name": "balance", "type": "FLOAT", "source_path": "c_acctbal", "excluded_scopes": ["RETURNABLE"]},
)

DOCS = FeatureType.of(
    "docs", "/events_doc{sortKey=event_id}",
    {"name": "id", "type": "INTEGER", "source_path": "event_id", "role": "ID"},
    {"name": "values", "type": "VALUE_ARRAY", "value_type": "INTEGER", "source_path": "[JSON]doc/items[*]/v"},
    {"name": "list", "type": "VALUE_ARRAY", "value_type": "INTEGER", "source_path": "[JSON]doc/list"},
)

#: Lines have no unique key of their own: the engine numbers the rows of one order.
LINES = FeatureType.of(
    "lines", "/lineitem{sortKey=l_orderkey}{sortKeyUnique=false}",
    {"name": "key", "type": "INTEGER", "source_path": "l_orderkey"},
    {"name": "line", "type": "INTEGER", "source_path": "l_linenumber"},
    {"name": "n", "type": "INTEGER", "source_path": "_number"},
    {"name": "start", "type": "DATETIME", "source_path": "l_shipdate", "role": "PRIMARY_INTERVAL_START"},
    {"name": "end", "type": "DATETIME", "source_path": "[EXPRESSION]{sql=l_shipdate + make_dt_interval(l_linenumber)}", "role": "PRIMARY_INTERVAL_END"},
)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CODELISTS = {"status": {"entries": {"O": "open", "F": "filled"}, "fallback": "other"}}


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """The Parquet tables, and customers with a point made from their key."""
    read = parquet_tables(spark, sf_dir)

    def get(name: str) -> DataFrame:
        if name == "customer_shape":
            geo = get("customer_geo").withColumn("y", F.round(F.col("lat") * 0.8, 1))
            at = lambda dx, dy: F.concat_ws(" ", F.col("lon") + dx, F.round(F.col("y") + dy, 1))
            line = F.concat(F.lit("LINESTRING("), F.concat_ws(",", at(0, 0), at(10, 0)), F.lit(")"))
            ring = F.concat(F.lit("POLYGON(("), F.concat_ws(",", at(0, 0), at(10, 0), at(10, 10), at(0, 10), at(0, 0)), F.lit("))"))
            return geo.withColumn("line", line).withColumn("square", ring)
        if name == "events_doc":
            item = lambda c: F.struct(c.alias("v"))
            doc = F.struct(F.array(item(F.col("event_id") % 5), item(F.lit(None).cast("long")), item(F.col("event_id") % 3)).alias("items"), F.array(F.col("event_id") % 4, F.lit(7)).alias("list"))
            return read("events").select("event_id", F.to_json(doc).alias("doc"))
        if name == "customer_geo":
            return read("customer").withColumn("lon", (F.col("c_custkey") * 37 % 360 - 180).cast("double")).withColumn("lat", (F.col("c_custkey") * 17 % 180 - 90).cast("double"))
        return read(name)

    return get


def provider(spark: SparkSession, sf_dir: str) -> Provider:
    from lodestrata.schema.resolve import embed

    types = {t.name: t for t in (ORDERS, NATION, EVENTS, PARTY, SHAPE, DOCS, LINES)}
    types["customer"] = embed(CUSTOMER, types)
    return Provider(spark, tables(spark, sf_dir), types, codelists=CODELISTS)


def _flat(type_: str, fields: str, *filters: str, **more) -> Query:
    return lambda spark, d: provider(spark, d).query(FeatureQuery(type_, filters=filters, fields=tuple(fields.split()), **more))


def _orders(where: str) -> str:
    return f"SELECT o_orderkey AS key, o_totalprice AS price FROM orders o WHERE {where}"


def _customers(where: str) -> str:
    return f"SELECT c_custkey AS key FROM (SELECT *, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 17 % 180 - 90 AS DOUBLE) AS lat FROM customer) c WHERE {where}"


#: Filters over orders: CQL2 text and SQL condition.
FILTERS = {
    "f_eq": ("status = 'O'", "o_orderstatus = 'O'"),
    "f_neq": ("status <> 'O'", "o_orderstatus <> 'O'"),
    "f_lt": ("price < 100000", "o_totalprice < 100000"),
    "f_lte": ("custkey <= 100", "o_custkey <= 100"),
    "f_gt": ("price > 250000.5", "o_totalprice > 250000.5"),
    "f_gte": ("date >= TIMESTAMP('1997-01-01T00:00:00Z')", "o_orderdate >= TIMESTAMP '1997-01-01'"),
    "f_like": ("priority LIKE '%-%I%'", "o_orderpriority LIKE '%-%I%'"),
    "f_not_like": ("priority NOT LIKE '1%'", "o_orderpriority NOT LIKE '1%'"),
    "f_like_number": ("custkey LIKE '1%'", "CAST(o_custkey AS VARCHAR) LIKE '1%'"),
    "f_between": ("price BETWEEN 50000 AND 60000", "o_totalprice BETWEEN 50000 AND 60000"),
    "f_not_between": ("price NOT BETWEEN 50000 AND 60000", "o_totalprice NOT BETWEEN 50000 AND 60000"),
    "f_in": ("status IN ('O','P')", "o_orderstatus IN ('O', 'P')"),
    "f_not_in": ("status NOT IN ('O','P')", "o_orderstatus NOT IN ('O', 'P')"),
    "f_in_id": ("_ID_ IN (1,2,3,7)", "o_orderkey IN (1, 2, 3, 7)"),
    "f_is_null": ("unfinished IS NULL", "o_orderstatus = 'F'"),
    "f_not_null": ("status IS NOT NULL", "o_orderstatus IS NOT NULL"),
    "f_and_or": ("status = 'O' AND (price > 200000 OR custkey < 50)", "o_orderstatus = 'O' AND (o_totalprice > 200000 OR o_custkey < 50)"),
    "f_not_demorgan": ("NOT (status = 'O' OR price > 100000)", "NOT (o_orderstatus = 'O' OR o_totalprice > 100000)"),
    "f_bool_literal": ("true AND (false OR custkey = 7)", "o_custkey = 7"),
    "f_casei": ("CASEI(priority) = CASEI('1-urgent')", "lower(o_orderpriority) = '1-urgent'"),
    "f_accenti": ("ACCENTI(status) = ACCENTI('Ó')", "strip_accents(o_orderstatus) = 'O'"),
    "f_upper_lower": ("LOWER(status) = 'o' AND UPPER(priority) LIKE '%HIGH'", "lower(o_orderstatus) = 'o' AND upper(o_orderpriority) LIKE '%HIGH'"),
    "f_prop_prop": ("custkey > key", "o_custkey > o_orderkey"),
    "f_json_encoding": ('{"op": "and", "args": [{"op": ">", "args": [{"property": "price"}, 100000]}, {"op": "like", "args": [{"property": "priority"}, "2%"]}]}',
        "o_totalprice > 100000 AND o_orderpriority LIKE '2%'"),
    "j_semi_existential": ("items.quantity = 50 AND items.flag = 'R'", "EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50) AND EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"),
    "j_semi_not": ("NOT (items.flag = 'N')", "EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N')"),
    "j_semi_or": ("items.quantity > 49 OR customer.balance < 0", "EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) OR EXISTS (FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)"),
    "j_n_to_one_filter": ("customer.segment = 'BUILDING'", "EXISTS (FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')"),
    "j_nested_filter": ("items[flag = 'R'].quantity > 45", "EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)"),
    "j_m_to_n_filter": ("parts.size > 48", "EXISTS (FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 48)"),
    "j_position": ("items[position() = 2].quantity > 40", "EXISTS (FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE l_orderkey = o_orderkey AND n = 2 AND l_quantity > 40)"),
    "a_contains": ("A_CONTAINS(flags, ('A','R'))", "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2)"),
    "a_equals": ("A_EQUALS(flags, ('A','R'))", "o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2 AND count(*) FILTER (l_returnflag NOT IN ('A', 'R')) = 0)"),
    "a_overlaps": ("A_OVERLAPS(flags, ('A','R'))", "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R'))"),
    "a_containedby": ("A_CONTAINEDBY(flags, ('A','R'))", "o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag NOT IN ('A', 'R')) = 0)"),
    "a_literals": ("A_CONTAINS(('a','b'), ('b'))", "true"),
    "a_swapped": ("A_CONTAINEDBY(('A','R'), flags)", "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2)"),
    "a_not_contains": ("NOT (A_CONTAINS(flags, ('A','R')))", "o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2)"),
    "t_interval_props": ("T_INTERSECTS(INTERVAL(date,date), INTERVAL('1996-01-01','1996-03-31'))", "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-03-31 23:59:59'"),
    "t_offset": ("date >= TIMESTAMP('1996-01-01T00:00:00-05:00') AND date < TIMESTAMP('1996-03-01T02:30:00+02:30')", "o_orderdate >= TIMESTAMP '1996-01-01 05:00:00' AND o_orderdate < TIMESTAMP '1996-03-01'"),
    "t_interval_open": ("T_DURING(date, INTERVAL('1997-06-10T07:30:00Z','..'))", "o_orderdate > TIMESTAMP '1997-06-10 07:30:00'"),
}

_A, _B = "1996-01-01T00:00:00Z", "1996-12-31T00:00:00Z"
#: Temporal operators between the order date and an interval (starts and ends that dates can hit), and their conditions.
TEMPORAL = {
    "t_after": "o_orderdate > b", "t_before": "o_orderdate < a", "t_during": "o_orderdate > a AND o_orderdate < b",
    "t_equals": "o_orderdate = a AND o_orderdate = b", "t_starts": "o_orderdate = a AND o_orderdate < b", "t_startedBy": "o_orderdate = a AND o_orderdate > b",
    "t_contains": "o_orderdate < a AND o_orderdate > b", "t_disjoint": "o_orderdate < a OR o_orderdate > b", "t_intersects": "o_orderdate >= a AND o_orderdate <= b",
    "t_finishes": "o_orderdate > a AND o_orderdate = b", "t_finishedBy": "o_orderdate < a AND o_orderdate = b", "t_meets": "o_orderdate = a", "t_metBy": "o_orderdate = b",
    "t_overlaps": "o_orderdate < a AND o_orderdate > a AND o_orderdate < b", "t_overlappedBy": "o_orderdate > a AND o_orderdate < b AND o_orderdate > b",
}
#: Relations that an instant and an interval cannot have; they are shown on intervals of properties below.
_INTERVALS_ONLY = ("t_equals", "t_startedBy", "t_contains", "t_finishedBy", "t_overlaps", "t_overlappedBy")
for _op, _where in TEMPORAL.items():
    if _op not in _INTERVALS_ONLY:
        _sql = _where.replace(" a", " TIMESTAMP '1996-01-01'").replace(" b", " TIMESTAMP '1996-12-31'")
        FILTERS[_op.lower()] = (f"{_op.upper()}(date, INTERVAL('{_A}','{_B}'))", _sql)

#: Temporal operators between the interval from a shipping date to so many days later as the line's number, and four days.
_S, _E = "l_shipdate", "l_shipdate + to_days(l_linenumber)"
INTERVALS = {
    "t_equals": "s = a AND e = b", "t_startedBy": "s = a AND e > b", "t_contains": "s < a AND e > b", "t_finishedBy": "s < a AND e = b",
    "t_overlaps": "s < a AND e > a AND e < b", "t_overlappedBy": "s > a AND s < b AND e > b", "ti_starts": "s = a AND e < b", "ti_during": "s > a AND e < b",
    "ti_finishes": "s > a AND e = b", "ti_meets": "e = a", "ti_metBy": "s = b", "ti_after": "s > b", "ti_before": "e < a", "ti_disjoint": "e < a OR s > b", "ti_intersects": "e >= a AND s <= b",
}


def _interval_sql(where: str) -> str:
    names = {"s": _S, "e": _E, "a": "TIMESTAMP '1996-05-02'", "b": "TIMESTAMP '1996-05-06'"}
    return f"SELECT l_orderkey AS key, l_linenumber AS line, count(*) AS n FROM lineitem WHERE {re.sub(r'\b[seab]\b', lambda m: names[m[0]], where)} GROUP BY 1, 2"


_TRIANGLE = "POLYGON((-100.5 -60.5,120.5 -20.5,10.5 70.5,-100.5 -60.5))"
_SIDE = lambda ax, ay, bx, by: f"(({bx}) - ({ax})) * (lat - ({ay})) - (({by}) - ({ay})) * (lon - ({ax})) > 0"
_IN_TRIANGLE = " AND ".join((_SIDE(-100.5, -60.5, 120.5, -20.5), _SIDE(120.5, -20.5, 10.5, 70.5), _SIDE(10.5, 70.5, -100.5, -60.5)))
#: Spatial filters over customers.
SPATIAL = {
    "g_intersects_bbox": ("S_INTERSECTS(location, BBOX(-10,-20,60,45))", "lon BETWEEN -10 AND 60 AND lat BETWEEN -20 AND 45"),
    "g_within_bbox": ("S_WITHIN(location, BBOX(-10,-20,60,45))", "lon > -10 AND lon < 60 AND lat > -20 AND lat < 45"),
    "g_touches_bbox": ("S_TOUCHES(location, BBOX(-10,-20,60,45))", "lon BETWEEN -10 AND 60 AND lat BETWEEN -20 AND 45 AND NOT (lon > -10 AND lon < 60 AND lat > -20 AND lat < 45)"),
    "g_disjoint_bbox": ("S_DISJOINT(location, BBOX(-10,-20,60,45))", "NOT (lon BETWEEN -10 AND 60 AND lat BETWEEN -20 AND 45)"),
    "g_bbox_antimeridian": ("S_INTERSECTS(location, BBOX(150,-40,-150,40))", "(lon >= 150 OR lon <= -150) AND lat BETWEEN -40 AND 40"),
    "g_within_polygon": (f"S_WITHIN(location, {_TRIANGLE})", _IN_TRIANGLE),
    "g_disjoint_polygon": (f"S_DISJOINT(location, {_TRIANGLE})", f"NOT ({_IN_TRIANGLE})"),
    "g_equals_point": ("S_EQUALS(location, POINT(-106 -56))", "lon = -106 AND lat = -56"),
    "g_contains_multipoint": ("S_CONTAINS(MULTIPOINT(-106 -56,-69 -39), location)", "(lon = -106 AND lat = -56) OR (lon = -69 AND lat = -39)"),
    "g_intersects_line": ("S_INTERSECTS(location, LINESTRING(-180 0,180 0))", "lat = 0"),
    "g_and_scalar": ("S_INTERSECTS(location, BBOX(-10,-20,60,45)) AND balance > 0", "lon BETWEEN -10 AND 60 AND lat BETWEEN -20 AND 45 AND c_acctbal > 0"),
}

#: Spatial filters over a line and a square at each customer's place (``y`` is its latitude, drawn in from the poles).
_BOX_SQL = "lon < 60 AND lon + 10 > -10 AND y < 45 AND y + 10 > -20"
_INSIDE_SQL = "lon > -10 AND lon + 10 < 60 AND y > -20 AND y + 10 < 45"
SHAPES = {
    "g_crosses": ("S_CROSSES(line, BBOX(-10,-20,60,45))", "y > -20 AND y < 45 AND lon < 60 AND lon + 10 > -10 AND (lon < -10 OR lon + 10 > 60)"),
    "g_crosses_line": ("S_CROSSES(line, LINESTRING(5.5 -80,5.5 80))", "lon < 5.5 AND lon + 10 > 5.5"),
    "g_overlaps": ("S_OVERLAPS(square, BBOX(-10,-20,60,45))", f"{_BOX_SQL} AND NOT (lon >= -10 AND lon + 10 <= 60 AND y >= -20 AND y + 10 <= 45)"),
    "g_touches_square": ("S_TOUCHES(square, BBOX(-10,-20,60,45))", f"lon <= 60 AND lon + 10 >= -10 AND y <= 45 AND y + 10 >= -20 AND NOT ({_BOX_SQL})"),
    "g_within_square": ("S_WITHIN(square, BBOX(-10.5,-20.5,60.5,45.5))", "lon >= -10.5 AND lon + 10 <= 60.5 AND y >= -20.5 AND y + 10 <= 45.5"),
    "g_contains_square": ("S_CONTAINS(square, POINT(5.5 5.25))", "lon < 5.5 AND lon + 10 > 5.5 AND y < 5.25 AND y + 10 > 5.25"),
    "g_intersects_square": ("S_INTERSECTS(square, LINESTRING(0.5 -90,0.5 90))", "lon <= 0.5 AND lon + 10 >= 0.5"),
    "g_disjoint_line": ("S_DISJOINT(line, BBOX(-10,-20,60,45))", "NOT (lon <= 60 AND lon + 10 >= -10 AND y <= 45 AND y >= -20)"),
    "g_equals_line": ("S_EQUALS(line, LINESTRING(-96 -44.8,-106 -44.8))", "lon = -106 AND y = -44.8"),
    "g_intersects_3d": ("S_INTERSECTS(pole, POLYGON((-10 -20 50,60 -20 50,60 45 50,-10 45 50,-10 -20 50)))", "lon BETWEEN -10 AND 60 AND y BETWEEN -20 AND 45 AND c_acctbal >= 5000"),
    "g_diameter": ("DIAMETER2D(square) > 2000000", "sqrt(pow(6378137 * radians(10), 2) + pow(6378137 * (ln(tan(pi() / 4 + radians(y + 10) / 2)) - ln(tan(pi() / 4 + radians(y) / 2))), 2)) > 2000000"),
    "g_diameter_3d": ("DIAMETER3D(square) > 1400000", "diameter > 1400000"),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expensive recent orders: filter, sort and page over one type."""
    return provider(spark, sf_dir).query(FeatureQuery("orders", ("price > 1000 AND T_AFTER(date, TIMESTAMP('1996-01-01T00:00:00Z'))",), ("-price",), ("key", "price"), limit=100))


def _json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def _multi(spark, d):
    p = provider(spark, d)
    return p.multi([FeatureQuery("nation", fields=("title",)), FeatureQuery("customer", ("balance > 9000",), fields=("name",))]).select("title", "name", F.col("_ordinal").alias("ordinal"))


def _sum_items(spark, d, *filters):
    df = _flat("orders", "key items", *filters)(spark, d)
    return df.select("key", F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0.0), lambda a, x: a + x["quantity"]).alias("quantity"),
        F.array_join(F.transform("items", lambda x: x["line"].cast("string")), ",").alias("lines"))


def _transformed(spark, d, type_spec: list[dict], fields: str, *filters: str, **more) -> DataFrame:
    t = FeatureType.of("t", "/orders{sortKey=o_orderkey}", *type_spec)
    return Provider(spark, tables(spark, d), {"t": t}, codelists=CODELISTS).query(FeatureQuery("t", filters, fields=tuple(fields.split()), **more))


_KEY = {"name": "key", "type": "INTEGER", "source_path": "o_orderkey"}
_CUSTOMER = {"name": "customer", "type": "OBJECT", "source_path": "[o_custkey=c_custkey]customer", "properties": [{"name": "name",
    "source_path": "c_name"}, {"name": "segment", "source_path": "c_mktsegment"}]}


def _x(spec: list[dict], fields: str = "*") -> Query:
    return lambda spark, d: _transformed(spark, d, [_KEY, *spec], fields)


def _value(source: str, kind: str = "STRING", **t) -> dict:
    return {"name": "v", "type": kind, "source_path": source, "transformations": [t] if t else []}


def _cdc(spark, d):
    read = tables(spark, d)
    state = read("customer").select("c_custkey", "c_acctbal")
    e = read("events")
    changes = e.select((F.col("user_id") % 200 + 1).alias("c_custkey"), F.col("value").alias("c_acctbal"), F.when(F.col("event_id") % 5 == 0,
        "DELETE").otherwise("UPDATE").alias("action"), F.col("event_id").alias("at"))
    return apply_changes(state, changes, "c_custkey", "at")


_MUTABLE = FeatureType.of("n", "/nation{sortKey=n_nationkey}", {"name": "key", "type": "INTEGER", "source_path": "n_nationkey", "role": "ID"},
    {"name": "title", "source_path": "n_name"}, {"name": "region", "type": "INTEGER", "source_path": "n_regionkey"})


def _mutated(f) -> Query:
    def run(spark, d):
        own = {"nation": tables(spark, d)("nation")}
        out = f(own, own["nation"])["nation"]
        return out.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))

    return run


def _new_nations(n: DataFrame) -> DataFrame:
    return n.filter("n_nationkey < 5").select((F.col("n_nationkey") + 100).cast("int").alias("key"), F.concat(F.lit("new "), "n_name").alias("title"), F.col("n_regionkey").alias("region"))


def _changed_nations(n: DataFrame) -> DataFrame:
    return n.filter("n_nationkey < 5").select(F.col("n_nationkey").alias("key"), F.lower("n_name").alias("title"), F.lit(None).cast("int").alias("region"))


def _ranked(df: DataFrame) -> DataFrame:
    """With the place of each row in the result, so that a comparison of sets sees the order."""
    df = df.withColumn("_id", F.monotonically_increasing_id())
    return df.withColumn("rank", F.row_number().over(Window.orderBy("_id")).cast("long")).drop("_id")


def _sorted_multi(spark, d):
    p = provider(spark, d)
    parts = [FeatureQuery("nation", sort_keys=("-title",), fields=("title",)), FeatureQuery("orders", sort_keys=("-price",), fields=("key",))]
    return _ranked(p.multi(parts, limit=40, offset=3)).select("title", "key", "rank")


def _edges(spark, d):
    """A graph of all customers: each is reached from the one of half its key, and from its left neighbour by a way that never pays."""
    c = tables(spark, d)("customer").select(F.col("c_custkey").cast("long").alias("target")).filter("target > 1")
    cheap = c.select((F.col("target") * 2).alias("edge_id"), F.expr("target div 2").alias("source"), "target", (1 + F.col("target") % 3).cast("double").alias("cost"))
    dear = c.select((F.col("target") * 2 + 1).alias("edge_id"), (F.col("target") - 1).alias("source"), "target", F.lit(1000.0).alias("cost"))
    return cheap.unionByName(dear)


def _tile_counts(spark, d):
    g = tiles.GRIDS["WorldCRS84Quad"]
    return tiles.tile_points(tables(spark, d)("customer_geo"), g, range(0, 4), "lon", "lat").groupBy("level", "row", "col").agg(F.count("*").alias("n"))


def _mvt(spark, d):
    g = tiles.GRIDS["WorldCRS84Quad"]
    points = tiles.tile_points(tables(spark, d)("customer_geo"), g, range(0, 2), "lon", "lat").withColumn("geometry", G.point_wkt(F.col("lon"), F.col("lat")))
    return tiles.combine_layers(tiles.encode_tiles(points, g, "customers", fid="c_custkey", properties=("c_mktsegment", "c_acctbal")))


def _tile_box(spark, d):
    g = tiles.GRIDS["WorldCRS84Quad"]
    b = tables(spark, d)("customer_geo").select("c_custkey", "lon", "lat", F.least(F.col("lon") + 10, F.lit(180.0)).alias("x1"), F.least(F.col("lat") + 10, F.lit(90.0)).alias("y1"))
    return tiles.tile_boxes(b, g, 3, "lon", "lat", "x1", "y1").groupBy("row", "col").agg(F.count("*").alias("n"))


def _with_children(f) -> Query:
    """Lines of each order after a mutation of the orders of one status, with their lines."""

    def run(spark, d):
        read = tables(spark, d)
        features = provider(spark, d).query(FeatureQuery("orders", ("status = 'P'",), fields=("key", "status", "items")))
        out = f({"orders": read("orders"), "lineitem": read("lineitem")}, features)
        lines = out["lineitem"].groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
        return out["orders"].select(F.col("o_orderkey").alias("key")).join(lines, "key", "full")

    return run


def _join_types(spark, d):
    """Brands of an order's parts over a given size; the other lines count where the join keeps them."""
    path = "[o_orderkey=l_orderkey]lineitem/[l_partkey=p_partkey]part{{joinType={how}}}{{filter=p_size > 25}}/[EXPRESSION]{{sql=coalesce(p_brand, 'none')}}"
    own = [{"name": how.lower(), "type": "VALUE_ARRAY", "value_type": "STRING", "source_path": path.format(how=how)} for how in ("INNER", "LEFT", "RIGHT", "FULL")]
    df = _transformed(spark, d, [_KEY, *own], "*")
    return df.select("key", *(F.size(c).cast("long").alias(c) for c in ("inner", "left", "right", "full")))


def _refined(spark, d):
    """Tiles that a diagonal line at each customer's place meets."""
    g = tiles.GRIDS["WorldCRS84Quad"]
    c = tables(spark, d)("customer_shape").select("c_custkey", "lon", "y")
    c = c.repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")  # a small file is read by one task, and its few bytes would stay in one
    c = c.withColumn("x1", F.col("lon") + 10).withColumn("y1", F.round(F.col("y") + 10, 1))
    c = c.withColumn("diagonal", F.concat(F.lit("LINESTRING("), F.concat_ws(",", F.concat_ws(" ", "lon", "y"), F.concat_ws(" ", "x1", "y1")), F.lit(")")))
    return tiles.refine(tiles.tile_boxes(c.filter("x1 <= 180"), g, 5, "lon", "y", "x1", "y1"), g, "diagonal").select("c_custkey", "row", "col")


def _validated(spark, d):
    """What is wrong with a type whose sources are not there."""
    t = FeatureType.of("t", "/orders{sortKey=o_key}", {"name": "a", "source_path": "o_status"}, {"name": "b", "source_path": "[o_custkey=c_key]customer/c_name"},
        {"name": "c", "source_path": "[o_orderkey=x]nothing/y"}, {"name": "d", "type": "DATETIME", "source_path": "o_totalprice"})
    return spark.createDataFrame([(e,) for e in validate(t, tables(spark, d))], "error string")


def _sql_predicate(spark, d):
    G.register(spark)
    tables(spark, d)("customer_shape").createOrReplaceTempView("shapes_of_customers")
    return spark.sql("SELECT c_custkey AS key FROM shapes_of_customers WHERE s_intersects(line, 'POLYGON((-10 -20,60 -20,60 45,-10 45,-10 -20))')")


def _tile_set(spark, d):
    """Squares on two levels of a tile set: the coarser one shows rich customers only."""
    s = tilesets.TileSet("shape", "shape", tiles.GRIDS["WorldCRS84Quad"], range(0, 5), rules=(tilesets.LevelRule(0, 2, filter="balance > 5000"),))
    rows = tilesets.features(provider(spark, d), s, 2).unionByName(tilesets.features(provider(spark, d), s, 4))
    return rows.groupBy("level", "row", "col").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {k: _flat("orders", "key price", text) for k, (text, _) in FILTERS.items()}
    out |= {k: _flat("customer", "key", text) for k, (text, _) in SPATIAL.items()}
    out |= {k: _flat("shape", "key", text) for k, (text, _) in SHAPES.items()}
    for op in INTERVALS:
        name = op.replace("ti_", "t_").upper()
        lines = _flat("lines", "key line", f"{name}(INTERVAL(start,end), INTERVAL('1996-05-02T00:00:00Z','1996-05-06T00:00:00Z'))")
        out[op.lower()] = lambda s, d, f=lines: f(s, d).groupBy("key", "line").agg(F.count("*").alias("n"))
    out |= {
        "p_fields": lambda s, d: _flat("orders", "key status customer.name")(s, d).select("key", "status", F.col("customer.name").alias("name")),
        "p_scope": lambda s, d: provider(s, d).query(FeatureQuery("shape")).select(F.concat_ws(",", *[F.lit(c) for c in provider(s, d).query(FeatureQuery("shape")).columns]).alias("columns"), "key"),
        "p_function": _x([{"name": "v", "source_path": "lower(o_orderpriority)"}]),
        "p_date_format": _x([{"name": "v", "type": "DATE", "source_path": "date_format(o_orderdate, 'dd.MM.yyyy'){format=dd.MM.yyyy}"}]),
        "p_ccw": lambda s, d: _flat("shape", "key square")(s, d).select("key", F.size(F.split("square", ",")).cast("long").alias("corners")),
        "g_filter_crs": _flat("customer", "key", "S_INTERSECTS(location, BBOX(-1113190,-2273030,6679160,5621520))", filter_crs=C.WEB_MERCATOR),
        "x_remove_empty": lambda s, d: _transformed(s, d, [_KEY, {"name": "o", "type": "OBJECT", "properties": [{"name": "a", "source_path": "o_orderstatus",
            "transformations": [{"nullify": "O"}]}]}, {"name": "returned", "type": "VALUE_ARRAY", "value_type": "INTEGER", "source_path": "[o_orderkey=l_orderkey]lineitem{sortKey=l_linenumber}{filter=l_returnflag = 'R'}/l_linenumber"}],
            "*", remove_empty=True).select("key", F.col("o.a").alias("a"), F.col("o").isNull().alias("no_object"), F.size("returned").cast("long").alias("n"),
            F.col("returned").isNull().alias("no_array")),
        "js_below_array": lambda s, d: _flat("docs", "id values")(s, d).withColumn("values", F.array_join("values", ",")),
        "js_below_array_filter": _flat("docs", "id", "A_CONTAINS(values, (4,2))"),
        "js_json_array": lambda s, d: _flat("docs", "id list")(s, d).withColumn("list", F.array_join("list", ",")),
        "page_sort_hidden": lambda s, d: _ranked(_flat("orders", "key items", sort_keys=("-price",), limit=30, offset=2)(s, d)).select("key", F.size("items").cast("long").alias("n"), "rank"),
        "multi_sorted_limit": _sorted_multi,
        "concat_sorted_limit": lambda s, d: _ranked(provider(s, d).query(FeatureQuery("party", sort_keys=("-balance",), limit=30))).select("name", "balance", "rank"),
        "page_synthetic_key": lambda s, d: _ranked(_flat("lines", "key line n", limit=50, offset=7)(s, d)),
        "result_metadata": lambda s, d: provider(s, d).metadata(FeatureQuery("customer", ("balance > 0",), limit=100, offset=5)),
        "number_skipped": lambda s, d: provider(s, d).metadata(FeatureQuery("orders", ("status = 'O'",), limit=10, offset=1_000_000_000)).select("number_returned", "number_skipped"),
        "stat_temporal_two_tables": lambda s, d: _two_tables(s, d),
        "stat_spatial_extent_3d": lambda s, d: _extent_3d(s, d),
        "mut_stats": lambda s, d: mutations.stats(ORDERS, provider(s, d).query(FeatureQuery("orders", ("status = 'O'",), fields=("key", "date")))),
        "p_skip_geometry": lambda s, d: _flat("customer", "key name location", skip_geometry=True)(s, d),
        "p_constant": lambda s, d: _party(s, d).filter("kind = 'customer'"),
        "j_self_join": lambda s, d: _transformed(s, d, [_KEY, {"name": "siblings", "type": "VALUE_ARRAY", "value_type": "INTEGER",
            "source_path": "[o_custkey=o_custkey]orders{sortKey=o_orderkey}/o_orderkey"}], "*").select("key", F.size("siblings").cast("long").alias("n")),
        "j_left_filter": lambda s, d: _transformed(s, d, [_KEY, {"name": "returned", "type": "VALUE_ARRAY", "value_type": "INTEGER",
            "source_path": "[o_orderkey=l_orderkey]lineitem{sortKey=l_linenumber}{filter=l_returnflag = 'R'}/l_linenumber"}], "*").select("key",
            F.size("returned").cast("long").alias("n")),
        "asm_object_array": _sum_items,
        "asm_value_array": lambda s, d: _flat("orders", "key flags")(s, d).withColumn("flags", F.array_join("flags", "")),
        "asm_m_to_n": lambda s, d: _flat("orders", "key parts")(s, d).select("key", F.size("parts").cast("long").alias("n"), F.aggregate("parts",
            F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("sizes")),
        "asm_feature_ref": lambda s, d: _flat("customer", "key nation")(s, d).select("key", F.col("nation.title").alias("title")),
        "concat_root": lambda s, d: _party(s, d),
        "multi_query": _multi,
        "coalesce_values": lambda s, d: _transformed(s, d, [_KEY, {"name": "v", "coalesce": [{"source_path": "o_orderstatus", "transformations": [{"nullify": "O"}]},
            {"source_path": "o_orderpriority"}]}], "*"),
        "concat_values": lambda s, d: _transformed(s, d, [_KEY, {"name": "v", "type": "VALUE_ARRAY", "concat": [{"source_path": "o_orderstatus"},
            {"source_path": "o_orderpriority"}]}], "*").withColumn("v", F.array_join("v", ";")),
        "page_limit_offset": _flat("orders", "key", limit=50, offset=25),
        "page_sort_desc": _flat("orders", "key price", sort_keys=("-price",), limit=40),
        "page_sort_two": _flat("orders", "key status price", sort_keys=("status", "-price"), limit=40, offset=5),
        "page_children": lambda s, d: _flat("orders", "key items", sort_keys=("-price",), limit=30)(s, d).select("key", F.size("items").cast("long").alias("n")),
        "page_limit_zero": _flat("orders", "key", limit=0),
        "page_min_max_key": lambda s, d: provider(s, d).page_keys(FeatureQuery("orders", limit=100, offset=10)),
        "page_min_key_desc": lambda s, d: provider(s, d).page_keys(FeatureQuery("orders", sort_keys=("-price",), limit=100)),
        "hits_only": _flat("orders", "key", "status = 'O'", hits_only=True),
        "number_matched": lambda s, d: provider(s, d).count("orders", ("items.quantity > 49",)),
        "stat_count": lambda s, d: provider(s, d).count("party"),
        "stat_spatial_extent": lambda s, d: provider(s, d).spatial_extent("customer", ("balance > 0",)),
        "stat_temporal_instant": lambda s, d: provider(s, d).temporal_extent("orders"),
        "stat_temporal_interval": lambda s, d: _interval(s, d),
        "etag_weak": lambda s, d: provider(s, d).etag(FeatureQuery("orders", fields=("key", "price"))),
        "a_json_contains": _flat("events", "id", "A_CONTAINS(tags, (3))"),
        "a_json_equals": _flat("events", "id", "A_EQUALS(tags, (5,3))"),
        "a_json_overlaps": _flat("events", "id", "A_OVERLAPS(tags, (3,50))"),
        "a_json_containedby": _flat("events", "id", "A_CONTAINEDBY(tags, (1,2,3,4,5,6))"),
        "js_path_cast": _flat("events", "id k", "k > 90"),
        "js_sort_key": _flat("events", "id k", sort_keys=("-k",), limit=50),
        "js_array": lambda s, d: _flat("events", "id tags")(s, d).withColumn("tags", F.array_join("tags", ",")),
        "w_synthetic_key": lambda s, d: _flat("lines", "key line n")(s, d).select(F.col("key").alias("l_orderkey"), F.col("line").alias("l_linenumber"), "n"),
        "x_rename": _x([_value("o_orderstatus", rename="status")]),
        "x_remove": _x([_value("o_orderstatus", remove="ALWAYS"), {"name": "p", "source_path": "o_orderpriority"}]),
        "x_remove_in_collection": _x([_value("o_orderstatus", remove="IN_COLLECTION")]),
        "x_nullify": _x([_value("o_orderstatus", nullify=["O", "P"])]),
        "x_map": _x([_value("o_orderstatus", map={"O": "open", "*": "closed"})]),
        "x_codelist": _x([_value("o_orderstatus", codelist="status")]),
        "x_date_format": _x([_value("o_orderdate", "DATETIME", dateFormat="dd.MM.yyyy")]),
        "x_string_format": _x([_value("o_orderpriority", stringFormat="[{{value | toLower | replace:'-':' '}}]")]),
        "x_template_filters": _x([_value("o_orderstatus", stringFormat="{{value | prepend:'<b>' | append:'</b>' | unHtml}}/{{missing | orElse:'none'}}/{{value | urlEncode}}")]),
        "x_markdown": _x([_value("o_orderstatus", stringFormat="{{value | prepend:'**' | append:'**' | markdown}}")]),
        "x_object_reduce": _x([{**_CUSTOMER, "transformations": [{"objectReduceFormat": "{{name}} ({{segment}})"}]}]),
        "x_object_select": _x([{**_CUSTOMER, "transformations": [{"objectReduceSelect": "segment"}]}]),
        "x_object_map": lambda s, d: flatten(_x([{**_CUSTOMER, "transformations": [{"objectMapFormat": {"label": "{{name}}!", "group": "{{segment | toLower}}"}}]}])(s, d), "_"),
        "x_object_add": lambda s, d: flatten(_x([{**_CUSTOMER, "transformations": [{"objectMapDuplicate": {"title": "name"}}, {"objectAddConstants": {"kind": "c"}}]}])(s, d), "_"),
        "x_array_reduce": _x([{"name": "v", "type": "VALUE_ARRAY", "source_path": "[o_orderkey=l_orderkey]lineitem{sortKey=l_linenumber}/l_returnflag",
            "transformations": [{"arrayReduceFormat": "{{0}}-{{1 | orElse:'x'}}"}]}]),
        "x_wrap": lambda s, d: _x([_value("o_orderstatus", wrap="VALUE_ARRAY")])(s, d).withColumn("v", F.to_json("v")),
        "x_flatten": _x([{**_CUSTOMER, "transformations": [{"flatten": "_"}]}]),
        "g_reproject_3857": lambda s, d: _reproject(s, d),
        "g_reproject_wkt": lambda s, d: _flat("customer", "key location", crs=C.WEB_MERCATOR, geometry_precision=(1,))(s, d),
        "g_simplify": lambda s, d: _simplified(s, d),
        "tile_rowcol": lambda s, d: tiles.tile_points(tables(s, d)("customer_geo").select("c_custkey", "lon", "lat"), tiles.GRIDS["WorldCRS84Quad"],
            range(5, 6), "lon", "lat").select("c_custkey", "row", "col"),
        "tile_counts": _tile_counts,
        "tile_boxes": _tile_box,
        "tile_features": _tile_set,
        "tile_refined": _refined,
        "j_join_types": _join_types,
        "source_validation": _validated,
        "ud_sql_predicate": _sql_predicate,
        "geojson_out": lambda s, d: tables(s, d)("customer_geo").select(F.col("c_custkey").alias("key"), G.geojson(G.point_wkt(F.col("lon"), F.col("lat"))).alias("geojson")),
        "x_object_remove": lambda s, d: flatten(_x([{**_CUSTOMER, "properties": [*_CUSTOMER["properties"], {"name": "rich", "source_path": "[EXPRESSION]{sql=nullif(c_acctbal > 0, false)}",
            "type": "BOOLEAN"}], "transformations": [{"objectRemoveSelect": "rich"}]}])(s, d), "_").select("key", "customer_name"),
        "x_wrap_object": lambda s, d: _x([_value("o_orderstatus", wrap="OBJECT")])(s, d).select("key", F.col("v.value").alias("v")),
        "x_assign_to": _x([_value("o_orderstatus", stringFormat="{{value | toLower | assignTo:'low'}}{{value}}-{{low}}{{none | orElse:'/{{low}}'}}")]),
        "tile_coverage": lambda s, d: tiles.coverage(tiles.GRIDS["WorldCRS84Quad"], range(0, 5), (-10, -20, 60, 45), s).groupBy("level").agg(F.count("*").alias("n")),
        "mvt_bytes": _mvt,
        "route_distances": lambda s, d: routing.distances(_edges(s, d), 1).select("node", "cost"),
        "route_shortest": lambda s, d: routing.route(_edges(s, d), [1, 9, 75]),
        "route_nearest": lambda s, d: routing.nearest_node(tables(s, d)("customer_geo").select(F.col("c_custkey").alias("node"), F.col("lon").alias("x"),
            F.col("lat").alias("y")), 12.3, 45.6).select("node", F.round("distance", 6).alias("distance")),
        "cdc_apply": _cdc,
        "mut_insert": _mutated(lambda t, n: mutations.insert(t, _MUTABLE, _new_nations(n))),
        "mut_replace": _mutated(lambda t, n: mutations.replace(t, _MUTABLE, _changed_nations(n))),
        "mut_patch": _mutated(lambda t, n: mutations.patch(t, _MUTABLE, _changed_nations(n))),
        "mut_delete": _mutated(lambda t, n: mutations.delete(t, _MUTABLE, n.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id")))),
        "mut_insert_children": _with_children(lambda t, f: mutations.insert(t, ORDERS, f.withColumn("key", F.col("key") + 100_000_000))),
        "mut_delete_children": _with_children(lambda t, f: mutations.delete(t, ORDERS, f.select(F.col("key").alias("id")))),
        "mut_replace_children": _with_children(lambda t, f: mutations.replace(t, ORDERS, f.withColumn("items", F.slice("items", 1, 1)))),
        "schema_crawl": lambda s, d: s.createDataFrame([(t.name, x.name, x.property.type) for t in crawl(tables(s, d), TABLES).values() for x in t.leaves()],
            "type_name string, property string, kind string"),
    }
    return out


def _party(spark, d):
    p = provider(spark, d)
    return p.query(FeatureQuery("party")).select("name", "balance", "kind")


def _interval(spark, d):
    t = FeatureType.of("t", "/lineitem{sortKey=l_orderkey}", {"name": "a", "type": "DATETIME", "source_path": "l_shipdate", "role": "PRIMARY_INTERVAL_START"},
        {"name": "b", "type": "DATETIME", "source_path": "[EXPRESSION]{sql=l_shipdate + make_dt_interval(l_linenumber)}", "role": "PRIMARY_INTERVAL_END"})
    return Provider(spark, tables(spark, d), {"t": t}).temporal_extent("t")


def _two_tables(spark, d):
    """The extent from the first order to the last shipping: start and end in tables of their own."""
    t = FeatureType.of("t", "/orders{sortKey=o_orderkey}", {"name": "a", "type": "DATETIME", "source_path": "o_orderdate", "role": "PRIMARY_INTERVAL_START"},
        {"name": "b", "type": "DATETIME", "source_path": "[o_orderkey=l_orderkey]lineitem/l_shipdate", "role": "PRIMARY_INTERVAL_END"})
    return Provider(spark, tables(spark, d), {"t": t}).temporal_extent("t")


def _extent_3d(spark, d):
    t = FeatureType.of("t", "/customer_geo{sortKey=c_custkey}", {"name": "g", "type": "GEOMETRY", "role": "PRIMARY_GEOMETRY", "source_path": "[EXPRESSION]{sql=concat('POINT Z(', lon, ' ', lat, ' ', c_acctbal, ')')}"})
    return Provider(spark, tables(spark, d), {"t": t}).spatial_extent("t", height=True)


def _reproject(spark, d):
    x, y = C.web_mercator(F.col("lon"), F.col("lat"))
    return tables(spark, d)("customer_geo").filter("abs(lat) < 85").select("c_custkey", F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))


def _simplified(spark, d):
    """A line through each customer's orders, simplified."""
    o = tables(spark, d)("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.round(F.col("o_totalprice") / 10000).alias("p")))).alias("l")).filter("size(l) > 2")
    text = F.concat(F.lit("LINESTRING("), F.array_join(F.transform("l", lambda x, i: F.concat(i.cast("string"), F.lit(" "), x["p"].cast("string"))), ","), F.lit(")"))
    return o.select("o_custkey", G.processed(text, C.CRS84, C.CRS84, 1.0).alias("line"))


def oracle_sql() -> dict[str, str]:
    out = {k: _orders(where) for k, (_, where) in FILTERS.items()}
    out |= {k: _customers(where) for k, (_, where) in SPATIAL.items()}
    cust = "(SELECT *, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 17 % 180 - 90 AS DOUBLE) AS lat FROM customer)"
    x = lambda v, name="v": f"SELECT o_orderkey AS key, {v} AS {name} FROM orders"
    withc = "FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
    party = "SELECT c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier"
    nation = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
    ways = "WITH RECURSIVE d AS (SELECT 1::BIGINT AS node, 0.0::DOUBLE AS cost UNION ALL SELECT c_custkey, d.cost + 1 + c_custkey % 3 FROM d JOIN customer ON c_custkey // 2 = d.node AND c_custkey > 1)"
    mx, my = "lon * pi() / 180 * 6378137", "ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137"
    tile = lambda z: f"CAST(least(greatest(floor((90 - lat) * {1 << z} / 180.0), 0), {(1 << z) - 1}) AS INTEGER) AS row, CAST(least(greatest(floor((lon + 180) * {2 << z} / 360.0), 0), {(2 << z) - 1}) AS INTEGER) AS col"
    text = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    shape = f"(SELECT *, round(lat * 0.8, 1) AS y FROM {cust})"
    # Earth-centred coordinates of a square's corners, for the length of its diagonal in space.
    geo = lambda lon, lat: (f"(r / sqrt(1 - e2 * sin(radians({lat})) ** 2)) * cos(radians({lat})) * cos(radians({lon}))", f"(r / sqrt(1 - e2 * sin(radians({lat})) ** 2)) * cos(radians({lat})) * sin(radians({lon}))",
        f"(r / sqrt(1 - e2 * sin(radians({lat})) ** 2)) * (1 - e2) * sin(radians({lat}))")
    apart = " + ".join(f"({b} - {a}) ** 2" for a, b in zip(geo("lon", "y"), geo("lon + 10", "y + 10"), strict=True))
    shape_3d = f"(SELECT *, sqrt({apart}) AS diameter FROM (SELECT *, 6378137.0::DOUBLE AS r, {C.E2!r}::DOUBLE AS e2 FROM {shape}))"
    out |= {k: f"SELECT c_custkey AS key FROM {shape_3d if 'diameter >' in where else shape} WHERE {where}" for k, (_, where) in SHAPES.items()}
    out |= {k.lower(): _interval_sql(where) for k, where in INTERVALS.items()}
    columns = ", ".join(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    numbered = f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY {columns}) AS n FROM lineitem"
    names = ", ".join(f"'{t}'" for t in TABLES)
    by_order = "SELECT o_orderkey AS key, n, quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
    return out | {
        "p_fields": "SELECT o_orderkey AS key, o_orderstatus AS status, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
        "p_scope": "SELECT 'key,line,square' AS columns, c_custkey AS key FROM customer",
        "p_function": x("lower(o_orderpriority)"),
        "p_date_format": x("CAST(o_orderdate AS DATE)"),
        "p_ccw": "SELECT c_custkey AS key, 5 AS corners FROM customer",
        "g_filter_crs": f"SELECT c_custkey AS key FROM {cust} WHERE abs(lat) < 90 AND {mx} BETWEEN -1113190 AND 6679160 AND {my} BETWEEN -2273030 AND 5621520",
        "x_remove_empty": (
            "SELECT o_orderkey AS key, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS a, o_orderstatus = 'O' AS no_object, CASE WHEN "
            "n > 0 THEN n ELSE NULL END AS n, n IS NULL AS no_array FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE "
            "l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey"
        ),
        "js_below_array": "SELECT event_id AS id, (event_id % 5) || ',' || (event_id % 3) AS values FROM events",
        "js_below_array_filter": "SELECT event_id AS id FROM events WHERE event_id % 5 = 4 AND event_id % 3 = 2",
        "js_json_array": "SELECT event_id AS id, (event_id % 4) || ',7' AS list FROM events",
        "page_sort_hidden": (
            "SELECT key, (SELECT count(*) FROM lineitem WHERE l_orderkey = key) AS n, rank FROM (SELECT o_orderkey AS key, row_number() OVER (ORDER "
            "BY o_totalprice DESC, o_orderkey) - 2 AS rank FROM orders) WHERE rank BETWEEN 1 AND 30"
        ),
        "multi_sorted_limit": (
            "SELECT title, key, rank - 3 AS rank FROM (SELECT *, row_number() OVER (ORDER BY ordinal, title DESC, price DESC, key) AS rank FROM "
            "(SELECT n_name AS title, NULL::BIGINT AS key, NULL::DOUBLE AS price, 0 AS ordinal FROM nation UNION ALL SELECT NULL, o_orderkey, o_totalprice, "
            "1 FROM orders)) WHERE rank BETWEEN 4 AND 43"
        ),
        "concat_sorted_limit": (
            "SELECT c_name AS name, c_acctbal AS balance, rank FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM "
            "customer) WHERE rank <= 30"
        ),
        "page_synthetic_key": (
            "SELECT l_orderkey AS key, l_linenumber AS line, n, rank - 7 AS rank FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, n) AS "
            f"rank FROM ({numbered})) WHERE rank BETWEEN 8 AND 57"
        ),
        "result_metadata": (
            "SELECT count(*) AS number_returned, NULL::BIGINT AS number_skipped, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) "
            f"AS ymax FROM (SELECT * FROM {cust} WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 100 OFFSET 5)"
        ),
        "number_skipped": "SELECT 0::BIGINT AS number_returned, count(*) AS number_skipped FROM orders WHERE o_orderstatus = 'O'",
        "stat_temporal_two_tables": 'SELECT min(o_orderdate) AS "start", (SELECT max(l_shipdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS "end" FROM orders',
        "stat_spatial_extent_3d": f"SELECT min(lon) AS xmin, min(lat) AS ymin, min(c_acctbal) AS zmin, max(lon) AS xmax, max(lat) AS ymax, max(c_acctbal) AS zmax FROM {cust}",
        "mut_insert_children": f"{by_order} UNION ALL SELECT key + 100000000, n, quantity FROM ({by_order}) JOIN orders ON o_orderkey = key WHERE o_orderstatus = 'P'",
        "mut_delete_children": f"SELECT b.* FROM ({by_order}) b JOIN orders ON o_orderkey = key WHERE o_orderstatus <> 'P'",
        "mut_replace_children": (
            f"SELECT b.* FROM ({by_order}) b JOIN orders ON o_orderkey = key WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, CASE WHEN n > 0 THEN 1 END, first FROM orders LEFT JOIN "
            "(SELECT l_orderkey, count(*) AS n, arg_min(l_quantity, (l_linenumber, l_quantity)) AS first FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'"
        ),
        "mut_stats": 'SELECT count(*) AS n_features, min(o_orderdate) AS "first", max(o_orderdate) AS "last" FROM orders WHERE o_orderstatus = \'O\'',
        "schema_crawl": f"""SELECT table_name AS type_name, column_name AS property, CASE WHEN data_type LIKE '%[]' THEN 'VALUE_ARRAY' WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'INTEGER'
            WHEN data_type IN ('FLOAT', 'DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'FLOAT' WHEN data_type = 'VARCHAR' THEN 'STRING' WHEN data_type = 'BOOLEAN' THEN 'BOOLEAN' WHEN data_type = 'DATE' THEN 'DATE' ELSE 'DATETIME' END AS kind
            FROM information_schema.columns WHERE table_name IN ({names})""",
        "tile_boxes": f"""SELECT row, col, count(*) AS n FROM (SELECT unnest(range(r0, r1 + 1)) AS row, c0, c1 FROM (SELECT CAST(least(greatest(floor((90 - least(lat + 10, 90)) * 8 / 180.0), 0), 7) AS INTEGER) AS r0, CAST(least(greatest(floor((90 - lat) * 8 / 180.0), 0), 7) AS INTEGER) AS r1,
            CAST(least(greatest(floor((lon + 180) * 16 / 360.0), 0), 15) AS INTEGER) AS c0, CAST(least(greatest(floor((least(lon + 10, 180) + 180) * 16 / 360.0), 0), 15) AS INTEGER) AS c1 FROM {cust})), unnest(range(c0, c1 + 1)) AS u(col) GROUP BY 1, 2""",
        "tile_features": " UNION ALL ".join(
            f"""SELECT {z} AS level, row, col, count(*) AS n FROM (SELECT unnest(range(r0, r1 + 1)) AS row, c0, c1 FROM (SELECT CAST(least(greatest(floor(round(90 - (y + 10), 1) * {1 << z} / 180.0), 0), {(1 << z) - 1}) AS INTEGER) AS r0, CAST(least(greatest(floor((90 - y) * {1 << z} / 180.0), 0), {(1 << z) - 1}) AS INTEGER) AS r1,
            CAST(least(greatest(floor((lon + 180) * {2 << z} / 360.0), 0), {(2 << z) - 1}) AS INTEGER) AS c0, CAST(least(greatest(floor((lon + 190) * {2 << z} / 360.0), 0), {(2 << z) - 1}) AS INTEGER) AS c1 FROM {shape} WHERE {where})), unnest(range(c0, c1 + 1)) AS u(col) GROUP BY row, col"""
            for z, where in ((2, "c_acctbal > 5000"), (4, "true"))
        ),
        "tile_refined": f"""SELECT c_custkey, row, col FROM (SELECT c_custkey, lon, y, unnest(range(r0, r1 + 1)) AS row, c0, c1 FROM (SELECT *, CAST(floor(round(90 - (y + 10), 1) * 32 / 180.0) AS INTEGER) AS r0, CAST(floor((90 - y) * 32 / 180.0) AS INTEGER) AS r1,
            CAST(floor((lon + 180) * 64 / 360.0) AS INTEGER) AS c0, CAST(least(floor((lon + 190) * 64 / 360.0), 63) AS INTEGER) AS c1 FROM {shape} WHERE lon + 10 <= 180)), unnest(range(c0, c1 + 1)) AS u(col)
            WHERE greatest(col * 5.625 - 180 - lon, 90 - (row + 1) * 5.625 - y, 0) <= least((col + 1) * 5.625 - 180 - lon, 90 - row * 5.625 - y, 10) + 1e-9""",
        "source_validation": (
            "SELECT unnest(['t: sort key o_key does not exist in orders', 't.a: column o_status does not exist in orders', 't.b: column c_key does "
            "not exist in customer', 't: table nothing does not exist', 't.d: column o_totalprice is not temporal']) AS error"
        ),
        "ud_sql_predicate": f"SELECT c_custkey AS key FROM {shape} WHERE lon <= 60 AND lon + 10 >= -10 AND y BETWEEN -20 AND 45",
        "geojson_out": f"""SELECT c_custkey AS key, '{{"type": "Point", "coordinates": [' || lon || ', ' || lat || ']}}' AS geojson FROM {cust}""",
        "x_object_remove": f"SELECT o_orderkey AS key, CASE WHEN c_acctbal > 0 THEN c_name END AS customer_name {withc}",
        "j_join_types": (
            'SELECT o_orderkey AS key, count(p_partkey) AS "inner", count(l_orderkey) AS "left", count(p_partkey) AS "right", count(l_orderkey) AS "full" '
            "FROM orders LEFT JOIN (lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25) ON l_orderkey = o_orderkey GROUP BY 1"
        ),
        "x_wrap_object": x("o_orderstatus"),
        "x_assign_to": x("o_orderstatus || '-' || lower(o_orderstatus) || '/' || lower(o_orderstatus)"),
        "tile_coverage": (
            "SELECT CAST(z AS INTEGER) AS level, CAST((floor(110 * 2 ** z / 180) - floor(45 * 2 ** z / 180) + 1) * (floor(240 * 2 ** (z + 1) / "
            "360) - floor(170 * 2 ** (z + 1) / 360) + 1) AS BIGINT) AS n FROM range(0, 5) t(z)"
        ),
        "p_skip_geometry": "SELECT c_custkey AS key, c_name AS name FROM customer",
        "p_constant": "SELECT c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer",
        "j_self_join": "SELECT o_orderkey AS key, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
        "j_left_filter": "SELECT o_orderkey AS key, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders",
        "asm_object_array": (
            "SELECT o_orderkey AS key, count(l_linenumber) AS n, coalesce(sum(l_quantity), 0) AS quantity, coalesce(string_agg(CAST(l_linenumber "
            "AS VARCHAR), ',' ORDER BY l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
        ),
        "asm_value_array": (
            "SELECT o_orderkey AS key, coalesce(string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag), '') AS flags FROM orders LEFT "
            "JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
        ),
        "asm_m_to_n": (
            "SELECT o_orderkey AS key, count(p_partkey) AS n, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS sizes FROM orders LEFT JOIN (lineitem "
            "JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey GROUP BY 1"
        ),
        "asm_feature_ref": "SELECT c_custkey AS key, n_name AS title FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
        "concat_root": party,
        "multi_query": "SELECT n_name AS title, NULL::VARCHAR AS name, 0 AS ordinal FROM nation UNION ALL SELECT NULL, c_name, 1 FROM customer WHERE c_acctbal > 9000",
        "coalesce_values": x("CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE o_orderstatus END"),
        "concat_values": x("o_orderstatus || ';' || o_orderpriority"),
        "page_limit_offset": "SELECT o_orderkey AS key FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 25",
        "page_sort_desc": "SELECT o_orderkey AS key, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40",
        "page_sort_two": (
            "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey "
            "LIMIT 40 OFFSET 5"
        ),
        "page_children": (
            "SELECT o_orderkey AS key, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice "
            "DESC, o_orderkey LIMIT 30)"
        ),
        "page_limit_zero": "SELECT o_orderkey AS key FROM orders LIMIT 0",
        "page_min_max_key": "SELECT count(*) AS number_returned, min(k) AS min_key, max(k) AS max_key FROM (SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 100 OFFSET 10)",
        "page_min_key_desc": (
            "SELECT count(*) AS number_returned, min(k) AS min_key, max(k) AS max_key FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice "
            "DESC, o_orderkey LIMIT 100)"
        ),
        "hits_only": "SELECT count(*) AS number_matched FROM orders WHERE o_orderstatus = 'O'",
        "number_matched": "SELECT count(*) AS number_matched FROM orders WHERE EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
        "stat_count": f"SELECT count(*) AS number_matched FROM ({party})",
        "stat_spatial_extent": f"SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM {cust} WHERE c_acctbal > 0",
        "stat_temporal_instant": 'SELECT min(o_orderdate) AS "start", max(o_orderdate) AS "end" FROM orders',
        "stat_temporal_interval": 'SELECT min(l_shipdate) AS "start", max(l_shipdate + to_days(l_linenumber)) AS "end" FROM lineitem',
        "a_json_contains": "SELECT event_id AS id FROM events WHERE CAST(props->>'k' AS INT) = 3 OR event_id % 7 = 3",
        "a_json_equals": "SELECT event_id AS id FROM events WHERE CAST(props->>'k' AS INT) = 5 AND event_id % 7 = 3",
        "a_json_overlaps": "SELECT event_id AS id FROM events WHERE CAST(props->>'k' AS INT) IN (3, 50) OR event_id % 7 IN (3, 50)",
        "a_json_containedby": "SELECT event_id AS id FROM events WHERE CAST(props->>'k' AS INT) BETWEEN 1 AND 6 AND event_id % 7 BETWEEN 1 AND 6",
        "js_path_cast": "SELECT event_id AS id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE CAST(props->>'k' AS BIGINT) > 90",
        "js_sort_key": "SELECT event_id AS id, CAST(props->>'k' AS BIGINT) AS k FROM events ORDER BY k DESC NULLS LAST, event_id LIMIT 50",
        "js_array": "SELECT event_id AS id, (props->>'k') || ',' || CAST(event_id % 7 AS VARCHAR) AS tags FROM events",
        "w_synthetic_key": numbered,
        "x_rename": x("o_orderstatus", "status"),
        "x_remove": x("o_orderpriority", "p"),
        "x_remove_in_collection": "SELECT o_orderkey AS key FROM orders",
        "x_nullify": x("CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN o_orderstatus END"),
        "x_map": x("CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END"),
        "x_codelist": x("CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END"),
        "x_date_format": x("strftime(o_orderdate, '%d.%m.%Y')"),
        "x_string_format": x("'[' || replace(lower(o_orderpriority), '-', ' ') || ']'"),
        "x_template_filters": x("o_orderstatus || '/none/' || o_orderstatus"),
        "x_markdown": x("'<strong>' || o_orderstatus || '</strong>'"),
        "x_object_reduce": f"SELECT o_orderkey AS key, c_name || ' (' || c_mktsegment || ')' AS customer {withc}",
        "x_object_select": f"SELECT o_orderkey AS key, c_mktsegment AS customer {withc}",
        "x_object_map": f"SELECT o_orderkey AS key, c_name || '!' AS customer_label, lower(c_mktsegment) AS customer_group {withc}",
        "x_object_add": (
            "SELECT o_orderkey AS key, c_name AS customer_name, c_mktsegment AS customer_segment, c_name AS customer_title, CASE WHEN c_name IS "
            f"NOT NULL THEN 'c' END AS customer_kind {withc}"
        ),
        "x_array_reduce": (
            "SELECT o_orderkey AS key, CASE WHEN count(l_linenumber) > 0 THEN (list(l_returnflag ORDER BY l_linenumber, l_returnflag))[1] || '-' "
            "|| coalesce((list(l_returnflag ORDER BY l_linenumber, l_returnflag))[2], 'x') END AS v FROM orders LEFT JOIN lineitem ON l_orderkey "
            "= o_orderkey GROUP BY 1"
        ),
        "x_wrap": x("'[\"' || o_orderstatus || '\"]'"),
        "x_flatten": f"SELECT o_orderkey AS key, c_name AS customer_name, c_mktsegment AS customer_segment {withc}",
        "g_reproject_3857": f"SELECT c_custkey, round({mx}, 1) AS x, round({my}, 1) AS y FROM {cust} WHERE abs(lat) < 85",
        "g_reproject_wkt": (
            f"SELECT c_custkey AS key, CASE WHEN lat > -90 THEN 'POINT(' || {text('x')} || ' ' || {text('y')} || ')' END AS location FROM (SELECT "
            f"*, round({mx}, 1) AS x, CASE WHEN lat > -90 THEN round({my.replace('lat', 'greatest(lat, -89)')}, 1) END AS y FROM {cust})"
        ),
        "etag_weak": (
            "SELECT sha256(CAST(sum(CAST('0x' || substr(sha256(CAST(to_json({'key': o_orderkey, 'price': o_totalprice}) AS VARCHAR)), 1, 15) AS "
            "BIGINT)) AS VARCHAR)) AS etag FROM orders"
        ),
        "tile_rowcol": f"SELECT c_custkey, {tile(5)} FROM {cust}",
        "tile_counts": " UNION ALL ".join(f"SELECT {z} AS level, row, col, count(*) AS n FROM (SELECT {tile(z)} FROM {cust}) GROUP BY ALL" for z in range(4)),
        "route_distances": f"{ways} SELECT node, cost FROM d",
        "route_shortest": (
            f"{ways}, up AS (SELECT 0 AS leg, 9::BIGINT AS node UNION ALL SELECT 1, 75 UNION ALL SELECT leg, node // 2 FROM up WHERE node > (CASE "
            "leg WHEN 0 THEN 1 ELSE 9 END)) SELECT leg, CAST(row_number() OVER (PARTITION BY leg ORDER BY up.node) - 1 AS INTEGER) AS seq, up.node, "
            "CASE WHEN up.node > (CASE leg WHEN 0 THEN 1 ELSE 9 END) THEN up.node * 2 END AS edge_id, cost - (SELECT cost FROM d AS s WHERE s.node "
            "= (CASE leg WHEN 0 THEN 1 ELSE 9 END)) AS cost FROM up JOIN d ON d.node = up.node"
        ),
        "route_nearest": (
            f"SELECT c_custkey AS node, round(sqrt((lon - 12.3) ** 2 + (lat - 45.6) ** 2), 6) AS distance FROM {cust} ORDER BY sqrt((lon - 12.3) "
            "** 2 + (lat - 45.6) ** 2), c_custkey LIMIT 1"
        ),
        "cdc_apply": (
            "WITH c AS (SELECT user_id % 200 + 1 AS k, arg_max(value, event_id) AS v, max(event_id) AS last FROM events GROUP BY 1) SELECT c_custkey, "
            "c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM c) UNION ALL SELECT k, v FROM c WHERE last % 5 <> 0"
        ),
        "mut_insert": f"{nation} UNION ALL SELECT n_nationkey + 100, 'new ' || n_name, n_regionkey FROM nation WHERE n_nationkey < 5",
        "mut_replace": f"{nation} WHERE n_nationkey >= 5 UNION ALL SELECT n_nationkey, lower(n_name), NULL FROM nation WHERE n_nationkey < 5",
        "mut_patch": (
            "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS n_name, CAST(n_regionkey "
            "AS BIGINT) AS n_regionkey FROM nation"
        ),
        "mut_delete": f"{nation} WHERE n_regionkey <> 1",
    }
