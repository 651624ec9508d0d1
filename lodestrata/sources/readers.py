"""Readers that give plain tables or features with a WKT geometry."""

from __future__ import annotations

import json
import re
import urllib.parse
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import wkt


def parquet_tables(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """Tables by name from ``folder/name.parquet``."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_tables(spark: SparkSession, url: str, schema: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> Callable[[str], DataFrame]:
    """Tables by name through JDBC (PostgreSQL, Oracle, SQLite); ``partition`` is column, lower, upper and number of reads."""

    def read(name: str) -> DataFrame:
        r = spark.read.format("jdbc").option("url", url).option("dbtable", f"{schema}.{name}" if schema else name).options(**options)
        if partition:
            column, lower, upper, n = partition
            r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", n)
        return r.load()

    return read


@F.pandas_udf(T.StringType())
def _geojson_wkt(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if not x or x == "null" else wkt.to_wkt(wkt.from_geojson(json.loads(x))))


def geojson_wkt(c):
    """WKT of GeoJSON geometry text."""
    return _geojson_wkt(c)


def read_geojson(spark: SparkSession, path: str, properties: str | None = None, lines: bool = False) -> DataFrame:
    """id, geometry (WKT) and the properties of a Feature or FeatureCollection, whatever the members' order.

    ``properties`` is a DDL schema; without it the property types are inferred from the values. With
    ``lines`` each line is a feature (a GeoJSON text sequence), and large files are read by many tasks;
    a collection is one value, so each of its files is read by one.
    """
    if lines:
        features = spark.read.text(path).select(F.ltrim("value", F.lit("\x1e")).alias("f")).filter("trim(f) != ''")
    else:
        text = spark.read.text(path, wholetext=True)
        features = text.select(F.explode(F.coalesce(F.from_json(F.get_json_object("value", "$.features"), "array<string>"), F.array("value"))).alias("f"))
    rows = features.select(F.get_json_object("f", "$.id").alias("id"), geojson_wkt(F.get_json_object("f", "$.geometry")).alias("geometry"), F.get_json_object("f", "$.properties").alias("p"))
    if properties is None:
        properties = spark.read.json(_strings(rows, "p")).schema
    return rows.select("id", "geometry", F.from_json("p", properties).alias("p")).select("id", "geometry", "p.*")


def _strings(df: DataFrame, column: str):
    """A column of JSON texts as the reader's input; only used to infer types."""
    return df.filter(F.col(column).isNotNull()).select(column).rdd.map(lambda r: r[0])


_GML = {"Point": "Point", "LineString": "LineString", "Curve": "LineString", "Polygon": "Polygon", "Surface": "Polygon", "MultiPoint": "MultiPoint", "MultiCurve": "MultiLineString", "MultiLineString": "MultiLineString", "MultiSurface": "MultiPolygon", "MultiPolygon": "MultiPolygon"}


def gml_geometry(xml: str) -> wkt.Geometry | None:
    """The first geometry of a GML fragment: posList, pos and coordinates, holes included."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(re.sub(r"(</?)[\w-]+:", r"\1", re.sub(r"\s[\w-]+:[\w-]+=(\"[^\"]*\"|'[^']*')", "", xml)))

    def coordinates(e) -> list:
        size = int(next((x.get("srsDimension") for x in e.iter() if x.get("srsDimension")), "2"))
        out: list = []
        for x in e.iter():
            if x.tag in ("posList", "pos") and x.text:
                v = [float(n) for n in x.text.split()]
                out += [v[i : i + size] for i in range(0, len(v), size)]
            elif x.tag == "coordinates" and x.text:
                out += [[float(n) for n in p.split(",")] for p in x.text.split()]
        return out

    def polygon(e) -> list:
        return [coordinates(r) for r in e.iter() if r.tag in ("exterior", "outerBoundaryIs")][:1] + [coordinates(r) for r in e.iter() if r.tag in ("interior", "innerBoundaryIs")]

    for e in root.iter():
        kind = _GML.get(e.tag)
        if not kind:
            continue
        if kind == "Point":
            return kind, coordinates(e)[0]
        if kind == "LineString":
            return kind, coordinates(e)
        if kind == "Polygon":
            return kind, polygon(e)
        single = {"MultiPoint": ("Point",), "MultiLineString": ("LineString", "Curve"), "MultiPolygon": ("Polygon", "Surface")}[kind]
        members = [x for x in e.iter() if x.tag in single]
        return kind, [coordinates(m)[0] if kind == "MultiPoint" else coordinates(m) if kind == "MultiLineString" else polygon(m) for m in members]
    return None


@F.pandas_udf(T.StringType())
def _gml_wkt(s: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        g = gml_geometry(f"<g>{text}</g>") if text else None
        return wkt.to_wkt(g) if g else None

    return s.map(one)


def read_gml(spark: SparkSession, path: str, feature: str, schema: str, geometry: str | None = None) -> DataFrame:
    """Features of an XML collection: ``feature`` is the element's name, ``schema`` the DDL of its children, read by Spark's XML source.

    Files are read once and split between features. The source gives the geometry element's inner text, which becomes WKT.
    """
    own = T.StructType.fromDDL(schema)
    if geometry and geometry not in own.names:
        own = own.add(geometry, "string")
    rows = spark.read.format("xml").option("rowTag", feature.split(":")[-1]).option("ignoreNamespace", "true").schema(own).load(path)
    return rows.withColumn(geometry, _gml_wkt(geometry)) if geometry else rows


def wfs_query(type_name: str, limit: int | None = None, offset: int = 0, hits: bool = False, filter_xml: str | None = None, version: str = "2.0.0") -> str:
    """The query string of a GetFeature request."""
    q = {"SERVICE": "WFS", "VERSION": version, "REQUEST": "GetFeature", "TYPENAMES": type_name}
    if limit is not None:
        q["COUNT"] = str(limit)
    if offset:
        q["STARTINDEX"] = str(offset)
    if hits:
        q["RESULTTYPE"] = "hits"
    if filter_xml:
        q["FILTER"] = filter_xml
    return urllib.parse.urlencode(q)


def graphql_query(root: str, fields: Iterable[str], arguments: dict[str, str] | None = None) -> str:
    """A GraphQL query with nested selections from dotted field names."""
    tree: dict = {}
    for f in fields:
        at = tree
        for step in f.split("."):
            at = at.setdefault(step, {})

    def selection(t: dict) -> str:
        return "{ " + " ".join(k + (f" {selection(v)}" if v else "") for k, v in t.items()) + " }"

    args = "(" + ", ".join(f"{k}: {v}" for k, v in arguments.items()) + ")" if arguments else ""
    return f"{{ {root}{args} {selection(tree)} }}"


def read_graphql(spark: SparkSession, responses: DataFrame, root: str, schema: str, body: str = "body") -> DataFrame:
    """Rows of GraphQL responses (JSON texts, one for each request): the list or object under ``data.root``."""
    at = F.get_json_object(body, f"$.data.{root}")
    listed = F.when(at.startswith("["), F.from_json(at, f"array<struct<{schema}>>")).otherwise(F.array(F.from_json(at, f"struct<{schema}>")))
    return responses.select(F.explode(listed).alias("r")).select("r.*")


# --- schemas -------------------------------------------------------------------------------


def infer_type(kind: T.DataType) -> str:
    """Schema type of a column type; decimals are FLOAT, what has no type UNKNOWN."""
    match kind:
        case T.LongType() | T.IntegerType() | T.ShortType() | T.ByteType():
            return "INTEGER"
        case T.DoubleType() | T.FloatType() | T.DecimalType():
            return "FLOAT"
        case T.StringType() | T.CharType() | T.VarcharType():
            return "STRING"
        case T.BooleanType():
            return "BOOLEAN"
        case T.TimestampType() | T.TimestampNTZType():
            return "DATETIME"
        case T.DateType():
            return "DATE"
    return "UNKNOWN"


def crawl(tables: Callable[[str], DataFrame], names: Iterable[str], keys: dict[str, str] | None = None) -> dict:
    """A feature type for each table, from its columns; the key is the declared one, or else the first column."""
    from lodestrata.schema.model import FeatureType, Property

    out = {}
    for name in names:
        schema = tables(name).schema
        key = (keys or {}).get(name, schema.names[0])
        props = []
        for f in schema.fields:
            kind = infer_type(f.dataType)
            if kind == "UNKNOWN":
                if isinstance(f.dataType, T.ArrayType) and infer_type(f.dataType.elementType) != "UNKNOWN":
                    props.append(Property(f.name, "VALUE_ARRAY", f.name, value_type=infer_type(f.dataType.elementType)))
                continue
            props.append(Property(f.name, kind, f.name, role="ID" if f.name == key else None))
        out[name] = FeatureType(name, f"/{name}{{sortKey={key}}}", tuple(props))
    return out


def validate(t, tables: Callable[[str], DataFrame], strict: bool = False) -> list[str]:
    """What is wrong with a type's source: missing tables or columns, wrong types, with ``strict`` keys that are not unique."""
    from lodestrata.schema.source_path import parse_path

    errors: list[str] = []

    def columns(name: str):
        try:
            return {f.name: f.dataType for f in tables(name).schema.fields}
        except Exception:
            errors.append(f"{t.name}: table {name} does not exist")
            return None

    main = columns(t.main.table)
    if main is not None and t.key not in main:
        errors.append(f"{t.name}: sort key {t.key} does not exist in {t.main.table}")
    for leaf in t.leaves():
        at, own = t.main.table, main
        for step in leaf.steps:
            if own is not None and step.source not in own:
                errors.append(f"{t.name}.{leaf.name}: column {step.source} does not exist in {at}")
            at, own = step.table, columns(step.table)
            if own is not None and step.target not in own:
                errors.append(f"{t.name}.{leaf.name}: column {step.target} does not exist in {at}")
        path = parse_path(leaf.property.source_path)
        if own is None or path.kind == "expression" or not path.column:
            continue
        if path.column not in own:
            errors.append(f"{t.name}.{leaf.name}: column {path.column} does not exist in {at}")
        elif leaf.property.type in ("DATE", "DATETIME") and infer_type(own[path.column]) not in ("DATE", "DATETIME", "STRING"):
            errors.append(f"{t.name}.{leaf.name}: column {path.column} is not temporal")
        elif leaf.property.type == "GEOMETRY" and infer_type(own[path.column]) != "STRING":
            errors.append(f"{t.name}.{leaf.name}: column {path.column} is not spatial")
    if strict and not errors and not tables(t.main.table).groupBy(t.key).count().filter("count > 1").isEmpty():
        errors.append(f"{t.name}: sort key {t.key} is not unique")
    return list(dict.fromkeys(errors))


def from_json_schema(name: str, source_path: str, schema: dict) -> dict:
    """A type's mapping from a JSON Schema: types, arrays, objects, required, const; ``allOf`` is merged first."""
    kinds = {"integer": "INTEGER", "number": "FLOAT", "boolean": "BOOLEAN", "string": "STRING"}

    def merged(s: dict) -> dict:
        out = {k: v for k, v in s.items() if k != "allOf"}
        for part in s.get("allOf", ()):
            part = merged(part)
            out["properties"] = {**part.get("properties", {}), **out.get("properties", {})}
            out["required"] = [*part.get("required", ()), *out.get("required", ())]
            out.setdefault("type", part.get("type"))
        return out

    def go(n: str, s: dict, required: bool) -> dict:
        s = merged(s)
        kind = s.get("type", "object" if "properties" in s else "string")
        p: dict = {"name": n, "required": required}
        if "const" in s:
            return {**p, "type": kinds.get(kind, "STRING"), "constant": s["const"]}
        if kind == "array":
            inner = go(n, s.get("items", {}), required)
            return {**inner, "type": "OBJECT_ARRAY"} if inner["type"] == "OBJECT" else {**p, "type": "VALUE_ARRAY", "value_type": inner["type"], "source_path": n}
        if kind == "object":
            needed = s.get("required", ())
            return {**p, "type": "OBJECT", "properties": [go(k, v, k in needed) for k, v in s.get("properties", {}).items()]}
        text = {"date": "DATE", "date-time": "DATETIME"}.get(s.get("format"), kinds.get(kind, "STRING"))
        return {**p, "type": text, "source_path": n}

    return {"name": name, "source_path": source_path, "properties": go(name, schema, False)["properties"]}
