"""Feature services: types from WFS capabilities and XML schemas, and GraphQL as a Spark data source."""

from __future__ import annotations

import json
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestrata.schema.model import FeatureType

XS = "{http://www.w3.org/2001/XMLSchema}"
#: Schema types of the XML schema language's simple types.
XSD_TYPES = {
    "string": "STRING", "token": "STRING", "normalizedString": "STRING", "anyURI": "STRING", "language": "STRING", "ID": "STRING", "NCName": "STRING",
    "boolean": "BOOLEAN", "byte": "INTEGER", "short": "INTEGER", "int": "INTEGER", "integer": "INTEGER", "long": "INTEGER", "nonNegativeInteger": "INTEGER", "positiveInteger": "INTEGER",
    "float": "FLOAT", "double": "FLOAT", "decimal": "FLOAT", "date": "DATE", "dateTime": "DATETIME",
}
#: Beginnings of the geometry property types of GML.
GML_GEOMETRIES = ("Geometry", "Point", "Curve", "Surface", "LineString", "Polygon", "MultiPoint", "MultiCurve", "MultiSurface", "MultiLineString", "MultiPolygon", "MultiGeometry")


def _local(name: str | None) -> str:
    return (name or "").rpartition("}")[2].rpartition(":")[2]


def capabilities(text: str) -> list[dict]:
    """name, title, crs and box (west, south, east, north) of a service's feature types."""
    out = []
    for e in ET.fromstring(text).iter():
        if _local(e.tag) != "FeatureType":
            continue
        found = {_local(c.tag): c for c in e}
        own = {"name": (found["Name"].text or "").strip(), "title": None, "crs": None, "box": None}
        if (t := found.get("Title")) is not None:
            own["title"] = t.text
        for k in ("DefaultCRS", "DefaultSRS", "SRS"):
            if k in found and not own["crs"]:
                own["crs"] = (found[k].text or "").strip()
        if (b := found.get("WGS84BoundingBox")) is not None:
            corner = {_local(c.tag): [float(x) for x in (c.text or "").split()] for c in b}
            own["box"] = (*corner["LowerCorner"], *corner["UpperCorner"])
        out.append(own)
    return out


def xsd_types(text: str) -> dict[str, FeatureType]:
    """A feature type for each global element of an XML schema whose type is complex.

    Elements of GML's geometry types are geometries; the first is the primary one. What may occur
    more than once is an array. A property called ``id`` becomes ``_id_``, as the feature's own id has that name.
    """
    root = ET.fromstring(text)
    complex_ = {e.get("name"): e for e in root.findall(f"{XS}complexType")}
    simple = {e.get("name"): e for e in root.findall(f"{XS}simpleType")}

    def base_of(e: ET.Element | None) -> str:
        """The schema type of a simple type, through its restrictions."""
        r = None if e is None else e.find(f"{XS}restriction")
        name = _local(r.get("base")) if r is not None else "string"
        return XSD_TYPES.get(name) or (base_of(simple[name]) if name in simple else "STRING")

    def members(e: ET.Element, seen: tuple[str, ...]) -> list[dict]:
        out = []
        for x in e.iter(f"{XS}extension"):
            base = _local(x.get("base"))
            if base in complex_ and base not in seen:
                out += members(complex_[base], (*seen, base))
        return out + [prop(x, seen) for x in own_elements(e)]

    def own_elements(e: ET.Element) -> Iterator[ET.Element]:
        """Elements below sequences and choices, but not those of inner types."""
        for c in e:
            if c.tag == f"{XS}element":
                yield c
            elif c.tag in (f"{XS}sequence", f"{XS}choice", f"{XS}all", f"{XS}complexContent", f"{XS}extension", f"{XS}group"):
                yield from own_elements(c)

    def prop(e: ET.Element, seen: tuple[str, ...]) -> dict:
        name = e.get("name") or _local(e.get("ref"))
        kind, many = _local(e.get("type")), e.get("maxOccurs", "1") not in ("0", "1")
        p: dict = {"name": "_id_" if name == "id" else name, "required": e.get("minOccurs", "1") != "0"}
        inner = e.find(f"{XS}complexType")
        if inner is None and kind in complex_ and kind not in seen:
            inner, seen = complex_[kind], (*seen, kind)
        if kind.removesuffix("PropertyType") in GML_GEOMETRIES and kind.endswith("PropertyType"):
            return {**p, "type": "GEOMETRY", "source_path": name}
        if inner is not None and (found := members(inner, seen)):
            return {**p, "type": "OBJECT_ARRAY" if many else "OBJECT", "properties": found}
        value = XSD_TYPES.get(kind) or base_of(e.find(f"{XS}simpleType") if kind not in simple else simple[kind])
        return {**p, "type": "VALUE_ARRAY", "value_type": value, "source_path": name} if many else {**p, "type": value, "source_path": name}

    out = {}
    for e in root.findall(f"{XS}element"):
        kind = _local(e.get("type"))
        body = e.find(f"{XS}complexType") if e.find(f"{XS}complexType") is not None else complex_.get(kind)
        if body is None:
            continue
        props, primary = members(body, (kind,)), False
        for p in props:
            if p["type"] == "GEOMETRY" and not primary:
                p["role"], primary = "PRIMARY_GEOMETRY", True
        key = {"name": "id", "type": "STRING", "source_path": "gml_id", "role": "ID"}
        out[e.get("name")] = FeatureType.of(e.get("name"), f"/{e.get('name')}{{sortKey=gml_id}}", key, *props)
    return out


# --- GraphQL -------------------------------------------------------------------------------


class _Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        super().__init__(None)
        self.offset, self.limit = offset, limit


class _GraphQlReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        total, size = int(self.options.get("total", 0)), int(self.options.get("pagesize", 1000))
        return [_Page(a, min(size, total - a)) for a in range(0, total, size)] or [_Page(0, size)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        query = self.options["query"].replace("{{offset}}", str(partition.offset)).replace("{{limit}}", str(partition.limit))
        request = urllib.request.Request(self.options["url"], json.dumps({"query": query}).encode(), {"Content-Type": "application/json", **json.loads(self.options.get("headers", "{}"))})
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 60))) as r:
            answer = json.loads(r.read())
        if answer.get("errors"):
            raise ValueError(f"the service answered: {answer['errors']}")
        rows = answer["data"]
        for step in self.options["root"].split("."):
            rows = rows[step]
        for row in rows if isinstance(rows, list) else [rows]:
            yield tuple(self._value(f.dataType, row.get(f.name)) for f in self.schema.fields)

    def _value(self, kind, v):
        if v is None or not isinstance(kind, StructType):
            return json.dumps(v) if isinstance(v, dict | list) and kind.typeName() == "string" else v
        return tuple(self._value(f.dataType, v.get(f.name)) for f in kind.fields)


class GraphQlDataSource(DataSource):
    """``spark.read.format("graphql")``: options url, query (with ``{{offset}}`` and ``{{limit}}``), root (the list below ``data``), total, pagesize, headers.

    A partition is one page, so a lost task asks again for its own page only.
    """

    @classmethod
    def name(cls) -> str:
        return "graphql"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GraphQlReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GraphQlDataSource)
