"""The OGC CQL2 filter language: text and JSON parsers, printers, checks and rewrites."""

from lodestrata.cql.ast import Array, Bbox, Func, Geom, Interval, Lit, Op, Prop
from lodestrata.cql.json_format import from_json, to_json
from lodestrata.cql.text import CqlError, parse, to_text

__all__ = ["Array", "Bbox", "CqlError", "Func", "Geom", "Interval", "Lit", "Op", "Prop", "from_json", "parse", "to_json", "to_text"]
