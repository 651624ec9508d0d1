"""Filters for back ends that understand less than SQL: OGC filter XML for web feature services, arguments for GraphQL.

What a back end cannot say raises :class:`CqlError`; the caller then reads without a filter and filters in Spark.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from lodestrata.cql.ast import Array, Bbox, Interval, Lit, Op, Prop
from lodestrata.cql.rewrites import fix_now
from lodestrata.cql.text import CqlError, to_text

#: The names of the filter encoding standard.
COMPARISON_TAGS = {"<": "PropertyIsLessThan", ">": "PropertyIsGreaterThan", "<=": "PropertyIsLessThanOrEqualTo", ">=": "PropertyIsGreaterThanOrEqualTo"}
NAMESPACES = 'xmlns:fes="http://www.opengis.net/fes/2.0" xmlns:gml="http://www.opengis.net/gml/3.2"'


def _cannot(x) -> CqlError:
    return CqlError(f"the back end has no form of {to_text(x)}")


def _tag(name: str, *parts: str) -> str:
    return f"<fes:{name}>{''.join(parts)}</fes:{name}>"


def _reference(x: Prop) -> str:
    return _tag("ValueReference", escape("/".join(x.path)))


def _literal(x: Lit) -> str:
    return _tag("Literal", escape(str(x.value).lower() if x.kind == "boolean" else str(x.value)))


def _time(x: Lit) -> str:
    return f"<gml:TimeInstant><gml:timePosition>{escape(x.value)}</gml:timePosition></gml:TimeInstant>"


def _envelope(x: Bbox, srs: str) -> str:
    v = [float(c) for c in x.values]
    k = len(v) // 2
    corner = lambda c: " ".join(map(repr, c))
    return f"<gml:Envelope srsName={quoteattr(srs)}><gml:lowerCorner>{corner(v[:k])}</gml:lowerCorner><gml:upperCorner>{corner(v[k:])}</gml:upperCorner></gml:Envelope>"


def wfs_filter(node, srs: str = "urn:ogc:def:crs:OGC:1.3:CRS84") -> str:
    """A filter of the standard's 2.0 XML: equality, order of instants, LIKE, one id, times, intersection with a box, logic."""

    def go(x) -> str:
        match x:
            case Op("and" | "or" as op, args):
                return _tag(op.capitalize(), *map(go, args))
            case Op("not", (inner,)):
                return _tag("Not", go(inner))
            case Op("=", (Prop() as p, Lit() as v)):
                return _tag("PropertyIsEqualTo", _reference(p), _literal(v))
            case Op(op, (Prop() as p, Lit(_, "date" | "timestamp") as v)) if op in COMPARISON_TAGS:
                return _tag("And", _tag(COMPARISON_TAGS[op], _reference(p), _literal(v)), _tag("Not", _tag("PropertyIsNull", _reference(p))))
            case Op("like", (Prop() as p, Lit(_, "string") as v)):
                return f'<fes:PropertyIsLike wildCard="%" singleChar="_" escapeChar="\\">{_reference(p)}{_literal(v)}</fes:PropertyIsLike>'
            case Op("in", (Prop(path), Array((Lit() as v,)))) if path == ("_ID_",):
                return f"<fes:ResourceId rid={quoteattr(str(v.value))}/>"
            case Op("t_equals", (Prop() as p, Lit() as v)):
                return _tag("TEquals", _reference(p), _time(v))
            case Op("t_during" | "t_intersects", (Prop() as p, Interval(Lit() as a, Lit() as b))):
                period = f"<gml:TimePeriod><gml:beginPosition>{escape(a.value)}</gml:beginPosition><gml:endPosition>{escape(b.value)}</gml:endPosition></gml:TimePeriod>"
                return _tag("During", _reference(p), period)
            case Op("s_intersects", (Prop() as p, Bbox() as b)):
                return _tag("BBOX", _reference(p), _envelope(b, srs))
        raise _cannot(x)

    return f"<fes:Filter {NAMESPACES}>{go(fix_now(node))}</fes:Filter>"


def graphql_arguments(node, templates: dict[str, str]) -> str:
    """Arguments of a GraphQL field: ``templates`` has ``id`` with ``{{value}}`` and ``box`` with ``{{xmin}}`` and so on."""
    parts = node.args if isinstance(node, Op) and node.op == "and" else (node,)
    out = []
    for x in parts:
        match x:
            case Op("in", (Prop(path), Array((Lit() as v,)))) if path == ("_ID_",) and "id" in templates:
                text = str(v.value).replace("\\", "\\\\").replace('"', '\\"')
                out.append(templates["id"].replace("{{value}}", text))
            case Op("s_intersects", (Prop(), Bbox(values))) if "box" in templates:
                k, text = len(values) // 2, templates["box"]
                for name, v in zip(("xmin", "ymin", "xmax", "ymax"), (*values[:2], *values[k : k + 2]), strict=True):
                    text = text.replace(f"{{{{{name}}}}}", repr(float(v)))
                out.append(text)
            case _:
                raise _cannot(x)
    return ", ".join(out)
