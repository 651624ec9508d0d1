"""Declared shorthands resolved before planning: fragments, feature references, embedding, merged parents."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from lodestrata.schema.model import FeatureType, Property, as_property


def fragments(spec: dict, known: Mapping[str, dict]) -> dict:
    """``{"$ref": name}`` replaced by the fragment, whose keys the referring property overrides."""
    if "$ref" in spec:
        spec = {**known[spec["$ref"]], **{k: v for k, v in spec.items() if k != "$ref"}}
    return {**spec, "properties": [fragments(p, known) for p in spec["properties"]]} if spec.get("properties") else spec


def references(t: FeatureType) -> FeatureType:
    """A FEATURE_REF without properties becomes an object of id, title (a copy of the id as text) and type."""

    def go(p: Property) -> Property:
        if p.type in ("FEATURE_REF", "FEATURE_REF_ARRAY") and not p.properties:
            hidden = ("QUERYABLE", "SORTABLE") if p.ref_type else ()
            path, _, column = (p.source_path or "").rpartition("/")
            inner = (
                Property("id", p.value_type or "STRING", column, excluded_scopes=hidden),
                Property("title", "STRING", column, excluded_scopes=hidden),
                *((Property("type", "STRING", None, constant=p.ref_type, excluded_scopes=hidden),) if p.ref_type else ()),
            )
            return replace(p, type="OBJECT_ARRAY" if p.type.endswith("ARRAY") else "OBJECT", source_path=path or None, properties=inner)
        if p.properties:
            inner = tuple(map(go, p.properties))
            if p.type.startswith("FEATURE_REF") and not any(q.name == "title" for q in inner):
                own = next(q for q in inner if q.name == "id")
                inner += (replace(own, name="title", type="STRING", role=None),)
            kind = {"FEATURE_REF": "OBJECT", "FEATURE_REF_ARRAY": "OBJECT_ARRAY"}.get(p.type, p.type)
            return replace(p, properties=inner, type=kind)
        return p

    return replace(t, properties=tuple(map(go, t.properties)))


def embed(t: FeatureType, types: Mapping[str, FeatureType], depth: int = 3) -> FeatureType:
    """A reference with ``embed`` becomes the referenced type's properties, reached by the reference's relation."""

    def go(p: Property, left: int) -> Property:
        if p.embed and p.ref_type in types and left:
            target = types[p.ref_type]
            kind = "OBJECT_ARRAY" if p.type.endswith("ARRAY") else "OBJECT"
            relation, _, _ = (p.source_path or "").rpartition("/")
            return Property(p.name, kind, relation or p.source_path, role="EMBEDDED_FEATURE", properties=tuple(replace(go(q, left - 1), role=None) for q in target.properties))
        return replace(p, properties=tuple(go(q, left) for q in p.properties)) if p.properties else p

    return replace(t, properties=tuple(go(p, depth) for p in t.properties))


def merge(t: FeatureType, *parts: FeatureType) -> FeatureType:
    """The properties of several partial types in one; a later definition of a name replaces an earlier one."""
    found: dict[str, Property] = {}
    for part in (t, *parts):
        for p in part.properties:
            old = found.get(p.name)
            if old and old.properties and p.properties:
                inner = {q.name: q for q in (*old.properties, *p.properties)}
                p = replace(p, properties=tuple(inner.values()))
            found[p.name] = p
    return replace(t, properties=tuple(found.values()))


def from_spec(spec: dict, known: Mapping[str, dict] | None = None) -> FeatureType:
    """A feature type from a mapping with name, source_path, properties and, for a root union, concat."""
    spec = fragments(spec, known or {})
    own = FeatureType(spec["name"], spec["source_path"], tuple(as_property(p) for p in spec.get("properties", ())))
    return replace(references(own), concat=tuple(references(from_spec({"name": spec["name"], **c}, known)) for c in spec.get("concat", ())))
