"""Feature types and their properties, as declared."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from lodestrata.schema.source_path import Step, parse_path

VALUE_TYPES = ("INTEGER", "FLOAT", "STRING", "BOOLEAN", "DATE", "DATETIME", "GEOMETRY", "VALUE")
TYPES = (*VALUE_TYPES, "OBJECT", "OBJECT_ARRAY", "VALUE_ARRAY", "FEATURE_REF", "FEATURE_REF_ARRAY", "UNKNOWN")
ROLES = ("ID", "TYPE", "PRIMARY_GEOMETRY", "PRIMARY_INSTANT", "PRIMARY_INTERVAL_START", "PRIMARY_INTERVAL_END", "SECONDARY_GEOMETRY", "EMBEDDED_FEATURE")
SCOPES = ("RETURNABLE", "RECEIVABLE", "QUERYABLE", "SORTABLE")

#: Spark types of schema types.
SPARK_TYPES = {"INTEGER": "bigint", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp_ntz", "GEOMETRY": "string", "FEATURE_REF": "string"}


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "STRING"
    source_path: str | None = None
    value_type: str | None = None
    role: str | None = None
    properties: tuple[Property, ...] = ()
    constant: Any = None
    ref_type: str | None = None
    embed: bool = False
    required: bool = False
    excluded_scopes: tuple[str, ...] = ()
    transformations: tuple[dict, ...] = ()
    coalesce: tuple[Property, ...] = ()
    concat: tuple[Property, ...] = ()
    #: Columns with x and y of a point geometry that has no text column.
    point: tuple[str, str] | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type} of property {self.name}")
        if self.role and self.role not in ROLES:
            raise ValueError(f"unknown role {self.role} of property {self.name}")

    def spark_type(self) -> str:
        kind = self.value_type if self.type in ("VALUE", "VALUE_ARRAY", "FEATURE_REF_ARRAY") and self.value_type else self.type
        return SPARK_TYPES.get(kind, "string")

    def in_scope(self, scope: str) -> bool:
        if scope in self.excluded_scopes:
            return False
        if scope == "SORTABLE":
            return self.constant is None and self.type in ("INTEGER", "FLOAT", "STRING", "BOOLEAN", "DATE", "DATETIME", "VALUE")
        return not (scope == "RECEIVABLE" and self.constant is not None)


def as_property(spec: dict | Property) -> Property:
    """A property from a plain mapping, as read from YAML or JSON."""
    if isinstance(spec, Property):
        return spec
    kept = dict(spec)
    for k in ("properties", "coalesce", "concat"):
        kept[k] = tuple(as_property({"name": spec["name"], **p} if k != "properties" and isinstance(p, dict) else p) for p in spec.get(k, ()))
    for k in ("excluded_scopes", "transformations"):
        kept[k] = tuple(spec.get(k, ()))
    return Property(**kept)


@dataclass(frozen=True)
class Leaf:
    """A value property with its full name, the relations from the main table, and the arrays it lies in."""

    name: str
    property: Property
    steps: tuple[Step, ...]
    objects: tuple[Property, ...] = field(default=())


@dataclass(frozen=True)
class FeatureType:
    """``source_path`` is ``/table{flags}``; ``concat`` lists further types of the same properties (a root union)."""

    name: str
    source_path: str
    properties: tuple[Property, ...]
    concat: tuple[FeatureType, ...] = ()

    @classmethod
    def of(cls, name: str, source_path: str, *properties: dict | Property) -> FeatureType:
        return cls(name, source_path, tuple(map(as_property, properties)))

    @property
    def main(self) -> Step:
        return parse_path(self.source_path).steps[0]

    @property
    def key(self) -> str:
        return self.main.flag("sortKey", "id")

    def leaves(self) -> Iterator[Leaf]:
        def go(props, at, steps, objects):
            for p in props:
                path = parse_path(p.source_path)
                name, all_steps = (*at, p.name), steps + path.steps
                if p.properties:
                    yield from go(p.properties, name, all_steps, (*objects, p))
                else:
                    yield Leaf(".".join(name), p, all_steps, objects)

        yield from go(self.properties, (), (), ())

    def leaf(self, name: str) -> Leaf:
        for x in self.leaves():
            if x.name == name:
                return x
        raise KeyError(f"type {self.name} has no property {name}")

    def with_role(self, role: str) -> Leaf | None:
        return next((x for x in self.leaves() if x.property.role == role), None)

    def select(self, keep) -> FeatureType:
        """The type with the properties for which ``keep(full name, property)`` holds, and their parents."""

        def go(props, at):
            for p in props:
                name = (*at, p.name)
                if p.properties:
                    if inner := tuple(go(p.properties, name)):
                        yield replace(p, properties=inner)
                elif keep(".".join(name), p):
                    yield p

        return replace(self, properties=tuple(go(self.properties, ())))

    def required_names(self) -> Iterator[str]:
        """Full names of the required properties, objects included."""

        def go(props, at):
            for p in props:
                if p.required:
                    yield ".".join((*at, p.name))
                yield from go(p.properties, (*at, p.name))

        yield from go(self.properties, ())

    def scope(self, scope: str) -> FeatureType:
        return self.select(lambda _, p: p.in_scope(scope))

    def types(self) -> dict[str, str]:
        """Full name to schema type, for the filter checks."""
        return {x.name: x.property.value_type or x.property.type if x.property.type == "VALUE" else x.property.type for x in self.leaves()}
