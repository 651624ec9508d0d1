"""CQL2 expressions as immutable values; equality is structural."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
SPATIAL = tuple(f"s_{n}" for n in ("equals", "disjoint", "touches", "within", "overlaps", "crosses", "intersects", "contains"))
TEMPORAL = tuple(
    f"t_{n}"
    for n in ("after", "before", "during", "equals", "starts", "startedBy", "contains", "disjoint", "intersects", "finishes", "finishedBy", "meets", "metBy", "overlaps", "overlappedBy")
)
ARRAY = ("a_contains", "a_equals", "a_overlaps", "a_containedBy")


@dataclass(frozen=True)
class Lit:
    """kind: string, number, boolean, date, timestamp (values as text for the last two) or now."""

    value: Any
    kind: str


@dataclass(frozen=True)
class Interval:
    """None stands for an open end."""

    start: Any
    end: Any


@dataclass(frozen=True)
class Prop:
    """A property path; ``nested`` maps a step's index to the filter in its brackets."""

    path: tuple[str, ...]
    nested: tuple[tuple[int, Any], ...] = ()

    @property
    def name(self) -> str:
        return ".".join(self.path)


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Geom:
    """type as in GeoJSON; coordinates as nested tuples; a collection has its geometries there."""

    type: str
    coordinates: tuple
    crs: Any = field(default=None, compare=False)


@dataclass(frozen=True)
class Bbox:
    values: tuple[float, ...]
    crs: Any = field(default=None, compare=False)


@dataclass(frozen=True)
class Array:
    items: tuple


@dataclass(frozen=True)
class Op:
    """Predicates and logic; ``op`` is the name of the JSON encoding, or ``true``/``false`` via :class:`Lit`."""

    op: str
    args: tuple


def children(node: Any) -> tuple:
    match node:
        case Op(_, args) | Func(_, args):
            return args
        case Interval(a, b):
            return tuple(x for x in (a, b) if x is not None)
        case Array(items):
            return items
        case Prop(_, nested):
            return tuple(f for _, f in nested)
    return ()


def walk(node: Any):
    yield node
    for c in children(node):
        yield from walk(c)


def transform(node: Any, f: Callable[[Any], Any]) -> Any:
    """Rebuild bottom-up, applying ``f`` to every node."""
    go = lambda x: x if x is None else transform(x, f)
    match node:
        case Op(op, args):
            node = Op(op, tuple(map(go, args)))
        case Func(name, args):
            node = Func(name, tuple(map(go, args)))
        case Interval(a, b):
            node = Interval(go(a), go(b))
        case Array(items):
            node = Array(tuple(map(go, items)))
        case Prop(_, nested) if nested:
            node = replace(node, nested=tuple((i, go(x)) for i, x in nested))
    return f(node)


def and_(*parts: Any) -> Any:
    parts = tuple(p for p in parts if p is not None)
    return None if not parts else parts[0] if len(parts) == 1 else Op("and", parts)
