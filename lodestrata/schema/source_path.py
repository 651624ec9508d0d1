"""The source path mini-language: ``/table{flags}``, ``[a=b]joined{flags}``, ``column``, ``[JSON]col/path``, ``[EXPRESSION]{sql=…}``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_RELATION = re.compile(r"\[(?P<source>[^=\[\]]+)=(?P<target>[^\[\]]+)\](?P<table>[^{}/]+)")


@dataclass(frozen=True)
class Step:
    """A table, reached from the one before by ``source = target`` (empty for the first)."""

    table: str
    source: str = ""
    target: str = ""
    flags: tuple[tuple[str, str], ...] = ()

    def flag(self, name: str, default: str | None = None) -> str | None:
        return dict(self.flags).get(name, default)


@dataclass(frozen=True)
class SourcePath:
    """kind of the column: column, json or expression."""

    steps: tuple[Step, ...] = ()
    column: str | None = None
    kind: str = "column"
    json_path: tuple[str, ...] = ()
    flags: tuple[tuple[str, str], ...] = field(default=())


def _split(path: str) -> list[str]:
    """Elements between slashes that stand outside of braces and brackets."""
    out, depth, now = [], 0, ""
    for c in path:
        depth += c in "{[" or -(c in "}]")
        if c == "/" and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [p for p in [*out, now] if p]


def _flags(element: str) -> tuple[str, tuple[tuple[str, str], ...]]:
    found, rest, at = [], "", 0
    while at < len(element):
        if element[at] != "{":
            rest += element[at]
            at += 1
            continue
        depth, end = 0, at
        while end < len(element):
            depth += (element[end] == "{") - (element[end] == "}")
            if not depth:
                break
            end += 1
        if depth:
            raise ValueError(f"an open brace in the source path {element!r}")
        key, _, value = element[at + 1 : end].partition("=")
        value = value.strip()
        found.append((key.strip(), value[1:-1] if len(value) > 1 and value[0] == value[-1] == "'" and key.strip() != "filter" else value))
        at = end + 1
    return rest.strip(), tuple(found)


def parse_path(path: str | None) -> SourcePath:
    """The steps and the column of a source path."""
    if not path:
        return SourcePath()
    if path.startswith("[EXPRESSION]"):
        _, flags = _flags(path[len("[EXPRESSION]") :])
        return SourcePath((), dict(flags).get("sql"), "expression", (), flags)
    steps: list[Step] = []
    column, kind, json_path, last = None, "column", (), ()
    elements = _split(path)
    for i, element in enumerate(elements):
        if element.startswith("[JSON]"):
            name, last = _flags(element[len("[JSON]") :])
            column, kind, json_path = name, "json", tuple(_flags(e)[0] for e in elements[i + 1 :])
            break
        if element.startswith("[EXPRESSION]"):
            _, last = _flags(element[len("[EXPRESSION]") :])
            column, kind = dict(last).get("sql"), "expression"
            break
        name, flags = _flags(element)
        if m := _RELATION.fullmatch(name):
            steps.append(Step(m["table"], m["source"], m["target"], flags))
        elif i == 0 and path.startswith("/"):
            steps.append(Step(name, "", "", flags))
        elif i == len(elements) - 1:
            column, last = name, flags
        else:
            raise ValueError(f"the element {element!r} of the source path {path!r} is neither a relation nor a column")
    return SourcePath(tuple(steps), column, kind, json_path, last)
