"""String templates ``{{name | filter:'a':'b'}}`` compiled to Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOLE = re.compile(r"\{\{\s*([\w.:-]+)\s*((?:\|(?:[^{}']|'(?:[^']|'')*')*?)?)\s*\}\}")
_FILTER = re.compile(r"\|\s*(\w+)((?:\s*:\s*'(?:[^']|'')*')*)")
_ARG = re.compile(r":\s*'((?:[^']|'')*)'")

#: Filters by name, each a function of the column and its arguments; callers may add their own.
FILTERS: dict[str, Callable[..., Column]] = {
    "replace": lambda c, a, b: F.regexp_replace(c, F.lit(a), F.lit(b)),
    "prepend": lambda c, a: F.concat(F.lit(a), c),
    "append": lambda c, a: F.concat(c, F.lit(a)),
    "urlEncode": lambda c: F.url_encode(c),
    "urlencode": lambda c: F.url_encode(c),
    "toLower": lambda c: F.lower(c),
    "toUpper": lambda c: F.upper(c),
    "unHtml": lambda c: F.regexp_replace(c, F.lit("<[^>]*>"), F.lit("")),
    "markdown": lambda c: markdown(c),
}


def markdown(c: Column) -> Column:
    """Links, strong and emphasised text as HTML."""
    for pattern, to in ((r"\[([^\]]*)\]\(([^)]*)\)", '<a href="$2">$1</a>'), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>")):
        c = F.regexp_replace(c, pattern, to)
    return c


def compile_template(template: str, lookup: Callable[[str], Column | None], depth: int = 4) -> Column:
    """The template as a string column: an unknown or null value is empty unless ``orElse`` replaces it.

    ``assignTo`` keeps a value under a name for later holes and prints nothing. Holes in the
    arguments of ``orElse`` are filled as well, to a fixed depth.
    """
    known: dict[str, Column] = {}

    def fill(text: str, left: int) -> Column:
        parts, at = [], 0
        for m in _HOLE.finditer(text):
            if m.start() > at:
                parts.append(F.lit(text[at : m.start()]))
            at = m.end()
            c = known.get(m[1])
            c = lookup(m[1]) if c is None else c
            c = F.lit(None).cast("string") if c is None else c.cast("string")
            shown = True
            for f in _FILTER.finditer(m[2] or ""):
                args = [a.replace("''", "'") for a in _ARG.findall(f[2])]
                if f[1] == "orElse":
                    c = F.coalesce(c, fill(args[0], left - 1) if left and "{{" in args[0] else F.lit(args[0]))
                elif f[1] == "assignTo":
                    known[args[0]], shown = c, False
                elif f[1] in FILTERS:
                    c = FILTERS[f[1]](c, *args)
                else:
                    raise ValueError(f"unknown template filter {f[1]}")
            if shown:
                parts.append(F.coalesce(c, F.lit("")))
        if at < len(text):
            parts.append(F.lit(text[at:]))
        return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else F.lit("")

    return fill(template, depth)
