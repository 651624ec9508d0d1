"""Property transformations: of values, in a fixed order, and of structure."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.templates import compile_template
from lodestrata.schema.model import FeatureType, Property


def lookup_map(values: dict, c: Column, fallback: Column | None) -> Column:
    """A literal map's value, else the fallback."""
    if not values:
        return fallback
    pairs = F.create_map(*chain.from_iterable((F.lit(str(k)), F.lit(str(v))) for k, v in values.items()))
    found = F.try_element_at(pairs, c.cast("string"))
    return found if fallback is None else F.coalesce(found, fallback)


#: Formats that text dates are read with, in this order.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def date_format(c: Column, pattern: str) -> Column:
    """Reformat a date, timestamp or its text; what cannot be read stays as it is."""
    text = c.cast("string")
    read = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))
    return F.coalesce(F.date_format(read, pattern), text)


def apply_value(c: Column, p: Property, codelists: dict[str, dict]) -> Column:
    """Value transformations: nullify, stringFormat, dateFormat, codelist, map."""
    for t in p.transformations:
        for pattern in [t["nullify"]] if isinstance(t.get("nullify"), str) else t.get("nullify", ()):
            c = F.when(~F.coalesce(c.cast("string").rlike(f"^(?:{pattern})$"), F.lit(False)), c)
        if "stringFormat" in t:
            value = c
            c = F.when(value.isNotNull(), compile_template(t["stringFormat"], lambda n, value=value: value if n in ("value", p.name) else None))
        if "dateFormat" in t:
            c = date_format(c, t["dateFormat"])
        if "codelist" in t:
            entry = codelists[t["codelist"]]
            fallback = entry.get("fallback")
            c = lookup_map(entry["entries"], c, F.lit(fallback) if fallback is not None else c.cast("string"))
        if "map" in t:
            values = {k: v for k, v in t["map"].items() if k != "*"}
            other = t["map"].get("*")
            c = F.when(c.isNotNull(), lookup_map(values, c, F.lit(other) if other is not None else c.cast("string")))
    return c


def transform_structure(df: DataFrame, t: FeatureType, single: bool = False) -> DataFrame:
    """Structural transformations of top-level properties: rename, remove, reduce, map, wrap, add, flatten."""
    columns, flat = [], None
    extra = [c for c in df.columns if c not in {p.name for p in t.properties}]
    for p in t.properties:
        name, c = p.name, F.col(p.name)
        kind = df.schema[p.name].dataType
        gone = False
        for x in p.transformations:
            if x.get("remove") == "ALWAYS" or x.get("remove") == "IN_COLLECTION" and not single:
                gone = True
            field = lambda n, c=c: c[n] if n else None
            if "objectReduceFormat" in x:
                c = F.when(c.isNotNull(), compile_template(x["objectReduceFormat"], lambda n, c=c, kind=kind: c[n] if n in kind.names else None))
            if "objectReduceSelect" in x:
                c = c[x["objectReduceSelect"]]
            if "objectRemoveSelect" in x:
                c = F.when(c[x["objectRemoveSelect"]].isNotNull(), c)
            if "objectMapFormat" in x:
                c = F.when(c.isNotNull(), F.struct(*(compile_template(v, lambda n, c=c, kind=kind: c[n] if n in kind.names else None).alias(k) for k, v in x["objectMapFormat"].items())))
            for target, source in x.get("objectMapDuplicate", {}).items():
                c = F.when(c.isNotNull(), c.withField(target, c[source]))
            for k, v in x.get("objectAddConstants", {}).items():
                c = F.when(c.isNotNull(), c.withField(k, F.lit(v)))
            if "arrayReduceFormat" in x:
                c = F.when(F.size(c) > 0, compile_template(x["arrayReduceFormat"], lambda n, c=c: F.try_element_at(c, F.lit(int(n) + 1)) if n.isdigit() else F.array_join(c.cast("array<string>"), ", ") if n in ("value", p.name) else None))
            match x.get("wrap"):
                case "VALUE_ARRAY" | "OBJECT_ARRAY":
                    c = c if isinstance(kind, T.ArrayType) else F.when(c.isNotNull(), F.array(c))
                case "OBJECT":
                    c = c if isinstance(kind, T.StructType) else F.when(c.isNotNull(), F.struct(c.alias("value")))
            if "flatten" in x:
                flat = x["flatten"] or "."
            name = x.get("rename", x.get("renamePathOnly", name))
        if not gone:
            columns.append(c.alias(name))
    out = df.select(*columns, *extra)
    return flatten(out, flat) if flat else out


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs as flat columns; arrays, whose number of columns the data decide, as a map of flat names (from 1) to text."""

    def go(c: Column, kind, name: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from go(c[f.name], f.dataType, f"{name}{separator}{f.name}")
        elif isinstance(kind, T.ArrayType):
            yield flatten_array(c, kind, name, separator).alias(name)
        else:
            yield c.alias(name)

    return df.select(*(x for f in df.schema.fields for x in go(F.col(f"`{f.name}`"), f.dataType, f.name)))


def flatten_array(c: Column, kind: T.ArrayType, name: str, separator: str) -> Column:
    if isinstance(kind.elementType, T.StructType):
        fields = kind.elementType.names
        entries = F.flatten(F.transform(c, lambda x, i: F.array(*(F.struct(F.concat(F.lit(name + separator), (i + 1).cast("string"), F.lit(separator + f)).alias("key"), x[f].cast("string").alias("value")) for f in fields))))
    else:
        entries = F.transform(c, lambda x, i: F.struct(F.concat(F.lit(name + separator), (i + 1).cast("string")).alias("key"), x.cast("string").alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def remove_empty(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Objects without any value and empty arrays become null, but for the required ones (of whom the parts are still cleaned)."""

    def clean(c: Column, kind, name: str) -> Column:
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType):
                c = F.transform(c, lambda x: clean(x, kind.elementType, name + "[]"))
            return c if name in keep else F.when(F.size(c) > 0, c)
        if isinstance(kind, T.StructType):
            s = F.struct(*(clean(c[f.name], f.dataType, f"{name}.{f.name}").alias(f.name) for f in kind.fields))
            some = reduce(lambda a, b: a | b, (s[n].isNotNull() for n in kind.names))
            return F.when(c.isNotNull(), s) if name in keep else F.when(some, s)
        return c

    return df.select(*(clean(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields))
