"""CQL2 filters over a feature type, as Column expressions and semi-joins.

A predicate on a property of a related table holds if some related row meets it,
each predicate by itself (only a filter in the path's brackets binds predicates
to one row). Conjuncts become ``left_semi`` joins, nested from the innermost
table outwards; below OR or NOT they become marker columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.cql import checks
from lodestrata.cql.ast import ARRAY, SPATIAL, Array, Bbox, Func, Geom, Lit, Op, Prop, transform, walk
from lodestrata.cql.rewrites import prepare
from lodestrata.cql.text import CqlError
from lodestrata.functions import crs as C
from lodestrata.functions import geometry as G
from lodestrata.schema.model import FeatureType, Leaf
from lodestrata.schema.source_path import Step, parse_path

Tables = Callable[[str], DataFrame]
#: Stand for the open ends of intervals; Spark has no infinite timestamps.
FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 23:59:59"
_MARK = count()


def instant_literal(x: Lit) -> Column:
    """A date as DATE, a timestamp in UTC without zone, whatever the session's zone."""
    if x.kind == "date":
        return F.lit(x.value).cast("date")
    at = datetime.fromisoformat(x.value)
    at = at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
    return F.lit(at.isoformat(" ")).cast("timestamp_ntz")


def table(tables: Tables, step: Step) -> DataFrame:
    """A step's rows, its flags' filter (CQL2 over the table's own columns) applied."""
    df = tables(step.table)
    if text := step.flag("filter"):
        from lodestrata.cql.text import parse

        own = prepare(parse(text))
        df = df.filter(Expressions({}, lambda p: F.col(p.path[-1])).predicate(own))
    return df


def matched(df: DataFrame, column: str, keys: DataFrame, how: str) -> DataFrame:
    """The rows with or without their ``column`` in ``keys``, a table of one column.

    Keys too many to broadcast are hashed, once each, in every task, and the rows pass by: a sort-merge join would keep
    both in the task's memory to sort them.
    """
    plan = keys._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) > df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        keys = keys.hint("shuffle_hash")
    return df.join(keys, df[column] == keys[keys.columns[0]], how)


def json_values(c: Column, path: tuple[str, ...], kind: str) -> Column:
    """All values below a JSON path with arrays (steps that end in ``[*]``), one after another, without nulls."""

    def schema(keys: tuple[str, ...]) -> str:
        if not keys:
            return kind
        inner = schema(keys[1:])
        return f"struct<`{keys[0].removesuffix('[*]')}`: {f'array<{inner}>' if keys[0].endswith('[*]') else inner}>"

    def below(x: Column, keys: tuple[str, ...]) -> tuple[Column, bool]:
        """The value or values, and which of both."""
        if not keys:
            return x, False
        own = x[keys[0].removesuffix("[*]")]
        if not keys[0].endswith("[*]"):
            return below(own, keys[1:])
        return inside(own, keys[1:]), True

    def inside(array: Column, keys: tuple[str, ...]) -> Column:
        many = any(k.endswith("[*]") for k in keys)
        out = F.transform(array, lambda x: below(x, keys)[0])
        return F.flatten(F.filter(out, lambda x: x.isNotNull())) if many else out

    i = next(k for k, step in enumerate(path) if step.endswith("[*]"))
    text = F.get_json_object(c, "$." + ".".join(path[: i + 1]).removesuffix("[*]"))
    return F.filter(inside(F.from_json(text, f"array<{schema(path[i + 1 :])}>"), path[i + 1 :]), lambda x: x.isNotNull())


def leaf_column(leaf: Leaf) -> Column:
    """The value of a property in its own table's row."""
    p = leaf.property
    if p.constant is not None:
        return F.lit(p.constant).cast(p.spark_type())
    if p.point:
        return G.point_wkt(F.col(p.point[0]), F.col(p.point[1]))
    path = parse_path(p.source_path)
    if path.kind == "expression":
        kind = f"array<{p.spark_type()}>" if p.type == "VALUE_ARRAY" else p.spark_type()
        return F.expr(path.column.replace("$T$.", "")).cast(kind)
    if path.kind == "json":
        if any(k.endswith("[*]") for k in path.json_path):
            return json_values(F.col(path.column), path.json_path, p.spark_type())
        keys = "".join(f".{k}" for k in path.json_path)
        if p.type == "VALUE_ARRAY":
            return F.from_json(F.get_json_object(path.column, f"${keys}"), f"array<{p.spark_type()}>")
        return F.get_json_object(path.column, f"${keys}").cast(p.spark_type())
    c = F.expr(path.column) if "(" in path.column else F.col(path.column)  # a function of the column
    if p.type in ("DATE", "DATETIME"):
        if pattern := dict(path.flags).get("format"):  # how the column's text is to be read
            return F.to_date(c, pattern) if p.type == "DATE" else F.to_timestamp_ntz(c, F.lit(pattern))
        return c.cast(p.spark_type())
    return c


@dataclass
class Expressions:
    """Scalar expressions over one row; ``column`` resolves a property, ``geometry`` its point columns if it has any."""

    leaves: dict[str, Leaf]
    column: Callable[[Prop], Column]
    position: Column | None = None
    accents: bool = True

    def value(self, x) -> Column:
        match x:
            case Lit(_, "date" | "timestamp"):
                return instant_literal(x)
            case Lit(value, _):
                return F.lit(value)
            case Prop():
                return self.column(x)
            case Func(name, args):
                return self.call(name.lower(), args)
            case Geom():
                from lodestrata.cql.text import geometry_text

                return F.lit(geometry_text(x))
        raise CqlError(f"not a value: {x!r}")

    def call(self, name: str, args: tuple) -> Column:
        match name:
            case "casei" | "lower":
                return F.lower(self.value(args[0]))
            case "upper":
                return F.upper(self.value(args[0]))
            case "accenti":
                return F.collate(self.value(args[0]), "UNICODE_AI")
            case "_start":
                return F.coalesce(self.value(args[0]).cast("timestamp_ntz"), F.lit(FIRST).cast("timestamp_ntz"))
            case "_end":
                return F.coalesce(self.value(args[0]).cast("timestamp_ntz"), F.lit(LAST).cast("timestamp_ntz"))
            case "position":
                if self.position is None:
                    raise CqlError("position() stands in a nested filter only")
                return self.position
            case "diameter2d":
                box = G.bbox(self.value(args[0]))
                return C.diameter_2d(box.xmin, box.ymin, box.xmax, box.ymax)
            case "diameter3d":
                box = G.bbox_3d(self.value(args[0]))
                return C.diameter_3d(box.xmin, box.ymin, box.zmin, box.xmax, box.ymax, box.zmax)
        raise CqlError(f"unknown function {name}()")

    def point(self, x) -> tuple[Column, Column] | None:
        leaf = self.leaves.get(x.name) if isinstance(x, Prop) else None
        return (F.col(leaf.property.point[0]), F.col(leaf.property.point[1])) if leaf and leaf.property.point else None

    def spatial(self, op: str, a, b) -> Column:
        if isinstance(a, Geom) and not isinstance(b, Geom):
            a, b, op = b, a, {"s_within": "s_contains", "s_contains": "s_within"}.get(op, op)
        if not isinstance(b, Geom):
            return G.spatial_columns(op, self.value(a), self.value(b))
        literal = (b.type, _lists(b.coordinates))
        at = self.point(a)
        if at:
            fast = self.native(op, at, literal)
            if fast is not None:
                return fast
        if isinstance(a, Geom):
            from lodestrata.functions import predicates

            return F.lit(predicates.evaluate(op, (a.type, _lists(a.coordinates)), literal))
        test = G.spatial(op, self.value(a), literal)
        box = G.wkt.bbox(literal)
        if at and box and op != "s_disjoint":  # cheap comparisons run below the UDF
            x, y = at
            return x.between(box[0], box[2]) & y.between(box[1], box[3]) & test
        return test

    def native(self, op: str, at: tuple[Column, Column], literal) -> Column | None:
        if box := G.rectangle(literal):
            return G.point_in_box(op, *at, box)
        if literal[0] == "Polygon":
            return G.point_in_polygon(op, *at, literal[1])
        if literal[0] == "MultiPolygon":
            parts = [self.native(op, at, ("Polygon", p)) for p in literal[1]]
            if any(p is None for p in parts) or op not in ("s_intersects", "s_disjoint", "s_within"):
                return None
            return reduce((lambda x, y: x & y) if op == "s_disjoint" else (lambda x, y: x | y), parts)
        return None

    def predicate(self, x) -> Column:
        match x:
            case Lit(value, "boolean"):
                return F.lit(value)
            case Op("and", args):
                return reduce(lambda a, b: a & b, map(self.predicate, args))
            case Op("or", args):
                return reduce(lambda a, b: a | b, map(self.predicate, args))
            case Op("not", (inner,)):
                return ~self.predicate(inner)
            case Op("isNull", (a,)):
                return self.value(a).isNull()
            case Op("like", (a, b)):
                pattern = self.value(b)
                text = self.value(a).cast("string") if not (isinstance(a, Func) and a.name.lower() == "accenti") else self.value(a)
                # SQL's wildcards only: a backslash is an ordinary character.
                return F.like(text, F.replace(pattern, F.lit("\\"), F.lit("\\\\"))) if isinstance(b, Lit) is False else text.like(b.value.replace("\\", "\\\\"))
            case Op("between", (a, lo, hi)):
                return self.value(a).between(self.value(lo), self.value(hi))
            case Op("in", (a, Array(items))):
                if any(isinstance(i, Func) for i in items):
                    return reduce(lambda p, q: p | q, (self.value(a) == self.value(i) for i in items))
                return self.value(a).isin(*map(self.value, items))
            case Op(op, (a, b)) if op in SPATIAL:
                return self.spatial(op, a, b)
            case Op(op, (a, b)) if op in ARRAY:
                return self.array(op, a, b)
            case Op("=", (a, b)):
                return self.value(a) == self.value(b)
            case Op("<>", (a, b)):
                return self.value(a) != self.value(b)
            case Op("<", (a, b)):
                return self.value(a) < self.value(b)
            case Op("<=", (a, b)):
                return self.value(a) <= self.value(b)
            case Op(">", (a, b)):
                return self.value(a) > self.value(b)
            case Op(">=", (a, b)):
                return self.value(a) >= self.value(b)
            case Func() | Prop():
                return self.value(x)
        raise CqlError(f"cannot evaluate {x!r}")

    def array(self, op: str, a, b) -> Column:
        """Array predicates over an array column (a JSON array): equality is exact, with order and repeats."""
        if not isinstance(b, Array):
            raise CqlError("array predicates compare a property with a literal")
        items = F.array(*map(self.value, b.items)) if b.items else F.array()
        own = self.value(a)
        no = F.lit(False)
        match op:
            case "a_contains":
                return F.coalesce(F.size(F.array_except(items, own)) == 0, no)
            case "a_equals":
                return F.coalesce(own == items, no)
            case "a_overlaps":
                return F.coalesce(F.arrays_overlap(own, items), no)
        return F.coalesce((F.size(own) > 0) & (F.size(F.array_except(own, items)) == 0), no)


def _lists(x):
    return list(map(_lists, x)) if isinstance(x, tuple) else x


def to_native(node, source: C.Crs, native: C.Crs):
    """Geometry literals, checked in their own reference system, in that of the features' coordinates (in the plane)."""

    def move(x):
        if not isinstance(x, Geom | Bbox):
            return x
        own = x.crs or source
        checks.check_domain(x, own)
        if own == native:
            return x
        if isinstance(x, Bbox):
            v = x.values if len(x.values) == 4 else (*x.values[:2], *x.values[3:5])
            low, high = C.transform(list(v[:2]), own, native), C.transform(list(v[2:]), own, native)
            lon = 0 if native.lon_lat else 1
            if C.unit(own) == C.unit(native) == "degree" and low[lon] > high[lon]:  # it crosses the antimeridian there, too
                return Bbox((*low, *high), native)
            return Bbox(C.transform_bbox(v, own, native), native)
        g = G.wkt.map_coordinates((x.type, _lists(x.coordinates)), lambda line: [C.transform(c[:2], own, native) for c in line])
        return Geom(x.type, _tuples(g[1]), native)

    return transform(node, move)


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


class FilterPlan:
    """Applies a filter to the rows of a feature type's main table."""

    def __init__(self, feature_type: FeatureType, tables: Tables, native_crs: C.Crs = C.CRS84):
        self.type, self.tables, self.native_crs = feature_type, tables, native_crs
        self.leaves = {x.name: x for x in feature_type.leaves()}
        self.main = feature_type.main

    def check(self, expression) -> None:
        if bad := checks.unknown_properties(transform(expression, lambda x: x), set(self.leaves)):
            raise CqlError(f"unknown properties: {', '.join(bad)}")
        checks.check_functions(expression)
        checks.check_types(expression, self.type.scope("QUERYABLE").types())

    def apply(self, df: DataFrame, expression, crs: C.Crs | None = None) -> DataFrame:
        """Rows of ``df`` (of the main table) that the filter keeps, with the same columns; ``crs`` is that of the filter's coordinates."""
        columns = df.columns
        key = self.type.with_role("ID")
        expression = transform(expression, lambda x: Prop((key.name,)) if isinstance(x, Prop) and x.path == ("_ID_",) and key else x)
        self.check(expression)
        expression = to_native(expression, crs or self.native_crs, self.native_crs)
        dates = frozenset(n for n, x in self.leaves.items() if x.property.type == "DATE")
        node = prepare(expression, dates)
        parts = node.args if isinstance(node, Op) and node.op == "and" else (node,)
        for part in sorted(parts, key=lambda p: bool(self.related(p))):  # plain conjuncts first: they reach the scan
            if self.related(part) and not (isinstance(part, Op) and part.op in ("and", "or")):
                rows, source = self.keys(part)
                if rows is not None:
                    df = df.join(rows, df[source] == rows["_k"], "left_semi")
                    continue
            df, test = self.mark(df, part)
            df = df.filter(test)
        return df.select(*columns)

    def related(self, node) -> bool:
        return any(isinstance(x, Prop) and (x.nested or len(self.steps(x)) > 0) for x in walk(node))

    def leaf(self, x: Prop) -> Leaf:
        return self.leaves[x.name]

    def steps(self, x: Prop) -> tuple[Step, ...]:
        return self.leaf(x).steps if x.name in self.leaves else ()

    def mark(self, df: DataFrame, node) -> tuple[DataFrame, Column]:
        """A predicate as a column of ``df``; related leaves join their keys as a marker first."""
        if isinstance(node, Op) and node.op in ("and", "or"):
            tests = []
            for a in node.args:
                df, t = self.mark(df, a)
                tests.append(t)
            return df, reduce((lambda p, q: p & q) if node.op == "and" else (lambda p, q: p | q), tests)
        if not self.related(node):
            return df, Expressions(self.leaves, lambda p: leaf_column(self.leaf(p))).predicate(node)
        inner, negated = (node.args[0], True) if isinstance(node, Op) and node.op == "not" and isinstance(node.args[0], Op) and node.args[0].op in ARRAY else (node, False)
        rows, source = self.keys(inner)
        name = f"_mark{next(_MARK)}"
        rows = rows.select(F.col("_k").alias(f"{name}k")).distinct().withColumn(name, F.lit(True))
        df = df.join(rows, df[source] == F.col(f"{name}k"), "left")
        test = F.coalesce(F.col(name), F.lit(False))
        return df, ~test if negated else test

    def keys(self, node) -> tuple[DataFrame | None, str]:
        """Rows ``_k`` of link values for which the predicate holds in the related tables, and the main table's link column."""
        props = [x for x in walk(node) if isinstance(x, Prop) and x.name in self.leaves and self.steps(x)]
        deepest = max(props, key=lambda x: len(self.steps(x)))
        steps = self.steps(deepest)
        if isinstance(node, Op) and node.op == "not" and isinstance(node.args[0], Op) and node.args[0].op in ARRAY:
            return None, steps[0].source
        if isinstance(node, Op) and node.op in ARRAY and self.leaf(deepest).property.type != "VALUE_ARRAY" or isinstance(node, Op) and node.op in ARRAY and parse_path(self.leaf(deepest).property.source_path).kind != "json":
            return self.array_keys(node, deepest, steps), steps[0].source
        rows = None
        for i in range(len(steps) - 1, -1, -1):
            own = self.step_rows(deepest, steps, i)
            if i == len(steps) - 1:
                own = own.filter(Expressions(self.leaves, lambda p: leaf_column(self.leaf(p))).predicate(node))
            if rows is not None:
                own = own.join(rows, own[steps[i + 1].source] == rows["_k"], "left_semi")
            rows = own.select(F.col(steps[i].target).alias("_k"))
        return rows, steps[0].source

    def step_rows(self, x: Prop, steps: tuple[Step, ...], i: int) -> DataFrame:
        """Rows of one step's table, its nested filter applied; position() counts a parent's rows by their sort key."""
        own = table(self.tables, steps[i])
        for at, inner in x.nested:
            prefix = x.path[: at + 1]
            if len(self.object_steps(prefix)) - 1 == i:
                inner = transform(inner, lambda y, prefix=prefix: Prop(prefix + y.path) if isinstance(y, Prop) else y)
                position = None
                if any(isinstance(y, Func) and y.name.lower() == "position" for y in walk(inner)):
                    order = steps[i].flag("sortKey", own.columns[0])
                    own = own.withColumn("_position", F.row_number().over(Window.partitionBy(steps[i].target).orderBy(order, *own.columns)))  # all columns break ties
                    position = F.col("_position")
                own = own.filter(Expressions(self.leaves, lambda p: leaf_column(self.leaf(p)), position).predicate(prepare(inner)))
        return own

    def object_steps(self, prefix: tuple[str, ...]) -> tuple[Step, ...]:
        """Relations from the main table to an object property."""
        name = ".".join(prefix) + "."
        inner = next(x for x in self.leaves.values() if x.name.startswith(name))
        out: tuple[Step, ...] = ()
        for p in inner.objects[: len(prefix)]:
            out += parse_path(p.source_path).steps
        return out

    def array_keys(self, node: Op, x: Prop, steps: tuple[Step, ...]) -> DataFrame:
        """Array predicates over related rows: counts of distinct values, grouped by the main table's link."""
        a, b = node.args
        if not isinstance(b, Array):
            raise CqlError("array predicates compare a property with a literal")
        own = self.step_rows(x, steps, 0)
        rows = own.withColumn("_k", F.col(steps[0].target))
        for i in range(1, len(steps)):
            nxt = self.step_rows(x, steps, i)
            rows = rows.select("_k", F.col(steps[i].source).alias("_link")).join(nxt, F.col("_link") == nxt[steps[i].target])
        e = Expressions(self.leaves, lambda p: leaf_column(self.leaf(p)))
        rows = rows.select("_k", e.value(a).alias("_v")).filter("_v is not null")
        items = list(dict.fromkeys(b.items))
        inside = F.col("_v").isin(*map(e.value, items)) if items else F.lit(False)
        if node.op == "a_overlaps":
            return rows.filter(inside).select("_k").distinct()
        # Each item has a bit: one partial aggregation tells which items a feature has, whatever repeats.
        seen, words = [], range(0, len(items), 62)
        for w in words:
            bit = F.lit(0).cast("long")
            for k, item in enumerate(items[w : w + 62]):
                bit = F.when(F.col("_v") == e.value(item), F.lit(1 << k).cast("long")).otherwise(bit)
            seen.append(F.bit_or(bit).alias(f"_b{w}"))
        full = [F.col(f"_b{w}") == (1 << len(items[w : w + 62])) - 1 for w in words]
        if node.op == "a_contains":
            if not items:  # every array holds an empty one
                return rows.select("_k").distinct()
            return rows.filter(inside).groupBy("_k").agg(*seen).filter(reduce(lambda p, q: p & q, full)).select("_k")
        other = F.max(F.when(inside, 0).otherwise(1)).alias("_other")
        kept = rows.groupBy("_k").agg(other, *(seen if node.op == "a_equals" else ())).filter("_other = 0")
        return (kept.filter(reduce(lambda p, q: p & q, full, F.lit(True))) if node.op == "a_equals" else kept).select("_k")
