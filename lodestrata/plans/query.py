"""Feature queries: filter, sort, page, assemble nested features, project, transform.

A page is chosen on the main table alone (``TakeOrderedAndProject``); related
tables are then semi-joined to the links of what was chosen before they are
grouped into arrays, so a page or a filter never builds arrays for all features.
Results are sorted only for a page or custom sort keys: an order by the key alone
would be a range shuffle of the whole result that nothing asks for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata import scratch
from lodestrata.cql.ast import and_
from lodestrata.cql.json_format import from_json
from lodestrata.cql.text import parse
from lodestrata.functions import crs as C
from lodestrata.functions import geometry as G
from lodestrata.functions.transformations import apply_value, remove_empty, transform_structure
from lodestrata.plans.filters import FilterPlan, Tables, leaf_column, matched, table
from lodestrata.schema.model import FeatureType, Leaf, Property
from lodestrata.schema.source_path import Step, parse_path


#: Rows that a page may reach to by a top-k in memory.
TOP_ROWS = 1_000_000
_TOP_K = "spark.sql.execution.topKSortFallbackThreshold"


@dataclass(frozen=True)
class FeatureQuery:
    """Filters are CQL2 text, CQL2 JSON or expressions; sort keys are names, with a leading ``-`` for descending."""

    type: str
    filters: tuple = ()
    sort_keys: tuple[str, ...] = ()
    fields: tuple[str, ...] = ("*",)
    skip_geometry: bool = False
    crs: C.Crs | None = None
    max_allowable_offset: float = 0
    geometry_precision: tuple[int, ...] = ()
    limit: int | None = None
    offset: int = 0
    hits_only: bool = False
    single: bool = False
    scope: str = "RETURNABLE"
    #: Reference system of the filters' coordinates; without one, the provider's own.
    filter_crs: C.Crs | None = None
    #: Objects without any value and empty arrays become null, but for required ones.
    remove_empty: bool = False


def expression(f: Any):
    if isinstance(f, str):
        return from_json(f) if f.lstrip().startswith("{") else parse(f)
    return from_json(f) if isinstance(f, dict) else f


def ordered(c: Column, down: bool) -> Column:
    """Nulls are smallest."""
    return c.desc_nulls_last() if down else c.asc_nulls_first()


@dataclass
class Provider:
    """Feature types over named tables; ``native_crs`` is the coordinates' own reference system."""

    spark: SparkSession
    tables: Tables
    types: dict[str, FeatureType]
    native_crs: C.Crs = C.CRS84
    codelists: dict[str, dict] = field(default_factory=dict)
    #: Hooks: on each query before it is planned, and on each result.
    before: list[Callable[[FeatureQuery], FeatureQuery]] = field(default_factory=list)
    after: list[Callable[[FeatureQuery, DataFrame], DataFrame]] = field(default_factory=list)

    def __post_init__(self):
        # Top-k keeps as many rows in a task's memory as offset and limit add up to; beyond this Spark sorts and streams.
        if self.spark.conf.get(_TOP_K, None) is None:
            self.spark.conf.set(_TOP_K, str(TOP_ROWS))

    # --- selection of rows ---------------------------------------------------------------

    def rows(self, t: FeatureType, filters: tuple = (), crs: C.Crs | None = None) -> DataFrame:
        """The main table's rows that pass the type's own and the query's filters.

        Where the sort key is flagged as not unique, ``_number`` counts the rows of
        one key, by all columns; a key's rows are few, so no task gets the whole table.
        """
        df = table(self.tables, t.main)
        if t.main.flag("sortKeyUnique") == "false":
            df = df.withColumn("_number", F.row_number().over(Window.partitionBy(t.key).orderBy(*df.columns)))
        node = and_(*map(expression, filters)) if filters else None
        return FilterPlan(t, self.tables, self.native_crs).apply(df, node, crs) if node is not None else df

    def sort_values(self, t: FeatureType, sort_keys: tuple[str, ...]) -> list[tuple[Column, bool]]:
        """Custom keys, then the main key, each with whether it descends."""
        out = []
        for k in sort_keys:
            name = k.lstrip("+-")
            leaf = t.leaf(name)
            if not leaf.property.in_scope("SORTABLE") or leaf.steps:
                raise ValueError(f"type {t.name} cannot be sorted by {name}")
            out.append((leaf_column(leaf), k.startswith("-")))
        if t.main.flag("sortKeyUnique") == "false":
            return [*out, (F.col(t.key), False), (F.col("_number"), False)]
        return [*out, (F.col(t.key), False)]

    def sort_columns(self, t: FeatureType, sort_keys: tuple[str, ...]) -> list[Column]:
        """Custom keys, then the main key ascending; nulls are smallest."""
        return [ordered(c, down) for c, down in self.sort_values(t, sort_keys)]

    def page(self, q: FeatureQuery) -> DataFrame:
        """The main table's rows of the query's page, in order; without page and sort keys, in any order."""
        t = self.types[q.type]
        df = self.rows(t, q.filters, q.filter_crs)
        if q.limit is None and not q.offset and not q.sort_keys:
            return df
        df = df.orderBy(*self.sort_columns(t, q.sort_keys))
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit is not None else df

    def chosen(self, t: FeatureType, q: FeatureQuery) -> DataFrame:
        """:meth:`page`, written down once where related properties of ``t`` would each plan and scan it again."""
        page = self.page(q)
        if q.limit is not None and q.limit <= TOP_ROWS and any(x.steps for x in t.leaves()) and scratch.usable(self.spark):
            return scratch.written(page, "page")
        return page

    # --- results -------------------------------------------------------------------------

    def query(self, q: FeatureQuery) -> DataFrame:
        """Nested features, or only their number for ``hits_only``."""
        for hook in self.before:
            q = hook(q)
        out = self.plan(q)
        for hook in self.after:
            out = hook(q, out)
        return out

    def plan(self, q: FeatureQuery) -> DataFrame:
        if q.hits_only:
            return self.count(q.type, q.filters)
        t = self.types[q.type]
        if t.concat:
            return self.multi([replace(q, limit=None, offset=0, type=x.name) for x in self.union_types(t)], q.limit, q.offset)
        return self.assemble(shown := self.projected(t, q), self.chosen(shown, q), q)

    def union_types(self, t: FeatureType) -> list[FeatureType]:
        """The types of a root union, registered under names of their own."""
        out = []
        for i, x in enumerate((replace(t, concat=()), *t.concat)):
            own = replace(x, name=f"{t.name}#{i}")
            self.types[own.name] = own
            out.append(own)
        return out

    def multi(self, queries: list[FeatureQuery], limit: int | None = None, offset: int = 0) -> DataFrame:
        """Sub-queries one after another, with one limit and offset over all; ``_ordinal`` is the sub-query's place."""
        parts, order = [], [F.col("_ordinal")]
        for i, q in enumerate(queries):
            t = self.types[q.type]
            if limit is not None:  # no sub-query can give more rows than the whole
                q = replace(q, limit=min(limit + offset, limit + offset if q.limit is None else q.limit))
            one = self.assemble(shown := self.projected(t, q), self.chosen(shown, q), q, keep=f"_s{i}_")
            order += [ordered(F.col(f"_s{i}_{k}"), down) for k, (_, down) in enumerate(self.sort_values(t, q.sort_keys))]
            parts.append(one.withColumn("_ordinal", F.lit(i)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        if limit is not None or offset or any(q.sort_keys for q in queries):
            # A sub-query's sort columns are null in the rows of all others, so they order its own rows only.
            out = out.orderBy(*order)
            out = out.offset(offset) if offset else out
            out = out.limit(limit) if limit is not None else out
        return out.drop(*(c for c in out.columns if c.startswith("_s") and c[2].isdigit()))

    def projected(self, t: FeatureType, q: FeatureQuery) -> FeatureType:
        """The type with the scope's and the query's properties."""
        t = t.scope(q.scope)
        if q.fields != ("*",):
            refs = {x.name for x in t.leaves() if any(o.type.startswith("FEATURE_REF") for o in x.objects)}
            t = t.select(lambda n, p: any(n == f or n.startswith(f"{f}.") for f in q.fields) or n in refs and n.rpartition(".")[0] in q.fields)
        return t.select(lambda _, p: p.role != "PRIMARY_GEOMETRY") if q.skip_geometry else t

    def value(self, p: Property, q: FeatureQuery) -> Column:
        if p.coalesce:
            return F.coalesce(*(self.value(replace(c, name=p.name), q) for c in p.coalesce))
        if p.concat:
            parts = [self.value(replace(c, name=p.name), q) for c in p.concat]
            arrays = [c if x.type.endswith("ARRAY") else F.array(c) for c, x in zip(parts, p.concat, strict=True)]
            return F.filter(F.concat(*arrays), lambda x: x.isNotNull())
        c = leaf_column(Leaf(p.name, p, ()))
        if p.type == "GEOMETRY" and (not p.point or q.crs and q.crs != self.native_crs or q.max_allowable_offset or q.geometry_precision):
            c = G.processed(c, self.native_crs, q.crs or self.native_crs, q.max_allowable_offset, q.geometry_precision)
        return apply_value(c, p, self.codelists)

    def assemble(self, t: FeatureType, page: DataFrame, q: FeatureQuery, keep: str | None = None) -> DataFrame:
        """One row for each row of ``page``, with objects as structs and related objects as arrays.

        With ``keep``, the columns that the page is sorted by stay, under that name and a number.
        """
        df, columns = page, []
        for i, p in enumerate(t.properties):
            df, c = self.property(df, page, p, q, f"_j{i}")
            columns.append(c.alias(p.name))
        # Joins lose the page's order. Its sort columns need not be among the result's, so they are carried along.
        sort = self.sort_values(self.types[q.type], q.sort_keys)
        again = not keep and len(df.columns) > len(page.columns) and (q.limit is not None or q.offset or q.sort_keys)
        names = [f"{keep or '_sort'}{k}" for k in range(len(sort))] if keep or again else []
        out = df.select(*columns, *(c.alias(n) for n, (c, _) in zip(names, sort, strict=False)))
        out = transform_structure(out, t, q.single)
        if again:
            out = out.orderBy(*(ordered(F.col(n), down) for n, (_, down) in zip(names, sort, strict=True))).drop(*names)
        return remove_empty(out, tuple(t.required_names())) if q.remove_empty else out

    def property(self, df: DataFrame, page: DataFrame, p: Property, q: FeatureQuery, tag: str) -> tuple[DataFrame, Column]:
        """The property's column over ``df``, after joining what it needs."""
        path = parse_path(p.source_path)
        if not path.steps:
            if not p.properties:
                return df, self.value(p, q)
            inner = []
            for i, c in enumerate(p.properties):
                df, column = self.property(df, page, c, q, f"{tag}_{i}")
                inner.append(column.alias(c.name))
            return df, self.object(p, inner)
        many = p.type.endswith("ARRAY")
        children = self.related(p, path.steps, page, q, tag)
        joined = df.join(children, df[path.steps[0].source] == children[f"{tag}k"], "left").drop(f"{tag}k")
        return joined, F.coalesce(F.col(f"{tag}v"), F.array().cast(children.schema[f"{tag}v"].dataType)) if many else F.col(f"{tag}v")

    def object(self, p: Property, columns: list[Column]) -> Column:
        """A struct, or null if all its values are."""
        s = F.struct(*columns)
        names = [c.name for c in p.properties if c.constant is None]
        if p.required or not names:
            return s
        test = None
        for n in names:
            test = s[n].isNotNull() if test is None else test | s[n].isNotNull()
        return F.when(test, s)

    def related(self, p: Property, steps: tuple[Step, ...], page: DataFrame, q: FeatureQuery, tag: str) -> DataFrame:
        """Link value and the related value, struct or sorted array: one row for each link of the page."""
        first = table(self.tables, steps[0])
        links = page.select(F.col(steps[0].source).alias("_link"))
        if q.limit is not None or q.filters:  # the related rows of other features are never grouped
            first = matched(first, steps[0].target, links, "left_semi")
        rows = first.withColumn("_k", F.col(steps[0].target))
        for step in steps[1:]:
            nxt = table(self.tables, step)
            how = step.flag("joinType", "INNER").lower()
            rows = rows.select("_k", F.col(step.source).alias("_source")).join(nxt, F.col("_source") == nxt[step.target], how).drop("_source")
        order = steps[-1].flag("sortKey", steps[-1].target)
        if p.properties:
            inner, df = [], rows
            for i, c in enumerate(p.properties):
                df, column = self.property(df, rows, c, q, f"{tag}_{i}")
                inner.append(column.alias(c.name))
            value = self.object(p, inner)
        else:
            df, value = rows, self.value(replace(p, source_path=self.tail(p), type="VALUE" if p.type == "VALUE_ARRAY" else p.type), q)
        df = df.select("_k", F.col(order).alias("_o"), value.alias("_v"))
        if p.type.endswith("ARRAY"):
            listed = F.sort_array(F.collect_list(F.struct("_o", "_v")))
            return df.filter("_v is not null").groupBy("_k").agg(F.transform(listed, lambda x: x["_v"]).alias(f"{tag}v")).withColumnRenamed("_k", f"{tag}k")
        return df.groupBy("_k").agg(F.min_by("_v", "_o").alias(f"{tag}v")).withColumnRenamed("_k", f"{tag}k")

    def tail(self, p: Property) -> str | None:
        """The source path below the last relation."""
        path = parse_path(p.source_path)
        if path.kind == "json":
            return f"[JSON]{path.column}" + "".join(f"/{k}" for k in path.json_path)
        return f"[EXPRESSION]{{sql={path.column}}}" if path.kind == "expression" else path.column

    # --- statistics ----------------------------------------------------------------------

    def count(self, type_: str, filters: tuple = ()) -> DataFrame:
        t = self.types[type_]
        out = None
        for x in (replace(t, concat=()), *t.concat):
            n = self.rows(x, filters).agg(F.count("*").alias("number_matched"))
            out = n if out is None else out.unionAll(n)
        return out.agg(F.sum("number_matched").alias("number_matched"))

    def metadata(self, q: FeatureQuery) -> DataFrame:
        """number_returned, number_skipped, xmin, ymin, xmax, ymax, first and last instant of a page: one row.

        The rows that an offset skips are counted only where nothing is left to return.
        """
        t = self.types[q.type]
        page = self.page(q)
        place, at = t.with_role("PRIMARY_GEOMETRY"), t.with_role("PRIMARY_INSTANT")
        columns = [F.count("*").alias("number_returned")]
        if place and place.property.point:
            x, y = map(F.col, place.property.point)
            columns += [F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")]
        elif place:
            page = page.withColumn("_box", G.bbox(leaf_column(place)))
            columns += [f(f"_box.{n}").alias(n) for f, names in ((F.min, ("xmin", "ymin")), (F.max, ("xmax", "ymax"))) for n in names]
        if at:
            columns += [F.min(leaf_column(at)).alias("first"), F.max(leaf_column(at)).alias("last")]
        out = page.agg(*columns)
        skipped = F.lit(None).cast("long")
        if q.offset:
            out = out.crossJoin(self.rows(t, q.filters, q.filter_crs).select(t.key).limit(q.offset).agg(F.count("*").alias("_skipped")))  # one row each
            skipped = F.when(F.col("number_returned") == 0, F.col("_skipped"))
        return out.select("number_returned", skipped.alias("number_skipped"), *(c for c in out.columns if c not in ("number_returned", "_skipped")))

    def page_keys(self, q: FeatureQuery) -> DataFrame:
        """Number, least and greatest key of the page."""
        key = F.col(self.types[q.type].key)
        return self.page(q).agg(F.count("*").alias("number_returned"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))

    def spatial_extent(self, type_: str, filters: tuple = (), height: bool = False) -> DataFrame:
        """xmin, ymin, xmax, ymax of the primary geometry; with ``height`` zmin and zmax too."""
        t = self.types[type_]
        leaf = t.with_role("PRIMARY_GEOMETRY")
        df = self.rows(t, filters)
        if height:
            names = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")
            return df.select(G.bbox_3d(leaf_column(leaf)).alias("b")).agg(*((F.min if n.endswith("min") else F.max)(f"b.{n}").alias(n) for n in names))
        if leaf.property.point:
            x, y = map(F.col, leaf.property.point)
            return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))
        b = df.select(G.bbox(leaf_column(leaf)).alias("b"))
        return b.agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))

    def temporal_extent(self, type_: str, filters: tuple = ()) -> DataFrame:
        """start and end of the primary instant or interval; an open end is null, and without a start there is no extent."""
        t = self.types[type_]
        df = self.rows(t, filters)
        if instant := t.with_role("PRIMARY_INSTANT"):
            c = leaf_column(instant)
            return df.agg(F.min(c).alias("start"), F.max(c).alias("end"))
        start, end = t.with_role("PRIMARY_INTERVAL_START"), t.with_role("PRIMARY_INTERVAL_END")
        if start.steps or end.steps:  # in tables of their own: one row from each
            a = self.values(df, start).agg(F.min("_v").alias("start"))
            b = self.values(df, end).agg(F.max("_v").alias("end"), F.max(F.col("_v").isNull()).alias("open"))
            return a.crossJoin(b).select("start", F.when(~F.col("open") & F.col("start").isNotNull(), F.col("end")).alias("end"))
        a, b = leaf_column(start), leaf_column(end)
        out = df.agg(F.min(a).alias("start"), F.max(b).alias("end"), F.max(b.isNull()).alias("open"))
        return out.select("start", F.when(~F.col("open") & F.col("start").isNotNull(), F.col("end")).alias("end"))

    def values(self, df: DataFrame, leaf: Leaf) -> DataFrame:
        """``_v``: the values of a property that may lie in related tables, for the main table's rows ``df``."""
        link = leaf.steps[0].source if leaf.steps else None
        for i, step in enumerate(leaf.steps):
            rows = table(self.tables, step)
            df = df.select(F.col(link).alias("_link")).join(rows, F.col("_link") == rows[step.target])
            link = leaf.steps[i + 1].source if i + 1 < len(leaf.steps) else None
        return df.select(leaf_column(leaf).alias("_v"))

    def etag(self, q: FeatureQuery) -> DataFrame:
        """A weak ETag: a hash over the features' hashes; those of a page count in its order.

        Without a page the order follows from the features and the sort keys, so
        the hashes are added up, in any number of tasks, and the keys hashed with them.
        """
        t = self.types[q.type]
        features = self.assemble(shown := self.projected(t, q), self.chosen(shown, q), q, keep="_s0_")
        sort = [ordered(F.col(f"_s0_{k}"), down) for k, (_, down) in enumerate(self.sort_values(t, q.sort_keys))]
        own = F.sha2(F.to_json(F.struct(*(c for c in features.columns if not c.startswith("_s0_")))), 256)
        if q.limit is None:
            total = F.coalesce(F.sum(F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
            return features.agg(F.sha2(F.concat_ws("|", total, *map(F.lit, q.sort_keys)), 256).alias("etag"))
        ranked = features.select(F.row_number().over(Window.orderBy(*sort)).alias("n"), own.alias("h"))  # at most ``limit`` rows
        return ranked.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ""), 256).alias("etag"))

    def strong_etag(self, encoded: DataFrame, content: str, order: str) -> DataFrame:
        """A strong ETag: a hash over the output's own bytes. ``encoded`` has one row (``order``, ``content``) for each part of it."""
        digest = encoded.select(F.col(order).alias("n"), F.sha2(F.col(content).cast("binary"), 256).alias("h"))
        return digest.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ""), 256).alias("etag"))
