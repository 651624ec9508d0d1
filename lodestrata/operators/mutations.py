"""Create, replace, patch and delete of features, as new versions of the tables below a type.

Tables are values here: each mutation returns the changed tables, to be written
with :func:`commit` as a new version beside the old one; :func:`current` reads the
newest version that is whole, so a crash at any point leaves a table to read.
Replacing is deleting by id and inserting with the id kept; a patch first folds
the changed values over the stored ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.filters import matched
from lodestrata.schema.model import FeatureType
from lodestrata.schema.source_path import parse_path


def insert(tables: dict[str, DataFrame], t: FeatureType, features: DataFrame) -> dict[str, DataFrame]:
    """Rows for the main table, its junctions and children. ``features`` has one column for each property, arrays for children."""
    key, main = t.key, t.main.table
    out, columns = dict(tables), {}
    id_leaf = t.with_role("ID")
    for p in t.properties:
        path = parse_path(p.source_path)
        if not path.steps and path.kind == "column" and path.column and p.name in features.columns:
            columns[path.column] = F.col(p.name)
    if id_leaf and id_leaf.name in features.columns:
        columns[key] = F.col(id_leaf.name)
    out[main] = tables[main].unionByName(features.select(*(c.alias(n) for n, c in columns.items())), allowMissingColumns=True)
    for p in t.properties:
        path = parse_path(p.source_path)
        if not path.steps or p.name not in features.columns:
            continue
        if len(path.steps) > 2:
            raise ValueError(f"{t.name}.{p.name}: a path of more than two relations cannot be written")
        child = path.steps[-1].table
        source = columns.get(path.steps[0].source, F.col(id_leaf.name))
        many = features.select(source.alias("_link"), F.explode(p.name).alias("_v")) if p.type.endswith("ARRAY") else features.select(source.alias("_link"), F.col(p.name).alias("_v")).filter("_v is not null")
        if len(path.steps) == 1:
            values = [F.col("_link").alias(path.steps[0].target)]
            values += [F.col(f"_v.{c.name}").alias(parse_path(c.source_path).column) for c in p.properties] if p.properties else [F.col("_v").alias(path.column)]
        else:  # a junction: the related row is there already, its key is the value of the target's key property
            junction = path.steps[0]
            own = next((c.name for c in p.properties if parse_path(c.source_path).column == path.steps[1].target), None)
            target = F.col(f"_v.{own}") if own else F.col("_v")
            out[junction.table] = out[junction.table].unionByName(many.select(F.col("_link").alias(junction.target), target.alias(path.steps[1].source)), allowMissingColumns=True)
            continue
        out[child] = out[child].unionByName(many.select(*values), allowMissingColumns=True)
    return out


def delete(tables: dict[str, DataFrame], t: FeatureType, ids: DataFrame, cascade: bool = True) -> dict[str, DataFrame]:
    """Without the features whose id is in ``ids`` (column ``id``), and without their child and junction rows."""
    out, main = dict(tables), tables[t.main.table]
    keys = ids.select(F.col("id").alias("_id"))
    links = {}  # properties that follow the same relation share its join
    for p in t.properties if cascade else ():
        path = parse_path(p.source_path)
        if path.steps and p.type.endswith("ARRAY"):
            links[path.steps[0].table, path.steps[0].target, path.steps[0].source] = None
    gone = matched(main, t.key, keys, "left_semi") if links else None
    for table, target, source in links:
        out[table] = matched(out[table], target, gone.select(F.col(source).alias("_link")), "left_anti")
    out[t.main.table] = matched(main, t.key, keys, "left_anti")
    return out


def replace(tables: dict[str, DataFrame], t: FeatureType, features: DataFrame) -> dict[str, DataFrame]:
    ids = features.select(F.col(t.with_role("ID").name).alias("id"))
    return insert(delete(tables, t, ids), t, features)


def patch(tables: dict[str, DataFrame], t: FeatureType, changes: DataFrame) -> dict[str, DataFrame]:
    """Non-null values of ``changes`` over the stored main row; children stay as they are."""
    key, main = t.key, tables[t.main.table]
    given = {parse_path(p.source_path).column: p.name for p in t.properties if not parse_path(p.source_path).steps and p.name in changes.columns}
    new = changes.select(F.col(t.with_role("ID").name).alias("_key"), *(F.col(n).alias(f"_new_{c}") for c, n in given.items() if c != key), F.lit(True).alias("_hit"))
    joined = main.join(new, main[key] == new["_key"], "left")
    out = dict(tables)
    out[t.main.table] = joined.select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in given and c != key else F.col(c) for c in main.columns))
    return out


def stats(t: FeatureType, features: DataFrame, point: tuple[str, str] | None = None) -> DataFrame:
    """What a mutation touched, for its listeners: n_features, box and first and last instant, in one pass."""
    columns = [F.count("*").alias("n_features")]
    if point:
        x, y = map(F.col, point)
        columns += [F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")]
    if (at := t.with_role("PRIMARY_INSTANT")) and at.name in features.columns:
        columns += [F.min(at.name).alias("first"), F.max(at.name).alias("last")]
    return features.agg(*columns)


def _versions(spark: SparkSession, path: str) -> tuple[object, list[str]]:
    """The path's file system, and its whole versions, oldest first."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
    whole = [n for n in names if n.startswith("v-") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return fs, whole


def commit(table: DataFrame, path: str) -> None:
    """Write a table's next version. It counts once its last file, the marker of success, is there; the one before stays for its readers."""
    spark = table.sparkSession
    fs, whole = _versions(spark, path)
    table.write.mode("overwrite").parquet(f"{path}/v-{int(whole[-1][2:]) + 1 if whole else 1:012d}")
    for old in whole[:-1]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version that :func:`commit` wrote."""
    _, whole = _versions(spark, path)
    if not whole:
        raise ValueError(f"no table was committed to {path}")
    return spark.read.parquet(f"{path}/{whole[-1]}")
