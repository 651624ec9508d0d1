"""What keeps a query's time and memory in bounds on larger tables, with the same results."""

import random

import pandas as pd
from pyspark.sql import functions as F

from lodestrata import catalog
from lodestrata.functions import geometry as G
from lodestrata.functions import predicates, wkt
from lodestrata.operators import mutations, tiles

SF = "/root/testdata/sf0.001"
GRID = tiles.GRIDS["WorldCRS84Quad"]


def box(level, row, col):
    w, s, e, n = GRID.tile_box(level, row, col)
    return "Polygon", [[[w, s], [e, s], [e, n], [w, n], [w, s]]]


def candidates():
    """Tiles and geometries, many of which touch a tile's edge or corner."""
    rnd = random.Random(3)
    snap = lambda v: round(v / 5.625) * 5.625 if rnd.random() < 0.5 else round(v, 1)
    at = lambda: f"{snap(rnd.uniform(-40, 40))} {snap(rnd.uniform(-40, 40))}"

    def ring(x, y, a, b):
        return f"({x} {y},{x + a} {y},{x + a} {y + b},{x} {y + b},{x} {y})"

    for _ in range(400):
        x, y, a = snap(rnd.uniform(-40, 20)), snap(rnd.uniform(-40, 20)), rnd.choice((2, 5.625, 45))
        texts = (f"POINT({at()})", f"LINESTRING({at()},{at()},{at()})", f"MULTILINESTRING(({at()},{at()}),({at()},{at()}))", f"POLYGON({ring(x, y, a, a)})", f"POLYGON({ring(x, y, 40, 40)},{ring(x + 2, y + 2, 36, 36)})",
            f"GEOMETRYCOLLECTION(POINT({at()}),POLYGON({ring(x, y, a, 3)}))", "LINESTRING EMPTY", "LINESTRING Z(1 2 3,9 8 7)", f"POLYGON(({x} {y},{x + a} {y},{x + a} {y + a}))", None)
        for text in texts:
            yield 5, rnd.randrange(9, 23), rnd.randrange(25, 39), text


def test_tiles_are_refined_as_by_the_exact_predicate(monkeypatch):
    rows = pd.DataFrame(list(candidates()), columns=["level", "row", "col", "text"])
    want = [t is not None and predicates.evaluate("s_intersects", G.flat(wkt.parsed(t)), box(z, r, c)) for z, r, c, t in rows.itertuples(index=False)]
    assert 100 < sum(want) < len(want) - 100
    for pairs in (tiles.PAIRS, 5):
        monkeypatch.setattr(tiles, "PAIRS", pairs)
        assert tiles.meeting(GRID, rows.level.to_numpy(), rows.row.to_numpy(), rows.col.to_numpy(), rows.text).tolist() == want


def test_the_exact_predicate_is_left_to_what_is_close_to_an_edge(monkeypatch):
    def exact(*_):
        raise AssertionError("decided one by one")

    monkeypatch.setattr(predicates, "evaluate", exact)
    texts = pd.Series(["LINESTRING(1 1,4 4)", "LINESTRING(-3 2,9 4)", "LINESTRING(-2 5,0.5 8)", "LINESTRING(20 20,30 30)", "POLYGON((-9 -9,20 -9,20 20,-9 20,-9 -9))", "POINT(7 3)"])
    n = len(texts)
    level, row, col = (pd.Series([v] * n).to_numpy() for v in (5, 15, 32))  # the tile of 0 to 5.625
    assert tiles.meeting(GRID, level, row, col, texts).tolist() == [True, True, False, False, True, False]


def test_refined_tiles_are_spread_over_the_cores(spark):
    assert catalog.queries()["tile_refined"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _deleted(spark, ids):
    """Orders and their lines, of which some are orphans, without the given orders."""
    orders = spark.createDataFrame([(k, "P") for k in (1, 2, 3)], "o_orderkey long, o_orderstatus string")
    lines = spark.createDataFrame([(k, n) for k in (1, 2, 3, 8, 9, None) for n in (1, 2)], "l_orderkey long, l_linenumber int")
    return mutations.delete({"orders": orders, "lineitem": lines}, catalog.ORDERS, spark.createDataFrame([(i,) for i in ids], "id long"))


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_properties_of_one_relation_are_deleted_by_one_join(spark):
    out = _deleted(spark, [2, 2, 9, None])
    assert sorted(r[0] for r in out["orders"].collect()) == [1, 3]
    left = [r[0] for r in out["lineitem"].collect()]  # lines of an order that is not there, and those without one, stay
    assert sorted(k for k in left if k is not None) == [1, 1, 3, 3, 8, 8, 9, 9] and left.count(None) == 2
    assert _plan(out["lineitem"]).count("LeftAnti") == 1


def test_many_deleted_keys_are_hashed_and_few_are_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    ids = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("orders", "lineitem")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        many = mutations.delete(tables, catalog.ORDERS, ids)["lineitem"]
        assert "SortMergeJoin" not in _plan(many) and "ShuffledHashJoin" in _plan(many)
        n = many.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    few = mutations.delete(tables, catalog.ORDERS, ids)["lineitem"]
    assert "BroadcastHashJoin" in _plan(few) and "ShuffledHashJoin" not in _plan(few)
    assert few.count() == n == tables["lineitem"].filter("l_orderkey % 3 <> 0").count()


def test_links_of_a_filter_are_hashed_where_they_are_many(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    query = catalog.queries()["mut_replace_children"]
    want = sorted(map(tuple, query(spark, SF).collect()), key=str)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = query(spark, SF)
        plan = _plan(df)
        assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and ("LeftSemi" in x or "LeftAnti" in x)]
        assert plan.count("LeftAnti") == 2 and plan.count("LeftSemi") == 2  # orders and lines; orders that go, lines of the features
        assert sorted(map(tuple, df.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
