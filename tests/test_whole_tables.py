"""Assembly, projection and reprojection run over whole tables: one row for each feature."""

import pytest

from lodestrata import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,table", [("p_fields", "orders"), ("g_reproject_wkt", "customer"), ("p_skip_geometry", "customer"), ("asm_feature_ref", "customer"), ("a_literals", "orders"), ("asm_value_array", "orders"), ("asm_m_to_n", "orders")])
def test_one_row_for_each_feature(spark, name, table):
    keys = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select({"orders": "o_orderkey", "customer": "c_custkey"}[table]).collect()}
    got = [r.key for r in catalog.queries()[name](spark, SF).select("key").collect()]
    assert len(got) == len(keys) and set(got) == keys


@pytest.mark.parametrize("name,table,key", [("asm_object_array", "orders", "o_orderkey"), ("js_array", "events", "event_id")])
def test_no_filter_by_a_value(spark, name, table, key):
    keys = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in catalog.queries()[name](spark, SF).collect()]
    assert len(got) == len(keys) and set(got) == keys
