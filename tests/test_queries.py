"""Registered queries beside their SQL on the smallest driver tables, and the shape of their plans."""

import os

import duckdb
import pandas as pd
import pytest

from checks.compare import _texts
from checks.fixtures import FIXTURES, TABLES, projection
from checks.oracle import SQL, oracle_sql
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

COMPARED = [
    "storm_events", "storm_days", "radius_count", "steep_slope_flag", "nearest_segment", "name_then_nearest", "complaint_labels",
    "crash_allocation", "closure_flags", "label_profile", "static_features", "season_statistics", "capped_sample",
    "relevance_grades", "average_precision", "calibrated_scores", "forecast_summary", "hourly_scenario", "day_night_pairs",
    "status_counts", "route_risk", "stitched_edges", "safest_routes", "closure_text", "location_text", "geojson_midpoints",
    "feed_latest_stream", "probability_updates", "feed_snapshot_compacted", "merged_passes", "highest_risk_by_day",
]
NO_PAIRING = ["closure_segment_pairs", "conditions_bbox", "segments_near", "complaint_labels", "crash_allocation", "closure_flags",
              "storm_labels", "route_segments", "calibrated_scores", "storm_ranking_metrics"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = oracle_sql()
    return lambda name: con.execute(sql[name]).df()


@pytest.mark.parametrize("name", COMPARED)
def test_same_as_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle(name)
    assert sorted(got.columns) == sorted(want.columns)
    assert _texts(got) == _texts(want)
    for c in got.columns:
        assert pd.api.types.is_numeric_dtype(got[c]) == pd.api.types.is_numeric_dtype(want[c])


@pytest.mark.parametrize("name", NO_PAIRING)
def test_plans_pair_nothing_blindly(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["segments_near"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan and "s_acctbal" not in plan
    plan = QUERIES["prediction_status"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_returnflag" not in plan


def test_every_query_has_sql_or_is_a_model():
    assert set(QUERIES) - set(SQL) == {"gbt_scores", "feature_importance"}
    assert set(SQL) <= set(QUERIES)


def test_projections_take_whole_tables(spark):
    for name, text in FIXTURES.items():
        assert " limit " not in text.lower(), name
    for name, table in {"fx_plow": "lineitem", "fx_closures": "orders", "fx_crashes": "orders", "fx_feed": "events"}.items():
        assert projection(spark, SF, name).count() == spark.read.parquet(f"{SF}/{table}.parquet").count(), name


def test_nothing_is_joined_to_the_unfolded_grid(spark):
    plan = QUERIES["storm_labels"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Union")]
    assert "Join" not in above
