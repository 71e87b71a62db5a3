"""Plan shape: no cartesian or nested-loop joins in the headline queries, and
the slice filter reaches the Parquet scan."""

import pytest

from swellcast.plans.queries import QUERIES, load_all

from conftest import SF_SMALL

load_all()

HEADLINE = ["m14_block_benchmark", "p19_preprocess", "a1_hourly_mean", "w4_target_summary", "w13_sliding_pairs",
            "j7_sliding_folds", "j9_context_rows", "m10_cv_naive", "m11_grid_search", "m15_expanding_blocks",
            "d2_mann_kendall", "d10_seasonality", "d5_white_test", "e8_run_tree", "p8_day_slice", "e3_experiment_name"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name


def test_slice_pushed_to_scan(spark):
    plan = _plan(QUERIES["p6_date_slice"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan or "GreaterThanOrEqual(ts" in plan
    assert "LessThan(ts" in plan


@pytest.mark.parametrize("name", HEADLINE)
def test_plans_reach_the_scan(spark, name):
    """Queries are lazy: nothing is cut off by a checkpoint on the way to Parquet."""
    plan = _plan(QUERIES[name](spark, SF_SMALL)).replace("ExistingRDD[trial_id", "")  # the small trial table
    assert "ExistingRDD" not in plan and "parquet" in plan


def test_unused_columns_are_not_read(spark):
    plan = _plan(QUERIES["p9_target_split"](spark, SF_SMALL))
    assert "ReadSchema" in plan and "props" not in plan and "user_id" not in plan


@pytest.mark.parametrize("one,many", [("p15_standard_scale", "m6_transform_pipelines"), ("m18_deseasonalize", "m18_deseasonalize")])
def test_reads_do_not_grow_with_columns(spark, one, many):
    reads = [_plan(QUERIES[n](spark, SF_SMALL)).split("Initial Plan")[0].count("Scan parquet") for n in (one, many)]
    assert reads[1] <= reads[0]


@pytest.mark.parametrize("name", ["d2_mann_kendall", "d3_prewhitened_mk", "d4_seasonal_mk"])
def test_trend_tests_read_their_input_a_few_times(spark, name):
    """Bounds (asked for by both passes, run once), chunks and buckets;
    pre-whitening joins the series with itself."""
    from swellcast.plans import bases, q_diag
    one = _plan(q_diag.filled_long(spark, SF_SMALL)).split("Initial Plan")[0].count("Scan parquet")
    rows = 1 if name != "d3_prewhitened_mk" else 5  # the series, the one before, its mean and the deviations of both
    assert _plan(QUERIES[name](spark, SF_SMALL)).split("Initial Plan")[0].count("Scan parquet") <= 4 * rows * one


def test_building_a_trend_test_runs_no_job(spark):
    """But for the one that reads the schema of the given table."""
    tracker, names = spark.sparkContext.statusTracker(), ("d2_mann_kendall", "d3_prewhitened_mk", "d4_seasonal_mk", "d2_trend_test")
    before = len(tracker.getJobIdsForGroup(None))
    for name in names:
        QUERIES[name](spark, SF_SMALL)
    assert len(tracker.getJobIdsForGroup(None)) <= before + len(names)


def test_folds_end_before_the_hold_out(spark):
    from pyspark.sql import functions as F
    from swellcast.operators.blocks import series_length, sliding_folds
    from swellcast.plans import bases
    from swellcast.plans.q_forecast import TEST_SIZE
    from swellcast.plans.q_windows import FOLD_H, FOLD_S, FOLD_W
    n = series_length(bases.met_hourly(spark, SF_SMALL).select("series_id", "idx"))
    last = sliding_folds(bases.targets_train(spark, SF_SMALL), FOLD_W, FOLD_H, FOLD_S).groupBy("series_id").agg(F.max("idx").alias("last"))
    assert last.join(n, "series_id").where(F.col("last") >= F.col("n_rows") - TEST_SIZE).count() == 0
